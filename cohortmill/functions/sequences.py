"""Row-level expressions on sequences and half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import col

# IUPAC letters and their complements.
BASES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
PAIRED = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(col(seq), BASES, PAIRED))


def canonical(seq: str | Column) -> Column:
    """The smaller of a sequence and its reverse complement: the same for both strands."""
    return F.least(col(seq), reverse_complement(seq))


def hash_id(prefix: str, *parts: str | Column, n: int = 16) -> Column:
    """A stable id from content: prefix and the first n hex digits of SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("~", *(col(p).cast("string") for p in parts)), 256), 1, n))


def letters(seq: str | Column, which: str) -> Column:
    """How many characters are one of ``which``."""
    return F.length(col(seq)) - F.length(F.translate(col(seq), which, ""))


def gc_fraction(seq: str | Column) -> Column:
    return letters(seq, "gcGC") / F.nullif(letters(seq, "acgtACGT"), F.lit(0))


def entropy(seq: str | Column, alphabet: str = "acgt") -> Column:
    """Shannon entropy in bits over the alphabet; null for an empty sequence."""
    n = F.nullif(F.length(col(seq)), F.lit(0)).cast("double")
    out = F.lit(0.0)
    for x in alphabet:
        p = letters(seq, x) / n
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(F.when(p.isNotNull(), 0.0))
    return out


def kmers(seq: str | Column, k: int, stride: int = 1) -> Column:
    """Array of the windows of k letters. Windows side by side are cut by a pattern in one pass; others by position, which
    takes a pass for each."""
    s = col(seq)
    if stride == k:
        return F.coalesce(F.regexp_extract_all(s, F.lit(f"([\\s\\S]{{{k}}})"), F.lit(1)), F.array().cast("array<string>"))
    last = F.length(s) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: s.substr(i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """identical, nested, overlap, adjacent or disjoint."""
    nested = ((a0 <= b0) & (a1 >= b1)) | ((b0 <= a0) & (b1 >= a1))
    return (
        F.when((a0 == b0) & (a1 == b1), "identical").when(nested, "nested").when((a0 < b1) & (b0 < a1), "overlap")
        .when((a1 == b0) | (b1 == a0), "adjacent").otherwise("disjoint")
    )


def closed_to_half_open(start: Column, stop: Column) -> tuple[Column, Column]:
    """1-based closed coordinates, possibly reversed, to 0-based half-open ones."""
    return F.least(start, stop) - 1, F.greatest(start, stop)


def boundary_distance(start: Column, stop: Column, outer_start: Column, outer_stop: Column) -> Column:
    return F.least(start - outer_start, outer_stop - stop)


def translate_codons(seq: str | Column, table: dict[str, str]) -> Column:
    """Amino acids of the whole codons from the first letter on; X for codons outside the table."""
    s = col(seq)
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(kmers(s, 3, 3), lambda codon: F.coalesce(F.element_at(lookup, codon), F.lit("X"))), "")


def standard_code(first: str = "tcag") -> dict[str, str]:
    """The standard genetic code, in the usual order of bases t, c, a, g."""
    amino = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    return {a + b + c: amino[16 * i + 4 * j + k] for i, a in enumerate(first) for j, b in enumerate(first) for k, c in enumerate(first)}


def coding_fault(seq: str | Column, table: dict[str, str]) -> Column:
    """Why a coding sequence is none: empty, length (no multiple of three), letters (others than a, c, g, t), inner_stop (a stop
    codon before the last one); else empty."""
    s = col(seq)
    inner = F.regexp_replace(translate_codons(s, table), r"\*$", "")
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, "empty").when(F.length(s) % 3 != 0, "length").when(s.rlike("[^acgt]"), "letters").when(F.instr(inner, "*") > 0, "inner_stop").otherwise("")


def coding_protein(seq: str | Column, at_edge: Column, table: dict[str, str]) -> Column:
    """The protein of a coding sequence: its first codon is read as M whatever it is, unless the sequence begins ``at_edge`` of its
    contig; a stop at the end is left out."""
    p = translate_codons(seq, table)
    started = F.when(F.coalesce(at_edge, F.lit(False)) | (F.length(p) == 0), p).otherwise(F.concat(F.lit("M"), F.substring(p, 2, 1 << 30)))
    return F.regexp_replace(started, r"\*$", "")


def locate_in(part: str | Column, parent: str | Column) -> tuple[Column, Column]:
    """(0-based place of a slice in its parent, status): unique, ambiguous (a second place, also one that overlaps the first),
    absent, or unknown where either is null or the slice is empty. The place is null unless it is unique."""
    a, b = col(part), col(parent)
    first = F.instr(b, a)
    second = F.instr(F.substring(b, first + 1, F.length(b)), a)
    status = F.when(a.isNull() | b.isNull() | (a == ""), "unknown").when(first == 0, "absent").when(second > 0, "ambiguous").otherwise("unique")
    return F.when(status == "unique", first - 1), status


def verify_slices(occurrences: DataFrame, parents: DataFrame, key: str, seq: str, stored: str) -> DataFrame:
    """Adds ``same``: whether start0 to end0 of the parent, reverse-complemented on '-', has the stored SHA-256; null without a
    parent."""
    known = parents.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    both = occurrences.hint("shuffle_merge").join(known, F.col(key) == F.col("_key"), "left")
    cut = F.col("_seq").substr((F.col("start0") + 1).cast("int"), (F.col("end0") - F.col("start0")).cast("int"))
    return both.withColumn("same", F.sha2(F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut), 256) == F.col(stored)).drop("_key", "_seq")
