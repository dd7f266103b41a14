"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(text, low=False):
    found = WORD.findall(text or "")
    return [lower(w) for w in found] if low else found


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, k, num, den):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)]."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def lines(docs):
    """{doc_id: (n_lines, n_dropped, kept text)}."""
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[line_key(x)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(line_key(x)) < 10 or len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def measures(text):
    x = text or ""
    w = words(x)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), again, len(cover)


def sentences(text):
    out, last = [], None
    for m in WORD.finditer(text):
        if last is None or text[last.end() - 1] in ".!?" or "\n" in text[last.end() : m.start()]:
            out.append([])
        out[-1].append(m)
        last = m
    return out


def spans(docs, span=2, least=12):
    """{doc_id: kept text} of the documents that lose sentences."""
    held, owner = {}, {}
    for i, t in sorted((i, t or "") for i, t in docs):
        s = sentences(t)
        low = [tuple(lower(m[0]) for m in x) for x in s]
        held[i] = (t, s, [(j, tuple(low[j : j + span])) for j in range(len(s) - span + 1) if sum(map(len, low[j : j + span])) >= least])
        for j, g in held[i][2]:
            owner.setdefault(g, (i, j))
    out = {}
    for i, (t, s, found) in held.items():
        gone = {j + k for j, g in found if owner[g] != (i, j) for k in range(span)}
        if gone:
            cuts = [x[0].start() for x in s] + [len(t)]
            out[i] = t[: cuts[0]] + "".join(t[cuts[j] : cuts[j + 1]] for j in range(len(s)) if j not in gone)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality_votes(text):
    """1 good, 0 bad, None abstains, rule by rule."""
    x = text or ""
    w, lines = words(x), [v for v in x.split("\n") if WORD.search(v)]
    n, chars, symbols, again, repeats = measures(x)
    stops, long = sum(v[-1] in ".!?" for v in w), sum(len(v.encode()) > 40 for v in w)
    size = max(n, 1)
    bad = lambda cond: 0 if cond else None
    return [
        bad(n < 10), bad(symbols >= 0.10 * size), bad(repeats > 0.20 * size), bad(again >= 0.30 * max(len(lines), 1) and again >= 2), bad(abs(chars / size - 5.5) > 4.0), bad(long >= 0.05 * size),
        1 if stops / size >= 0.03 else bad(stops / size < 0.005),
    ]


def posteriors(votes, rounds=200, precision=0.9, good=0.85):
    """EM document by document: the chance that each is good, from what the rules say of it."""
    n, rules, kinds = len(votes), len(votes[0]), (0, 1, None)
    share = [{k: sum(v[r] is k for v in votes) + 0.5 for k in kinds} for r in range(rules)]
    believed = {0: {0: precision, 1: 1 - precision, None: 1 - good}, 1: {0: 1 - precision, 1: precision, None: good}}
    start, strength = {0: 1 - good, 1: good}, 0.5 * n + 10
    prior = {}
    for c in (0, 1):
        for r in range(rules):
            raw = {k: share[r][k] / sum(share[r].values()) * believed[c][k] / start[c] for k in kinds}
            prior[c, r] = {k: x / sum(raw.values()) for k, x in raw.items()}
    theta, balance = dict(prior), dict(start)
    post = [0.5] * n
    for _ in range(rounds):
        new = []
        for v in votes:
            like = {c: balance[c] * math.prod(theta[c, r][v[r]] for r in range(rules)) for c in (0, 1)}
            new.append(like[1] / (like[0] + like[1]))
        change, post = sum(abs(a - b) for a, b in zip(new, post)), new
        weight = {0: [1 - p for p in post], 1: post}
        for c in (0, 1):
            total = sum(weight[c]) + strength * start[c]
            for r in range(rules):
                theta[c, r] = {k: (sum(w for w, v in zip(weight[c], votes) if v[r] is k) + strength * start[c] * prior[c, r][k]) / total for k in kinds}
        balance = {c: (sum(weight[c]) + strength * start[c]) / (n + strength) for c in (0, 1)}
        if change < 1e-9 * n:
            break
    return post
