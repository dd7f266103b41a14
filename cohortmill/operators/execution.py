"""What a workflow's trace says of each unit: the state of its stages, what failed and whether it came to an end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

# A trace names a task by its process and, in brackets, its unit; states of tasks that did not end well; exits that are none.
TASK = r"(?:^|:)([A-Z_]+)\s+\(([^()]*)\)\s*$"
BROKEN = ("FAILED", "ABORTED", "KILLED")
NO_ERROR = ("0", "-", "")
ENDED = ("completed", "cached")


def task(name: str | Column) -> Column:
    """(process, unit) of a task's name; null where the name has no such form."""
    parts = F.struct(F.regexp_extract(name, TASK, 1).alias("process"), F.regexp_extract(name, TASK, 2).alias("unit"))
    return F.when(V.col(name).rlike(TASK), parts)


def tasks(trace: DataFrame, stages: dict[str, str], name: str = "name", status: str = "status", exit_code: str = "exit", order: str = "task_id") -> DataFrame:
    """unit, process, stage, state (failed, cached, completed, unfinished), exit, order of the trace's rows whose process is one of
    ``stages``. A nonzero exit is a failure unless the task was cached; a null status is unfinished."""
    said = F.upper(F.coalesce(F.col(status), F.lit("UNKNOWN")))
    bad = said.isin(*BROKEN) | (~F.coalesce(F.col(exit_code), F.lit("")).isin(*NO_ERROR) & (said != "CACHED"))
    state = V.ladder([(bad, "failed"), (said == "CACHED", "cached"), (said == "COMPLETED", "completed")], "unfinished")
    stage_of = F.create_map(*(F.lit(x) for pair in stages.items() for x in pair))
    out = trace.select(task(name).alias("t"), state.alias("state"), F.col(exit_code).alias("exit"), F.col(order).alias("order"))
    return out.select("t.unit", "t.process", F.try_element_at(stage_of, F.col("t.process")).alias("stage"), "state", "exit", "order").where("stage is not null")


def unit_states(units: DataFrame, tasks: DataFrame, unit: str, stages: dict[str, str], last: str, counted: str | None = None, published: DataFrame | None = None, traced: bool = True) -> DataFrame:
    """A row for each of ``units``: <stage>_status of every stage (that of its latest task, or not_run), failed_tasks (processes, in
    order), n_tasks, execution_status and, with ``published`` (unit, n), n_published.

    execution_status: failed where any task failed; completed where the stage ``last`` ended well; incomplete; without tasks not_run,
    or unknown where there is no trace (``traced`` false). Published numbers count only where the stage ``counted`` ended well in
    this trace, so that an old file says nothing; a number of zero makes completed into completed_zero. One aggregate per unit; no list longer than the stages.
    """
    names = list(dict.fromkeys(stages.values()))
    failed = F.col("state") == "failed"
    each = [F.max_by("state", F.when(F.col("stage") == s, F.col("order"))).alias(f"{s}_status") for s in names]
    g = tasks.groupBy(F.col("unit").alias(unit)).agg(*each, F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("process")))), ";").alias("failed_tasks"), F.count("*").alias("n_tasks"))
    out = units.select(F.col(unit).cast("string").alias(unit)).distinct().hint("shuffle_merge").join(g, unit, "left").na.fill(0, ["n_tasks"])
    out = out.na.fill("not_run", [f"{s}_status" for s in names]).na.fill("", ["failed_tasks"])
    status = V.ladder([(F.col("failed_tasks") != "", "failed"), (F.col(f"{last}_status").isin(*ENDED), "completed"), (F.col("n_tasks") > 0, "incomplete")], "not_run" if traced else "unknown")
    out = out.withColumn("execution_status", status)
    if published is None:
        return out
    known = published.groupBy(F.col(unit).cast("string").alias(unit)).agg(F.max("n").alias("_n"))
    out = out.hint("shuffle_merge").join(known, unit, "left").withColumn("n_published", F.when(F.col(f"{counted}_status").isin(*ENDED), F.col("_n"))).drop("_n")
    zero = (F.col("execution_status") == "completed") & (F.col("n_published") == 0)
    return out.withColumn("execution_status", F.when(zero, "completed_zero").otherwise(F.col("execution_status")))


def strangers(units: DataFrame, tasks: DataFrame, unit: str) -> DataFrame:
    """unit, n_tasks of tasks whose unit is none of ``units``: the trace belongs to other inputs."""
    own = units.select(F.col(unit).cast("string").alias(unit)).distinct()
    return tasks.groupBy(F.col("unit").alias(unit)).agg(F.count("*").alias("n_tasks")).hint("shuffle_merge").join(own, unit, "left_anti")
