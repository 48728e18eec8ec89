"""Stage attempt state: which tasks count, given the order of stage and task events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.spread import HOT_ROWS, hot_join

KEYS = ["app_key", "stage_id"]


def stage_state(stage_events: DataFrame) -> DataFrame:
    """One row per stage with everything its task rows have to be compared with.

    Running attempt numbers only ever rise, so the whole ordered rule needs four facts:
    the attempts with the positions where each began (``steps``), the position where
    the highest attempt began if another event came before (``reset_seq``), and the last
    positions that set the submission and completion time. Events are reduced to one row per
    attempt first: a later event of an attempt overtakes no task that its first did not, so
    ``steps`` is as long as a stage has attempts, whatever the number of its events.
    """
    submitted = F.when(F.col("submission_ms") > 0, F.col("seq"))
    completed = F.when(F.col("completion_ms") > 0, F.col("seq"))
    named = F.when(F.col("stage_name").isNotNull(), F.col("seq"))
    tries = stage_events.groupBy(*KEYS, "attempt_id").agg(
        F.min("seq").alias("seq"),
        F.max("seq").alias("last_seq"),
        F.max_by("submission_ms", submitted).alias("start_event_ms"),
        F.max(submitted).alias("start_seq"),
        F.max_by("completion_ms", completed).alias("end_event_ms"),
        F.max(completed).alias("end_seq"),
        F.max_by("stage_name", named).alias("stage_name"),
        F.max(named).alias("name_seq"),
        F.max_by("parent_ids", "seq").alias("parent_ids"),
    )
    # Equal attempts sort by -seq, so the largest pair is the first event of the last attempt.
    last_rise = -F.max(F.struct(F.col("attempt_id"), (-F.col("seq")).alias("s")))["s"]
    state = tries.groupBy(*KEYS).agg(
        F.max("attempt_id").alias("last_attempt"),
        F.min("seq").alias("first_seq"),
        last_rise.alias("rise_seq"),
        F.collect_list(F.struct("attempt_id", "seq")).alias("steps"),
        F.max_by("start_event_ms", "start_seq").alias("start_event_ms"),
        F.max("start_seq").alias("start_seq"),
        F.max_by("end_event_ms", "end_seq").alias("end_event_ms"),
        F.max("end_seq").alias("end_seq"),
        F.max_by("stage_name", "name_seq").alias("stage_name"),
        F.max_by("parent_ids", "last_seq").alias("parent_ids"),
    )
    return state.withColumn(
        "reset_seq", F.when(F.col("rise_seq") > F.col("first_seq"), F.col("rise_seq"))
    ).drop("rise_seq")


def mark_tasks(
    tasks: DataFrame, state: DataFrame, keep_salt: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds the verdicts of the ordered rule to every task row.

    ``stale``: a higher attempt had begun. ``kept``: not stale and after the last reset.
    ``accepted``: kept, not failed, not speculative. ``counted_on_host``: not stale, not
    failed, not speculative, wherever the reset lies.
    """
    dim = state.select(
        *KEYS, "steps", "reset_seq", "start_event_ms", "start_seq", "end_event_ms", "end_seq"
    )
    joined = hot_join(tasks, dim, KEYS, ["seq", "executor_id"], keep_salt=keep_salt, hot_rows=hot_rows)
    overtaken = F.exists(
        "steps",
        lambda s: (s["attempt_id"] > F.col("attempt_id")) & (s["seq"] < F.col("seq")),
    )
    good = ~F.col("failed") & ~F.col("speculative")
    return (
        joined.withColumn("stale", F.coalesce(overtaken, F.lit(False)))
        .withColumn(
            "kept",
            ~F.col("stale") & (F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))),
        )
        .withColumn("accepted", F.col("kept") & good)
        .withColumn("counted_on_host", ~F.col("stale") & good)
        .drop("steps")
    )
