"""The stage table of the metric report: every known stage with its accepted-task measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.scalars import safe_pct, safe_ratio, stage_name, whole_div
from loomlog.operators.attempts import KEYS, mark_tasks, stage_state
from loomlog.operators.ranks import WINDOW_ROWS
from loomlog.operators.rollups import stage_medians, stage_tasks_accepted
from loomlog.session import materialize
from loomlog.sources.events import JobLog
from loomlog.spread import hot_join, many


def listed_stages(log: JobLog) -> DataFrame:
    """One row per (job start, stage it lists), with the list position."""
    return log.job_starts.select(
        "app_key", "seq", "job_id", F.posexplode("stage_infos").alias("pos", "info")
    ).select("app_key", "seq", "job_id", "pos", "info.stage_id", "info.num_tasks")


def stage_jobs(log: JobLog) -> DataFrame:
    """Owning job of each stage: the last job start that lists it."""
    return listed_stages(log).groupBy(*KEYS).agg(F.max_by("job_id", "seq").alias("job_id"))


def announced_stages(log: JobLog) -> DataFrame:
    """One row per stage that a job start or stage event names, from one pass over both.

    ``seen`` is where it first appeared, with the list place for equal positions;
    ``num_tasks`` the last announced size and ``job_id`` the last job start that lists it.
    """
    from_jobs = listed_stages(log).select(*KEYS, "seq", "pos", "job_id", "num_tasks")
    from_events = log.stage_events.select(
        *KEYS,
        "seq",
        F.lit(0).alias("pos"),
        F.lit(None).cast("bigint").alias("job_id"),
        "num_tasks",
    )

    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    return from_jobs.unionByName(from_events).groupBy(*KEYS).agg(
        F.min(F.struct("seq", "pos")).alias("seen"), last("num_tasks"), last("job_id")
    )


def unreported_stages(log: JobLog) -> DataFrame:
    """Stages known from job or stage events for which no task ever ended."""
    known = (
        listed_stages(log).select(*KEYS).unionByName(log.stage_events.select(*KEYS)).distinct()
    )
    return known.join(many(log.tasks.select(*KEYS).distinct()), KEYS, "left_anti")


def stage_table(log: JobLog) -> DataFrame:
    """One row per stage from any source, with accepted-task sums, envelope and wall time.

    The envelope starts from the last event that set a time and is widened by the accepted
    tasks that ended after it. 0 means unknown.
    """
    # Three joins read the state; written out, it is computed once and its size is known.
    state = materialize(stage_state(log.stage_events), "state")
    marked = mark_tasks(log.tasks, state, keep_salt=True, hot_rows=WINDOW_ROWS)
    rollup = stage_tasks_accepted(marked)
    known = announced_stages(log).join(many(state.drop("steps")), KEYS, "left")
    rows = known.join(rollup, KEYS, "full_outer").join(many(stage_medians(marked)), KEYS, "left")
    start = F.coalesce(F.least("start_event_ms", "task_start_ms"), F.lit(0))
    end = F.coalesce(F.greatest("end_event_ms", "task_end_ms"), F.lit(0))
    sums = [c for c in rollup.columns if c not in (*KEYS, "task_start_ms", "task_end_ms")]
    sums.remove("first_task_seq")
    first_task = F.struct(F.col("first_task_seq").alias("seq"), F.lit(0).alias("pos"))
    return rows.select(
        *KEYS,
        F.coalesce("job_id", F.lit(-1)).cast("bigint").alias("job_id"),
        stage_name("stage_name").alias("stage_name"),
        F.coalesce("num_tasks", F.lit(0)).alias("num_tasks"),
        F.coalesce("parent_ids", F.array().cast("array<bigint>")).alias("parent_ids"),
        F.least("seen", F.when(F.col("first_task_seq").isNotNull(), first_task)).alias("seen"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        F.when((start > 0) & (end > 0), F.greatest(F.lit(0), end - start))
        .otherwise(F.lit(0))
        .alias("wall_ms"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in sums),
        F.coalesce("median_task_ms", F.lit(0)).alias("median_task_ms"),
    )


def with_app_totals(stages: DataFrame, cluster: DataFrame) -> DataFrame:
    """Adds the application columns every derived measure needs.

    Applications may differ in their number of stages by orders of magnitude, so the join
    is salted by stage.
    """
    totals = stages.groupBy("app_key").agg(
        F.sum("run_ms").alias("app_run_ms"), F.sum(_io_bytes()).alias("app_io_bytes")
    )
    dims = cluster.select("app_key", "total_cores", F.col("duration_ms").alias("app_ms")).join(
        totals, "app_key"
    )
    return hot_join(stages, dims, ["app_key"], ["stage_id"], "inner")


def _io_bytes():
    return (
        F.col("input_bytes")
        + F.col("output_bytes")
        + F.col("shuffle_read_bytes")
        + F.col("shuffle_write_bytes")
    )


def core_hours(rows: DataFrame) -> DataFrame:
    available = F.col("total_cores") * F.col("wall_ms")
    used = safe_pct("run_ms", available)
    return rows.select(
        "*",
        available.alias("available_ms"),
        used.alias("used_pct"),
        F.when(available > 0, F.greatest(F.lit(0.0), F.lit(100.0) - used))
        .otherwise(F.lit(0.0))
        .alias("wasted_pct"),
    )


def skew(rows: DataFrame) -> DataFrame:
    average = safe_ratio("run_ms", "n_accepted")
    return rows.select(
        "*",
        average.alias("avg_task_ms"),
        safe_ratio("max_task_ms", "median_task_ms").alias("task_skew"),
        safe_ratio("max_task_ms", average).alias("skew_avg_ratio"),
        safe_ratio("max_task_ms", "wall_ms").alias("stage_skew"),
        safe_ratio("num_tasks", "total_cores").alias("p_ratio"),
    )


def io(rows: DataFrame) -> DataFrame:
    taken = F.col("input_bytes") + F.col("shuffle_read_bytes")
    given = F.col("output_bytes") + F.col("shuffle_write_bytes")
    return rows.select(
        "*",
        taken.alias("input_total_bytes"),
        given.alias("output_total_bytes"),
        safe_ratio(given, taken).alias("oi_ratio"),
    )


def time_distribution(rows: DataFrame) -> DataFrame:
    run = F.col("run_ms")
    busy = run > 0
    return rows.select(
        "*",
        safe_pct("gc_ms", "run_ms").alias("gc_pct"),
        F.when(busy, F.col("sw_time_ns") * F.lit(100.0) / run / F.lit(1_000_000.0))
        .otherwise(F.lit(0.0))
        .alias("shuffle_write_pct"),
        safe_pct("fetch_wait_ms", "run_ms").alias("fetch_wait_pct"),
        F.when(busy, F.col("cpu_ns") * F.lit(100.0) / (run * F.lit(1_000_000.0)))
        .otherwise(F.lit(0.0))
        .alias("cpu_pct"),
    )


def shares(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        safe_pct("wall_ms", "app_ms").alias("wall_clock_pct"),
        safe_pct("run_ms", "app_run_ms").alias("task_runtime_pct"),
        safe_pct(_io_bytes(), "app_io_bytes").alias("io_pct"),
    )


def ideal_wall(rows: DataFrame) -> DataFrame:
    ideal = F.when(
        F.col("total_cores") > 0, whole_div("run_ms", "total_cores")
    ).otherwise(F.col("run_ms"))
    return rows.withColumn("ideal_wall_ms", ideal.cast("bigint"))


def stage_report(stages: DataFrame, cluster: DataFrame) -> DataFrame:
    """All derived stage measures in one row."""
    rows = with_app_totals(stages, cluster)
    for measure in (core_hours, skew, io, time_distribution, shares, ideal_wall):
        rows = measure(rows)
    return rows


def top_wall_stages(stages: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` longest stages per application, ties by first appearance.

    The rank filter lets Spark keep only ``k`` rows per application before the shuffle.
    """
    order = Window.partitionBy("app_key").orderBy(F.desc("wall_ms"), "seen", "stage_id")
    return stages.withColumn("wall_rank", F.row_number().over(order)).filter(
        F.col("wall_rank") <= k
    )
