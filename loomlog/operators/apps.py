"""Application-level tables: meta data, environment, executors, cluster, jobs, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog import schema as S
from loomlog.functions.scalars import safe_pct, spark_version
from loomlog.operators.scan import FAN_BITS, TIME_BITS, carried
from loomlog.sources.events import JobLog
from loomlog.spread import hot_join, many

APP = ["app_key"]


def app_events(log: JobLog) -> DataFrame:
    """Last start and end record per application; the log-start version is kept apart."""
    def at(kind: str):
        return F.when(F.col("kind") == kind, F.col("seq"))

    return log.app_events.groupBy("app_key").agg(
        F.max_by(F.struct("app_id", "app_name", "spark_version", "ts_ms"), at("start")).alias("s"),
        F.max_by("ts_ms", at("end")).alias("end_ms"),
        F.max_by(
            "spark_version",
            F.when((F.col("kind") == "log") & F.col("spark_version").isNotNull(), F.col("seq")),
        ).alias("log_version"),
    )


def app_meta(log: JobLog) -> DataFrame:
    """Identity, times, version, executor count, first resource profile, SQL count."""
    last_env = log.env_events.groupBy("app_key").agg(
        F.max_by(F.col("props")["spark.version"], "seq").alias("prop_version")
    )
    profile_columns = ["memory_mb", "overhead_mb", "offheap_mb", "cores"]
    first_profile = (
        log.profiles.groupBy("app_key")
        .agg(F.min_by(F.struct(*profile_columns), "seq").alias("p"))
        .select("app_key", *(F.col(f"p.{c}").alias(f"executor_{c}") for c in profile_columns))
    )
    added = (
        log.executor_events.filter(F.col("kind") == "add")
        .groupBy("app_key")
        .agg(F.count(F.lit(1)).alias("executor_count"))
    )
    sql_counts = log.sql_starts.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("sql_execution_count"),
        F.count_if(F.col("plan_json").isNotNull()).alias("n_plans"),
    )
    meta = log.apps
    for side in (app_events(log), last_env, first_profile, added, sql_counts):
        meta = meta.join(side, "app_key", "left")
    counts = [
        "executor_memory_mb",
        "executor_overhead_mb",
        "executor_offheap_mb",
        "executor_cores",
        "executor_count",
        "sql_execution_count",
        "n_plans",
    ]
    return meta.select(
        "app_key",
        F.coalesce("s.app_id", F.lit("unknown")).alias("app_id"),
        F.coalesce("s.app_name", F.lit("unknown")).alias("app_name"),
        spark_version("s.spark_version", "prop_version").alias("spark_version"),
        F.coalesce("log_version", F.lit("unknown")).alias("log_version"),
        F.coalesce("s.ts_ms", F.lit(0)).alias("start_ms"),
        F.coalesce("end_ms", F.lit(0)).alias("end_ms"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
    ).withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))


def first_plans(log: JobLog) -> DataFrame:
    """The first SQL plan of each application."""
    plans = log.sql_starts.filter(F.col("plan_json").isNotNull())
    return plans.groupBy("app_key").agg(F.min_by("plan_json", "seq").alias("plan_json"))


def env_settings(env_events: DataFrame) -> DataFrame:
    """Last value of each reported configuration key over all environment events."""
    kept = env_events.select(
        "app_key", "seq", F.explode(F.map_filter("props", lambda k, v: k.isin(*S.ENV_KEYS)))
    )
    return kept.groupBy("app_key", "key").agg(F.max_by("value", "seq").alias("value"))


def env_maps(env_events: DataFrame) -> DataFrame:
    """``env_settings`` as one map per application (at most one entry per reported key)."""
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return env_settings(env_events).groupBy("app_key").agg(
        F.map_from_entries(entries).alias("environment")
    )


def executor_dim(log: JobLog) -> DataFrame:
    """One row per executor: start, end (the application's where still running), cores, host."""
    def at(kind: str):
        return F.when(F.col("kind") == kind, F.col("seq"))

    spans = log.executor_events.groupBy("app_key", "executor_id").agg(
        F.min("seq").alias("first_seq"),
        F.max_by(F.struct("ts_ms", "host", "cores", "seq"), at("add")).alias("a"),
        F.max_by(F.struct("ts_ms", "seq"), at("remove")).alias("r"),
        F.min_by("ts_ms", at("remove")).alias("first_removed_ms"),
    )
    closed = F.col("a").isNull() | (F.col("r.seq") > F.col("a.seq"))
    ends = app_events(log).select("app_key", F.col("end_ms").alias("app_end_ms"))
    return hot_join(spans, ends, APP, ["executor_id"]).select(
        "app_key",
        "executor_id",
        "first_seq",
        F.coalesce("a.host", F.lit("unknown")).alias("host"),
        F.coalesce("a.cores", F.lit(0)).alias("cores"),
        F.coalesce("a.ts_ms", "first_removed_ms").alias("start_ms"),
        F.coalesce(
            F.nullif(F.when(closed, F.col("r.ts_ms")), F.lit(0)), "app_end_ms", F.lit(0)
        ).alias("end_ms"),
    )


def peak_concurrency(
    ticks: DataFrame,
    keys: list[str],
    ts: str = "ts_ms",
    bits: int = TIME_BITS,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """Peak of a counter that goes +1 on ``add`` and -1 on ``remove`` but never below 0.

    Additions come before removals at the same time. With S the unclamped running sum the
    clamped counter is ``S - min(0, lowest S so far)``. Events are first folded per time
    stamp; sum and lowest sum are carried over ranges of time (``scan.carried``).
    """
    folded = (
        ticks.groupBy(*keys, F.col(ts).alias("_t"))
        .agg(
            F.count_if(F.col("kind") == "add").alias("_up"),
            F.count_if(F.col("kind") == "remove").alias("_down"),
        )
        .withColumn("_net", F.col("_up") - F.col("_down"))
        .withColumn("_dip", F.col("_net"))
    )
    scanned = carried(folded, keys, "_t", {"_net": "sum", "_dip": "low:_net"}, bits, fan_bits)
    lowest = F.least(F.lit(0), F.col("_dip_before"))
    # A pure removal lowers the counter, so it can never set the peak.
    level = F.when(F.col("_up") > 0, F.col("_net_before") + F.col("_up") - lowest).otherwise(F.lit(0))
    return scanned.groupBy(*keys).agg(F.max(level).alias("peak"))


def cluster_capacity(log: JobLog, executors: DataFrame | None = None) -> DataFrame:
    """Peak executors, cores and available core time per application."""
    executors = executor_dim(log) if executors is None else executors
    registered = executors.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("n_registered"),
        F.min_by("cores", F.when(F.col("cores") > 0, F.col("first_seq"))).alias("fallback_cores"),
    )
    cluster = (
        app_meta(log)
        .join(registered, "app_key", "left")
        .join(peak_concurrency(log.executor_events, APP), "app_key", "left")
        .select(
            "app_key",
            "duration_ms",
            F.coalesce(F.nullif("peak", F.lit(0)), "n_registered", F.lit(0)).alias(
                "peak_executors"
            ),
            F.coalesce(
                F.nullif("executor_cores", F.lit(0)), F.nullif("fallback_cores", F.lit(0)), F.lit(1)
            )
            .cast("bigint")
            .alias("cores_per_executor"),
            F.col("executor_memory_mb").alias("memory_mb"),
            F.col("executor_overhead_mb").alias("overhead_mb"),
        )
        .withColumn("total_cores", F.col("peak_executors") * F.col("cores_per_executor"))
    )
    lived = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    # Executors that name no cores count with the default, which is known per application.
    alive = executors.groupBy("app_key").agg(
        F.sum(lived * F.col("cores")).alias("_own_core_ms"),
        F.sum(F.when(F.col("cores") == 0, lived).otherwise(0)).alias("_coreless_ms"),
    )
    own = F.coalesce("_own_core_ms", F.lit(0)) + F.coalesce(
        "_coreless_ms", F.lit(0)
    ) * F.col("cores_per_executor")
    return (
        cluster.join(alive, "app_key", "left")
        .withColumn(
            "available_core_ms",
            F.when(own > 0, own).otherwise(F.col("duration_ms") * F.col("total_cores")),
        )
        .drop("_own_core_ms", "_coreless_ms")
    )


def cluster_report(cluster: DataFrame, stages: DataFrame) -> DataFrame:
    """Cluster capacity with used core time and utilization."""
    used = stages.groupBy("app_key").agg(F.sum("run_ms").alias("used_core_ms"))
    joined = cluster.join(used, "app_key", "left").withColumn(
        "used_core_ms", F.coalesce("used_core_ms", F.lit(0))
    )
    return joined.select(
        "*",
        (F.col("available_core_ms") / 3_600_000.0).alias("available_core_hours"),
        (F.col("used_core_ms") / 3_600_000.0).alias("used_core_hours"),
        safe_pct("used_core_ms", "available_core_ms").alias("utilization_pct"),
    )


def jobs(log: JobLog) -> DataFrame:
    """One row per job: its last start and the last end that followed; ids sorted, distinct."""
    starts = log.job_starts.groupBy("app_key", "job_id").agg(
        F.max_by(F.struct("start_ms", "stage_infos", "seq"), "seq").alias("s")
    )
    ends = log.job_ends.groupBy("app_key", "job_id").agg(
        F.max_by(F.struct("end_ms", "seq"), "seq").alias("e")
    )
    joined = starts.join(many(ends), ["app_key", "job_id"], "left")
    end = F.when(F.col("e.seq") > F.col("s.seq"), F.col("e.end_ms"))
    return joined.select(
        "app_key",
        "job_id",
        F.col("s.start_ms").alias("start_ms"),
        F.coalesce(end, F.lit(0)).alias("end_ms"),
        F.array_sort(
            F.array_distinct(F.transform("s.stage_infos", lambda x: x["stage_id"]))
        ).alias("stage_ids"),
    ).withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))


def job_stages(job_rows: DataFrame) -> DataFrame:
    """``app_key, job_id, stage_id``: the distinct stages of each job."""
    return job_rows.select("app_key", "job_id", F.explode("stage_ids").alias("stage_id"))


def job_totals(job_rows: DataFrame) -> DataFrame:
    return job_rows.groupBy("app_key").agg(F.sum("duration_ms").alias("job_ms"))


def driver_idle(meta: DataFrame, job_rows: DataFrame) -> DataFrame:
    """Share of the application's time that no job accounts for."""
    joined = meta.select("app_key", "duration_ms").join(job_totals(job_rows), "app_key", "left")
    idle = F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("job_ms", F.lit(0)))
    return joined.select(
        "app_key",
        "duration_ms",
        F.coalesce("job_ms", F.lit(0)).alias("job_ms"),
        idle.alias("idle_ms"),
        safe_pct(idle, "duration_ms").alias("driver_idle_pct"),
    )


def app_summary(log: JobLog, stage_rows: DataFrame) -> DataFrame:
    """Application totals over its stage rows; here the duration is not clamped."""
    totals = stage_rows.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("num_stages"),
        *(
            F.sum(c).alias(name)
            for c, name in {
                "num_tasks": "num_tasks",
                "input_bytes": "total_input_bytes",
                "output_bytes": "total_output_bytes",
                "shuffle_read_bytes": "total_shuffle_read_bytes",
                "shuffle_write_bytes": "total_shuffle_write_bytes",
            }.items()
        ),
    )
    names = [c for c in totals.columns if c != "app_key"]
    return (
        app_meta(log)
        .withColumn("total_duration_ms", F.col("end_ms") - F.col("start_ms"))
        .drop("duration_ms")
        .join(totals, "app_key", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    )
