"""From lines to events, and from events to typed fact tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog import schema as S
from loomlog.functions.scalars import whole

# Plans nest deeply and descriptions get long, so the reader's default limits are lifted.
JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "maxNestingDepth": "1000000",
    "maxStringLen": str(2**31 - 1),
}

# Event text repeats its names in every line; this codec takes about half of what snappy leaves, and
# its first level no more room than its third.
TEXT_CODEC = "zstd"
TEXT_OPTIONS = {"compression": TEXT_CODEC, "parquet.compression.codec.zstd.level": "1"}
LARGE_FACTS = ("tasks", "sql_starts")
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_TYPES = 24  # more than an event log has of types that are read


class JobLog(NamedTuple):
    """Fact tables of many applications, all keyed by ``app_key`` and ordered by ``seq``."""

    apps: DataFrame
    tasks: DataFrame
    stage_events: DataFrame
    job_starts: DataFrame
    job_ends: DataFrame
    executor_events: DataFrame
    app_events: DataFrame
    env_events: DataFrame
    profiles: DataFrame
    sql_starts: DataFrame


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once per row.

    A filter on a plain column would be pushed below its projection and parse the text again;
    no filter moves below a generator.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _heads(lines: DataFrame) -> DataFrame:
    """Adds ``_event``: the event name of the line, NULL where the line is no such record.

    The line is parsed as a field of an enclosing record. Text after its end then breaks the
    enclosing record, while a line parsed on its own would be accepted up to there.
    """
    boxed = F.concat(F.lit('{"r":'), F.col("line"), F.lit("}"))
    head = F.from_json(boxed, "r struct<Event:string>", JSON_OPTIONS)
    return _once(lines, head["r"]["Event"], "_event")


def parse_events(lines: DataFrame) -> DataFrame:
    """``app_key, seq, event_type, body`` of every line that is a record with an event name."""
    heads = _heads(lines).filter(F.col("_event").isNotNull())
    return heads.select(
        "app_key", "seq", F.col("_event").alias("event_type"), F.col("line").alias("body")
    )


def quarantine_events(lines: DataFrame) -> DataFrame:
    """The complement of ``parse_events``, with a reason per line."""
    heads = _heads(lines).filter(F.col("_event").isNull())
    # In an array, text after the record is an error as well, and a missing name is not.
    boxed = F.concat(F.lit("["), F.col("line"), F.lit("]"))
    array = F.from_json(boxed, "array<struct<Event:string>>", JSON_OPTIONS)
    is_record = F.col("line").startswith("{") & F.col("line").endswith("}") & (F.size(array) == 1)
    other_json = ~F.col("line").startswith("{") & F.expr("try_parse_json(line) is not null")
    reason = (
        F.when(is_record, "no_event_name")
        .when(other_json, "not_an_object")
        .otherwise("malformed_json")
    )
    return heads.withColumn("reason", reason).drop("_event")


def write_bronze(events: DataFrame, path: str) -> None:
    """Persist parsed events once, partitioned by type so that each reader prunes.

    A task keeps one file open for each type it meets. Otherwise Spark sorts its rows by type first,
    and whole lines, a dozen times as large as their files, do not fit in a task's memory. Should a
    task meet more types than ``OPEN_TYPES``, Spark sorts what is left of its rows.
    """
    conf = events.sparkSession.conf
    before = conf.get(WRITERS, None)
    conf.set(WRITERS, OPEN_TYPES)
    try:
        events.write.mode("overwrite").partitionBy("event_type").options(**TEXT_OPTIONS).parquet(path)
    finally:
        conf.unset(WRITERS) if before is None else conf.set(WRITERS, before)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("app_key", "seq", "event_type", "body")


def of_type(events: DataFrame, *event_types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*event_types))


def sql_start_events(events: DataFrame) -> DataFrame:
    """SQL starts carry a package prefix, so they are matched by suffix."""
    return events.filter(F.col("event_type").endswith(S.SQL_START_SUFFIX))


def _typed(events: DataFrame, ddl: str) -> DataFrame:
    record = F.from_json("body", ddl, JSON_OPTIONS)
    return _once(events, record, "r").drop("body")


def _kind(event_type: str, when_equal: str, otherwise: str) -> Column:
    return F.when(F.col("event_type") == event_type, when_equal).otherwise(otherwise).alias("kind")


def task_facts(events: DataFrame) -> DataFrame:
    """Flat task measurements; ids below 0 and tasks without a stage are ignored."""
    options = {**JSON_OPTIONS, "columnNameOfCorruptRecord": S.BAD}
    record = F.from_json("body", S.TASK_WHOLE_SCHEMA, options)
    r = _once(of_type(events, S.TASK_END), record, "r")
    # A record with anything else in place of a number is read again, leaf by leaf as text.
    text = F.from_json("body", f"{S.TASK_SCHEMA}, {S.BAD} string", options)
    mended = F.when(F.col(f"r.{S.BAD}").isNotNull(), text.try_cast(StructType.fromDDL(S.TASK_WHOLE_SCHEMA)))
    r = _once(r, F.coalesce(mended, "r"), "_r").select("app_key", "seq", F.col("_r").alias("r"))
    numbers = [whole(f"r.{path}").alias(name) for name, path in S.TASK_NUMBERS.items()]
    return r.filter(F.col("r.`Stage ID`") >= 0).select(
        "app_key",
        "seq",
        F.coalesce("r.`Task Info`.`Executor ID`", F.lit("")).alias("executor_id"),
        F.col("r.`Task Info`.Host").alias("host"),
        F.coalesce("r.`Task Info`.Failed", F.lit(False)).alias("failed"),
        F.coalesce("r.`Task Info`.Speculative", F.lit(False)).alias("speculative"),
        *numbers,
    )


def stage_event_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.STAGE_SUBMITTED, S.STAGE_COMPLETED), S.STAGE_SCHEMA)
    info = "r.`Stage Info`."
    return r.filter(F.col(f"{info}`Stage ID`").try_cast("bigint") >= 0).select(
        "app_key",
        "seq",
        _kind(S.STAGE_SUBMITTED, "submitted", "completed"),
        whole(f"{info}`Stage ID`").alias("stage_id"),
        whole(f"{info}`Stage Attempt ID`").alias("attempt_id"),
        F.col(f"{info}`Stage Name`").alias("stage_name"),
        F.col(f"{info}`Number of Tasks`").try_cast("bigint").alias("num_tasks"),
        F.coalesce(f"{info}`Parent IDs`", F.array().cast("array<bigint>")).alias("parent_ids"),
        whole(f"{info}`Submission Time`").alias("submission_ms"),
        whole(f"{info}`Completion Time`").alias("completion_ms"),
    )


def job_start_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.JOB_START), S.JOB_START_SCHEMA)
    infos = F.transform(
        F.coalesce("r.`Stage Infos`", F.array().cast("array<struct<`Stage ID`:string,`Number of Tasks`:string>>")),
        lambda x: F.struct(
            x["Stage ID"].try_cast("bigint").alias("stage_id"),
            x["Number of Tasks"].try_cast("bigint").alias("num_tasks"),
        ),
    )
    return r.filter(F.col("r.`Job ID`").try_cast("bigint") >= 0).select(
        "app_key",
        "seq",
        whole("r.`Job ID`").alias("job_id"),
        whole("r.`Submission Time`").alias("start_ms"),
        F.filter(infos, lambda x: x["stage_id"] >= 0).alias("stage_infos"),
    )


def job_end_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.JOB_END), S.JOB_END_SCHEMA)
    return r.filter(F.col("r.`Job ID`").try_cast("bigint") >= 0).select(
        "app_key",
        "seq",
        whole("r.`Job ID`").alias("job_id"),
        whole("r.`Completion Time`").alias("end_ms"),
    )


def executor_event_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.EXECUTOR_ADDED, S.EXECUTOR_REMOVED), S.EXECUTOR_SCHEMA)
    return r.select(
        "app_key",
        "seq",
        _kind(S.EXECUTOR_ADDED, "add", "remove"),
        F.coalesce("r.`Executor ID`", F.lit("")).alias("executor_id"),
        whole("r.Timestamp").alias("ts_ms"),
        F.coalesce("r.`Executor Info`.Host", F.lit("unknown")).alias("host"),
        whole("r.`Executor Info`.`Total Cores`").alias("cores"),
    )


def app_event_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.LOG_START, S.APP_START, S.APP_END), S.APP_SCHEMA)
    kind = (
        F.when(F.col("event_type") == S.LOG_START, "log")
        .when(F.col("event_type") == S.APP_START, "start")
        .otherwise("end")
    )
    return r.select(
        "app_key",
        "seq",
        kind.alias("kind"),
        F.col("r.`App ID`").alias("app_id"),
        F.col("r.`App Name`").alias("app_name"),
        F.col("r.`Spark Version`").alias("spark_version"),
        whole("r.Timestamp").alias("ts_ms"),
    )


def env_event_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.ENVIRONMENT), S.ENVIRONMENT_SCHEMA)
    return r.select(
        "app_key",
        "seq",
        F.coalesce("r.`Spark Properties`", F.create_map().cast("map<string,string>")).alias("props"),
    )


def profile_facts(events: DataFrame) -> DataFrame:
    r = _typed(of_type(events, S.RESOURCE_PROFILE), S.PROFILE_SCHEMA)
    amounts = {
        "cores": "cores",
        "memory": "memory_mb",
        "memoryOverhead": "overhead_mb",
        "offHeap": "offheap_mb",
    }
    return r.select(
        "app_key",
        "seq",
        *(
            whole(f"r.`Executor Resource Requests`.{key}.Amount").alias(name)
            for key, name in amounts.items()
        ),
    )


def sql_start_facts(events: DataFrame) -> DataFrame:
    """One row per SQL execution start; ``plan_json`` is NULL where no plan object came along.

    Copying out a nested object has a fixed depth limit in the JSON reader. A deeper plan
    keeps its whole record as ``plan_json``, which the plan walk understands.
    """
    starts = sql_start_events(events)
    both = _once(starts, F.from_json("body", S.SQL_PLAN_SCHEMA, JSON_OPTIONS), "r")
    # Where the plan could not be copied out, the other fields are read without it.
    alone = F.when(F.col("r.sparkPlanInfo").isNull(), F.from_json("body", S.SQL_START_SCHEMA, JSON_OPTIONS))
    both = _once(both, F.coalesce(alone, F.struct("r.executionId", "r.description")), "n")
    both = both.withColumn("_plan", F.col("r.sparkPlanInfo"))
    is_object = F.ltrim(F.col("_plan")).startswith("{")
    too_deep = F.col("_plan").isNull() & F.col("body").rlike(r'"sparkPlanInfo"\s*:\s*\{')
    return both.select(
        "app_key",
        "seq",
        F.col("n.executionId").try_cast("bigint").alias("execution_id"),
        F.coalesce("n.description", F.lit("")).alias("description"),
        F.when(is_object, F.col("_plan")).when(too_deep, F.col("body")).alias("plan_json"),
    )


def save_fact_table(rows: DataFrame, path: str, name: str) -> None:
    """Writes one fact table to ``path``, those that grow with tasks and plan texts by ``TEXT_CODEC``."""
    options = TEXT_OPTIONS if name in LARGE_FACTS else {}
    rows.write.mode("overwrite").options(**options).parquet(path)


def save_job_log(log: JobLog, path: str) -> None:
    """Writes every fact table below ``path``, in Parquet."""
    for name, rows in log._asdict().items():
        save_fact_table(rows, f"{path}/{name}", name)


def load_job_log(spark: SparkSession, path: str) -> JobLog:
    return JobLog(*(spark.read.parquet(f"{path}/{name}") for name in JobLog._fields))


def job_log(events: DataFrame) -> JobLog:
    return JobLog(
        apps=events.select("app_key").distinct(),
        tasks=task_facts(events),
        stage_events=stage_event_facts(events),
        job_starts=job_start_facts(events),
        job_ends=job_end_facts(events),
        executor_events=executor_event_facts(events),
        app_events=app_event_facts(events),
        env_events=env_event_facts(events),
        profiles=profile_facts(events),
        sql_starts=sql_start_facts(events),
    )
