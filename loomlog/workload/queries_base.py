"""Registered queries: sources, parsing, scalar functions, filters and joins."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import schema as S
from loomlog.functions import plan_nodes as P
from loomlog.functions import scalars as fn
from loomlog.functions.text import head_lines
from loomlog.operators import apps, attempts, groups, rollups, stages
from loomlog.session import fresh_dir, materialize
from loomlog.sources import archives, events, lines, zip_source
from loomlog.spread import many
from loomlog.workload.oracle_views import pct, ratio, sc
from loomlog.workload.registry import query
from loomlog.workload.views import prepared_lines, prepared_log, table, view, stored_table

KEYS = ["app_key", "stage_id"]

# --- sources -----------------------------------------------------------------------------

DOCS_PER_ARCHIVE = 16
ASCII_SPACE = r" \t\n\r\x0b\x0c"


def _pack_archive(pdf: pd.DataFrame) -> pd.DataFrame:
    """One archive per group of 16 documents, a member each; some archives are damaged."""
    number = int(pdf["doc_id"].iloc[0]) // DOCS_PER_ARCHIVE
    if number % 7 == 3:
        return pd.DataFrame({"number": [number], "content": [b"" if number % 2 else b"XX no zip"]})
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("logs/", "")
        for doc, text in sorted(zip(pdf["doc_id"], pdf["text"], strict=True)):
            archive.writestr(f"logs/{doc}", text.encode())
        if number % 7 == 4:
            archive.writestr("zeros", "0" * 1_000_000)
        if number % 7 == 5:
            for i in range(1001):
                archive.writestr(f"many/{i}", "x")
        if number % 7 == 6:
            archive.writestr(zipfile.ZipInfo("damaged"), f"lost {number}")
    content = buffer.getvalue()
    if number % 7 == 6:  # stored as it is, so a changed letter breaks the member's checksum
        content = content.replace(f"lost {number}".encode(), f"LOST {number}".encode())
    return pd.DataFrame({"number": [number], "content": [content]})


def _write_archives(spark: SparkSession, sf_dir: str) -> str:
    """Packs the documents into archives below the shared folder, in parallel by archive."""
    folder = fresh_dir(spark, "archives")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = (
        documents.withColumn("_n", F.floor(F.col("doc_id") / DOCS_PER_ARCHIVE))
        .groupBy("_n")
        .applyInPandas(_pack_archive, "number bigint, content binary")
    )
    packed.foreachPartition(lambda rows: _store(folder, rows))
    return folder


def _store(folder: str, rows) -> None:
    filesystem, inner = archives._locate(folder)
    filesystem.create_dir(inner, recursive=True)
    for row in rows:
        with filesystem.open_output_stream(f"{inner}/{row.number}.zip") as out:
            out.write(row.content)


@query(
    "src_zip_lines",
    f"""
select cast(doc_id // 16 as string) as app_key, concat('logs/', cast(doc_id as string)) as file_name,
  trim(line, E'{ASCII_SPACE}') as line, count(*) as n
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents
  where (doc_id // 16) % 7 not in (3, 4, 5)) t
where trim(line, E'{ASCII_SPACE}') <> '' group by 1, 2, 3
union all select cast(number as string), case when number % 7 = 6 then 'damaged' end, concat('(', case number % 7
    when 3 then case when number % 2 = 1 then 'empty' else 'bad_magic' end when 4 then 'compression_ratio'
    when 5 then 'too_many_files' else 'damaged' end, ')'), 1
from (select distinct doc_id // 16 as number from documents) a where number % 7 in (3, 4, 5, 6)""",
)
def src_zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all archives, and a row with the reason for what could not be read."""
    zip_source.register(spark)
    read = spark.read.format("loomlog_zip").load(_write_archives(spark, sf_dir))
    reason = F.concat(F.lit("("), F.regexp_extract("reason", "^[a-z_]+", 0), F.lit(")"))
    read = read.select("app_key", "file_name", F.coalesce("line", reason).alias("line"))
    return read.groupBy("app_key", "file_name", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_archive_audit",
    """
select number, case when number % 7 = 3 then 0 else n_docs + case number % 7 when 4 then 1 when 5 then 1001 when 6 then 1 else 0 end end as n_files,
  case when number % 7 = 3 then 0 else n_bytes + case number % 7 when 4 then 1000000 when 5 then 1001
    when 6 then 5 + length(cast(number as string)) else 0 end end as uncompressed_bytes,
  case when number % 7 = 3 then case when number % 2 = 1 then 'empty' else 'bad_magic' end
    when number % 7 = 4 then 'compression_ratio' when number % 7 = 5 then 'too_many_files' end as reason
from (select doc_id // 16 as number, count(*) as n_docs, cast(sum(strlen(text)) as bigint) as n_bytes
  from documents group by 1) t""",
)
def src_archive_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = archives.archive_audit(archives.archive_members(spark, _write_archives(spark, sf_dir)))
    number = F.regexp_extract("archive", r"([0-9]+)\.zip$", 1).cast("bigint")
    return audit.select(number.alias("number"), "n_files", "uncompressed_bytes", "reason")


@query(
    "src_text_lines",
    f"""
select trim(line, E'{ASCII_SPACE}') as line, count(*) as n
from (select unnest(string_split(text, chr(10))) as line from documents) t
where trim(line, E'{ASCII_SPACE}') <> '' group by 1""",
)
def src_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.option("compression", "gzip").text(folder)
    return lines.text_lines(spark, folder).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


EVENT_COUNTS = """
select app_key, 'SparkListenerTaskEnd' as event_type, count(*) as n from v_task group by 1
union all select app_key, case when kind = 'submitted' then 'SparkListenerStageSubmitted'
  else 'SparkListenerStageCompleted' end, count(*) from v_stage_event group by 1, 2
union all select app_key, case when kind = 'add' then 'SparkListenerExecutorAdded'
  else 'SparkListenerExecutorRemoved' end, count(*) from v_executor_event group by 1, 2
union all select app_key, 'SparkListenerJobStart', count(*) from v_job group by 1
union all select app_key, 'SparkListenerJobEnd', count(*) from v_job where end_ms > 0 group by 1
union all select app_key, 'SparkListenerLogStart', 1 from v_app
union all select app_key, 'SparkListenerApplicationStart', 1 from v_app
union all select app_key, 'SparkListenerApplicationEnd', 1 from v_app
union all select app_key, 'SparkListenerEnvironmentUpdate', 2 from v_app
union all select app_key, 'SparkListenerResourceProfileAdded', 2 from v_app
union all select app_key, 'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart', count(*)
  from v_plan group by 1"""


@query("parse_events", EVENT_COUNTS)
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = events.parse_events(prepared_lines(spark, sf_dir))
    return parsed.groupBy("app_key", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quarantine_events",
    """
select case event_id % 8 when 0 then 'malformed_json' when 1 then 'not_an_object' when 2 then 'no_event_name'
    when 3 then 'malformed_json' when 4 then 'malformed_json' when 5 then 'not_an_object' end as reason,
  event_type, count(*) as n
from events where event_id % 8 < 6 group by 1, 2""",
)
def quarantine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("event_type").alias("Event"), "event_id", "value"))
    kind = F.col("event_id") % 8
    line = (
        F.when(kind == 0, F.expr("left(to_json(struct(event_id, props)), 12)"))
        .when(kind == 1, F.concat(F.lit("["), record, F.lit("]")))
        .when(kind == 2, F.to_json(F.struct("event_id", "value")))
        .when(kind == 3, F.concat(record, record))
        .when(kind == 4, F.concat(record, F.lit(" tail")))
        .when(kind == 5, F.col("event_id").cast("string"))
        .otherwise(record)
    )
    named = rows.select(F.col("event_type").alias("app_key"), F.col("event_id").alias("seq"), line.alias("line"))
    rejected = events.quarantine_events(named)
    return rejected.groupBy("reason", F.col("app_key").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


TASK_SUMS = [c for c in S.TASK_NUMBERS if c not in ("stage_id", "launch_ms", "finish_ms")]


@query(
    "filter_event_type",
    "select app_key, stage_id, count(*) as n, count(host) as n_host, "
    "cast(sum(launch_ms - 1700000000000) as bigint) as launch_ms, "
    "cast(sum(finish_ms - 1700000000000) as bigint) as finish_ms, "
    "cast(count(*) filter (where failed) as bigint) as n_failed, "
    "cast(count(*) filter (where speculative) as bigint) as n_speculative, "
    + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in TASK_SUMS)
    + " from v_task group by 1, 2",
)
def filter_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = events.task_facts(events.parse_events(prepared_lines(spark, sf_dir)))
    epoch = F.lit(1700000000000)
    return tasks.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("host").alias("n_host"),
        F.sum(F.col("launch_ms") - epoch).alias("launch_ms"),
        F.sum(F.col("finish_ms") - epoch).alias("finish_ms"),
        F.count_if("failed").alias("n_failed"),
        F.count_if("speculative").alias("n_speculative"),
        *(F.sum(c).alias(c) for c in TASK_SUMS),
    )


# --- scalar functions ----------------------------------------------------------------------


@query(
    "fn_resource_amount",
    """
select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey when 1 then o_custkey else 0 end as amount
from orders""",
)
def fn_resource_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    raw = (
        F.when(key == 0, F.col("o_orderkey").cast("string"))
        .when(key == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
        .when(key == 2, F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.resource_amount(raw).alias("amount"))


@query(
    "fn_safe_pct",
    f"select p_partkey, {sc(pct('p_partkey', 'p_size % 5'))} as pct_x1000 from part",
)
def fn_safe_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fn.safe_pct("p_partkey", F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", fn.scaled(value).alias("pct_x1000"))


@query(
    "fn_safe_ratio",
    f"select p_partkey, {sc(ratio('p_partkey', 'p_size % 5 - 1'))} as ratio_x1000 from part",
)
def fn_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fn.safe_ratio("p_partkey", F.col("p_size") % 5 - 1)
    return table(spark, sf_dir, "part").select("p_partkey", fn.scaled(value).alias("ratio_x1000"))


@query(
    "fn_round",
    """
select o_orderkey,
  q3 // 10 + case when q3 % 10 > 5 or (q3 % 10 = 5 and (q3 // 10) % 2 = 1) then 1 else 0 end as thousandths,
  q1 // 10 + case when q1 % 10 > 5 or (q1 % 10 = 5 and (q1 // 10) % 2 = 1) then 1 else 0 end as tenths
from (select o_orderkey, o_orderkey * 625 as q3, o_orderkey * 25 as q1 from orders) t""",
)
def fn_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    sixteenths = F.col("o_orderkey") / F.lit(16.0)
    quarters = F.col("o_orderkey") / F.lit(4.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.scaled(fn.half_even(sixteenths, 3), 1000).alias("thousandths"),
        fn.scaled(fn.half_even(quarters, 1), 10).alias("tenths"),
    )


@query(
    "fn_stage_group_name",
    """
select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then concat('scan ', p_brand)
  when 2 then p_type else concat(p_brand, ' (x)') end as group_name from part""",
)
def fn_stage_group_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    number = F.concat(F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    name = (
        F.when(key == 0, F.concat(F.col("p_name"), F.lit(" at Job.scala:42")))
        .when(key == 1, F.concat(F.lit("scan "), F.col("p_brand"), number, F.lit(" at a.py:1")))
        .when(key == 2, F.concat(F.lit(" "), F.col("p_type"), number, F.lit(" ")))
        .otherwise(F.concat(F.col("p_brand"), F.lit(" (x)")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", fn.group_name(name).alias("group_name"))


BYTES_TEXT = "case " + " ".join(
    f"when b < {1024 ** (i + 1)} then format('{{:.1f}} {u}', b / {float(1024**i)}e0)"
    for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))
) + f" else format('{{:.1f}} PB', b / {float(1024**5)}e0) end"


@query(
    "fn_fmt_bytes",
    f"select b, {BYTES_TEXT} as text from (select o_orderkey * o_orderkey * o_custkey * (o_orderkey % 7) as b from orders) t",
)
def fn_fmt_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every order's size; ``b`` is NULL where no BIGINT holds the size, its text is not."""
    key, customer = F.col("o_orderkey").cast("decimal(38,0)"), F.col("o_custkey").cast("decimal(38,0)")
    b = key * key * customer * (F.col("o_orderkey") % 7).cast("decimal(38,0)")
    return table(spark, sf_dir, "orders").select(b.try_cast("bigint").alias("b"), fn.fmt_bytes(b).alias("text"))


@query(
    "fn_fmt_ms",
    """
select ms, case when ms < 1000 then concat(cast(ms as string), ' ms')
  when ms < 60000 then format('{:.1f} s', ms / 1000.0e0) else format('{:.1f} min', ms / 60000.0e0) end as text
from (select o_orderkey * (o_orderkey % 50) as ms from orders) t""",
)
def fn_fmt_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("o_orderkey") * (F.col("o_orderkey") % 50)
    return table(spark, sf_dir, "orders").select(ms.alias("ms"), fn.fmt_ms(ms).alias("text"))


@query(
    "fn_task_duration",
    "select app_key, finish_ms - launch_ms as dur_ms, count(*) as n from v_task group by 1, 2",
)
def fn_task_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared_log(spark, sf_dir).tasks.select("app_key", fn.task_duration().alias("dur_ms"))
    return rows.groupBy("app_key", "dur_ms").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_ns_to_ms",
    """
select app_key, stage_id, cast(sum(cpu_ns // 1000000) as bigint) as cpu_ms,
  cast(sum(sw_time_ns // 1000000) as bigint) as sw_ms, cast(sum(cpu_ns) as bigint) // 1000000 as cpu_sum_ms
from v_task group by 1, 2""",
)
def fn_ns_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_log(spark, sf_dir).tasks.groupBy(*KEYS).agg(
        F.sum(fn.ns_to_ms("cpu_ns")).alias("cpu_ms"),
        F.sum(fn.ns_to_ms("sw_time_ns")).alias("sw_ms"),
        fn.ns_to_ms(F.sum("cpu_ns")).alias("cpu_sum_ms"),
    )


@query(
    "fn_shuffle_read_bytes",
    """
select app_key, stage_id, cast(sum(case when sr_total_bytes > 0 then sr_total_bytes
  else sr_remote_bytes + sr_local_bytes end) as bigint) as shuffle_read_bytes from v_task group by 1, 2""",
)
def fn_shuffle_read_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(fn.shuffle_read_bytes()).alias("shuffle_read_bytes")
    return prepared_log(spark, sf_dir).tasks.groupBy(*KEYS).agg(total)


HOST_COUNTS = """
select t.app_key, coalesce(t.host, r.host, 'unknown') as host, count(*) as n
from v_task t left join o_registry r using (app_key, executor_id) group by 1, 2"""


@query("fn_host_of_task", HOST_COUNTS)
def fn_host_of_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    folded = log.tasks.groupBy("app_key", "executor_id", "host").agg(F.count(F.lit(1)).alias("c"))
    named = folded.join(many(rollups.first_hosts(log.executor_events)), ["app_key", "executor_id"], "left")
    host = fn.host_of_task("host", "executor_host")
    return named.groupBy("app_key", host.alias("host")).agg(F.sum("c").alias("n"))


@query(
    "fn_spark_version",
    """
select app_key, coalesce(start_version, concat('4.1.', cast(length(app_key) as string))) as spark_version,
  '4.1.2' as log_version from v_app
union all select app_key, 'unknown', 'unknown' from o_only_plan""",
)
def fn_spark_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = apps.app_meta(log)
    return rows.select("app_key", "spark_version", "log_version")


@query("fn_stage_name_default", "select app_key, stage_id, stage_name from o_metrics")
def fn_stage_name_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    known = log.tasks.select(*KEYS).distinct()
    return rollups.join_stage_info(known, log.stage_events).select(*KEYS, "stage_name")


@query(
    "fn_node_type",
    "select app_key, node_name, node_type, count(*) as n from o_type group by 1, 2, 3",
)
def fn_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.plans.flatten import flatten_plans

    nodes = flatten_plans(prepared_log(spark, sf_dir).sql_starts)
    names = nodes.groupBy("app_key", "node_name").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("node_type", F.lower(P.node_type("node_name")))


@query(
    "fn_execution_class",
    """
select p_partkey, case when p_size % 3 = 0 then 'write' when p_size % 3 = 1 then 'ddl'
  when p_partkey % 100 > 50 then 'compute' else 'init' end as class from part""",
)
def fn_execution_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    root = (
        F.when(size == 0, "execute INSERTinto")
        .when(size == 1, "createview and write")
        .otherwise("Project")
    )
    kind = P.execution_class(root, F.col("p_partkey") % 100)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("class"))


@query(
    "fn_is_write",
    """
select app_key, root, regexp_matches(root, 'Insert|Write', 'i') and position('Create' in root) = 0 as is_write,
  count(*) as n
from (select app_key, case when execution_id % 97 <> 5 then root end as root from v_plan) p group by 1, 2, 3""",
)
def fn_is_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All executions of the parsed log; those without a plan have no root and no answer."""
    starts = prepared_log(spark, sf_dir).sql_starts
    root = F.get_json_object("plan_json", "$.nodeName")
    rows = starts.select("app_key", root.alias("root"), P.is_write(root).alias("is_write"))
    return rows.groupBy("app_key", "root", "is_write").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_scan_source",
    """
select execution_id, case when execution_id % 5 = 0 then regexp_extract(scan_text, '([^/]+)$', 1)
  else regexp_extract(scan_text, '\\[([^\\]]+)\\]', 1) end as source from v_plan""",
)
def fn_scan_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = view(spark, sf_dir, "v_plan")
    return plans.select("execution_id", P.scan_source(F.col("scan_text")).alias("source"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(
        spark, sf_dir, "metrics", lambda log: rollups.stage_metrics(log.tasks, log.stage_events)
    )


@query(
    "fn_stage_flags",
    "select app_key, stage_id, has_skew, has_spill, has_heavy_shuffle, has_low_cpu from o_flags",
)
def fn_stage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [c.alias(name) for name, c in fn.stage_flags().items()]
    return _metrics(spark, sf_dir).select(*KEYS, *flags)


@query("fn_anomaly_text", "select app_key, stage_id, pos, anomaly from o_message")
def fn_anomaly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Positions in the source SQL are kinds; the operator numbers present messages.
    rows = _metrics(spark, sf_dir).select(*KEYS, F.explode(fn.anomaly_texts()).alias("anomaly"))
    prefixes = F.array(*map(F.lit, ("skew", "disk_spill", "gc", "low_cpu")))
    kind = F.array_position(prefixes, F.regexp_extract("anomaly", "^([a-z_]+)=", 1)) - 1
    return rows.withColumn("pos", kind)


@query(
    "fn_severity",
    """
select p_partkey, case when p_partkey / 10.0e0 > 5 then 'critical' when p_partkey / 10.0e0 > 2 then 'attention' end as skew,
  case when p_partkey / 10.0e0 > 15 then 'critical' when p_partkey / 10.0e0 > 5 then 'attention' end as gc_pressure,
  case when p_partkey / 10.0e0 > 25 then 'critical' when p_partkey / 10.0e0 > 10 then 'attention' end as shuffle_bound,
  case when p_partkey / 10.0e0 > 1 then 'critical' when p_partkey / 10.0e0 > 0 then 'attention' end as spill,
  case when p_partkey / 10.0e0 > 70 then 'critical' when p_partkey / 10.0e0 > 30 then 'attention' end as low_utilization,
  case when p_partkey / 10.0e0 > 40 then 'critical' when p_partkey / 10.0e0 > 20 then 'attention' end as driver_overhead
from part""",
)
def fn_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.col("p_partkey") / F.lit(10.0)
    grades = [fn.severity(kind, metric).alias(kind) for kind in fn.SEVERITY]
    return table(spark, sf_dir, "part").select("p_partkey", *grades)


@query("fn_name_trunc", "select doc_id, substring(text, 1, 35) as short_name from documents")
def fn_name_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.short_name("text").alias("short_name"))


# --- filters -------------------------------------------------------------------------------


@query(
    "filter_tasks_accepted",
    """
select app_key, stage_id, cast(count(*) filter (where good) as bigint) as n_good,
  cast(count(*) filter (where failed) as bigint) as n_failed,
  cast(count(*) filter (where speculative and not failed) as bigint) as n_speculative
from o_task where kept group by 1, 2""",
)
def filter_tasks_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    marked = attempts.mark_tasks(log.tasks, attempts.stage_state(log.stage_events)).filter("kept")
    return marked.groupBy(*KEYS).agg(
        F.count_if("accepted").alias("n_good"),
        F.count_if("failed").alias("n_failed"),
        F.count_if(F.col("speculative") & ~F.col("failed")).alias("n_speculative"),
    )


@query(
    "filter_latest_attempt",
    """
select app_key, stage_id, attempt_id, cast(count(*) filter (where stale) as bigint) as n_stale,
  cast(count(*) filter (where kept) as bigint) as n_kept, count(*) as n from o_task group by 1, 2, 3""",
)
def filter_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    marked = attempts.mark_tasks(log.tasks, attempts.stage_state(log.stage_events))
    return marked.groupBy(*KEYS, "attempt_id").agg(
        F.count_if("stale").alias("n_stale"),
        F.count_if("kept").alias("n_kept"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "filter_valid_ids",
    """
select o_orderstatus as app_key, cast(o_custkey % 7 - 2 as bigint) as stage_id, count(*) as n
from orders where o_orderkey % 11 <> 0 and o_custkey % 7 >= 2 group by 1, 2""",
)
def filter_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 7 - 2)
    record = F.to_json(F.struct(F.lit(S.TASK_END).alias("Event"), stage.alias("Stage ID")))
    named = rows.select(
        F.col("o_orderstatus").alias("app_key"), F.col("o_orderkey").alias("seq"), record.alias("line")
    )
    tasks = events.task_facts(events.parse_events(named))
    return tasks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_env_keys",
    """
select app_key, seq, key, value from v_env
where key in ('spark.executor.memory', 'spark.executor.cores', 'spark.sql.shuffle.partitions')""",
)
def filter_env_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.map_filter("props", lambda k, v: k.isin(*S.ENV_KEYS))
    return prepared_log(spark, sf_dir).env_events.select("app_key", "seq", F.explode(kept))


def _executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    return rollups.executor_summary(log.tasks, log.executor_events)


@query(
    "filter_executor_outliers",
    f"""
select app_key, executor_id, host, {sc('gc_pct', 100)} as gc_pct_x100,
  {sc('cpu_efficiency')} as cpu_efficiency_x1000
from o_executor_summary where gc_pct > 5.0e0 or cpu_efficiency < 0.05e0""",
)
def filter_executor_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.executor_outliers(_executors(spark, sf_dir)).select(
        "app_key",
        "executor_id",
        "host",
        fn.scaled("gc_pct", 100).alias("gc_pct_x100"),
        fn.scaled("cpu_efficiency").alias("cpu_efficiency_x1000"),
    )


@query(
    "filter_low_cpu_stages",
    f"select app_key, stage_id, {sc('cpu_efficiency')} as cpu_efficiency_x1000 from o_flags where has_low_cpu",
)
def filter_low_cpu_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.low_cpu_stages(_metrics(spark, sf_dir)).select(
        *KEYS, fn.scaled("cpu_efficiency").alias("cpu_efficiency_x1000")
    )


@query(
    "filter_group_solo",
    "select app_key, group_name, n_stages, n_stages = 1 as is_solo from o_group",
)
def filter_group_solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = groups.stage_groups(_metrics(spark, sf_dir))
    several = groups.repeated_groups(grouped).select("app_key", "group_name", "n_stages", F.lit(False).alias("is_solo"))
    solo = grouped.filter("n_stages = 1").select("app_key", "group_name", "n_stages", F.lit(True).alias("is_solo"))
    return several.unionByName(solo)


# --- joins ---------------------------------------------------------------------------------


@query(
    "join_stage_info",
    "select app_key, stage_id, num_tasks, stage_name, duration_ms from o_metrics",
)
def join_stage_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    counted = log.tasks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_tasks"))
    return rollups.join_stage_info(counted, log.stage_events)


@query(
    "join_executor_registry",
    "select app_key, executor_id, host, cores, tasks from o_executor_summary",
)
def join_executor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executors(spark, sf_dir).select("app_key", "executor_id", "host", "cores", "tasks")


@query("join_stage_job", "select app_key, stage_id, job_id from o_stage_job")
def join_stage_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_jobs(prepared_log(spark, sf_dir))


@query("join_task_executor_host", HOST_COUNTS)
def join_task_executor_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    placed = rollups.tasks_on_hosts(log.tasks, log.executor_events)
    return placed.groupBy("app_key", "host").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_job_stages",
    """
select j.app_key, j.job_id, j.stage_id, s.run_ms, s.n_accepted
from v_job_stage j join o_stage s using (app_key, stage_id)""",
)
def join_job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    pairs = apps.job_stages(apps.jobs(log))
    measured = stages.stage_table(log).select(*KEYS, "run_ms", "n_accepted")
    return pairs.join(many(measured), KEYS).select("app_key", "job_id", "stage_id", "run_ms", "n_accepted")


@query("join_stage_parents", "select app_key, job_id, stage_id, parent_id from o_stage_edge")
def join_stage_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.operators.graph import job_edges

    log = prepared_log(spark, sf_dir)
    state = attempts.stage_state(log.stage_events)
    return job_edges(apps.job_stages(apps.jobs(log)), state)


@query("semi_top_stages", "select app_key, stage_id from o_report where wall_rank <= 3")
def semi_top_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(stages.stage_table(prepared_log(spark, sf_dir)), "stages")
    top = stages.top_wall_stages(rows).select(*KEYS)
    return rows.join(top, KEYS, "left_semi").select(*KEYS)


@query(
    "semi_solo_stages",
    """
select m.app_key, m.stage_id from o_grouped m join o_group g using (app_key, group_name)
where g.n_stages = 1""",
)
def semi_solo_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    known = rollups.join_stage_info(log.tasks.select(*KEYS).distinct(), log.stage_events)
    return groups.solo_stages(known).select(*KEYS)


@query(
    "anti_unreported_stages",
    """
select distinct app_key, stage_id from v_job_stage j where not exists (
  select 1 from v_task t where t.app_key = j.app_key and t.stage_id = j.stage_id)""",
)
def anti_unreported_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.unreported_stages(prepared_log(spark, sf_dir))


@query("text_head_lines", """
select doc_id, text as head_500, case when len(string_split(text, chr(10))) > 20
  then concat(array_to_string(string_split(text, chr(10))[1:20], chr(10)), chr(10),
    '# ... (truncated, showing first 20 of ', cast(len(string_split(text, chr(10))) as string), ' lines)')
  else text end as head_20
from documents""")
def text_head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", head_lines("text").alias("head_500"), head_lines("text", 20).alias("head_20")
    )
