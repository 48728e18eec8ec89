"""Registered queries: plan trees, execution selection, report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.scalars import scaled
from loomlog.operators import apps, rollups, stages
from loomlog.plans import executions as X
from loomlog.plans.flatten import codegen_members, flatten_plans
from loomlog.plans.simplify import simplify_plans
from loomlog.reports import documents as D
from loomlog.reports import lines as L
from loomlog.reports import metrics as M
from loomlog.operators.numbering import PART_ITEMS
from loomlog.session import fresh_dir
from loomlog.workload.oracle_views import pct, rounded, sc
from loomlog.workload.queries_metrics import RANKED, WHATIF
from loomlog.workload.registry import query
from loomlog.workload.views import prepared_log, stored_table, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_plans(prepared_log(spark, sf_dir).sql_starts)


@query(
    "tree_flatten_plan",
    """
select app_key, execution_id, node_id, parent_id, depth, node_name, simple_string, n_metrics from o_node""",
)
def tree_flatten_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select(
        "app_key", "execution_id", "node_id", "parent_id", "depth", "node_name", "simple_string",
        "n_metrics",
    )


@query(
    "tree_simplify_plan",
    "select app_key, execution_id, node_id, depth, node_name from o_simple",
)
def tree_simplify_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplify_plans(_nodes(spark, sf_dir)).select(
        "app_key", "execution_id", "node_id", "depth", "node_name"
    )


@query(
    "tree_codegen_members",
    """
select app_key, execution_id, 1 as codegen_id, node_id, node_name from o_simple
where node_id >= 1""",
)
def tree_codegen_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegen_members(simplify_plans(_nodes(spark, sf_dir))).drop("seq")


TYPES = "scan join shuffle aggregate window write cache op".split()


@query(
    "agg_plan_stats",
    "select app_key, execution_id, count(*) as n_nodes, max(depth) as max_depth, "
    + ", ".join(f"cast(count(*) filter (where node_type = '{t}') as bigint) as n_{t}" for t in TYPES)
    + " from o_type group by 1, 2",
)
def agg_plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.plan_stats(_nodes(spark, sf_dir)).drop("seq")


@query(
    "agg_plan_stats_simplified",
    "select app_key, execution_id, count(*) as n_nodes, max(depth) as max_depth from o_simple group by 1, 2",
)
def agg_plan_stats_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.plan_stats(simplify_plans(_nodes(spark, sf_dir)))
    return rows.select("app_key", "execution_id", "n_nodes", "max_depth")


@query("agg_sql_exec_count", "select app_key, count(*) as n_executions from v_plan group by 1")
def agg_sql_exec_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql_execution_counts(prepared_log(spark, sf_dir).sql_starts)


@query("distinct_sources", "select app_key, source from o_source where source <> ''")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scan_sources(_nodes(spark, sf_dir))


@query(
    "agg_execution_classes",
    """
select app_key, class, count(*) as n_items, cast(sum(n_nodes) as bigint) as n_nodes,
  case class when 'init' then 1 when 'ddl' then 2 when 'compute' then 3 else 4 end as class_order
from o_execution group by 1, 2
union all
select app_key, 'source', count(*), 0, 0 from o_source where source <> '' group by 1""",
)
def agg_execution_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return X.execution_classes(X.executions(nodes), X.scan_sources(nodes))


@query(
    "top_execution",
    """
select app_key, execution_id, n_nodes from (select *, row_number() over (partition by app_key
  order by n_nodes desc, execution_id desc) as rn from o_execution) t where rn = 1""",
)
def top_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_execution(X.executions(_nodes(spark, sf_dir)))


SELECTED = """
select * from (with f as (select *, is_write or n_nodes > 100 as sure from o_execution),
s as (select app_key, count(*) as n_sure from f where sure group by 1),
q as (select *, row_number() over (partition by app_key, root order by n_nodes desc, seq) as q from f where not sure),
r as (select *, row_number() over (partition by app_key order by n_nodes desc, seq) as r from q where q <= 3),
b as (select app_key, execution_id, root, n_nodes from f where sure
  union all select r.app_key, r.execution_id, r.root, r.n_nodes from r left join s using (app_key)
    where r.r <= 30 - coalesce(s.n_sure, 0))
select app_key, execution_id, root, n_nodes, position from (select *, row_number() over (partition by app_key
  order by execution_id) as position from b) t where position <= 30) z"""


@query("select_sql_executions", SELECTED)
def select_sql_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = prepared_log(spark, sf_dir).sql_starts
    rows = X.select_executions(starts, X.executions(flatten_plans(starts)))
    position = F.col("position").cast("bigint").alias("position")
    return rows.select("app_key", "execution_id", "root", "n_nodes", position)


@query(
    "win_root_quota",
    """
select app_key, root, execution_id, n_nodes, rank_in_root from (select *, row_number() over (
  partition by app_key, root order by n_nodes desc, seq) as rank_in_root from o_execution) t where rank_in_root <= 3""",
)
def win_root_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.root_quota(X.executions(_nodes(spark, sf_dir)))
    rank = F.col("rank_in_root").cast("bigint").alias("rank_in_root")
    return rows.select("app_key", "root", "execution_id", "n_nodes", rank)


# --- report sinks --------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    log = prepared_log(spark, sf_dir)
    rows = stored_table(spark, sf_dir, "metrics", lambda log: rollups.stage_metrics(log.tasks, log.stage_events))
    return (
        stored_table(spark, sf_dir, "summary", lambda log: apps.app_summary(log, rows)),
        rollups.job_efficiency(log.tasks),
        stored_table(spark, sf_dir, "executors", lambda log: rollups.executor_summary(log.tasks, log.executor_events)),
        rows,
    )


RECORDS = """
select app_key, 'stage' as kind, lpad(cast(stage_id as string), 20, '0') as position, stage_name as label,
  num_tasks as tasks, cast(round(skew_ratio * 100) as bigint) as measure from o_metrics
union all
select app_key, 'executor', executor_id, host, tasks, cast(round(cpu_efficiency * 1000) as bigint) from o_executor_summary
union all
select app_key, 'group', concat(lpad(cast(first_stage_id as string), 20, '0'), group_name), group_name, total_tasks,
  cast(round(skew_ratio_max * 100) as bigint) from o_group
union all
select k.app_key, 'app', '', coalesce(a.app_name, 'unknown'), coalesce(t.n, 0), null
from (select app_key from v_app union select app_key from v_plan) k left join v_app a using (app_key)
left join (select app_key, count(*) as n from v_task group by 1) t using (app_key)"""


@query("sink_summary_json", RECORDS)
def sink_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all records of the summary as JSON, reads them back and unfolds them."""
    path = fresh_dir(spark, "summary")
    D.summary_records(*_parts(spark, sf_dir)).write.option("compression", "gzip").json(path)
    records = spark.read.schema("app_key string, kind string, position string, record string").json(path)
    ddl = (
        "app_name string, num_tasks bigint, stage_name string, skew_ratio double, host string, tasks bigint, "
        "cpu_efficiency double, group_name string, total_tasks bigint, skew_ratio_max double, part bigint"
    )
    rows = records.select("*", F.from_json("record", ddl).alias("r")).filter(F.col("r.part").isNull())
    kind = F.col("kind")
    measure = (
        F.when(kind == "stage", scaled("r.skew_ratio", 100))
        .when(kind == "executor", scaled("r.cpu_efficiency", 1000))
        .when(kind == "group", scaled("r.skew_ratio_max", 100))
    )
    return rows.select(
        "app_key",
        "kind",
        # A group's position ends in the part of its lists.
        F.when(kind == "group", F.regexp_replace("position", " [0-9]{20}$", "")).otherwise(F.col("position")).alias("position"),
        F.coalesce("r.stage_name", "r.host", "r.group_name", "r.app_name").alias("label"),
        F.coalesce("r.num_tasks", "r.tasks", "r.total_tasks").alias("tasks"),
        measure.alias("measure"),
    )


@query(
    "sink_report_doc",
    "select app_key, cast(section as bigint) as section, item, item_key, cast(line_no as bigint) as line_no, piece, text from o_line",
)
def sink_report_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every report, in pieces where a line lists many items."""
    rows = L.report_lines(*_parts(spark, sf_dir))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("section", "line_no")]
    return rows.select("app_key", numbers[0], "item", "item_key", numbers[1], "piece", "text")


@query(
    "sink_report_documents",
    f"""
select app_key, (place - 1) // {PART_ITEMS} as chunk_no, count(*) as n_pieces,
  string_agg(case when piece > 0 or place = 1 then text else concat(chr(10), text) end, '' order by place) as text
from (select *, row_number() over (partition by app_key order by section, item, item_key, line_no, piece) as place from o_line) t
group by 1, 2""",
)
def sink_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = L.report_documents(L.report_lines(*_parts(spark, sf_dir)))
    return chunks.withColumn("n_pieces", F.col("n_pieces").cast("bigint"))


@query(
    "sink_report_compact",
    """
select doc_id, case when length(body) <= 5000 then body
  when position('## ⚠️ Anomaly Summary' in body) > 1 then concat(left(body, 3000), chr(10), chr(10), '...', chr(10), chr(10),
    substring(body, position('## ⚠️ Anomaly Summary' in body)))
  else concat(left(body, 5000), chr(10), chr(10), '*(truncated — compact mode)*') end as compact
from (select doc_id, case when doc_id % 2 = 0 then concat(text, chr(10), '## ⚠️ Anomaly Summary', chr(10), lang)
  else text end as body from documents) t""",
)
def sink_report_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.lit("\n" + L.ANOMALY_HEADING + "\n"), F.col("lang"))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), tail)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return rows.select("doc_id", L.compact_report(F.col("body")).alias("compact"))


@query(
    "sink_llm_context",
    f"""
select g.app_key, 'stage_group' as kind, group_name as label, part, case when part = 0 then n_stages end as n,
  case when part = 0 then total_tasks end as tasks,
  case when part = 0 and total_disk_spill_bytes > 0 then total_disk_spill_bytes end as disk_spill_bytes,
  case when part = 0 and worst_gc_pct > 5.0e0 then {sc('worst_gc_pct', 100)} end as worst_gc_x100,
  greatest(0, least({PART_ITEMS}, coalesce(m.n, 0) - part * {PART_ITEMS})) as n_anomalies
from o_group g left join (select app_key, group_name, count(*) as n from o_message group by 1, 2) m using (app_key, group_name),
  lateral (select unnest(range(1 + greatest(n_stages - 1, coalesce(m.n, 0) - 1) // {PART_ITEMS})) as part) p
union all select app_key, 'app', app_name, 0, num_stages, num_tasks, null, null, 0 from o_summary
union all select app_key, 'job_efficiency', '', 0, null, null, null, {sc('gc_overhead_pct', 100)}, 0 from o_efficiency
union all
select app_key, case when uniform then 'uniform_executors' else 'executor' end, case when uniform then '' else executor_id end, 0,
  case when uniform then n_executors end, case when uniform then total_tasks else tasks end, null, null, 0
from (select s.app_key, s.executor_id, s.tasks, m.n_executors, m.total_tasks, m.n_executors > 2
    and m.far_gc <= greatest(m.gc_mean * 0.1e0, 0.5e0) and m.far_cpu <= greatest(m.cpu_mean * 0.1e0, 0.05e0) as uniform,
    row_number() over (partition by s.app_key order by s.executor_id) as rn
  from o_executor_summary s join (
    select app_key, n_executors, total_tasks, gc_mean, cpu_mean, greatest(hi_gc - gc_mean, gc_mean - lo_gc) as far_gc,
      greatest(hi_cpu - cpu_mean, cpu_mean - lo_cpu) as far_cpu
    from (select app_key, count(*) as n_executors, cast(sum(tasks) as bigint) as total_tasks, avg(gc_pct) as gc_mean,
        avg(cpu_efficiency) as cpu_mean, min(gc_pct) as lo_gc, max(gc_pct) as hi_gc, min(cpu_efficiency) as lo_cpu,
        max(cpu_efficiency) as hi_cpu from o_executor_summary group by 1) z) m using (app_key)) t
where not uniform or rn = 1""",
)
def sink_llm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = D.context_records(*_parts(spark, sf_dir))
    ddl = (
        "id string, name string, part bigint, count bigint, tasks bigint, total_tasks bigint, num_stages bigint, num_tasks bigint, "
        "total_disk_spill_bytes bigint, worst_gc_pct double, gc_overhead_pct double, anomalies array<string>"
    )
    rows = records.select("app_key", "kind", F.from_json("record", ddl).alias("r"))
    return rows.select(
        "app_key",
        "kind",
        F.coalesce("r.name", "r.id", F.lit("")).alias("label"),
        F.coalesce("r.part", F.lit(0)).alias("part"),
        F.coalesce("r.count", "r.num_stages").alias("n"),
        F.coalesce("r.total_tasks", "r.tasks", "r.num_tasks").alias("tasks"),
        F.col("r.total_disk_spill_bytes").alias("disk_spill_bytes"),
        scaled(F.coalesce("r.worst_gc_pct", "r.gc_overhead_pct"), 100).alias("worst_gc_x100"),
        F.coalesce(F.size("r.anomalies"), F.lit(0)).alias("n_anomalies"),
    )


def _rounded_x(expression: str, digits: int = 3) -> str:
    """A measure as a report shows it, times 1000."""
    return sc(rounded(expression, digits).replace("{{", "{").replace("}}", "}"))


_PLACE = "lpad(cast({} as string), 20, '0')"
_ENVIRONMENT = """
select app_key, key, arg_max(value, seq) as value from v_env
where key in ('spark.executor.memory', 'spark.executor.cores', 'spark.sql.shuffle.partitions') group by 1, 2"""

#: Every record of the metric report: a label, two whole numbers and up to three measures.
METRIC_REPORT = f"""
select * from (with apps as (select app_key from o_app union select app_key from o_only_plan),
jobs as (select app_key, job_id, start_ms, greatest(0, end_ms - start_ms) as duration_ms from v_job),
gaps as (
  select app_key, 'inter_stage_gap' as label, prev as a, start_ms as b
  from (select app_key, start_ms, lag(end_ms) over (partition by app_key order by start_ms) as prev from o_island) t
  where prev is not null
  union all select a.app_key, 'pre_first_stage', a.start_ms, i.s
  from o_app a join (select app_key, min(start_ms) as s from o_island group by 1) i using (app_key) where a.start_ms < i.s
  union all select a.app_key, 'post_last_stage', i.e, a.end_ms
  from o_app a join (select app_key, max(end_ms) as e from o_island group by 1) i using (app_key) where i.e < a.end_ms),
hosts as (
  select o.*, coalesce(o.host, r.host, 'unknown') as found_host
  from o_task o left join o_registry r using (app_key, executor_id) where good and not stale),
host_parts as (
  select app_key, found_host, (rn - 1) // {PART_ITEMS} as part, count(*) as n from (
    select *, row_number() over (partition by app_key, found_host order by executor_id) as rn
    from (select distinct app_key, found_host, executor_id from hosts) d) e group by 1, 2, 3),
host_sums as (
  select app_key, found_host, count(*) as n, cast(sum(run_ms) as bigint) as run_ms, cast(sum(gc_ms) as bigint) as gc_ms
  from hosts group by 1, 2)
select app_key, 'app' as kind, '' as position, app_name as label, duration_ms as n, start_ms as amount,
  {_rounded_x(pct('greatest(0, duration_ms - job_ms)', 'duration_ms'), 1)} as m1_x1000,
  {_rounded_x('duration_ms / 60000.0e0', 1)} as m2_x1000, cast(null as bigint) as m3_x1000
from o_app join (select app_key, cast(sum(duration_ms) as bigint) as job_ms from jobs group by 1) j using (app_key)
union all select app_key, 'app', '', 'unknown', 0, 0, 0, 0, null from o_only_plan
union all select app_key, 'cluster', '', '', total_cores, peak_executors, {_rounded_x('available_core_ms / 3600000.0e0')},
  {_rounded_x('u.used / 3600000.0e0')}, {_rounded_x(pct('u.used', 'available_core_ms'))}
from o_cluster join (select app_key, cast(sum(run_ms) as bigint) as used from o_stage group by 1) u using (app_key)
union all select app_key, 'cluster', '', '', 0, 0, 0, 0, 0 from o_only_plan
union all select app_key, 'driver_analysis', '', '', driver_time_ms, executor_time_ms, {_rounded_x('driver_pct')},
  {_rounded_x('100.0e0 - driver_pct')}, null from o_split
union all select app_key, 'driver_analysis', '', '', 0, 0, 0, 100000, null from o_only_plan
union all select app_key, 'driver_intervals', {_PLACE.format('a')}, label, b - a, b, null, null, null from gaps
union all select k.app_key, 'environment', '', coalesce(string_agg(e.key || '=' || e.value, ',' order by e.key), ''),
  count(e.key), null, null, null, null from apps k left join ({_ENVIRONMENT}) e using (app_key) group by 1
union all select app_key, 'jobs', {_PLACE.format('job_id')}, '', duration_ms, n, null, null, null
from jobs join (select app_key, job_id, count(distinct stage_id) as n from v_job_stage group by 1, 2) s using (app_key, job_id)
union all select app_key, 'job_timelines', {_PLACE.format('job_id')}, string_agg(stages, '|' order by level), count(*),
  cast(sum(ms) as bigint), null, null, null
from (select app_key, job_id, level, string_agg(cast(stage_id as string), ',' order by stage_id) as stages,
    greatest(0, max(end_ms) - min(start_ms)) as ms
  from o_level join o_envelope using (app_key, stage_id) group by 1, 2, 3) g group by 1, 2, 3
union all select app_key, 'stages', {_PLACE.format('stage_id')}, stage_name, run_ms, n_accepted, {_rounded_x('skew_avg_ratio')},
  {_rounded_x('used_pct')}, {_rounded_x('io_pct')} from o_report
union all select app_key, 'scalability_bounds', {_PLACE.format('pct')}, '', lower_ms, upper_ms, null, null, null from ({WHATIF}) w
union all select p.app_key, 'host_analysis', concat(p.found_host, ' ', {_PLACE.format('p.part')}), p.found_host,
  case when p.part = 0 then h.n end, p.n, case when p.part = 0 then {_rounded_x(pct('h.gc_ms', 'h.run_ms'))} end, null, null
from host_parts p join host_sums h using (app_key, found_host)
union all select app_key, 'top_bottlenecks', {_PLACE.format('finding_rank')}, kind, stage_id, null, {_rounded_x('metric_value')},
  null, null from ({RANKED}) r where finding_rank <= 5
union all select app_key, 'task_run_times', concat({_PLACE.format('stage_id')}, ' ', {_PLACE.format('part')}), '', count(*),
  cast(sum(run_ms) as bigint), null, null, null
from (select app_key, stage_id, run_ms, (row_number() over (partition by app_key, stage_id order by seq) - 1) // {PART_ITEMS} as part
  from o_task where kept and good) t group by 1, 2, 3, part) whole"""


@query("sink_metric_report", METRIC_REPORT)
def sink_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all records of the metric report as JSON, reads them back and unfolds them."""
    path = fresh_dir(spark, "metric-report")
    table_rows = stored_table(spark, sf_dir, "stages", stages.stage_table)
    M.metric_records(prepared_log(spark, sf_dir), table_rows).write.option("compression", "gzip").json(path)
    records = spark.read.schema("app_key string, kind string, position string, record string").json(path)
    ddl = (
        "name string, label string, host string, type string, duration_ms bigint, start_ms bigint, end_ms bigint, "
        "driver_idle_pct double, duration_min double, total_cores bigint, executor_count bigint, "
        "available_core_hours double, used_core_hours double, cluster_utilization_pct double, driver_time_ms bigint, "
        "executor_time_ms bigint, driver_pct double, executor_pct double, stage_ids array<bigint>, "
        "parallel_groups array<struct<stages array<bigint>, duration_ms bigint>>, task_run_ms_total bigint, "
        "task_count_accepted bigint, skew struct<skew_avg_ratio double>, one_core_hours struct<used_pct double>, "
        "percentages struct<io_pct double>, lower_ms bigint, upper_ms bigint, task_count bigint, "
        "executor_ids array<string>, gc_pct double, stage_id bigint, metric_value double, run_ms array<bigint>"
    )
    rows = records.select("app_key", "kind", "position", "record", F.from_json("record", ddl).alias("r"))
    kind = F.col("kind")

    def either(cases: dict[str, str | Column]) -> Column:
        value = F.lit(None)
        for name, column in cases.items():
            value = F.when(kind == name, F.expr(column) if isinstance(column, str) else column).otherwise(value)
        return value

    settings = F.array_sort(F.map_entries(F.from_json("record", "map<string,string>")))
    pairs = F.array_join(F.transform(settings, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    levels = F.transform("r.parallel_groups", lambda g: F.array_join(g["stages"].cast("array<string>"), ","))
    span = F.aggregate("r.parallel_groups", F.lit(0).cast("bigint"), lambda total, g: total + g["duration_ms"])
    total = F.aggregate("r.run_ms", F.lit(0).cast("bigint"), lambda sum_ms, ms: sum_ms + ms)
    label = {
        "app": "r.name", "driver_intervals": "r.label", "environment": pairs, "job_timelines": F.array_join(levels, "|"),
        "stages": "r.name", "host_analysis": "r.host", "top_bottlenecks": "r.type",
    }
    n = {
        "app": "r.duration_ms", "cluster": "r.total_cores", "driver_analysis": "r.driver_time_ms",
        "driver_intervals": "r.duration_ms", "environment": F.size(settings), "jobs": "r.duration_ms",
        "job_timelines": F.size("r.parallel_groups"), "stages": "r.task_run_ms_total", "scalability_bounds": "r.lower_ms",
        "host_analysis": "r.task_count", "top_bottlenecks": "r.stage_id", "task_run_times": F.size("r.run_ms"),
    }
    amount = {
        "app": "r.start_ms", "cluster": "r.executor_count", "driver_analysis": "r.executor_time_ms",
        "driver_intervals": "r.end_ms", "jobs": F.size("r.stage_ids"), "job_timelines": span,
        "stages": "r.task_count_accepted", "scalability_bounds": "r.upper_ms", "host_analysis": F.size("r.executor_ids"),
        "task_run_times": total,
    }
    measures = [
        {"app": "r.driver_idle_pct", "cluster": "r.available_core_hours", "driver_analysis": "r.driver_pct",
         "stages": "r.skew.skew_avg_ratio", "host_analysis": "r.gc_pct", "top_bottlenecks": "r.metric_value"},
        {"app": "r.duration_min", "cluster": "r.used_core_hours", "driver_analysis": "r.executor_pct",
         "stages": "r.one_core_hours.used_pct"},
        {"cluster": "r.cluster_utilization_pct", "stages": "r.percentages.io_pct"},
    ]
    return rows.select(
        "app_key",
        "kind",
        "position",
        F.coalesce(either(label), F.lit("")).alias("label"),
        either(n).cast("bigint").alias("n"),
        either(amount).cast("bigint").alias("amount"),
        *(scaled(either(m)).alias(f"m{i}_x1000") for i, m in enumerate(measures, 1)),
    )


@query(
    "agg_reduction_size",
    """
select o_orderkey as app_key, o_custkey * 3 as archive_bytes, strlen(o_orderpriority) * 100 as report_bytes,
  greatest(0, o_custkey * 3 - strlen(o_orderpriority) * 100) as saved_bytes from orders""",
)
def agg_reduction_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    sizes = rows.select(
        F.col("o_orderkey").alias("app_key"), (F.col("o_custkey") * 3).alias("archive_bytes")
    )
    texts = rows.select(
        F.col("o_orderkey").alias("app_key"), F.repeat("o_orderpriority", F.lit(100)).alias("text")
    )
    return L.reduction_size(sizes, texts)
