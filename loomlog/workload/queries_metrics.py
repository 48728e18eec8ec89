"""Registered queries: aggregations, windows, rankings, set operations, graphs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.scalars import scaled
from loomlog.functions.text import collapse_runs
from loomlog.operators import (
    apps,
    attempts,
    bottlenecks,
    graph,
    groups,
    intervals,
    ranks,
    rollups,
    snippets,
    stages,
)
from loomlog.operators.numbering import numbered
from loomlog.session import fresh_dir, materialize
from loomlog.spread import at_least_cores
from loomlog.streaming.stage_tasks import Snapshots, rollup_lines
from loomlog.workload.oracle_views import ALL_SUMS, STAGE_SUMS, pct, ratio, sc
from loomlog.workload.registry import query
from loomlog.workload.views import prepared_lines, prepared_log, stored_table, table

KEYS = ["app_key", "stage_id"]


def x(columns: dict[str, int]) -> list:
    """Scaled integer columns ``<name>_x<factor>``."""
    return [scaled(c, f).alias(f"{c}_x{f}") for c, f in columns.items()]


def xs(columns: dict[str, int]) -> str:
    return ", ".join(f"{sc(c, f)} as {c}_x{f}" for c, f in columns.items())


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage table: it costs passes over all tasks, so the log's queries share one copy."""
    return stored_table(spark, sf_dir, "stages", stages.stage_table)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    return stages.stage_report(_stages(spark, sf_dir), apps.cluster_capacity(log))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    return intervals.driver_split(_stages(spark, sf_dir), apps.app_meta(log))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(
        spark, sf_dir, "metrics", lambda log: rollups.stage_metrics(log.tasks, log.stage_events)
    )


# --- aggregations --------------------------------------------------------------------------

ALL_COLUMNS = [
    "num_tasks",
    "dur_sum_ms",
    "dur_min_ms",
    "dur_max_ms",
    "shuffle_read_bytes",
    "sw_time_ms",
    "cpu_ms",
    "peak_mem_bytes",
    *ALL_SUMS,
]


@query(
    "agg_stage_tasks_all",
    f"select app_key, stage_id, {', '.join(ALL_COLUMNS)} from o_stage_all",
)
def agg_stage_tasks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.stage_tasks_all(prepared_log(spark, sf_dir).tasks).select(*KEYS, *ALL_COLUMNS)


@query(
    "stream_stage_tasks",
    f"select app_key, stage_id, {', '.join(ALL_COLUMNS)} from o_stage_all",
)
def stream_stage_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup as a stream over the log's files, stopped after a batch and taken up again."""
    lines = prepared_lines(spark, sf_dir)
    files = lines.inputFiles()
    raw = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", -(-len(files) // 3))
    rows = rollup_lines(raw.parquet(os.path.dirname(files[0]))).select(*KEYS, *ALL_COLUMNS)
    snapshots = Snapshots(fresh_dir(spark, "stream"))
    first = snapshots.start(rows)
    while snapshots.latest is None and not first.awaitTermination(1):
        pass
    first.stop()
    snapshots.start(rows).awaitTermination()
    return snapshots.read(spark)


ACCEPTED = [*STAGE_SUMS, "n_accepted", "n_filtered", "min_task_ms", "max_task_ms", "peak_mem_bytes"]


@query(
    "agg_stage_tasks_accepted",
    f"select app_key, stage_id, {', '.join(ACCEPTED)} from o_acc",
)
def agg_stage_tasks_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    state = attempts.stage_state(log.stage_events)
    marked = attempts.mark_tasks(log.tasks, state, keep_salt=True)
    return rollups.stage_tasks_accepted(marked).select(*KEYS, *ACCEPTED)


@query("agg_stage_p95", "select app_key, stage_id, dur_p95_ms from o_p95")
def agg_stage_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.stage_p95(prepared_log(spark, sf_dir).tasks)


@query(
    "agg_stage_ratios",
    f"""
select app_key, stage_id, {sc(ratio('dur_sum_ms', 'num_tasks'))} as dur_avg_ms_x1000,
  {sc(ratio('dur_max_ms', ratio('dur_sum_ms', 'num_tasks')))} as skew_ratio_x1000,
  {sc(ratio('cpu_ms', 'dur_sum_ms'))} as cpu_efficiency_x1000,
  {sc(ratio('gc_ms', 'dur_sum_ms') + ' * 100')} as gc_overhead_pct_x1000,
  {sc(ratio('deser_ms', 'dur_sum_ms') + ' * 100')} as deser_overhead_pct_x1000,
  {sc(ratio('result_bytes', 'num_tasks') + ' / 1024')} as avg_result_kb_x1000 from o_stage_all""",
)
def agg_stage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.stage_ratios(rollups.stage_tasks_all(prepared_log(spark, sf_dir).tasks))
    names = (
        "dur_avg_ms skew_ratio cpu_efficiency gc_overhead_pct deser_overhead_pct avg_result_kb"
    ).split()
    return rows.select(*KEYS, *x(dict.fromkeys(names, 1000)))


@query(
    "agg_executor",
    f"""
select app_key, executor_id, host, cores, tasks, run_ms, gc_ms, cpu_ms,
  {xs({'gc_pct': 100, 'cpu_efficiency': 1000})} from o_executor_summary""",
)
def agg_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    return rollups.executor_summary(log.tasks, log.executor_events).select(
        "app_key", "executor_id", "host", "cores", "tasks", "run_ms", "gc_ms", "cpu_ms",
        *x({"gc_pct": 100, "cpu_efficiency": 1000}),
    )


@query(
    "agg_job_efficiency",
    f"""
select app_key, {sc(ratio('cpu', 'run'))} as cpu_efficiency_x1000,
  {sc(ratio('gc', 'run') + ' * 100')} as gc_overhead_pct_x1000,
  {sc(ratio('deser', 'run') + ' * 100')} as deser_overhead_pct_x1000
from (select app_key, cast(sum(cpu_ms) as bigint) as cpu, cast(sum(gc_ms) as bigint) as gc,
    cast(sum(deser_ms) as bigint) as deser, cast(sum(run_ms) as bigint) as run
  from o_executor group by app_key) t""",
)
def agg_job_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("cpu_efficiency", "gc_overhead_pct", "deser_overhead_pct")
    rows = rollups.job_efficiency(prepared_log(spark, sf_dir).tasks)
    return rows.select("app_key", *x(dict.fromkeys(names, 1000)))


SUMMARY = (
    "num_stages num_tasks total_duration_ms executor_count executor_memory_mb executor_overhead_mb "
    "executor_offheap_mb executor_cores sql_execution_count total_input_bytes total_output_bytes "
    "total_shuffle_read_bytes total_shuffle_write_bytes"
).split()


@query("agg_app_summary", "select app_key, app_id, app_name, " + ", ".join(SUMMARY) + " from o_summary")
def agg_app_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = apps.app_summary(log, rollups.stage_tasks_all(log.tasks))
    return rows.select("app_key", "app_id", "app_name", *SUMMARY)


GROUP_SUMS = (
    "first_stage_id n_stages total_tasks total_duration_ms total_input_bytes total_output_bytes "
    "total_shuffle_read_bytes total_shuffle_write_bytes total_disk_spill_bytes total_mem_spill_bytes "
    "total_gc_ms worst_disk_spill_bytes peak_mem_bytes"
).split()
GROUP_SCALED = {
    "skew_ratio_min": 100,
    "skew_ratio_avg": 100,
    "skew_ratio_max": 100,
    "worst_gc_pct": 100,
    "worst_cpu_efficiency": 1000,
}


@query(
    "agg_stage_group",
    f"""
select g.app_key, g.group_name, {', '.join(GROUP_SUMS)}, {xs(GROUP_SCALED)},
  coalesce(m.n, 0) as n_anomalies
from o_group g left join (select app_key, group_name, count(*) as n from o_message group by 1, 2) m
  using (app_key, group_name)""",
)
def agg_stage_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups.stage_groups(_metrics(spark, sf_dir))
    return rows.select("app_key", "group_name", *GROUP_SUMS, *x(GROUP_SCALED), "n_anomalies")


@query(
    "agg_stage_group_ids",
    """
select app_key, group_name, (rn - 1) // 1000 as part, string_agg(cast(stage_id as string), ',' order by stage_id) as stage_ids
from (select *, row_number() over (partition by app_key, group_name order by stage_id) as rn from o_grouped) t
group by 1, 2, 3""",
)
def agg_stage_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    known = rollups.join_stage_info(log.tasks.select(*KEYS).distinct(), log.stage_events)
    ids = F.array_join(F.transform("stage_ids", lambda s: s.cast("string")), ",")
    return groups.group_stage_ids(known).withColumn("stage_ids", ids)


HOST = "tasks run_ms max_task_ms gc_ms shuffle_read_bytes shuffle_write_bytes input_bytes disk_spill_bytes avg_task_ms".split()


@query(
    "agg_host",
    f"""
select app_key, host, tasks, run_ms, max_task_ms, gc_ms, shuffle_read_bytes, shuffle_write_bytes,
  input_bytes, disk_spill_bytes, run_ms // tasks as avg_task_ms, {sc(pct('gc_ms', 'run_ms'))} as gc_pct_x1000,
  n_executors, part, executor_ids
from (select o.app_key, coalesce(o.host, r.host, 'unknown') as host, count(*) as tasks,
    cast(sum(run_ms) as bigint) as run_ms, max(run_ms) as max_task_ms, cast(sum(gc_ms) as bigint) as gc_ms,
    cast(sum(case when sr_total_bytes > 0 then sr_total_bytes else sr_remote_bytes + sr_local_bytes end) as bigint)
      as shuffle_read_bytes,
    cast(sum(sw_bytes) as bigint) as shuffle_write_bytes, cast(sum(input_bytes) as bigint) as input_bytes,
    cast(sum(disk_spill_bytes) as bigint) as disk_spill_bytes, count(distinct executor_id) as n_executors
  from o_task o left join o_registry r using (app_key, executor_id) where good and not stale group by 1, 2) t
join (select app_key, host, (rn - 1) // 1000 as part, string_agg(executor_id, ',' order by executor_id) as executor_ids
  from (select *, row_number() over (partition by app_key, host order by executor_id) as rn from (
    select distinct o.app_key, coalesce(o.host, r.host, 'unknown') as host, executor_id
    from o_task o left join o_registry r using (app_key, executor_id) where good and not stale) p) n
  group by 1, 2, 3) e using (app_key, host)""",
)
def agg_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    marked = attempts.mark_tasks(log.tasks, attempts.stage_state(log.stage_events))
    totals, lists = rollups.host_tables(marked, log.executor_events)
    rows = totals.hint("merge").join(lists, ["app_key", "host"])
    ids = F.array_join("executor_ids", ",").alias("executor_ids")
    return rows.select("app_key", "host", *HOST, *x({"gc_pct": 1000}), "n_executors", "part", ids)


@query(
    "agg_app_meta",
    """
select a.app_key, a.app_id, a.app_name, a.start_ms, a.end_ms, a.duration_ms, a.cores as executor_cores,
  a.memory_mb as executor_memory_mb, a.n_added as executor_count, p.root as first_root
from o_app a left join (select app_key, arg_min(root, seq) as root from o_execution group by app_key) p using (app_key)
union all
select app_key, 'unknown', 'unknown', 0, 0, 0, 0, 0, 0, root
from o_only_plan left join (select app_key, arg_min(root, seq) as root from o_execution group by app_key) p using (app_key)""",
)
def agg_app_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    root = F.get_json_object("plan_json", "$.nodeName").alias("first_root")
    plans = apps.first_plans(log).select("app_key", root)
    rows = apps.app_meta(log).join(plans, "app_key", "left")
    return rows.select(
        "app_key", "app_id", "app_name", "start_ms", "end_ms", "duration_ms", "executor_cores",
        "executor_memory_mb", "executor_count", "first_root",
    )


@query(
    "agg_env_merged",
    """
select app_key, key, arg_max(value, seq) as value from v_env
where key in ('spark.executor.memory', 'spark.executor.cores', 'spark.sql.shuffle.partitions') group by 1, 2""",
)
def agg_env_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps.env_settings(prepared_log(spark, sf_dir).env_events)


@query(
    "agg_jobs",
    """
select j.app_key, j.job_id, j.start_ms, j.end_ms, greatest(0, j.end_ms - j.start_ms) as duration_ms,
  s.stage_ids
from v_job j join (select app_key, job_id, string_agg(cast(stage_id as string), ',' order by stage_id) as stage_ids
  from v_job_stage group by 1, 2) s using (app_key, job_id)""",
)
def agg_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apps.jobs(prepared_log(spark, sf_dir))
    ids = F.array_join(F.transform("stage_ids", lambda s: s.cast("string")), ",")
    return rows.withColumn("stage_ids", ids)


@query(
    "agg_cluster_capacity",
    f"""
select c.app_key, peak_executors, cores_per_executor, total_cores, memory_mb, overhead_mb, available_core_ms,
  u.used as used_core_ms, {sc('available_core_ms / 3600000.0e0')} as available_core_hours_x1000,
  {sc('u.used / 3600000.0e0')} as used_core_hours_x1000, {sc(pct('u.used', 'available_core_ms'))} as utilization_pct_x1000
from o_cluster c join (select app_key, cast(sum(run_ms) as bigint) as used from o_stage group by app_key) u
  using (app_key)
union all select app_key, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0 from o_only_plan""",
)
def agg_cluster_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    cluster = apps.cluster_capacity(log)
    rows = apps.cluster_report(cluster, _stages(spark, sf_dir))
    return rows.select(
        "app_key", "peak_executors", "cores_per_executor", "total_cores", "memory_mb", "overhead_mb",
        "available_core_ms", "used_core_ms",
        *x(dict.fromkeys(("available_core_hours", "used_core_hours", "utilization_pct"), 1000)),
    )


@query(
    "agg_core_hours",
    f"select app_key, stage_id, total_cores * wall_ms as available_ms, {xs({'used_pct': 1000, 'wasted_pct': 1000})} from o_report",
)
def agg_core_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)
    return rows.select(*KEYS, "available_ms", *x({"used_pct": 1000, "wasted_pct": 1000}))


SKEW = dict.fromkeys(("avg_task_ms", "task_skew", "skew_avg_ratio", "stage_skew", "p_ratio"), 1000)


@query(
    "agg_stage_skew",
    f"select app_key, stage_id, min_task_ms, median_task_ms, max_task_ms, {xs(SKEW)} from o_report",
)
def agg_stage_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir)
    return rows.select(*KEYS, "min_task_ms", "median_task_ms", "max_task_ms", *x(SKEW))


@query(
    "agg_stage_io",
    f"""
select app_key, stage_id, input_bytes + shuffle_read_bytes as input_total_bytes,
  output_bytes + shuffle_write_bytes as output_total_bytes,
  {sc(ratio('output_bytes + shuffle_write_bytes', 'input_bytes + shuffle_read_bytes'))} as oi_ratio_x1000 from o_stage""",
)
def agg_stage_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.io(_stages(spark, sf_dir))
    return rows.select(*KEYS, "input_total_bytes", "output_total_bytes", *x({"oi_ratio": 1000}))


TIMES = dict.fromkeys(("gc_pct", "shuffle_write_pct", "fetch_wait_pct", "cpu_pct"), 1000)


@query("agg_time_distribution", f"select app_key, stage_id, {xs(TIMES)} from o_report")
def agg_time_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.time_distribution(_stages(spark, sf_dir))
    return rows.select(*KEYS, *x(TIMES))


SHARES = dict.fromkeys(("wall_clock_pct", "task_runtime_pct", "io_pct"), 1000)


@query("agg_stage_shares", f"select app_key, stage_id, {xs(SHARES)} from o_report")
def agg_stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(*KEYS, *x(SHARES))


@query(
    "agg_ideal_wall",
    "select app_key, stage_id, case when total_cores > 0 then run_ms // total_cores else run_ms end as ideal_wall_ms from o_report",
)
def agg_ideal_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select(*KEYS, "ideal_wall_ms")


@query(
    "agg_driver_idle",
    f"""
select app_key, duration_ms, job_ms, idle_ms, {sc(pct('idle_ms', 'duration_ms'))} as driver_idle_pct_x1000
from (select a.app_key, a.duration_ms, j.job_ms, greatest(0, a.duration_ms - j.job_ms) as idle_ms
  from o_app a join (select app_key, cast(sum(greatest(0, end_ms - start_ms)) as bigint) as job_ms
    from v_job group by app_key) j using (app_key)) t
union all select app_key, 0, 0, 0, 0 from o_only_plan""",
)
def agg_driver_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    meta = apps.app_meta(log)
    rows = apps.driver_idle(meta, apps.jobs(log))
    return rows.select("app_key", "duration_ms", "job_ms", "idle_ms", *x({"driver_idle_pct": 1000}))


@query(
    "executor_homogeneity",
    f"""
select app_key, n_executors, total_tasks, {sc('gc_mean')} as gc_mean_x1000, {sc('cpu_mean')} as cpu_mean_x1000,
  n_executors > 2 and far_gc <= greatest(gc_mean * 0.1e0, 0.5e0)
    and far_cpu <= greatest(cpu_mean * 0.1e0, 0.05e0) as uniform
from (select s.app_key, m.n_executors, m.total_tasks, m.gc_mean, m.cpu_mean,
    max(abs(s.gc_pct - m.gc_mean)) as far_gc, max(abs(s.cpu_efficiency - m.cpu_mean)) as far_cpu
  from o_executor_summary s join (select app_key, count(*) as n_executors, cast(sum(tasks) as bigint) as total_tasks,
      avg(gc_pct) as gc_mean, avg(cpu_efficiency) as cpu_mean from o_executor_summary group by app_key) m
    using (app_key) group by 1, 2, 3, 4, 5) t""",
)
def executor_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = rollups.executor_homogeneity(rollups.executor_summary(log.tasks, log.executor_events))
    return rows.select(
        "app_key", "n_executors", "total_tasks", *x({"gc_mean": 1000, "cpu_mean": 1000}), "uniform"
    )


@query(
    "agg_kpis",
    f"""
select a.app_key, {sc('(a.end_ms - a.start_ms) / 60000.0e0')} as duration_min_x1000,
  {sc('s.i / 1073741824.0e0', 1000000)} as input_gb_x1000000, s.n as total_tasks,
  {sc('s.i::double / s.n / 1024.0e0')} as kb_per_task_x1000, s.i::double / s.n / 1024.0e0 < 1024 as kb_per_task_critical,
  s.n_skew as stages_with_skew, {sc('s.ds / 1073741824.0e0', 1000000)} as disk_spill_gb_x1000000,
  {sc('s.ms / 1073741824.0e0', 1000000)} as mem_spill_gb_x1000000,
  {sc('s.w / 1073741824.0e0', 1000000)} as shuffle_write_gb_x1000000, coalesce(t.n, 0) as stages_with_failure_or_retry
from o_app a join (select app_key, cast(sum(input_bytes) as bigint) as i, cast(sum(num_tasks) as bigint) as n,
    cast(count(*) filter (where has_skew) as bigint) as n_skew, cast(sum(disk_spill_bytes) as bigint) as ds,
    cast(sum(mem_spill_bytes) as bigint) as ms, cast(sum(shuffle_write_bytes) as bigint) as w
  from o_flags group by app_key) s using (app_key)
left join (select app_key, count(distinct stage_id) as n from v_task where failed or attempt_id > 0 group by app_key) t
  using (app_key)
union all select app_key, 0, 0, 0, 0, true, 0, 0, 0, 0, 0 from o_only_plan""",
)
def agg_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = _metrics(spark, sf_dir)
    summary = apps.app_summary(log, rows)
    troubled = bottlenecks.failed_or_retried_stages(log.tasks, log.stage_events)
    kpis = bottlenecks.kpis(summary, rows, troubled)
    volumes = ("input_gb", "disk_spill_gb", "mem_spill_gb", "shuffle_write_gb")
    return kpis.select(
        "app_key", "total_tasks", "kb_per_task_critical", "stages_with_skew",
        "stages_with_failure_or_retry",
        *x({"duration_min": 1000, "kb_per_task": 1000, **dict.fromkeys(volumes, 1_000_000)}),
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    table_rows = _stages(spark, sf_dir)
    report = materialize(
        stages.stage_report(table_rows, apps.cluster_capacity(log)), "report"
    )
    split = intervals.driver_split(table_rows, apps.app_meta(log))
    return bottlenecks.all_findings(report, split)


@query(
    "agg_health_score",
    """
select app_key, n_critical, n_attention, greatest(0, 100 - 15 * n_critical - 4 * n_attention) as score
from (select a.app_key, cast(count(*) filter (where f.severity = 'critical') as bigint) as n_critical,
    cast(count(*) filter (where f.severity = 'attention') as bigint) as n_attention
  from (select app_key from v_app union all select app_key from o_only_plan) a left join o_finding f using (app_key) group by 1) t""",
)
def agg_health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = prepared_log(spark, sf_dir).apps
    return bottlenecks.health_score(meta, _findings(spark, sf_dir))


# --- windows -------------------------------------------------------------------------------


@query(
    "win_rank_select",
    """
select l_suppkey, max(case when rn = n // 2 + 1 then v end) as median_v,
  max(case when rn = cast(floor(0.95e0 * n) as bigint) + 1 then v end) as p95_v,
  max(case when rn = 1 then v end) as first_v, max(case when rn = n then v end) as last_v
from (select l_suppkey, v, row_number() over (partition by l_suppkey order by v) as rn,
    count(*) over (partition by l_suppkey) as n
  from (select case when l_suppkey % 3 = 0 then 0 else l_suppkey end as l_suppkey,
      cast(floor(l_extendedprice) as bigint) - 20000 as v from lineitem) a) t group by 1""",
)
def win_rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("l_suppkey"),
        (F.floor("l_extendedprice") - 20000).alias("v"),
    )
    picks = {
        "median_v": ranks.upper_median,
        "p95_v": ranks.p95,
        "first_v": lambda n: F.lit(0),
        "last_v": lambda n: n - 1,
    }
    return ranks.rank_select(rows, ["l_suppkey"], "v", picks)


@query("win_peak_concurrency", "select app_key, peak from o_peak")
def win_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps.peak_concurrency(prepared_log(spark, sf_dir).executor_events, ["app_key"])


EVENT_MS = "cast(floor(epoch_us(ts) / 1000.0e0) as bigint)"


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: value tells the length; a third of them share one type."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.floor(micros / F.lit(1000.0)).cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_type", start.alias("start_ms"), (start + F.floor(F.col("value") * 10000)).alias("end_ms")
    )


@query(
    "win_peak_concurrency_events",
    f"""
select event_type, cast(max(s) as bigint) as peak
from (select event_type, sum(d) over (partition by event_type order by t, d desc
    rows between unbounded preceding and current row) as s
  from (select event_type, {EVENT_MS} as t, 1 as d from events
    union all select event_type, {EVENT_MS} + cast(floor(value * 10000) as bigint), -1 from events) e) u group by 1""",
)
def win_peak_concurrency_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _event_spans(spark, sf_dir)
    marks = F.array(
        F.struct(F.lit("add").alias("kind"), F.col("start_ms").alias("ts_ms")),
        F.struct(F.lit("remove").alias("kind"), F.col("end_ms").alias("ts_ms")),
    )
    return apps.peak_concurrency(spans.select("event_type", F.inline(marks)), ["event_type"])


@query("win_interval_merge", "select app_key, start_ms, end_ms from o_island")
def win_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stages(spark, sf_dir)
    return intervals.merge_intervals(rows, ["app_key"], "start_ms", "end_ms")


@query(
    "win_interval_merge_events",
    f"""
select event_type, min(s) as start_ms, max(e) as end_ms
from (select event_type, s, e, sum(fresh) over (partition by event_type order by s, e
    rows between unbounded preceding and current row) as island
  from (select event_type, s, e, case when s <= max(e) over (partition by event_type order by s, e
      rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
    from (select event_type, {EVENT_MS} as s, {EVENT_MS} + cast(floor(value * 10000) as bigint) as e from events) a) b) c
group by event_type, island""",
)
def win_interval_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(
        _event_spans(spark, sf_dir), ["event_type"], "start_ms", "end_ms"
    )


@query(
    "win_driver_gaps",
    """
select app_key, 'inter_stage_gap' as label, prev as gap_start_ms, start_ms as gap_end_ms, start_ms - prev as gap_ms
from (select app_key, start_ms, lag(end_ms) over (partition by app_key order by start_ms) as prev from o_island) t
where prev is not null
union all
select a.app_key, 'pre_first_stage', a.start_ms, i.s, i.s - a.start_ms
from o_app a join (select app_key, min(start_ms) as s from o_island group by 1) i using (app_key) where a.start_ms < i.s
union all
select a.app_key, 'post_last_stage', i.e, a.end_ms, a.end_ms - i.e
from o_app a join (select app_key, max(end_ms) as e from o_island group by 1) i using (app_key) where i.e < a.end_ms""",
)
def win_driver_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    return intervals.driver_gaps(_stages(spark, sf_dir), apps.app_meta(log))


@query(
    "win_driver_split",
    f"""
select app_key, duration_ms, executor_time_ms, driver_time_ms, {xs({'driver_pct': 1000})},
  {sc('100.0e0 - driver_pct')} as executor_pct_x1000 from o_split
union all select app_key, 0, 0, 0, 0, 100000 from o_only_plan""",
)
def win_driver_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    return rows.select(
        "app_key", "duration_ms", "executor_time_ms", "driver_time_ms",
        *x({"driver_pct": 1000, "executor_pct": 1000}),
    )


@query(
    "win_attempt_state",
    """
select app_key, stage_id, attempt_id, seq, stale, kept, count(*) as n from o_task group by 1, 2, 3, 4, 5, 6""",
)
def win_attempt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    marked = attempts.mark_tasks(log.tasks, attempts.stage_state(log.stage_events))
    keys = [*KEYS, "attempt_id", "seq", "stale", "kept"]
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "win_stage_envelope",
    "select app_key, stage_id, start_ms, end_ms, wall_ms from o_envelope",
)
def win_stage_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stages(spark, sf_dir)
    return rows.select(*KEYS, "start_ms", "end_ms", "wall_ms")


@query(
    "win_run_collapse",
    """
select doc_id, string_agg(piece, chr(10) order by first_no) as collapsed
from (select doc_id, island, min(no) as first_no,
    case when count(*) <= 2 then array_to_string(list(line order by no), chr(10))
      else concat(min(line), chr(10), min(line), chr(10), '[... repeated line omitted ',
        cast(count(*) - 2 as string), ' times ...]') end as piece
  from (select *, sum(fresh) over (partition by doc_id order by no rows between unbounded preceding and current row) as island
    from (select *, case when line = lag(line) over (partition by doc_id order by no) then 0 else 1 end as fresh
      from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no
        from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as ls from documents) a) b) c) d
  group by doc_id, island) e
group by doc_id""",
)
def win_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = at_least_cores(table(spark, sf_dir, "documents"))
    return collapse_runs(documents, "text", "collapsed").select("doc_id", "collapsed")


# --- rankings and set operations -----------------------------------------------------------


@query("topk_wall_stages", "select app_key, stage_id, wall_ms, wall_rank from o_report where wall_rank <= 3")
def topk_wall_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.top_wall_stages(_stages(spark, sf_dir))
    return rows.select(*KEYS, "wall_ms", F.col("wall_rank").cast("bigint").alias("wall_rank"))


FINDING = {"metric_value": 1000, "score": 1000}


@query(
    "union_bottlenecks",
    f"select app_key, stage_id, detector, kind, severity, {xs(FINDING)} from o_finding",
)
def union_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir)
    return rows.select(*KEYS, F.col("detector").cast("bigint").alias("detector"), "kind", "severity", *x(FINDING))


RANKED = """select *, row_number() over (partition by app_key order by score desc,
  case when stage_id = -1 then 1 else 0 end, stage_id, detector) as finding_rank from o_finding"""


@query(
    "topk_bottlenecks",
    f"select app_key, finding_rank, kind, stage_id, {xs(FINDING)} from ({RANKED}) t where finding_rank <= 5",
)
def topk_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottlenecks.top_findings(_findings(spark, sf_dir))
    rank = F.col("finding_rank").cast("bigint").alias("finding_rank")
    return rows.select("app_key", rank, "kind", "stage_id", *x(FINDING))


@query(
    "win_bottleneck_rank",
    f"""
select app_key, finding_rank, kind, case kind
    when 'long_stage' then concat('Stage ', cast(stage_id as string), ' is one of the longest stages by wall clock.')
    when 'low_parallelism' then concat('Stage ', cast(stage_id as string), ' used only ',
      format('{{:.1f}}', metric_value), '% of available core time.')
    when 'driver_overhead' then concat('Driver (non-executor) time is ', format('{{:.1f}}', metric_value),
      '% of total application time (', severity, '). Adding executors has limited benefit.')
    when 'skew' then concat('Stage ', cast(stage_id as string), ' has ',
      case when severity = 'critical' then 'severe' else 'moderate' end, ' task skew (max/avg=',
      format('{{:.2f}}', metric_value), 'x).')
    when 'gc_pressure' then concat('Stage ', cast(stage_id as string), ' spent ', format('{{:.1f}}', metric_value),
      '% of executor time in JVM GC (', severity, ').')
    when 'shuffle_bound' then concat('Stage ', cast(stage_id as string), ' spent ', format('{{:.1f}}', metric_value),
      '% of executor time waiting on shuffle fetches (', severity, ').')
    when 'shuffle_heavy' then concat('Stage ', cast(stage_id as string), ' spent ', format('{{:.1f}}', metric_value),
      '% of executor time in shuffle waits/writes.')
    when 'spill' then concat('Stage ', cast(stage_id as string), ' spilled ', format('{{:.2f}}', metric_value),
      ' GB to disk (', severity, ').')
    else concat('Stage ', cast(stage_id as string), ' wasted ', format('{{:.1f}}', metric_value),
      '% of OneCoreComputeHours (', severity, ').') end as description
from ({RANKED}) t where finding_rank <= 12""",
)
def win_bottleneck_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottlenecks.describe(bottlenecks.top_findings(_findings(spark, sf_dir), 12))
    rank = F.col("finding_rank").cast("bigint").alias("finding_rank")
    return rows.select("app_key", rank, "kind", "description")


@query(
    "union_anomalies",
    """
select app_key, stage_id, 'skewed' as kind from o_flags where has_skew
union all select app_key, stage_id, 'disk_spill' from o_flags where has_spill
union all select app_key, stage_id, 'heavy_shuffle' from o_flags where has_heavy_shuffle
union all select app_key, stage_id, 'low_cpu' from o_flags where has_low_cpu""",
)
def union_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.anomaly_summary(_metrics(spark, sf_dir)).select(*KEYS, "kind")


@query(
    "limit_anomalies",
    """
select app_key, group_name, count(*) as n_anomalies, array_to_string(list(anomaly order by stage_id, pos)[1:10], '; ')
  as shown from o_message group by 1, 2""",
)
def limit_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups.first_anomalies(_metrics(spark, sf_dir), 10)
    return rows.select(
        "app_key", "group_name", "n_anomalies", F.array_join("anomalies", "; ").alias("shown")
    )


@query("distinct_stage_ids", "select distinct app_key, job_id, stage_id from v_job_stage")
def distinct_stage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apps.job_stages(apps.jobs(prepared_log(spark, sf_dir)))


@query(
    "sort_outputs",
    """
select kind, app_key, name, row_number() over (partition by kind, app_key order by number, name) as position from (
  select 'stage' as kind, app_key, stage_id as number, cast(stage_id as string) as name from o_stage
  union all select distinct 'job', app_key, job_id, cast(job_id as string) from v_job
  union all select distinct 'host', o.app_key, 0, coalesce(o.host, r.host, 'unknown')
    from o_task o left join o_registry r using (app_key, executor_id) where good and not stale
  union all select 'executor', app_key, 0, executor_id from o_executor
  union all select 'group', app_key, first_stage_id, group_name from o_group) t""",
)
def sort_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five ordered outputs: stages, jobs and groups by number, hosts and executors by name."""
    log = prepared_log(spark, sf_dir)
    marked = attempts.mark_tasks(log.tasks, attempts.stage_state(log.stage_events))

    def kind(name: str, rows: DataFrame, number: str, label: str) -> DataFrame:
        number = F.col(number) if number else F.lit(0)
        return rows.select(
            F.lit(name).alias("kind"), "app_key", number.cast("bigint").alias("number"), F.col(label).cast("string").alias("name")
        )

    rows = kind("stage", _stages(spark, sf_dir), "stage_id", "stage_id")
    rows = rows.unionByName(kind("job", apps.jobs(log), "job_id", "job_id"))
    rows = rows.unionByName(kind("host", rollups.host_rollup(marked, log.executor_events), "", "host"))
    rows = rows.unionByName(kind("executor", rollups.executor_rollup(log.tasks), "", "executor_id"))
    rows = rows.unionByName(kind("group", groups.stage_groups(_metrics(spark, sf_dir)), "first_stage_id", "group_name"))
    return numbered(rows, ["kind", "app_key"], ["number", "name"]).select("kind", "app_key", "name", "position")


# --- graphs --------------------------------------------------------------------------------


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = prepared_log(spark, sf_dir)
    job_rows = apps.jobs(log)
    state = attempts.stage_state(log.stage_events)
    return job_rows, graph.stage_levels(apps.job_stages(job_rows), state)


@query("graph_stage_levels", "select app_key, job_id, stage_id, level from o_level")
def graph_stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)[1].withColumn("level", F.col("level").cast("bigint"))


@query(
    "graph_parallel_groups",
    """
select app_key, job_id, level, string_agg(cast(stage_id as string), ',' order by stage_id) as stages,
  min(start_ms) as start_ms, max(end_ms) as end_ms, greatest(0, max(end_ms) - min(start_ms)) as duration_ms,
  min(start_ms) = 0 as has_skipped
from o_level join o_envelope using (app_key, stage_id) group by 1, 2, 3""",
)
def graph_parallel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    job_rows, levels = _levels(spark, sf_dir)
    spans = _stages(spark, sf_dir)
    rows = graph.parallel_groups(job_rows, levels, spans)
    ids = F.array_join(F.transform("stages", lambda s: s.cast("string")), ",")
    return rows.withColumn("stages", ids).withColumn("level", F.col("level").cast("bigint"))


@query(
    "graph_critical_path",
    """
select app_key, job_id, max(total) as work_ms from (
  with recursive w as (
    select s.app_key, s.job_id, s.stage_id, o.run_ms as total from v_job_stage s join o_stage o using (app_key, stage_id)
    where not exists (select 1 from o_stage_edge e where e.app_key = s.app_key and e.job_id = s.job_id and e.stage_id = s.stage_id)
    union all
    select e.app_key, e.job_id, e.stage_id, w.total + o.run_ms from w join o_stage_edge e
      on e.app_key = w.app_key and e.job_id = w.job_id and e.parent_id = w.stage_id
    join o_stage o on o.app_key = e.app_key and o.stage_id = e.stage_id)
  select * from w) t group by 1, 2""",
)
def graph_critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = _stages(spark, sf_dir)
    pairs = apps.job_stages(apps.jobs(log))
    return graph.critical_paths(pairs, rows, {"work_ms": F.col("run_ms")})


@query(
    "cross_whatif_grid",
    """
select app_key, pct, greatest(1, peak_executors * pct // 100) as target_executors
from (select app_key, peak_executors from o_cluster union all select app_key, 0 from o_only_plan) c,
  (select cast(unnest([10, 20, 50, 80, 100, 110, 120, 150, 200, 300, 400, 500]) as bigint) as pct) g""",
)
def cross_whatif_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    rows = graph.whatif_sizes(apps.cluster_capacity(log))
    return rows.select("app_key", "pct", "target_executors")


WHATIF = f"""
select app_key, pct, target_executors, lower_ms, upper_ms,
  {sc(pct('run_ms', 'lower_ms * target_executors * cores_per_executor'))} as utilization_hi_pct_x1000,
  {sc(pct('run_ms', 'upper_ms * target_executors * cores_per_executor'))} as utilization_lo_pct_x1000
from (select c.app_key, cast(p.pct as bigint) as pct, greatest(1, c.peak_executors * p.pct // 100) as target_executors,
    c.cores_per_executor, u.run_ms, greatest(0, c.duration_ms - j.job_ms) + p.lo as lower_ms,
    greatest(0, c.duration_ms - j.job_ms) + p.hi as upper_ms
  from o_cluster c join (select app_key, pct, cast(sum(lo) as bigint) as lo, cast(sum(hi) as bigint) as hi from (
      select app_key, job_id, pct, max(lo) as lo, max(hi) as hi from o_priced_walk group by 1, 2, 3) a group by 1, 2) p
    using (app_key)
  join (select app_key, cast(sum(run_ms) as bigint) as run_ms from o_stage group by 1) u using (app_key)
  join (select app_key, cast(sum(greatest(0, end_ms - start_ms)) as bigint) as job_ms from v_job group by 1) j
    using (app_key)) t
union all
select app_key, cast(unnest([10, 20, 50, 80, 100, 110, 120, 150, 200, 300, 400, 500]) as bigint), 1, 0, 0, 0, 0
from o_only_plan"""


@query("whatif_bound", WHATIF)
def whatif_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = prepared_log(spark, sf_dir)
    job_rows = apps.jobs(log)
    rows = graph.whatif_bounds(
        apps.cluster_capacity(log), job_rows, apps.job_stages(job_rows), _stages(spark, sf_dir)
    )
    return rows.select(
        "app_key", "pct", "target_executors", "lower_ms", "upper_ms",
        *x({"utilization_hi_pct": 1000, "utilization_lo_pct": 1000}),
    )


#: A file's first place that passes a test on line number i; lists count from 1.
_FIRST_PLACE = "list_filter(range(1, len(lines) + 1), lambda i: {})[1]"
_TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"
_SAME_BLOCK = "lines[i] = wanted[1] and lines[i : i + len(wanted) - 1] = wanted"
_NEAR = "lines[i] = wanted[1] and (len(wanted) = 1 or list_contains(lines[i + 1 : i + len(wanted) + 2], wanted[2]))"
_PART = (
    "length(lines[i]) >= 15 and len(list_filter(wanted, lambda t: length(t) >= 15"
    " and (contains(t, lines[i]) or contains(lines[i], substring(t, 1, 50))))) > 0"
)
SNIPPETS = f"""
select app_key, finding_no, arg_min(a, place) as line_start, arg_min(b, place) as line_end
from (select concat('app-', cast(app as string)) as app_key, finding_no, place,
    case when spot > 0 then at_line else first_line end as a,
    case when spot > 0 then at_line + breaks else first_line + len(wanted) - 1 end as b
  from (select *, len(string_split(substring(src, 1, spot - 1), chr(10))) as at_line,
      len(string_split(snippet, chr(10))) - 1 as breaks,
      case when spot = 0 and len(wanted) > 0 then coalesce({_FIRST_PLACE.format(_SAME_BLOCK)}, {_FIRST_PLACE.format(_NEAR)},
        {_FIRST_PLACE.format(_PART)}) end as first_line
    from (select f.app, f.finding_no, f.snippet, f.wanted, d.src, d.lines, case when d.ord = 2 then -1 else d.ord end as place,
        case when f.snippet <> '' then position(f.snippet in d.src) else 0 end as spot
      from (select app, finding_no, snippet,
          list_filter(list_transform(string_split(snippet, chr(10)), lambda x: {_TRIMMED.format('x')}), lambda x: x <> '') as wanted
        from (select app, ord as finding_no, trim(replace(case ord when 0 then quoted
              when 1 then concat('  ', replace(quoted, chr(10), concat('  ', chr(10), chr(10), ' ')))
              when 2 then concat(parts[1], chr(10), 'no such line') else concat('# ', substring(parts[-1], 1, 200), ' #') end,
            concat(chr(13), chr(10)), chr(10)), chr(10)) as snippet
          from (select *, array_to_string(parts[greatest(len(parts) // 2, 1) : greatest(len(parts) // 2, 1) + 2], chr(10)) as quoted
            from (select doc_id // 4 as app, doc_id % 4 as ord, string_split(text, chr(10)) as parts from documents) x) y) z) f
      join (select app, ord, src, list_transform(string_split(src, chr(10)), lambda x: {_TRIMMED.format('x')}) as lines
        from (select doc_id // 4 as app, doc_id % 4 as ord, replace(text, concat(chr(13), chr(10)), chr(10)) as src from documents) x) d
        on f.app = d.app) pairs) hits) found
where a is not null group by 1, 2"""


@query(
    "join_snippet_lines",
    f"""
select k.app_key, k.finding_no, h.line_start, h.line_end
from (select concat('app-', cast(doc_id // 4 as string)) as app_key, doc_id % 4 as finding_no from documents) k
left join ({SNIPPETS}) h on k.app_key = h.app_key and k.finding_no = h.finding_no""",
)
def join_snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files, four per report, quoted in different ways."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("app-"), F.floor(F.col("doc_id") / 4).cast("string")).alias("app_key"),
        F.concat(F.lit("f"), (F.col("doc_id") % 4).cast("string"), F.lit(".py")).alias("file_name"),
        (F.col("doc_id") % 4).alias("file_ord"),
        "text",
    )
    parts = F.split("text", "\n", -1)
    middle = F.floor(F.size(parts) / 2).cast("int")
    quoted = F.array_join(F.slice(parts, F.greatest(middle, F.lit(1)), F.lit(3)), "\n")
    snippet = (
        F.when(F.col("file_ord") == 0, quoted)
        .when(F.col("file_ord") == 1, F.concat(F.lit("  "), F.replace(quoted, F.lit("\n"), F.lit("  \n\n "))))
        .when(F.col("file_ord") == 2, F.concat(F.element_at(parts, 1), F.lit("\nno such line")))
        .otherwise(F.concat(F.lit("# "), F.substring(F.element_at(parts, -1), 1, 200), F.lit(" #")))
    )
    finding = F.struct(
        F.col("file_ord").cast("int").alias("finding_no"),
        snippet.alias("snippet"),
        F.lit("main").alias("function_name"),
    )
    # Four files per report by construction, so the list is bounded.
    reports = documents.groupBy("app_key").agg(
        F.lit("f2.py").alias("job_file"), F.array_sort(F.collect_list(finding)).alias("findings")
    )
    return snippets.locate_snippets(reports, documents)
