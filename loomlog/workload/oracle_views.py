"""Reference results in DuckDB SQL: intermediate views, written with windows and subqueries.

They read the derived log views directly and share no expression with the operators.
"""

from __future__ import annotations


def pct(n: str, d: str) -> str:
    return f"(case when ({d}) > 0 then ({n}) * 100.0e0 / ({d})::double else 0.0e0 end)"


def ratio(n: str, d: str) -> str:
    return f"(case when ({d}) > 0 then ({n})::double / ({d})::double else 0.0e0 end)"


def rounded(x: str, digits: int) -> str:
    """Correct decimal rounding through text, ties of the exact value to even."""
    return f"cast(format('{{{{:.{digits}f}}}}', {x}) as double)"


def sc(x: str, factor: int = 1000) -> str:
    return f"cast(floor(({x}) * {factor}.0e0 + 0.5e0) as bigint)"


def bytes_text(b: str) -> str:
    cases = " ".join(
        f"when ({b}) < {1024 ** (i + 1)} then format('{{{{:.1f}}}} {u}', ({b}) / {float(1024**i)}e0)"
        for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))
    )
    return f"(case {cases} else format('{{{{:.1f}}}} PB', ({b}) / {float(1024**5)}e0) end)"


def ms_text(m: str) -> str:
    return (
        f"(case when ({m}) < 1000 then concat(cast({m} as string), ' ms') when ({m}) < 60000"
        f" then format('{{{{:.1f}}}} s', ({m}) / 1000.0e0) else format('{{{{:.1f}}}} min', ({m}) / 60000.0e0) end)"
    )


def plain_text(x: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{{{:.3f}}}}', {x}), '0{{{{1,2}}}}$', ''), '\\.$', '.0')"


def texts(*lines: str) -> str:
    """Lines of one row, numbered from 0."""
    return f"unnest(range({len(lines)})) as line_no, unnest([{', '.join(lines)}]) as text"


def share_row(label: str, total: str, text) -> str:
    return f"concat('| {label} | ', {text(total)}, ' | ', {text(total + ' // n_stages')}, ' |')"


def thousands(x: str) -> str:
    return f"format('{{{{:,}}}}', {x})"


def big(**columns: str) -> str:
    return ", ".join(f"cast({expr} as bigint) as {name}" for name, expr in columns.items())


ALL_SUMS = {
    "input_bytes": "input_bytes",
    "output_bytes": "output_bytes",
    "shuffle_write_bytes": "sw_bytes",
    "gc_ms": "gc_ms",
    "mem_spill_bytes": "mem_spill_bytes",
    "disk_spill_bytes": "disk_spill_bytes",
    "fetch_wait_ms": "fetch_wait_ms",
    "deser_ms": "deser_ms",
    "result_bytes": "result_bytes",
    "remote_to_disk_bytes": "sr_remote_disk_bytes",
    "sr_records": "sr_records",
    "sw_records": "sw_records",
    "input_records": "input_records",
    "output_records": "output_records",
    "minor_gc": "minor_gc",
    "major_gc": "major_gc",
    "tem_gc_ms": "tem_gc_ms",
}
READ = "case when sr_total_bytes > 0 then sr_total_bytes else sr_remote_bytes + sr_local_bytes end"
STAGE_SUMS = (
    "input_bytes output_bytes shuffle_read_bytes shuffle_write_bytes gc_ms mem_spill_bytes "
    "disk_spill_bytes fetch_wait_ms deser_ms result_bytes run_ms sw_time_ns cpu_ns ser_ms"
).split()

GROUP_NAME = (
    r"trim(regexp_replace(regexp_replace({0}, '\s+at\s+\S+$', ''), '\s*\(\d+\)\s*$', ''))"
)

ORACLE_VIEWS = {
    "o_stage_edge": """
select s.app_key, s.job_id, s.stage_id, s.stage_id - e.d as parent_id
from v_job_stage s join (
  select 1 as k, 1 as d union all select 2, 2 union all select 3, 1 union all select 3, 2
  union all select 5, 1 union all select 5, 2 union all select 6, 1 union all select 7, 1
  union all select 7, 4) e on s.stage_id % 8 = e.k and s.stage_id < 100
where exists (select 1 from v_job_stage p where p.app_key = s.app_key and p.job_id = s.job_id
  and p.stage_id = s.stage_id - e.d)""",
    "o_stage_all": "select app_key, stage_id, "
    + big(
        num_tasks="count(*)",
        dur_sum_ms="sum(finish_ms - launch_ms)",
        dur_min_ms="min(finish_ms - launch_ms)",
        dur_max_ms="max(finish_ms - launch_ms)",
        shuffle_read_bytes="sum(sr_total_bytes)",
        sw_time_ms="sum(sw_time_ns // 1000000)",
        cpu_ms="sum(cpu_ns // 1000000)",
        peak_mem_bytes="max(peak_mem_bytes)",
        **{name: f"sum({c})" for name, c in ALL_SUMS.items()},
    )
    + " from v_task group by app_key, stage_id",
    "o_p95": """
select app_key, stage_id, max(case when rn = cast(floor(0.95e0 * n) as bigint) + 1 then d end) as dur_p95_ms
from (select app_key, stage_id, finish_ms - launch_ms as d,
    row_number() over (partition by app_key, stage_id order by finish_ms - launch_ms) as rn,
    count(*) over (partition by app_key, stage_id) as n from v_task) t
group by app_key, stage_id""",
    "o_completed": """
select app_key, stage_id, stage_name, completion_ms - submission_ms as duration_ms
from (select *, row_number() over (partition by app_key, stage_id order by seq desc) as rn
  from v_stage_event where kind = 'completed') t where rn = 1""",
    "o_metrics": f"""
select a.*, coalesce(c.stage_name, concat('Stage ', cast(a.stage_id as string))) as stage_name,
  coalesce(c.duration_ms, 0) as duration_ms, p.dur_p95_ms,
  {rounded(ratio('a.dur_sum_ms', 'a.num_tasks'), 1)} as dur_avg_ms,
  {rounded(ratio('a.dur_max_ms', ratio('a.dur_sum_ms', 'a.num_tasks')), 2)} as skew_ratio,
  {rounded(ratio('a.cpu_ms', 'a.dur_sum_ms'), 3)} as cpu_efficiency,
  {rounded(ratio('a.gc_ms', 'a.dur_sum_ms') + ' * 100', 2)} as gc_overhead_pct
from o_stage_all a left join o_completed c using (app_key, stage_id)
  left join o_p95 p using (app_key, stage_id)""",
    "o_flags": """
select *, skew_ratio > 3.0e0 as has_skew, disk_spill_bytes > 0 as has_spill,
  shuffle_read_bytes + shuffle_write_bytes > 524288000 as has_heavy_shuffle,
  cpu_efficiency < 0.1e0 and num_tasks >= 10 as has_low_cpu from o_metrics""",
    "o_grouped": "select *, " + GROUP_NAME.format("stage_name") + " as group_name from o_flags",
    "o_message": """
select app_key, group_name, stage_id, 0 as pos,
  concat('skew=', format('{{:.1f}}', skew_ratio), 'x in stage ', cast(stage_id as string)) as anomaly
from o_grouped where has_skew
union all
select app_key, group_name, stage_id, 1, concat('disk_spill=',
  format('{{:.0f}}', disk_spill_bytes / 1048576.0e0), 'MB in stage ', cast(stage_id as string))
from o_grouped where has_spill
union all
select app_key, group_name, stage_id, 2, concat('gc=', format('{{:.1f}}', gc_overhead_pct),
  '% in stage ', cast(stage_id as string)) from o_grouped where gc_overhead_pct > 5.0e0
union all
select app_key, group_name, stage_id, 3, concat('low_cpu=', format('{{:.3f}}', cpu_efficiency),
  ' in stage ', cast(stage_id as string)) from o_grouped where has_low_cpu""",
    "o_group": "select app_key, group_name, "
    + big(
        first_stage_id="min(stage_id)",
        n_stages="count(*)",
        total_tasks="sum(num_tasks)",
        total_duration_ms="sum(duration_ms)",
        total_input_bytes="sum(input_bytes)",
        total_output_bytes="sum(output_bytes)",
        total_shuffle_read_bytes="sum(shuffle_read_bytes)",
        total_shuffle_write_bytes="sum(shuffle_write_bytes)",
        total_disk_spill_bytes="sum(disk_spill_bytes)",
        total_mem_spill_bytes="sum(mem_spill_bytes)",
        total_gc_ms="sum(gc_ms)",
        worst_disk_spill_bytes="max(disk_spill_bytes)",
        peak_mem_bytes="max(peak_mem_bytes)",
    )
    + """, min(skew_ratio) as skew_ratio_min, max(skew_ratio) as skew_ratio_max,
  """ + rounded("cast(sum(cast(round(skew_ratio * 100) as bigint)) as bigint)::double / count(*) / 100", 2) + """
    as skew_ratio_avg,
  max(gc_overhead_pct) as worst_gc_pct, min(cpu_efficiency) as worst_cpu_efficiency
from o_grouped group by app_key, group_name""",
    "o_reset": """
select app_key, stage_id, max(case when prev is not null and attempt_id > prev then seq end) as reset_seq
from (select *, max(attempt_id) over (partition by app_key, stage_id order by seq
    rows between unbounded preceding and 1 preceding) as prev from v_stage_event) e
group by app_key, stage_id""",
    "o_task": """
select t.*, not t.failed and not t.speculative as good, t.attempt_id < t.cur as stale,
  t.attempt_id >= t.cur and (r.reset_seq is null or t.seq > r.reset_seq) as kept
from (select v.*, coalesce((select max(e.attempt_id) from v_stage_event e where e.app_key = v.app_key
    and e.stage_id = v.stage_id and e.seq < v.seq), 0) as cur from v_task v) t
left join o_reset r using (app_key, stage_id)""",
    "o_acc": "select app_key, stage_id, "
    + big(
        n_accepted="sum(case when kept and good then 1 else 0 end)",
        n_filtered="sum(case when kept and not good then 1 else 0 end)",
        min_task_ms="coalesce(min(case when kept and good then run_ms end), 0)",
        max_task_ms="coalesce(max(case when kept and good then run_ms end), 0)",
        peak_mem_bytes="coalesce(max(case when kept and good then peak_mem_bytes end), 0)",
        shuffle_read_bytes=f"coalesce(sum(case when kept and good then {READ} end), 0)",
        **{
            name: f"coalesce(sum(case when kept and good then {c} end), 0)"
            for name, c in {
                "input_bytes": "input_bytes",
                "output_bytes": "output_bytes",
                "shuffle_write_bytes": "sw_bytes",
                "gc_ms": "gc_ms",
                "mem_spill_bytes": "mem_spill_bytes",
                "disk_spill_bytes": "disk_spill_bytes",
                "fetch_wait_ms": "fetch_wait_ms",
                "deser_ms": "deser_ms",
                "result_bytes": "result_bytes",
                "run_ms": "run_ms",
                "sw_time_ns": "sw_time_ns",
                "cpu_ns": "cpu_ns",
                "ser_ms": "ser_ms",
            }.items()
        },
    )
    + " from o_task group by app_key, stage_id",
    "o_median": """
select app_key, stage_id, max(case when rn = n // 2 + 1 then run_ms end) as median_task_ms
from (select app_key, stage_id, run_ms,
    row_number() over (partition by app_key, stage_id order by run_ms) as rn,
    count(*) over (partition by app_key, stage_id) as n from o_task where kept and good) t
group by app_key, stage_id""",
    "o_event_times": """
select app_key, stage_id, max(case when rs = 1 then submission_ms end) as sub_ms,
  max(case when rs = 1 then seq end) as sub_seq, max(case when rc = 1 then completion_ms end) as com_ms,
  max(case when rc = 1 then seq end) as com_seq
from (select *, case when submission_ms > 0 then row_number() over (partition by app_key, stage_id
      order by case when submission_ms > 0 then seq else -1 end desc) end as rs,
    case when completion_ms > 0 then row_number() over (partition by app_key, stage_id
      order by case when completion_ms > 0 then seq else -1 end desc) end as rc
  from v_stage_event) e group by app_key, stage_id""",
    "o_envelope": """
select app_key, stage_id, start_ms, end_ms,
  case when start_ms > 0 and end_ms > 0 then greatest(0, end_ms - start_ms) else 0 end as wall_ms
from (select s.app_key, s.stage_id,
    coalesce(least(e.sub_ms, t.first_launch), 0) as start_ms,
    coalesce(greatest(e.com_ms, t.last_finish), 0) as end_ms
  from (select app_key, stage_id from v_job_stage union select app_key, stage_id from v_task) s
  left join o_event_times e using (app_key, stage_id)
  left join (select o.app_key, o.stage_id,
      min(case when o.good and not o.stale and o.seq > coalesce(x.sub_seq, -1) then o.launch_ms end) as first_launch,
      max(case when o.good and not o.stale and o.seq > coalesce(x.com_seq, -1) then o.finish_ms end) as last_finish
    from o_task o left join o_event_times x using (app_key, stage_id)
    group by o.app_key, o.stage_id) t using (app_key, stage_id)) z""",
    "o_stage_job": "select app_key, stage_id, max(job_id) as job_id from v_job_stage group by app_key, stage_id",
    "o_stage_name": """
select app_key, stage_id, arg_max(stage_name, case when stage_name is not null then seq end) as stage_name,
  arg_max(num_tasks, seq) as num_tasks from v_stage_event group by app_key, stage_id""",
    "o_stage": """
select v.app_key, v.stage_id, v.start_ms, v.end_ms, v.wall_ms, coalesce(j.job_id, -1) as job_id,
  coalesce(n.stage_name, concat('Stage ', cast(v.stage_id as string))) as stage_name,
  coalesce(n.num_tasks, 3) as num_tasks, coalesce(m.median_task_ms, 0) as median_task_ms,
  coalesce(f.pos, 0) as pos, """
    + ", ".join(
        f"coalesce(a.{c}, 0) as {c}"
        for c in [*STAGE_SUMS, "n_accepted", "n_filtered", "min_task_ms", "max_task_ms", "peak_mem_bytes"]
    )
    + """
from o_envelope v left join o_acc a using (app_key, stage_id)
  left join o_median m using (app_key, stage_id) left join o_stage_job j using (app_key, stage_id)
  left join o_stage_name n using (app_key, stage_id)
  left join (select app_key, stage_id, min(job_id * 1000 + p) as pos from (
      select app_key, stage_id, job_id, row_number() over (partition by app_key, job_id order by stage_id) - 1 as p
      from v_job_stage) q group by app_key, stage_id) f using (app_key, stage_id)""",
    "o_executor": "select app_key, executor_id, "
    + big(
        tasks="count(*)",
        run_ms="sum(finish_ms - launch_ms)",
        gc_ms="sum(gc_ms)",
        cpu_ms="sum(cpu_ns // 1000000)",
        deser_ms="sum(deser_ms)",
    )
    + " from v_task group by app_key, executor_id",
    "o_registry": """
select app_key, executor_id, arg_max(host, seq) as host, arg_max(cores, seq) as cores
from v_executor_event where kind = 'add' group by app_key, executor_id""",
    "o_executor_summary": f"""
select e.*, coalesce(r.host, 'unknown') as host, coalesce(r.cores, 0) as cores,
  {rounded(ratio('e.gc_ms', 'e.run_ms') + ' * 100', 2)} as gc_pct,
  {rounded(ratio('e.cpu_ms', 'e.run_ms'), 3)} as cpu_efficiency
from o_executor e left join o_registry r using (app_key, executor_id)""",
    "o_executor_dim": """
select x.app_key, x.executor_id, x.host, x.cores, x.first_seq, x.start_ms,
  case when x.removed_ms > 0 then x.removed_ms else coalesce(a.end_ms, 0) end as end_ms
from (select app_key, executor_id, min(seq) as first_seq,
    coalesce(arg_max(host, seq) filter (where kind = 'add'), 'unknown') as host,
    coalesce(arg_max(cores, seq) filter (where kind = 'add'), 0) as cores,
    coalesce(arg_max(ts_ms, seq) filter (where kind = 'add'), min(ts_ms)) as start_ms,
    case when arg_max(kind, seq) = 'remove' then arg_max(ts_ms, seq) else 0 end as removed_ms
  from v_executor_event group by app_key, executor_id) x left join v_app a using (app_key)""",
    "o_sweep": """
select app_key, ts_ms, kind, s, min(s) over (partition by app_key order by ts_ms, kind, seq
    rows between unbounded preceding and current row) as low
from (select *, sum(case when kind = 'add' then 1 else -1 end) over (partition by app_key
    order by ts_ms, kind, seq rows between unbounded preceding and current row) as s
  from v_executor_event) t""",
    "o_peak": "select app_key, cast(max(s - least(0, low)) as bigint) as peak from o_sweep group by app_key",
    "o_app": f"""
select a.app_key, a.app_id, a.app_name, a.start_version, a.start_ms, a.end_ms,
  greatest(0, a.end_ms - a.start_ms) as duration_ms, p.cores, p.memory_mb, p.overhead_mb, p.offheap_mb,
  coalesce(x.n_added, 0) as n_added
from v_app a left join (select * from v_profile where seq = 3) p using (app_key)
left join (select app_key, count(*) as n_added from v_executor_event where kind = 'add' group by app_key) x
  using (app_key)""",
    "o_only_plan": "select distinct app_key from v_plan where app_key not in (select app_key from v_app)",
    "o_cluster": """
select c.*, case when own > 0 then own else duration_ms * total_cores end as available_core_ms
from (select b.*, coalesce((select cast(sum(greatest(0, d.end_ms - d.start_ms)
      * (case when d.cores > 0 then d.cores else b.cores_per_executor end)) as bigint)
    from o_executor_dim d where d.app_key = b.app_key), 0) as own
  from (select a.app_key, a.duration_ms, a.memory_mb, a.overhead_mb,
      case when p.peak > 0 then p.peak else n.n end as peak_executors,
      case when a.cores > 0 then a.cores else coalesce(n.fallback, 1) end as cores_per_executor,
      (case when p.peak > 0 then p.peak else n.n end)
        * (case when a.cores > 0 then a.cores else coalesce(n.fallback, 1) end) as total_cores
    from o_app a join o_peak p using (app_key)
    join (select app_key, count(*) as n, arg_min(cores, first_seq) filter (where cores > 0) as fallback
      from o_executor_dim group by app_key) n using (app_key)) b) c""",
    "o_report": f"""
select r.*, {pct('run_ms', 'total_cores * wall_ms')} as used_pct,
  case when total_cores * wall_ms > 0
    then greatest(0.0e0, 100.0e0 - {pct('run_ms', 'total_cores * wall_ms')}) else 0.0e0 end as wasted_pct,
  {ratio('run_ms', 'n_accepted')} as avg_task_ms,
  {ratio('max_task_ms', 'median_task_ms')} as task_skew,
  {ratio('max_task_ms', ratio('run_ms', 'n_accepted'))} as skew_avg_ratio,
  {ratio('max_task_ms', 'wall_ms')} as stage_skew, {ratio('num_tasks', 'total_cores')} as p_ratio,
  {pct('gc_ms', 'run_ms')} as gc_pct, {pct('fetch_wait_ms', 'run_ms')} as fetch_wait_pct,
  case when run_ms > 0 then sw_time_ns * 100.0e0 / run_ms / 1000000.0e0 else 0.0e0 end as shuffle_write_pct,
  case when run_ms > 0 then cpu_ns * 100.0e0 / (run_ms * 1000000.0e0) else 0.0e0 end as cpu_pct,
  {pct('wall_ms', 'duration_ms')} as wall_clock_pct, {pct('run_ms', 'app_run_ms')} as task_runtime_pct,
  {pct('io_bytes', 'app_io_bytes')} as io_pct,
  row_number() over (partition by app_key order by wall_ms desc, pos, stage_id) as wall_rank
from (select s.*, c.total_cores, c.duration_ms,
    s.input_bytes + s.output_bytes + s.shuffle_read_bytes + s.shuffle_write_bytes as io_bytes,
    cast(sum(s.run_ms) over (partition by s.app_key) as bigint) as app_run_ms,
    cast(sum(s.input_bytes + s.output_bytes + s.shuffle_read_bytes + s.shuffle_write_bytes)
      over (partition by s.app_key) as bigint) as app_io_bytes
  from o_stage s join o_cluster c using (app_key)) r""",
    "o_island": """
select app_key, min(start_ms) as start_ms, max(end_ms) as end_ms
from (select *, sum(fresh) over (partition by app_key order by start_ms, end_ms
    rows between unbounded preceding and current row) as island
  from (select app_key, start_ms, end_ms, case when start_ms <= max(end_ms) over (partition by app_key
        order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
    from o_stage where start_ms > 0 and end_ms > 0) t) u
group by app_key, island""",
    "o_split": f"""
select app_key, duration_ms, executor_time_ms, driver_time_ms, {pct('driver_time_ms', 'duration_ms')} as driver_pct
from (select a.app_key, a.duration_ms, coalesce(cast(i.active as bigint), 0) as executor_time_ms,
    greatest(0, a.duration_ms - coalesce(cast(i.active as bigint), 0)) as driver_time_ms
  from o_app a left join (select app_key, sum(end_ms - start_ms) as active from o_island group by app_key) i
  using (app_key)) t""",
    "o_finding": """
select app_key, stage_id, 1 as detector, 'long_stage' as kind, wall_ms::double as metric_value,
  wall_ms::double as score, null as severity from o_report where wall_rank <= 3
union all select app_key, stage_id, 2, 'low_parallelism', used_pct, 100.0e0 - used_pct, null
from o_report where wall_rank <= 3 and used_pct < 50
union all select app_key, stage_id, 3, 'skew', skew_avg_ratio,
  case when skew_avg_ratio > 5 then skew_avg_ratio * 2.0e0 else skew_avg_ratio end,
  case when skew_avg_ratio > 5 then 'critical' else 'attention' end from o_report where skew_avg_ratio > 2
union all select app_key, stage_id, 4, 'gc_pressure', gc_pct,
  case when gc_pct > 15 then gc_pct * 2.0e0 else gc_pct end,
  case when gc_pct > 15 then 'critical' else 'attention' end from o_report where gc_pct > 5
union all select app_key, stage_id, 5, 'shuffle_bound', fetch_wait_pct,
  case when fetch_wait_pct > 25 then fetch_wait_pct * 2.0e0 else fetch_wait_pct end,
  case when fetch_wait_pct > 25 then 'critical' else 'attention' end from o_report where fetch_wait_pct > 10
union all select app_key, stage_id, 6, 'shuffle_heavy', shuffle_write_pct + fetch_wait_pct,
  shuffle_write_pct + fetch_wait_pct, null from o_report where shuffle_write_pct + fetch_wait_pct > 30
union all select app_key, stage_id, 7, 'spill', disk_spill_bytes / 1073741824.0e0,
  disk_spill_bytes / 1073741824.0e0 * 10.0e0 + 5.0e0,
  case when disk_spill_bytes > 1073741824 then 'critical' else 'attention' end
from o_report where disk_spill_bytes > 0
union all select app_key, stage_id, 8, 'low_utilization', wasted_pct, wasted_pct,
  case when wasted_pct > 70 then 'critical' else 'attention' end from o_report where wasted_pct > 30
union all select app_key, -1, 99, 'driver_overhead', driver_pct,
  case when driver_pct > 40 then driver_pct * 2.0e0 else driver_pct end,
  case when driver_pct > 40 then 'critical' else 'attention' end from o_split where driver_pct > 20""",
    "o_walk": """
select s.app_key, s.job_id, s.stage_id, 0 as level from v_job_stage s
where not exists (select 1 from o_stage_edge e where e.app_key = s.app_key and e.job_id = s.job_id
  and e.stage_id = s.stage_id)
union all
select e.app_key, e.job_id, e.stage_id, w.level + 1 from o_walk w join o_stage_edge e
  on e.app_key = w.app_key and e.job_id = w.job_id and e.parent_id = w.stage_id""",
    "o_level": """
select app_key, job_id, stage_id, max(level) as level from o_walk group by app_key, job_id, stage_id""",
    "o_price": """
select j.app_key, j.job_id, j.stage_id, p.pct,
  case when s.n_accepted = 0 then 0
    else greatest((s.run_ms + m - 1) // m, s.max_task_ms) end as lo,
  case when s.n_accepted = 0 then 0 else (s.run_ms + (m - 1) * s.max_task_ms) // m end as hi
from v_job_stage j join o_stage s using (app_key, stage_id)
join (select c.app_key, g.pct, greatest(1, c.peak_executors * g.pct // 100) * c.cores_per_executor as slots
  from o_cluster c, (select unnest([10, 20, 50, 80, 100, 110, 120, 150, 200, 300, 400, 500]) as pct) g) p
  using (app_key),
lateral (select least(p.slots, greatest(s.n_accepted, 1)) as m) z""",
    "o_priced_walk": """
select r.app_key, r.job_id, r.stage_id, r.pct, r.lo, r.hi from o_price r
where not exists (select 1 from o_stage_edge e where e.app_key = r.app_key and e.job_id = r.job_id
  and e.stage_id = r.stage_id)
union all
select e.app_key, e.job_id, e.stage_id, w.pct, w.lo + r.lo, w.hi + r.hi
from o_priced_walk w join o_stage_edge e
  on e.app_key = w.app_key and e.job_id = w.job_id and e.parent_id = w.stage_id
join o_price r on r.app_key = e.app_key and r.job_id = e.job_id and r.stage_id = e.stage_id and r.pct = w.pct""",
    "o_node": """
select p.app_key, p.seq, p.execution_id, i as node_id,
  case when i <= n_projects + 5 then i else i - n_projects - 5 end as depth,
  case when i = 0 then -1 when i <= n_projects + 5 then i - 1 when i = n_projects + 6 then 0
    else n_projects + 6 end as parent_id,
  case when i = 0 then p.root when i = 1 then 'WholeStageCodegen (1)' when i = 2 then 'InputAdapter'
    when i <= 4 then 'ColumnarToRow' when i <= 4 + n_projects then 'Project'
    when i = 5 + n_projects then 'Scan parquet' when i = 6 + n_projects then 'SubqueryBroadcast'
    else 'Scan csv' end as node_name,
  case when i = 5 + n_projects then scan_text when i = 7 + n_projects then '[hidden]'
    when i between 5 and 4 + n_projects then 'p' else '' end as simple_string,
  case when i = 1 then 1 when i = 3 then 2 else 0 end as n_metrics, n_projects, root
from v_plan p, lateral (select unnest(range(0, n_projects + 6 + case when has_subquery then 2 else 0 end)) as i) g
where p.execution_id % 97 <> 5""",
    "o_simple": """
select app_key, seq, execution_id, node_id,
  depth - (case when root = 'AdaptiveSparkPlan' and node_id > 0 then 1 else 0 end)
    - (case when node_id > 2 then 1 else 0 end) - (case when node_id > 3 then 1 else 0 end) as depth,
  case when depth = 30 then '… (truncado)' else node_name end as node_name
from o_node where node_id <= n_projects + 5 and depth <= 30 and node_id not in (2, 3)
  and not (node_id = 0 and root = 'AdaptiveSparkPlan')""",
    "o_type": """
select *, case when regexp_matches(node_name, '^(Scan|.*TableScan)', 'i') then 'scan'
  when regexp_matches(node_name, 'Join', 'i') then 'join'
  when regexp_matches(node_name, '^(BroadcastExchange|Exchange)', 'i') then 'shuffle'
  when regexp_matches(node_name, 'Aggregate', 'i') then 'aggregate'
  when regexp_matches(node_name, '^Window$', 'i') then 'window'
  when regexp_matches(node_name, '^(Insert|.*Write|.*Command)', 'i') then 'write'
  when regexp_matches(node_name, '^(InMemoryRelation|ReusedExchange)', 'i') then 'cache'
  else 'op' end as node_type from o_node""",
    "o_execution": """
select app_key, seq, execution_id, description, root, n_nodes,
  case when regexp_matches(root, 'Insert|Write', 'i') and not regexp_matches(root, 'Create', 'i') then 'write'
    when regexp_matches(root, 'CreateView|CreateTable|Command', 'i') then 'ddl'
    when n_nodes > 50 then 'compute' else 'init' end as class,
  regexp_matches(root, 'Insert|Write', 'i') and position('Create' in root) = 0 as is_write
from (select *, n_projects + 6 + case when has_subquery then 2 else 0 end as n_nodes from v_plan
  where execution_id % 97 <> 5) p""",
    "o_source": """
select distinct app_key, left(trim(case when simple_string like '%[%]%'
    then regexp_extract(simple_string, '\\[([^\\]]+)\\]', 1)
    else regexp_extract(simple_string, '([^\\s/\\\\]+)$', 1) end), 50) as source
from o_node where node_name like 'Scan%'""",
    "o_summary": """
select app_key, case when a.n_added is null then 'unknown'
    else coalesce(a.start_version, concat('4.1.', cast(length(app_key) as string))) end as spark_version, coalesce(q.n_plans, 0) as n_plans,
  coalesce(app_id, 'unknown') as app_id, coalesce(app_name, 'unknown') as app_name,
  coalesce(s.num_stages, 0) as num_stages, coalesce(s.num_tasks, 0) as num_tasks,
  coalesce(a.end_ms - a.start_ms, 0) as total_duration_ms, coalesce(a.n_added, 0) as executor_count,
  coalesce(a.memory_mb, 0) as executor_memory_mb, coalesce(a.overhead_mb, 0) as executor_overhead_mb,
  coalesce(a.offheap_mb, 0) as executor_offheap_mb, coalesce(a.cores, 0) as executor_cores,
  coalesce(q.n, 0) as sql_execution_count, coalesce(s.i, 0) as total_input_bytes,
  coalesce(s.o, 0) as total_output_bytes, coalesce(s.r, 0) as total_shuffle_read_bytes,
  coalesce(s.w, 0) as total_shuffle_write_bytes
from (select app_key from v_app union select app_key from v_plan) k left join o_app a using (app_key)
left join (select app_key, count(*) as num_stages, cast(sum(num_tasks) as bigint) as num_tasks,
    cast(sum(input_bytes) as bigint) as i, cast(sum(output_bytes) as bigint) as o,
    cast(sum(shuffle_read_bytes) as bigint) as r, cast(sum(shuffle_write_bytes) as bigint) as w
  from o_stage_all group by app_key) s using (app_key)
left join (select app_key, count(*) as n, sum(case when execution_id % 97 <> 5 then 1 else 0 end) as n_plans from v_plan group by app_key) q using (app_key)""",
    "o_efficiency": f"""
select app_key, {ratio('cpu', 'run')} as cpu_efficiency, {ratio('gc', 'run')} * 100 as gc_overhead_pct,
  {ratio('deser', 'run')} * 100 as deser_overhead_pct
from (select app_key, cast(sum(cpu_ms) as bigint) as cpu, cast(sum(gc_ms) as bigint) as gc,
    cast(sum(deser_ms) as bigint) as deser, cast(sum(run_ms) as bigint) as run from o_executor group by app_key) t""",
    "o_many": """
select g.*, coalesce(m.n, 0) as n_messages
from (select * from o_group where n_stages > 1) g
left join (select app_key, group_name, count(*) as n from o_message group by 1, 2) m using (app_key, group_name)""",
    "o_hit": f"""
select app_key, 1 as item, 'Skewed stages' as title, stage_id,
  concat('Stage ', cast(stage_id as string), ' (', {plain_text('skew_ratio')}, '×)') as label from o_flags where has_skew
union all select app_key, 2, 'Disk spill', stage_id,
  concat('Stage ', cast(stage_id as string), ' (', {bytes_text('disk_spill_bytes')}, ')') from o_flags where has_spill
union all select app_key, 3, 'Heavy shuffle', stage_id, concat('Stage ', cast(stage_id as string)) from o_flags where has_heavy_shuffle
union all select app_key, 4, 'Low CPU efficiency', stage_id,
  concat('Stage ', cast(stage_id as string), ' (', format('{{{{:.3f}}}}', cpu_efficiency), ')') from o_flags where has_low_cpu""",
    "o_line": f"""
select app_key, 1 as section, 0 as item, '' as item_key, line_no, 0 as piece, text from (select app_key, {texts(
    "concat('# Spark Log Report — ', app_name)", "''", "'## Application Overview'", "'| Field | Value |'", "'|---|---|'",
    "concat('| App ID | `', app_id, '` |')", "concat('| Spark Version | ', spark_version, ' |')",
    f"concat('| Total Duration | ', {ms_text('total_duration_ms')}, ' |')", "concat('| Stages | ', cast(num_stages as string), ' |')",
    "concat('| Tasks | ', cast(num_tasks as string), ' |')", "concat('| Executors | ', cast(executor_count as string), ' |')",
    f"concat('| Executor Memory | ', {thousands('executor_memory_mb')}, ' MB on-heap + ', {thousands('executor_overhead_mb')}, ' MB overhead |')",
    "concat('| Executor Cores | ', cast(executor_cores as string), ' vcores/executor |')",
    "concat('| SQL Executions | ', cast(sql_execution_count as string), ' |')",
    *(f"concat('| {label} | ', {bytes_text(c)}, ' |')" for label, c in {
        "Input": "total_input_bytes", "Output": "total_output_bytes",
        "Shuffle Read": "total_shuffle_read_bytes", "Shuffle Write": "total_shuffle_write_bytes"}.items()))} from o_summary) a
union all select app_key, 2, 0, '', line_no, 0, text from (select app_key, {texts(
    "''", "'## Job-Level Efficiency'", "'| Metric | Value | Interpretation |'", "'|---|---|---|'",
    "concat('| CPU Efficiency | ', format('{{:.3f}}', coalesce(cpu_efficiency, 0.0e0)), ' | ratio CPU time / wall-clock run time (1.0 = fully compute-bound) |')",
    "concat('| GC Overhead | ', format('{{:.2f}}', coalesce(gc_overhead_pct, 0.0e0)), '% | % of task wall-clock spent in GC (>5% is concerning) |')",
    "concat('| Deserialize Overhead | ', format('{{:.2f}}', coalesce(deser_overhead_pct, 0.0e0)), '% | % of task wall-clock spent deserializing inputs |')",
  )} from (select app_key from o_summary) k left join o_efficiency using (app_key)) b
union all select app_key, 3, -1, '', line_no, 0, text from (select app_key, {texts(
    "''", "'## Executor-Level Metrics'", "'| Executor | Cores | Tasks | GC ms | GC% | CPU Efficiency |'", "'|---|---|---|---|---|---|'",
  )} from (select distinct app_key from o_executor_summary) k) c
union all select app_key, 3, 0, executor_id, 0, 0, concat('| ', executor_id, ' | ', cast(cores as string), ' | ', cast(tasks as string),
  ' | ', {thousands('gc_ms')}, ' | ', format('{{{{:.2f}}}}', gc_pct), '% | ', format('{{{{:.3f}}}}', cpu_efficiency), ' |') from o_executor_summary
union all select app_key, 4, -1, '', line_no, 0, text from (select app_key, {texts(
    "''", "'**Outlier executors** (GC > 5% or CPU efficiency < 0.05):'")}
  from (select distinct app_key from o_executor_summary where gc_pct > 5.0e0 or cpu_efficiency < 0.05e0) k) d
union all select app_key, 4, 0, executor_id, 0, 0, concat('- Executor ', executor_id, ' (', host, '): gc=', format('{{{{:.2f}}}}', gc_pct),
  '%, cpu_eff=', format('{{{{:.3f}}}}', cpu_efficiency)) from o_executor_summary where gc_pct > 5.0e0 or cpu_efficiency < 0.05e0
union all select app_key, 5, -1, '', line_no, 0, text from (select app_key, {texts(
    "''", "'## Stage Groups (repeated operations)'")} from (select distinct app_key from o_many) k) e
union all select app_key, 5, first_stage_id, group_name, 0, part, concat(
    case when part = 0 then concat('### "', group_name, '" ×', cast(n_stages as string), ' stages (IDs: ') else ',' end, ids,
    case when part = (n_stages - 1) // 1000 then concat(')', case when n_messages > 0 then ' ⚠️' else '' end) else '' end)
  from o_many join (select app_key, group_name, (rn - 1) // 1000 as part, string_agg(cast(stage_id as string), ',' order by stage_id) as ids
    from (select *, row_number() over (partition by app_key, group_name order by stage_id) as rn from o_grouped) z group by 1, 2, 3) i
    using (app_key, group_name)
union all select app_key, 5, first_stage_id, group_name, line_no + 1, 0, text from (select app_key, first_stage_id, group_name, {texts(
    "'| Metric | Total | Per-Stage Avg |'", "'|---|---|---|'", share_row("Tasks", "total_tasks", thousands),
    share_row("Duration", "total_duration_ms", ms_text), share_row("Input", "total_input_bytes", bytes_text),
    share_row("Shuffle Read", "total_shuffle_read_bytes", bytes_text), share_row("Shuffle Write", "total_shuffle_write_bytes", bytes_text),
    f"case when total_disk_spill_bytes > 0 then {share_row('Disk Spill', 'total_disk_spill_bytes', bytes_text)} end",
    f"concat('| Skew Ratio | min=', {plain_text('skew_ratio_min')}, '× avg=', {plain_text('skew_ratio_avg')}, '× max=', {plain_text('skew_ratio_max')}, '× | — |')",
    "case when worst_gc_pct > 5.0e0 then concat('| Worst GC Overhead | ', format('{{:.2f}}', worst_gc_pct), '% | — |') end",
    "case when n_messages > 0 then '' end", "case when n_messages > 0 then concat('**Anomalies (', cast(n_messages as string), '):**') end",
  )} from o_many) f where text is not null
union all select m.app_key, 5, g.first_stage_id, m.group_name, 12 + rn, 0, concat('- ', anomaly) from (select o_message.*, row_number() over (
  partition by app_key, group_name order by stage_id, pos) as rn from o_message) m join o_many g using (app_key, group_name) where rn <= 10
union all select app_key, 5, first_stage_id, group_name, 11 + case when n_messages > 0 then 2 + least(10, n_messages) else 0 end, 0, '' from o_many
union all select app_key, 6, -1, '', line_no, 0, text from (select app_key, {texts(
    "''", "'## Stage Breakdown'",
    "'| Stage | Name | Tasks | Duration | Input | Shuffle R | Shuffle W | SW Time | Fetch Wait | Spill Mem | Spill Disk | Peak Mem | Skew | CPU Eff | GC% | Deser ms |'",
    "'|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|'")} from (select distinct app_key from o_group where n_stages = 1) k) h
union all select app_key, 6, stage_id, '', 0, 0, concat('| ', concat_ws(' | ', cast(stage_id as string), left(stage_name, 35), cast(num_tasks as string),
    {ms_text('duration_ms')}, {bytes_text('input_bytes')}, {bytes_text('shuffle_read_bytes')}, {bytes_text('shuffle_write_bytes')},
    {ms_text('sw_time_ms')}, {ms_text('fetch_wait_ms')}, {bytes_text('mem_spill_bytes')},
    concat({bytes_text('disk_spill_bytes')}, case when has_spill then ' 💾' else '' end), {bytes_text('peak_mem_bytes')},
    concat({plain_text('skew_ratio')}, case when has_skew then ' ⚠️' else '' end), {plain_text('cpu_efficiency')},
    {plain_text('gc_overhead_pct')}, cast(deser_ms as string)), ' |')
  from o_grouped join (select app_key, group_name from o_group where n_stages = 1) z using (app_key, group_name)
union all select app_key, 7, 0, '', line_no, 0, text from (select app_key, {texts(
    "''", "'## SQL Physical Plan (Structured)'", "'(interactive rendering available in desktop UI)'")} from o_summary where n_plans > 0) j
union all select app_key, 8, -1, '', line_no, 0, text from (select app_key, {texts("''", "'## ⚠️ Anomaly Summary'")}
  from (select distinct app_key from o_hit) k) l
union all select app_key, 8, item, '', 0, part, concat(case when part = 0
    then concat('- **', title, '** (', cast(n as string), '): ') else ', ' end, string_agg(label, ', ' order by stage_id))
  from (select *, (row_number() over (partition by app_key, item order by stage_id) - 1) // 1000 as part,
      count(*) over (partition by app_key, item) as n from o_hit) y group by app_key, item, title, n, part""",
}
