"""Golden numbers on small logs, end to end from JSON lines."""

import json

import random

import pytest
from logs import (
    app_end,
    app_start,
    executor,
    job,
    job_end,
    log_from,
    stage,
    task,
    forked_log,
)
from pyspark.sql import functions as F

from loomlog.functions.scalars import half_even
from loomlog.operators import apps, bottlenecks, graph, groups, intervals, rollups, stages
from loomlog.reports import documents, lines, metrics
from loomlog.session import materialize


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def full(spark):
    log = log_from(spark, forked_log())
    table = stages.stage_table(log)
    cluster = apps.cluster_capacity(log)
    return log, table, cluster, stages.stage_report(table, cluster)


def test_cluster(full):
    log, table, cluster, _ = full
    row = apps.cluster_report(cluster, table).first()
    assert (row.peak_executors, row.cores_per_executor, row.total_cores) == (3, 4, 12)
    assert (row.memory_mb, row.overhead_mb) == (8192, 1024)
    # Two executors for 8 s, one for 6 s, four cores each.
    assert row.available_core_ms == 4 * (8_000 + 8_000 + 6_000)
    assert row.used_core_ms == 4_900 + 4_800 + 800


def test_stage_measures(full):
    report = rows_by(full[3], "stage_id")
    load, join, tally = report[3], report[4], report[5]
    assert (load.run_ms, load.n_accepted, load.n_filtered, load.job_id) == (1_000 + 1_500 + 2_400, 3, 0, 7)
    assert load.used_pct == pytest.approx(100 * 4_900 / (12 * 2_400)) and load.used_pct + load.wasted_pct == pytest.approx(100)
    assert (load.median_task_ms, load.task_skew, load.ideal_wall_ms) == (1_500, 1.6, 4_900 // 12)
    assert load.skew_avg_ratio == pytest.approx(2_400 * 3 / 4_900) and load.gc_pct == pytest.approx(15_000 / 4_900)
    assert load.oi_ratio == pytest.approx(800 / 12_000)
    # Of two tasks the upper one is the median.
    assert (join.median_task_ms, join.task_skew, join.avg_task_ms) == (2_800, 1.0, 2_400.0)
    assert (join.shuffle_read_bytes, join.disk_spill_bytes, join.fetch_wait_pct) == (600, 64, 12.5)
    assert join.shuffle_write_pct == pytest.approx(100 * 400 / 4_800) and join.oi_ratio == (650 + 1_600) / 600
    assert tally.gc_pct == 25.0 and join.parent_ids == tally.parent_ids == [3]


def test_driver_time(full):
    log, table, _, _ = full
    split = intervals.driver_split(table, apps.app_meta(log)).first()
    assert (split.executor_time_ms, split.driver_time_ms, split.driver_pct) == (2_400 + 2_800, 2_800, 35.0)
    gaps = {label: r.gap_ms for label, r in rows_by(intervals.driver_gaps(table, apps.app_meta(log)), "label").items()}
    assert gaps == {"pre_first_stage": 600, "inter_stage_gap": 200, "post_last_stage": 2_000}


def test_hosts_jobs_versions(full):
    log = full[0]
    from loomlog.operators.attempts import mark_tasks, stage_state

    marked = mark_tasks(log.tasks, stage_state(log.stage_events))
    hosts = rows_by(rollups.host_rollup(marked, log.executor_events), "host")
    assert {h: (r.tasks, r.n_executors) for h, r in hosts.items()} == {"rack1": (4, 2), "rack2": (2, 1)}
    lists = rows_by(rollups.host_executors(marked, log.executor_events), "host")
    assert lists["rack1"].executor_ids == ["a1", "a2"] and lists["rack2"].executor_ids == ["b1"]
    meta = apps.app_meta(log).first()
    assert meta.log_version == "3.5.4" and meta.spark_version == "unknown"
    job_row = apps.jobs(log).first()
    assert job_row.stage_ids == [3, 4, 5] and job_row.duration_ms == 7_000
    idle = apps.driver_idle(apps.app_meta(log), apps.jobs(log)).first()
    assert idle.idle_ms == 1_000 and idle.driver_idle_pct == 12.5


def test_levels_and_paths(full):
    log, table, cluster, _ = full
    pairs = apps.job_stages(apps.jobs(log))
    levels = graph.stage_levels(pairs, table)
    grouped = rows_by(graph.parallel_groups(apps.jobs(log), levels, table), "level")
    assert grouped[0].stages == [3] and grouped[1].stages == [4, 5]
    assert (grouped[0].duration_ms, grouped[1].duration_ms) == (2_400, 2_800)
    paths = graph.critical_paths(pairs, table, {"w": F.col("max_task_ms")})
    assert paths.first().w == 2_400 + 2_800
    grid = rows_by(graph.whatif_bounds(cluster, apps.jobs(log), pairs, table), "pct")
    assert len(grid) == 12
    assert grid[100].target_executors == 3 and grid[10].target_executors == 1
    # Fewer tasks than slots: both stages of the path take their longest task, plus driver time.
    assert grid[100].lower_ms == 1_000 + 2_400 + 2_800
    assert all(r.lower_ms <= r.upper_ms for r in grid.values())


def test_cycles_keep_rows_without_level(spark):
    nodes = spark.createDataFrame(
        [("a", 0, k) for k in range(1, 7)] + [("b", 0, 8), ("b", 0, 9)], "app_key string, job_id int, stage_id int"
    )
    # 2 and 3 form a cycle that no root reaches, 6 lies behind it; 4 and 5 a cycle behind root 1.
    edges = [("a", 0, 2, 3), ("a", 0, 3, 2), ("a", 0, 6, 3), ("a", 0, 4, 1), ("a", 0, 4, 5), ("a", 0, 5, 4), ("b", 0, 9, 8)]
    edges = spark.createDataFrame(edges, "app_key string, job_id int, stage_id int, parent_id int")
    rows = graph.longest_paths(nodes, edges, []).collect()
    found = {(r["app_key"], r["stage_id"]): r["level"] for r in rows}
    assert len(rows) == 8
    assert found == {**{("a", k): None for k in range(2, 7)}, ("a", 1): 0, ("b", 8): 0, ("b", 9): 1}


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from loomlog.session import shared_dir

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs:///work")) == "hdfs:///work"


def test_top_findings(full):
    log, table, _, report = full
    split = intervals.driver_split(table, apps.app_meta(log))
    findings = bottlenecks.describe(bottlenecks.top_findings(bottlenecks.all_findings(report, split)))
    ranked = rows_by(findings, "finding_rank")
    assert len(ranked) == 5
    assert ranked[1].kind == "long_stage" and ranked[1].stage_id == 10 and ranked[1].score == 500.0
    score = bottlenecks.health_score(apps.app_meta(log), bottlenecks.all_findings(report, split)).first()
    assert 0 <= score.score <= 100


def test_failed_and_speculative(spark):
    log = log_from(spark, [
        app_start(1000), executor("Added", 1000, "1"), job(0, 1000, {0: 3}),
        stage("Submitted", 0, "s0", 3, 1000),
        task(0, 1000, 1200, 200, input=100),
        task(0, 1000, 1500, 500, failed=True, input=9999),
        task(0, 1000, 1300, 300, speculative=True, input=8888),
        stage("Completed", 0, sub=1000, done=1500), job_end(0, 1500), app_end(2000),
    ])
    row = stages.stage_table(log).first()
    assert (row.n_accepted, row.n_filtered, row.run_ms, row.input_bytes) == (1, 2, 200, 100)


def test_latest_attempt(spark):
    log = log_from(spark, [
        app_start(1000), job(0, 1000, {0: 1}),
        stage("Submitted", 0, "s0", 1, 1000, attempt=0), task(0, 1000, 1200, 200, input=100),
        stage("Submitted", 0, "again", 1, 1300, attempt=1), task(0, 1300, 1600, 300, attempt=1, input=500),
        task(0, 1300, 1900, 600, attempt=0, input=7),
        stage("Completed", 0, sub=1300, done=1600, attempt=1), app_end(2000),
    ])
    row = stages.stage_table(log).first()
    assert (row.n_accepted, row.run_ms, row.input_bytes, row.stage_name) == (1, 300, 500, "again")
    assert (row.start_ms, row.end_ms) == (1300, 1600)


def test_zero_start_has_no_interval(spark):
    log = log_from(spark, [
        app_start(0), executor("Added", 0, "1"), job(0, 500, {0: 1}), stage("Submitted", 0, "s", 1, 500),
        task(0, 500, 600, 100, cpu=80_000_000, peak=5242880, disk_spill=200000),
        stage("Completed", 0, sub=500, done=600), job_end(0, 600), app_end(1000),
    ])
    table = stages.stage_table(log)
    split = intervals.driver_split(table, apps.app_meta(log))
    assert split.first().driver_pct == 90.0
    report = stages.stage_report(table, apps.cluster_capacity(log))
    row = report.first()
    assert row.cpu_pct == 80.0 and row.peak_mem_bytes == 5242880
    kinds = {r.kind: r for r in bottlenecks.all_findings(report, split).collect()}
    assert kinds["driver_overhead"].severity == "critical" and kinds["driver_overhead"].score == 180.0
    assert kinds["spill"].severity == "attention"
    log = log_from(spark, [app_start(0), task(0, 0, 1000), app_end(1000)])
    assert stages.stage_table(log).first().wall_ms == 0


def test_environment(spark):
    def env(**props):
        return {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": props}

    log = log_from(spark, [
        env(**{"spark.executor.memory": "4g", "other": "x", "spark.version": "3.9"}),
        env(**{"spark.executor.memory": "8g", "spark.sql.shuffle.partitions": "200"}), app_start(0),
    ])
    assert apps.env_maps(log.env_events).first().environment == {
        "spark.executor.memory": "8g", "spark.sql.shuffle.partitions": "200",
    }
    # The version property counts only if the last update names it.
    assert apps.app_meta(log).first().spark_version == "unknown"


def test_missing_pieces(spark):
    """Null metric objects, tasks without stage events, text amounts, unknown job ends."""
    bare = {"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Info": None, "Task Metrics": None}
    log = log_from(spark, [app_start(5), bare, job_end(9, 100), {"Event": "SparkListenerTaskEnd", "Stage ID": -1}])
    rows = rollups.stage_metrics(log.tasks, log.stage_events).collect()
    assert [(r.stage_id, r.stage_name, r.duration_ms, r.num_tasks) for r in rows] == [(3, "Stage 3", 0, 1)]
    assert apps.jobs(log).count() == 0
    cluster = apps.cluster_capacity(log).first()
    assert (cluster.peak_executors, cluster.cores_per_executor) == (0, 1)


def stage_rows(spark, items):
    """Stage metric rows from partial dicts."""
    base = dict(
        app_key="a", stage_id=0, stage_name="s", num_tasks=100, duration_ms=5000, input_bytes=1024,
        output_bytes=512, shuffle_read_bytes=256, shuffle_write_bytes=128, gc_ms=50, skew_ratio=1.5,
        gc_overhead_pct=1.0, cpu_efficiency=0.5, disk_spill_bytes=0, mem_spill_bytes=0,
        peak_mem_bytes=0, sw_time_ms=0, fetch_wait_ms=0, deser_ms=0,
    )
    kinds = {str: "string", int: "long", float: "double"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items())
    return spark.createDataFrame([tuple({**base, **i}.values()) for i in items], ddl)


def test_groups(spark):
    rows = stage_rows(spark, [
        dict(stage_id=0, stage_name="scan at main.py:10", skew_ratio=5.0, disk_spill_bytes=1_000_000),
        dict(stage_id=1, stage_name="other"),
        dict(stage_id=2, stage_name="scan (2) at x.py:3", skew_ratio=1.2),
    ])
    found = rows_by(groups.stage_groups(rows), "group_name")
    scan = found["scan"]
    assert (scan.n_stages, scan.total_tasks, scan.total_duration_ms, scan.first_stage_id) == (2, 200, 10000, 0)
    assert (scan.skew_ratio_min, scan.skew_ratio_max, scan.skew_ratio_avg) == (1.2, 5.0, 3.1)
    assert scan.worst_disk_spill_bytes == 1_000_000 and scan.n_anomalies == 2
    ids = rows_by(groups.group_stage_ids(rows), "group_name")
    assert ids["scan"].stage_ids == [0, 2]
    texts = rows_by(groups.group_anomaly_lists(rows), "group_name")["scan"].anomalies
    assert texts == ["skew=5.0x in stage 0", "disk_spill=1MB in stage 0"]
    assert [r.stage_id for r in groups.solo_stages(rows).collect()] == [1]


def whole_text(chunks):
    return "".join(r.text for r in sorted(chunks.collect(), key=lambda r: r.chunk_no))


def test_report_document(spark):
    """Every line of a small report."""
    log = log_from(spark, [
        app_start(1_000_000, **{"Spark Version": "3.4.0"}),
        {"Event": "SparkListenerResourceProfileAdded", "Executor Resource Requests": {
            "memory": {"Amount": 14336}, "memoryOverhead": {"Amount": 2048}, "cores": {"Amount": 5}}},
        executor("Added", 1_000_000, "1", "h1", 5),
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 7,
         "sparkPlanInfo": {"nodeName": "HashAggregate", "children": []}},
        *[task(s, 1_001_000, 1_001_000 + 100 * i, total=256 * i, written=128 * i, input=1024 * i, output=512 * i,
               gc=50 * i) for s in (0, 1, 2) for i in range(1, 11)],
        stage("Completed", 0, "count at main.py:10", sub=1_001_000, done=1_020_000),
        stage("Completed", 1, "scan at a.py:1", sub=1_001_000, done=1_002_000),
        stage("Completed", 2, "scan at a.py:9", sub=1_001_000, done=1_061_000),
        app_end(1_060_000),
    ])
    metrics = rollups.stage_metrics(log.tasks, log.stage_events)
    executors = rollups.executor_summary(log.tasks, log.executor_events)
    parts = (apps.app_summary(log, metrics), rollups.job_efficiency(log.tasks), executors, metrics)
    rows = lines.report_lines(*parts)
    text = whole_text(lines.report_documents(rows))
    assert whole_text(lines.report_documents(rows, size=3)) == text
    expected = """# Spark Log Report — n

## Application Overview
| Field | Value |
|---|---|
| App ID | `id-1` |
| Spark Version | 3.4.0 |
| Total Duration | 1.0 min |
| Stages | 3 |
| Tasks | 30 |
| Executors | 1 |
| Executor Memory | 14,336 MB on-heap + 2,048 MB overhead |
| Executor Cores | 5 vcores/executor |
| SQL Executions | 1 |
| Input | 165.0 KB |
| Output | 82.5 KB |
| Shuffle Read | 41.2 KB |
| Shuffle Write | 20.6 KB |

## Job-Level Efficiency
| Metric | Value | Interpretation |
|---|---|---|
| CPU Efficiency | 0.000 | ratio CPU time / wall-clock run time (1.0 = fully compute-bound) |
| GC Overhead | 50.00% | % of task wall-clock spent in GC (>5% is concerning) |
| Deserialize Overhead | 0.00% | % of task wall-clock spent deserializing inputs |

## Executor-Level Metrics
| Executor | Cores | Tasks | GC ms | GC% | CPU Efficiency |
|---|---|---|---|---|---|
| 1 | 5 | 30 | 8,250 | 50.00% | 0.000 |

**Outlier executors** (GC > 5% or CPU efficiency < 0.05):
- Executor 1 (h1): gc=50.00%, cpu_eff=0.000

## Stage Groups (repeated operations)
### "scan" ×2 stages (IDs: 1,2) ⚠️
| Metric | Total | Per-Stage Avg |
|---|---|---|
| Tasks | 20 | 10 |
| Duration | 1.0 min | 30.5 s |
| Input | 110.0 KB | 55.0 KB |
| Shuffle Read | 27.5 KB | 13.8 KB |
| Shuffle Write | 13.8 KB | 6.9 KB |
| Skew Ratio | min=1.82× avg=1.82× max=1.82× | — |
| Worst GC Overhead | 50.00% | — |

**Anomalies (4):**
- gc=50.0% in stage 1
- low_cpu=0.000 in stage 1
- gc=50.0% in stage 2
- low_cpu=0.000 in stage 2


## Stage Breakdown
| Stage | Name | Tasks | Duration | Input | Shuffle R | Shuffle W | SW Time | Fetch Wait | Spill Mem | Spill Disk | Peak Mem | Skew | CPU Eff | GC% | Deser ms |
|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|
| 0 | count at main.py:10 | 10 | 19.0 s | 55.0 KB | 13.8 KB | 6.9 KB | 0 ms | 0 ms | 0.0 B | 0.0 B | 0.0 B | 1.82 | 0.0 | 50.0 | 0 |

## SQL Physical Plan (Structured)
(interactive rendering available in desktop UI)

## ⚠️ Anomaly Summary
- **Low CPU efficiency** (3): Stage 0 (0.000), Stage 1 (0.000), Stage 2 (0.000)"""
    assert text == expected

    doc = json.loads(whole_text(documents.nested_documents(documents.summary_records(*parts), size=2)))
    assert doc["app"]["num_tasks"] == 30 and len(doc["stage"]) == 3 and len(doc["group"]) == 2
    context = rows_by(documents.context_records(*parts), "kind", "position")
    assert json.loads(context[("app", "")].record)["executors"] == 1
    lean = [json.loads(r.record) for r in context.values() if r.kind == "stage_group"]
    assert all("total_disk_spill_bytes" not in g and g["worst_gc_pct"] == 50.0 for g in lean)


def test_compact_report(spark):
    head = lines.ANOMALY_HEADING
    texts = ["short", "x" * 6000, "y" * 6000 + head + "z", head + "w" * 6000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", lines.compact_report(F.col("t")).alias("c")).collect()}
    assert got[0] == "short"
    assert got[1] == "x" * 5000 + "\n\n*(truncated — compact mode)*"
    assert got[2] == "y" * 3000 + "\n\n...\n\n" + head + "z"
    assert got[3] == (head + "w" * 6000)[:5000] + "\n\n*(truncated — compact mode)*"


def test_half_even_equals_python_at_any_size(spark):
    chance = random.Random(17)
    values = []
    for _ in range(3000):
        size = 2.0 ** chance.uniform(20, 54)
        values.append(chance.choice([-1, 1]) * float(f"{size:.4f}"[:-1] + "5"))
        values.append(float(chance.randrange(2**30)) + chance.choice([0.5, 0.25, 0.125, 0.0625]))
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *(half_even("v", d).alias(f"r{d}") for d in range(4))).collect()
    for row in got:
        for digits in range(4):
            assert row[f"r{digits}"] == float(round(row["v"], digits)), (row["v"], digits)


def test_whole_division_beyond_doubles(spark):
    values = [k * 10**6 - 1 for k in (1, 10**9, 10**12, 9 * 10**12)] + [2**63 - 1, 0]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    from loomlog.functions.scalars import ns_to_ms

    assert {r["v"]: r["ms"] for r in rows.select("v", ns_to_ms("v").alias("ms")).collect()} == {v: v // 10**6 for v in values}


def test_half_even_equals_python(spark):
    import random

    rng = random.Random(3)
    values = [2.675, 1.005, 0.285, 1.115, 2.5, 3.5, 0.125, 0.375, 1e-9, 0.0005, 4194303.0625, 0.0]
    values += [rng.randint(0, 10**6) / 1000 + 0.0005 for _ in range(2000)]
    values += [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *(half_even("v", d).alias(f"r{d}") for d in range(4))).collect()
    wrong = [(r.v, d, r[f"r{d}"]) for r in got for d in range(4) if r[f"r{d}"] != round(r.v, d)]
    assert not wrong


def test_homogeneous_executors(spark):
    ddl = "app_key string, executor_id string, tasks long, gc_pct double, cpu_efficiency double"
    rows = [("a", str(i), 10, 4.0 + i / 10, 0.5) for i in range(3)]
    rows += [("b", str(i), 10, 1.0, 0.2 * i) for i in range(3)] + [("c", "1", 1, 1.0, 0.5)]
    found = rows_by(rollups.executor_homogeneity(spark.createDataFrame(rows, ddl)), "app_key")
    assert [found[k].uniform for k in "abc"] == [True, False, False]


def test_metric_report(full):
    log, table, _, _ = full
    records = materialize(metrics.metric_records(log, table), "metric-records")
    chunks = documents.nested_documents(records, size=4, single=metrics.SINGLE).collect()
    doc = json.loads("".join(r.text for r in sorted(chunks, key=lambda r: r.chunk_no)))
    kinds = {r.kind for r in metrics.lean_records(records).collect()}
    assert len(chunks) > 1 and kinds == set(doc) - {"task_run_times"}
    app, cluster, driver = doc["app"], doc["cluster"], doc["driver_analysis"]
    assert (app["start_ms"], app["end_ms"], app["duration_ms"], app["duration_min"]) == (5_000, 13_000, 8_000, 0.1)
    assert (app["spark_version"], app["driver_idle_pct"], doc["environment"]) == ("3.5.4", 12.5, {})
    assert (cluster["executor_count"], cluster["total_cores"], cluster["memory_mb_per_executor"]) == (3, 12, 8192)
    # 88,000 ms of cores there, 10,500 used.
    assert (cluster["available_core_hours"], cluster["used_core_hours"]) == (0.024, 0.003)
    assert cluster["cluster_utilization_pct"] == 11.932
    assert (driver["driver_time_ms"], driver["executor_time_ms"], driver["driver_pct"]) == (2_800, 5_200, 35.0)
    gaps = [(g["label"], g["start_ms"], g["duration_ms"]) for g in doc["driver_intervals"]]
    assert gaps == [("pre_first_stage", 5_000, 600), ("inter_stage_gap", 8_000, 200), ("post_last_stage", 11_000, 2_000)]
    assert [(j["job_id"], j["stage_ids"], j["duration_ms"]) for j in doc["jobs"]] == [(7, [3, 4, 5], 7_000)]
    levels = [(g["stages"], g["duration_ms"]) for g in doc["job_timelines"][0]["parallel_groups"]]
    assert levels == [([3], 2_400), ([4, 5], 2_800)]
    load, join, _ = doc["stages"]
    assert (load["stage_id"], load["task_run_ms_total"], load["skew"]["skew_avg_ratio"]) == (3, 4_900, 1.469)
    assert (join["memory"]["spill_disk_bytes"], join["time_distribution"]["shuffle_read_fetch_pct"]) == (64, 12.5)
    assert [(h["host"], h["task_count"], h["executor_ids"]) for h in doc["host_analysis"]] == [
        ("rack1", 4, ["a1", "a2"]),
        ("rack2", 2, ["b1"]),
    ]
    first = doc["top_bottlenecks"][0]
    assert (first["rank"], first["type"], first["stage_id"], first["metric_value"]) == (1, "long_stage", 4, 2_800.0)
    assert len(doc["top_bottlenecks"]) == 5 and len(doc["scalability_bounds"]) == 12
    times = [(t["stage_id"], t["part"], t["run_ms"]) for t in doc["task_run_times"]]
    assert times == [(3, 0, [1_000, 1_500, 2_400]), (4, 0, [2_000, 2_800]), (5, 0, [800])]
