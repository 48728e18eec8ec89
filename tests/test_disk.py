"""What is written, shuffled and broadcast: task text once, plans once, ranks of keys once, no stages to the driver."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loomlog import schema as S
from loomlog.operators import ranks, rollups
from loomlog.operators.graph import job_edges
from loomlog.plans.flatten import codegen_members
from loomlog.plans.simplify import simplify_plans
from loomlog.reports import metrics
from loomlog.session import materialize
from loomlog.spread import SALT, WHOLE, hot_join
from loomlog.workload import views

LINES = [
    '{"Event":"SparkListenerTaskEnd","Stage ID":3,"Task Info":{"Executor ID":"1"}}',
    '{"Event":"SparkListenerTaskEnd","Stage ID":-1}',
    '{"Event":"Spark\\u004cistenerTaskEnd","Stage ID":4}',
    '{"Event":"SparkListenerTaskEnd","Stage ID":5} tail',
    '{"Event":"SparkListenerJobStart","Job ID":5}',
]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_text_of_tasks_is_stored_once(spark, tmp_path, monkeypatch):
    made = [("b" if k == 1 else "a", k, text) for k, text in enumerate(LINES)]
    rows = spark.createDataFrame(made, "app_key string, seq long, line string")
    monkeypatch.setattr(views, "fresh_dir", lambda session, label: str(tmp_path / label))
    monkeypatch.setattr(views, "view_log", lambda session, sf_dir: None)
    monkeypatch.setattr(views, "log_lines", lambda log: rows)
    log = views.prepared_log(spark, str(tmp_path))
    assert sorted((r.seq, r.event_type, r.body) for r in log.bronze.collect()) == [
        (0, S.TASK_END, None), (1, S.TASK_END, None), (2, S.TASK_END, None), (4, S.JOB_START, LINES[4])
    ]
    assert sorted((r.seq, r.stage_id) for r in log.tasks.collect()) == [(0, 3), (2, 4)]
    assert sorted(r.app_key for r in log.apps.collect()) == ["a", "b"]
    assert [r.job_id for r in log.job_starts.collect()] == [5]


NODE = StructType(
    [StructField("app_key", StringType()), StructField("seq", LongType()), StructField("execution_id", LongType())]
    + [StructField(c, LongType()) for c in ("node_id", "parent_id", "last_id", "depth", "pos")]
    + [StructField("node_name", StringType()), StructField("simple_string", StringType()), StructField("n_metrics", LongType())]
)
NAMES = ["InputAdapter", "ColumnarToRow", "ColumnarToRow", "WholeStageCodegen (1)", "Project", "SubqueryBroadcast"]


def _tree(rng, key, seq):
    rows = []

    def grow(parent, depth, pos):
        me = len(rows)
        row = [key, seq, seq, me, parent, me, depth, pos, rng.choice(NAMES), "s", 0]
        rows.append(row)
        for place in range(rng.choice((0, 1, 1, 1, 2)) if depth < 8 else 0):
            grow(me, depth + 1, place)
        row[5] = len(rows) - 1

    grow(-1, 0, 0)
    return [tuple(r) for r in rows]


def test_plans_are_shuffled_once(spark, tmp_path):
    rng = random.Random(3)
    made = [row for k in range(40) for row in _tree(rng, None if k == 7 else f"a{k % 3}", k)]
    twice = _tree(rng, "twice", 99)
    spark.createDataFrame(made + twice + twice, NODE).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    kept = simplify_plans(nodes)
    members = codegen_members(kept)
    for rows in (kept, members):
        assert plan_of(rows).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(rows)
    rows = [r.asDict() for r in kept.collect()]
    wanted = sorted(
        (n["app_key"], n["seq"], h["node_id"], n["node_id"], n["node_name"])
        for h in rows if h["node_name"].startswith("WholeStageCodegen") and h["app_key"]
        for n in rows if (n["app_key"], n["seq"]) == (h["app_key"], h["seq"]) and h["node_id"] <= n["node_id"] <= h["last_id"]
    )
    got = sorted((r.app_key, r.seq, r.codegen_id, r.node_id, r.node_name) for r in members.collect())
    assert got == wanted and any(r[0] == "twice" for r in got)


@pytest.mark.parametrize("salted", [False, True])
def test_ranks_of_hot_and_other_keys(spark, salted):
    rng = random.Random(5)
    values = {k: [rng.randrange(-5000, 5000) for _ in range(n)] for k, n in (("hot", 6000), ("a", 400), ("b", 1), (None, 50))}
    rows = spark.createDataFrame([(k, n, v) for k, vs in values.items() for n, v in enumerate(vs)], "k string, n long, v long")
    if salted:
        dim = spark.createDataFrame([(k,) for k in values if k], "k string").withColumn("x", F.rand())
        rows = hot_join(rows, dim, ["k"], ["n"], keep_salt=True, hot_rows=1000)
        if SALT in rows.columns:
            assert {r.k for r in rows.filter(F.col(SALT) == WHOLE).collect()} == {"a", "b"}
    picks = {"mid": ranks.upper_median, "p95": ranks.p95}
    got = {r.k: (r.mid, r.p95) for r in ranks.rank_select(rows, ["k"], "v", picks, hot_rows=1000).collect()}
    assert got == {k: (sorted(v)[len(v) // 2], sorted(v)[int(0.95 * len(v))]) for k, v in values.items() if k}


def test_values_of_other_keys_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{v % 20}", v) for v in range(4000)], "k string, v long")
    found = ranks.rank_select(rows, ["k"], "v", {"mid": ranks.upper_median})
    stored = spark.read.parquet(*found.inputFiles())
    assert stored.count() == 20 == found.count()


def test_stages_are_not_broadcast(spark):
    parents = StructType([StructField("app_key", StringType()), StructField("stage_id", LongType()), StructField("parent_ids", ArrayType(LongType()))])
    stages = spark.createDataFrame([("a", k, [k - 1]) for k in range(1, 200)], parents)
    pairs = spark.createDataFrame([("a", k // 10, k) for k in range(200)], "app_key string, job_id long, stage_id long")
    edges = job_edges(materialize(pairs, "pairs"), materialize(stages, "stages"))
    assert "BroadcastExchange" not in plan_of(edges) and edges.count() == 180


def test_hosts_of_a_report_read_the_tasks_once(spark, monkeypatch):
    placed = spark.createDataFrame(
        [("a", "h", str(k), 1, 10, 10, 1, 1, 1, 1, 1) for k in range(3)],
        "app_key string, host string, executor_id string, tasks long, run_ms long, max_task_ms long, gc_ms long, "
        "shuffle_read_bytes long, shuffle_write_bytes long, input_bytes long, disk_spill_bytes long",
    )
    calls = []
    monkeypatch.setattr(rollups, "_placed", lambda marked, events: calls.append(1) or placed)
    [row] = metrics._hosts(None, views.JobLog(*[None] * len(views.JobLog._fields))).collect()
    assert len(calls) == 1 and json.loads(row.record)["executor_ids"] == ["0", "1", "2"]
