"""Ingestion writes the parts of a log that are asked for, and no others; ranks read their rows once."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from loomlog.operators import ranks
from loomlog.sources import events
from loomlog.workload import views

LINES = [
    '{"Event":"SparkListenerTaskEnd","Stage ID":3,"Task Info":{"Executor ID":"1"}}',
    '{"Event":"SparkListenerJobStart","Job ID":5}',
    '{"Event":"x.SparkListenerSQLExecutionStart","executionId":7,"description":"d"}',
    "no record",
]


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", k, text) for k, text in enumerate(LINES)], "app_key string, seq long, line string")
    monkeypatch.setattr(views, "fresh_dir", lambda session, label: str(tmp_path / label))
    monkeypatch.setattr(views, "view_log", lambda session, sf_dir: None)
    monkeypatch.setattr(views, "log_lines", lambda log: rows)
    return tmp_path / "joblog"


def test_lines_alone(spark, folder):
    assert views.prepared_lines(spark, str(folder)).count() == 4
    assert os.listdir(folder) == ["lines"]


def test_fact_tables_when_asked(spark, folder):
    log = views.prepared_log(spark, str(folder))
    assert [r.execution_id for r in log.sql_starts.collect()] == [7]
    assert sorted(os.listdir(folder)) == ["bronze", "facts", "lines"] and os.listdir(folder / "facts") == ["sql_starts"]
    assert [r.stage_id for r in log.tasks.collect()] == [3] and log.tasks is log.tasks
    assert sorted(os.listdir(folder / "facts")) == ["sql_starts", "tasks"]
    assert [r.app_key for r in views.prepared_log(spark, str(folder)).apps.collect()] == ["a"]
    with pytest.raises(AttributeError):
        log.no_such_table


def test_text_is_stored_densely(spark, folder):
    views.prepared_log(spark, str(folder)).job_starts
    files = [name for _, _, names in os.walk(folder) for name in names if name.endswith(".parquet")]
    assert any(".zstd.parquet" in name for name in files)


def test_plans_are_spread(spark, folder, monkeypatch):
    text = '{"Event":"x.SparkListenerSQLExecutionStart","executionId":%d,"description":"d"}'
    rows = spark.createDataFrame([("a", k, text % k) for k in range(40)], "app_key string, seq long, line string")
    monkeypatch.setattr(views, "log_lines", lambda log: rows.coalesce(1))
    log = views.prepared_log(spark, str(folder))
    assert sorted(r.execution_id for r in log.sql_starts.collect()) == list(range(40))
    assert len(log.sql_starts.inputFiles()) > 1


def test_ranks_read_their_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    values = [(k, v) for k in "ab" for v in range(-200, 200_000, 97)] + [(None, 5), (None, 5), ("c", None)]
    spark.createDataFrame(values, "k string, v long").write.parquet(path)
    picks = {"mid": ranks.upper_median}
    found = ranks.rank_select(spark.read.parquet(path), ["k"], "v", picks)
    assert not any(path in name for name in found.inputFiles())
    ordered = [v for k, v in values if k == "a"]
    got = {r.k: r.mid for r in found.filter("k is not null").collect()}
    assert got["a"] == got["b"] == ordered[len(ordered) // 2]


@pytest.mark.parametrize("before", [None, "3"])
def test_types_are_stored_without_sorting(spark, tmp_path, monkeypatch, before):
    named = [("a", k, f"type{k % (events.OPEN_TYPES + 9)}", f"body {k}") for k in range(2000)]
    rows = spark.createDataFrame(named, "app_key string, seq long, event_type string, body string").coalesce(1)
    write, seen = DataFrameWriter.parquet, []
    monkeypatch.setattr(
        DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(events.WRITERS)) or write(self, path)
    )
    if before:
        spark.conf.set(events.WRITERS, before)
    try:
        events.write_bronze(rows, str(tmp_path / "bronze"))
        assert int(seen[0]) >= 13 and spark.conf.get(events.WRITERS, None) == before
    finally:
        spark.conf.unset(events.WRITERS)
    got = events.read_bronze(spark, str(tmp_path / "bronze")).collect()
    assert sorted((r.app_key, r.seq, r.event_type, r.body) for r in got) == named


PLANS = [
    '{"nodeName":"A","simpleString":"s","children":[{"nodeName":"B","metrics":[1,2.5]}]}',
    '{"nodeName" : "A\\u00e9\\"",\n "children":[]}',
    '{"nodeName":"A"} tail',
    '{"nodeName":"A"}{}',
    '{"nodeName":"A","nodeName":"B"}',
    '{"nodeName":"A"',
    '[{"nodeName":"A"}]',
    '"text"',
    "",
    None,
]


def test_plans_stand_in_lines_as_they_are(spark):
    made = [("a", k, k, "d" if k % 2 else None, plan) for k, plan in enumerate(PLANS)]
    rows = spark.createDataFrame(made, "app_key string, seq long, id long, description string, plan string")
    fields = [F.col("id").alias("executionId"), F.col("description")]
    lines = views._line_with(rows, "E", {"sparkPlanInfo": "plan"}, *fields).orderBy("seq").collect()
    anew = views._line(rows, "E", *fields, F.try_parse_json("plan").alias("sparkPlanInfo")).orderBy("seq").collect()
    assert [json.loads(r.line) for r in lines] == [json.loads(r.line) for r in anew]
    assert f'"sparkPlanInfo":{PLANS[0]}}}' in lines[0].line and not any("\n" in r.line for r in lines)


def test_plan_texts_are_made_on_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "fresh_dir", lambda session, label: str(tmp_path / label))
    parts = spark.range(1, 200, numPartitions=1).selectExpr(
        "id as p_partkey", "cast(id % 50 as int) as p_size", "concat('Brand#', id % 5) as p_brand"
    )
    parts.write.parquet(str(tmp_path / "in" / "part.parquet"))
    items = spark.range(1, 50).selectExpr(
        "id as l_orderkey", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber", "5.0D as l_quantity"
    )
    items.write.parquet(str(tmp_path / "in" / "lineitem.parquet"))
    starts = views.view_log(spark, str(tmp_path / "in")).sql_starts
    assert "Exchange" not in starts._jdf.queryExecution().executedPlan().toString()
    assert len(starts.inputFiles()) > 1 and starts.count() == 199


def test_stage_events_are_spread(spark, folder, monkeypatch):
    text = '{"Event":"SparkListenerStageSubmitted","Stage Info":{"Stage ID":%d}}'
    rows = spark.createDataFrame([("a", k, text % k) for k in range(40)], "app_key string, seq long, line string")
    monkeypatch.setattr(views, "log_lines", lambda log: rows.coalesce(1))
    log = views.prepared_log(spark, str(folder))
    assert sorted(r.stage_id for r in log.stage_events.collect()) == list(range(40))
    assert len(log.stage_events.inputFiles()) > 1
