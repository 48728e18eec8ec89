"""Line sources, archives, parsing, text operators, streaming and a log Spark wrote itself."""

import io
import json
import os
import zipfile

import pytest
from logs import app_start, log_from, stage, task
from pyspark.sql import functions as F

from loomlog.functions.text import collapse_runs, head_lines, source_lines
from loomlog.sources import archives
from loomlog.sources.events import (
    job_log,
    load_job_log,
    parse_events,
    quarantine_events,
    read_bronze,
    save_job_log,
    write_bronze,
)
from loomlog.sources.lines import text_lines
from loomlog.streaming.stage_tasks import stream_stage_tasks


def as_lines(spark, items):
    return spark.createDataFrame(
        [("a", i, t) for i, t in enumerate(items)], "app_key string, seq long, line string"
    )


def test_parse_and_quarantine(spark):
    good = ['{"Event": "A"}', '{"Event":"B","x":"}{"}', '{"Event":"C","x":[{"y":1},{"z":2}]}']
    bad = {
        "not json": "malformed_json",
        "[1,2]": "not_an_object",
        '[{"Event":"A"}]': "not_an_object",
        "17": "not_an_object",
        '{"x": 1}': "no_event_name",
        '{"Event": null}': "no_event_name",
        '{"Event":"A"} tail': "malformed_json",
        '{"Event":"A"}{"Event":"B"}': "malformed_json",
        '{"Event":"A"},{"Event":"B"}': "malformed_json",
        '{"Event":"A"': "malformed_json",
        "{'Event':'A'}": "malformed_json",
    }
    lines = as_lines(spark, good + list(bad))
    parsed = parse_events(lines)
    assert sorted(r.event_type for r in parsed.collect()) == ["A", "B", "C"]
    rejected = {r.line: r.reason for r in quarantine_events(lines).collect()}
    assert rejected == bad


def test_suffix_match_and_plan_objects(spark):
    name = "SparkListenerSQLExecutionStart"
    log = log_from(spark, [
        {"Event": "org.x." + name, "executionId": 3, "sparkPlanInfo": {"nodeName": "A"}},
        {"Event": name, "executionId": "4", "description": "d", "sparkPlanInfo": [1]},
        {"Event": name + "X", "executionId": 5},
    ])
    rows = {r.execution_id: r for r in log.sql_starts.collect()}
    assert set(rows) == {3, 4}
    assert json.loads(rows[3].plan_json) == {"nodeName": "A"} and rows[4].plan_json is None


def test_bronze_round_trip(spark, tmp_path):
    lines = as_lines(spark, [json.dumps(app_start(1)), json.dumps(task(0, 1, 5)), json.dumps(stage("Completed", 0))])
    write_bronze(parse_events(lines), str(tmp_path / "bronze"))
    events = read_bronze(spark, str(tmp_path / "bronze"))
    save_job_log(job_log(events), str(tmp_path / "facts"))
    log = load_job_log(spark, str(tmp_path / "facts"))
    assert log.tasks.count() == 1 and log.stage_events.count() == 1 and log.apps.count() == 1
    # Pruning: a typed table reads only the folder of its event type.
    plan = job_log(events).tasks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "SparkListenerTaskEnd" in plan.split("PartitionFilters")[1][:200]


def test_text_order_over_splits(spark, tmp_path):
    """Positions follow the file across splits, files of a rolling log follow their number."""
    rolling = tmp_path / "eventlog_v2_app-9"
    rolling.mkdir()
    for part in (1, 2, 10):
        body = "\n".join(f"{part:03d}-{i:05d} " + "x" * (i % 90) for i in range(3000))
        (rolling / f"events_{part}_app-9").write_text(body + "\n\n")
    (tmp_path / "app-1.inprogress").write_text("  one \r\n\n two\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = text_lines(spark, [str(rolling), str(tmp_path / "app-1.inprogress")])
        assert rows.rdd.getNumPartitions() > 10
        found = rows.select("app_key", "seq", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    nine = [r.line[:9] for r in sorted((r for r in found if r.app_key == "app-9"), key=lambda r: r.seq)]
    assert nine == sorted(nine) and len(nine) == 9000
    assert len({r.seq for r in found if r.app_key == "app-9"}) == 9000
    assert [r.line for r in sorted(found, key=lambda r: r.seq) if r.app_key == "app-1"] == ["one", "two"]


def zip_bytes(members, level=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def archive_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    event = json.dumps(app_start(0))
    files = {
        "good.zip": zip_bytes({"logs/": "", "logs/b": f"{event}\n\n  not json \n", "logs/a": b"caf\xe9 \n{}"}),
        "empty.zip": b"",
        "magic.zip": b"not a zip",
        "broken.zip": b"PK damaged",
        "many.zip": zip_bytes({f"f{i}": event for i in range(1001)}),
        "limit.zip": zip_bytes({f"f{i}": event for i in range(1000)}),
        "bomb.zip": zip_bytes({"z": b"0" * 1_000_000, "ok": event}, 9),
        "none.zip": zip_bytes({"dir/": ""}),
    }
    for name, body in files.items():
        (folder / name).write_bytes(body)
    return str(folder)


def test_archive_audit(spark, archive_dir):
    members = archives.archive_members(spark, archive_dir)
    verdicts = {os.path.basename(r.archive): r for r in archives.archive_audit(members).collect()}
    assert {n: r.reason for n, r in verdicts.items()} == {
        "good.zip": None,
        "empty.zip": "empty",
        "magic.zip": "bad_magic",
        "broken.zip": "bad_magic",
        "many.zip": "too_many_files",
        "limit.zip": None,
        "bomb.zip": "compression_ratio",
        "none.zip": None,
    }
    assert verdicts["good.zip"].n_files == 2 and not verdicts["good.zip"].over_zip_mb


def test_archive_lines(spark, archive_dir):
    rows = archives.archive_lines(archives.archive_members(spark, archive_dir))
    good = sorted(rows.filter("app_key = 'good'").collect(), key=lambda r: r.seq)
    assert [(r.file_name, r.line_no, r.line) for r in good] == [
        ("logs/b", 0, json.dumps(app_start(0))),
        ("logs/b", 2, "not json"),
        ("logs/a", 0, "caf�"),
        ("logs/a", 1, "{}"),
    ]
    counts = {r.app_key: r["count"] for r in rows.groupBy("app_key").count().collect()}
    assert counts == {"good": 4, "limit": 1000}


def damaged_zips(folder):
    """Equal names in two folders, a bad checksum, an encrypted member, an unknown method."""
    for sub, line in (("x", "one"), ("y", "two")):
        (folder / sub).mkdir()
        (folder / sub / "app.zip").write_bytes(zip_bytes({"log": line}))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("first", "kept\n")
        z.writestr("second", "some text\n")
        z.writestr("second", "a name twice\n")
        z.writestr("third", "kept too\n")
    body = buffer.getvalue().replace(b"some text", b"SOME text")
    (folder / "crc.zip").write_bytes(body)
    secret, odd = bytearray(buffer.getvalue()), bytearray(buffer.getvalue())
    at = secret.rfind(b"PK\x01\x02")  # the directory entry of the last member
    secret[at + 8] |= 1
    odd[at + 10] = 99
    (folder / "secret.zip").write_bytes(secret)
    (folder / "odd.zip").write_bytes(odd)
    (folder / "empty.zip").write_bytes(b"")
    return str(folder)


@pytest.mark.parametrize("split", [1 << 30, 1])
def test_damaged_archives_are_rows(spark, tmp_path, split):
    from loomlog.sources import zip_source

    root = damaged_zips(tmp_path)
    zip_source.register(spark)
    source = spark.read.format("loomlog_zip").option("splitBytes", split).load(root)
    for rows in (source, archives.archive_rows(archives.archive_members(spark, root))):
        found = sorted((r.app_key, r.file_seq if r.file_seq is not None else -1, r.line or "(" + r.reason.split(":")[0] + ")") for r in rows.collect())
        rest = [(0, "kept"), (1, "some text"), (2, "a name twice")]
        assert found == [
            ("crc", 0, "kept"), ("crc", 1, "(damaged)"), ("crc", 2, "a name twice"), ("crc", 3, "kept too"),
            ("empty", -1, "(empty)"),
            *(("odd", *r) for r in rest), ("odd", 3, "(unknown_method)"),
            *(("secret", *r) for r in rest), ("secret", 3, "(encrypted)"),
            ("x/app", 0, "one"), ("y/app", 0, "two"),
        ]


def test_unknown_places_are_rows(spark, tmp_path):
    roots = [str(tmp_path / "absent"), "nowhere://bucket/logs", damaged_zips(tmp_path)]
    members = archives.archive_members(spark, roots)
    verdicts = {r.archive: r for r in archives.archive_audit(members).collect()}
    assert [verdicts[r].reason for r in roots[:2]] == ["unreadable"] * 2 and verdicts[roots[1]].error
    rows = archives.archive_rows(members).collect()
    assert {r.archive: r.reason for r in rows if r.reason == "unreadable"} == dict.fromkeys(roots[:2], "unreadable")
    # With several roots the key is the whole path.
    assert {r.app_key for r in rows if r.line == "one"} == {roots[2] + "/x/app"}


def test_lines_come_in_batches_of_bounded_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    path = tmp_path / "long.zip"
    path.write_bytes(zip_bytes({"log": "".join(f"line {k} {'x' * 90}\n" for k in range(500))}))
    magic, members, error = archives.read_directory(str(path))
    batches = list(archives.member_rows(str(path), "long", members))
    assert len(batches) > 40 and sum(b.num_rows for b in batches) == 500 and max(b.num_rows for b in batches) < 20


def model_collapse(text, keep):
    out, runs = [], []
    for line in text.splitlines():
        if runs and runs[-1][0] == line:
            runs[-1][1] += 1
        else:
            runs.append([line, 1])
    for line, n in runs:
        out += [line] * min(n, keep)
        if n > keep:
            out.append(f"[... repeated line omitted {n - keep} times ...]")
    return "\n".join(out) if runs else text


def test_collapse_runs(spark):
    texts = [
        "", "\n", "a", "a\na\na", "a\na\nb\nb\nb\nb\nc", "a\n\n\n\n\nb\n", "x\r\nx\r\nx\r\ny", "a\rb\x0bc\x0cd\x1ce",
        "a a a\u0085a", "\n\n\n\n", "b\na\na\na\na\n", "same\n" * 50,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for keep in (1, 2, 3):
        got = {r.i: r.o for r in collapse_runs(rows, "t", "o", keep).collect()}
        assert got == {i: model_collapse(t, keep) for i, t in enumerate(texts)}


def test_head_lines(spark):
    texts = ["", "a", "\n".join(map(str, range(500))), "\n".join(map(str, range(501))), "x\n" * 700]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.h for r in rows.select("i", head_lines("t").alias("h")).collect()}
    for i, text in enumerate(texts):
        n = text.count("\n") + 1
        cut = "\n".join(text.split("\n")[:500]) + f"\n# ... (truncated, showing first 500 of {n} lines)"
        assert got[i] == (cut if n > 500 else text)


def test_source_lines(spark):
    rows = spark.createDataFrame([("a", "f", "x\n\ny")], "app_key string, file_name string, text string")
    assert [(r.line_no, r.line) for r in source_lines(rows).orderBy("line_no").collect()] == [(1, "x"), (2, ""), (3, "y")]


def test_stream_matches_batch(spark, tmp_path):
    """A folder that grows between two triggers ends in the batch result."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, items):
        (folder / name).write_text("\n".join(json.dumps(t) for t in items))

    put("app-1", [task(0, 10 * i, 10 * i + i) for i in range(20)])
    stream = stream_stage_tasks(spark, str(folder))
    run = (
        stream.writeStream.outputMode("complete").format("memory").queryName("stage_tasks")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        run.processAllAvailable()
        put("app-2.json", [task(1, 0, 7), task(0, 0, 3)] + [{"Event": "other"}])
        run.processAllAvailable()
        rows = spark.sql("select app_key, stage_id, num_tasks, dur_sum_ms, dur_max_ms from stage_tasks").collect()
    finally:
        run.stop()
    assert {tuple(r) for r in rows} == {("app-1", 0, 20, 190, 19), ("app-2", 1, 1, 7, 7), ("app-2", 0, 1, 3, 3)}


def test_log_of_a_real_application(spark, tmp_path):
    """A log written by Spark itself parses into consistent tables."""
    import subprocess
    import sys

    script = (
        "from pyspark.sql import SparkSession\n"
        f"s = (SparkSession.builder.master('local[2]').config('spark.eventLog.enabled', 'true')"
        f".config('spark.eventLog.dir', 'file://{tmp_path}').config('spark.ui.enabled', 'false')"
        ".config('spark.eventLog.compress', 'false').config('spark.sql.shuffle.partitions', '3').getOrCreate())\n"
        "print(s.range(1000).selectExpr('id % 7 as k').groupBy('k').count().collect())\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, timeout=240, capture_output=True)
    lines = text_lines(spark, str(tmp_path / "*"))
    assert quarantine_events(lines).count() == 0
    from loomlog.operators import apps, rollups, stages
    from loomlog.plans.flatten import flatten_plans

    log = job_log(parse_events(lines))
    meta = apps.app_meta(log).collect()
    assert len(meta) == 1 and meta[0].app_id.startswith("local-") and meta[0].duration_ms > 0
    table = stages.stage_table(log).collect()
    assert table and all(r.n_accepted > 0 for r in table if r.start_ms > 0)
    metrics = rollups.stage_metrics(log.tasks, log.stage_events).agg(F.sum("num_tasks")).first()[0]
    assert metrics == log.tasks.count()
    assert flatten_plans(log.sql_starts).filter("node_id = 0").count() == meta[0].n_plans > 0


def test_deep_and_long_records(spark):
    """Plans nested thousands of levels deep and very long strings are not malformed."""
    from loomlog.plans.flatten import flatten_plans

    plan = '{"nodeName":"Scan","children":[]}'
    for _ in range(1500):
        plan = '{"nodeName":"Project","children":[' + plan + "]}"
    start = '{"Event":"SparkListenerSQLExecutionStart","executionId":1,"description":"%s","sparkPlanInfo":%s}'
    lines = as_lines(spark, [start % ("d" * 21_000_000, plan)])
    log = job_log(parse_events(lines))
    row = flatten_plans(log.sql_starts).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (row.n, row.d) == (1501, 1500)
    assert log.sql_starts.select(F.length("description")).first()[0] == 21_000_000
