"""Ordered and windowed operators against sequential models on random input."""

import os
import random

from logs import (
    log_from,
    model_attempts,
    model_locate,
    model_merge,
    model_peak,
    model_simplify,
    random_tree,
)
from pyspark.sql import functions as F

from loomlog.operators import apps, attempts, graph, intervals, ranks, snippets, stages
from loomlog.sources.events import JobLog


def test_attempt_rule(spark):
    """400 stages of random stage events and tasks, also tasks without any stage event."""
    rng = random.Random(11)
    tasks, events, expected, spans = [], [], {}, {}
    for sid in range(400):
        order = []
        for seq in range(rng.randint(1, 14)):
            attempt = rng.randint(0, 3)
            if rng.random() < 0.4:
                sub, done = rng.choice([0, rng.randint(1, 500)]), rng.choice([0, rng.randint(1, 900)])
                order.append(("stage", attempt, sub, done))
                events.append(("a", sid, seq, attempt, sub, done))
            else:
                launch = rng.choice([0, rng.randint(1, 500)])
                finish = launch + rng.randint(0, 300)
                order.append(("task", attempt, launch, finish))
                tasks.append(("a", sid, seq, attempt, launch, finish))
        verdicts, spans[sid] = model_attempts(order)
        seqs = [i for i, o in enumerate(order) if o[0] == "task"]
        expected |= {(sid, s): v for s, v in zip(seqs, verdicts, strict=True)}
    task_rows = spark.createDataFrame(
        tasks, "app_key string, stage_id long, seq long, attempt_id long, launch_ms long, finish_ms long"
    ).orderBy(F.rand(1))
    task_rows = task_rows.select(
        "*", F.lit("1").alias("executor_id"), F.lit(False).alias("failed"), F.lit(False).alias("speculative")
    )
    zero = [c for c in (
        "run_ms cpu_ns deser_ms ser_ms result_bytes gc_ms peak_mem_bytes mem_spill_bytes disk_spill_bytes "
        "sr_total_bytes sr_remote_bytes sr_local_bytes fetch_wait_ms sw_bytes sw_time_ns input_bytes output_bytes"
    ).split()]
    task_rows = task_rows.select("*", *(F.lit(0).cast("bigint").alias(c) for c in zero))
    event_rows = spark.createDataFrame(
        events, "app_key string, stage_id long, seq long, attempt_id long, submission_ms long, completion_ms long"
    ).select("*", F.lit("x").alias("stage_name"), F.lit(1).cast("bigint").alias("num_tasks"),
             F.array().cast("array<bigint>").alias("parent_ids"))
    state = attempts.stage_state(event_rows)
    marked = attempts.mark_tasks(task_rows, state)
    got = {(r.stage_id, r.seq): (r.stale, r.kept) for r in marked.select("stage_id", "seq", "stale", "kept").collect()}
    assert got == expected

    starts = spark.createDataFrame([], "app_key string, seq long, job_id long, start_ms long, "
                                       "stage_infos array<struct<stage_id:bigint,num_tasks:bigint>>")
    log = JobLog(*([None] * len(JobLog._fields)))._replace(tasks=task_rows, stage_events=event_rows, job_starts=starts)
    rows = {r.stage_id: (r.start_ms, r.end_ms) for r in stages.stage_table(log).collect()}
    assert rows == {s: v for s, v in spans.items() if s in rows}
    assert set(rows) == set(spans)


def test_rank_select(spark):
    """Exact ranks for tiny, constant, negative and very wide groups."""
    rng = random.Random(5)
    values = {
        "one": [7],
        "same": [0] * 500,
        "wide": [rng.randint(-(2**40), 2**60) for _ in range(999)],
        "narrow": [rng.randint(60, 70) for _ in range(1000)],
        "powers": [2**k + d for k in range(50) for d in (-1, 0, 1)],
        "negative": [-rng.randint(0, 10**6) for _ in range(333)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    got = {r.k: r for r in ranks.rank_select(rows, ["k"], "v", {"mid": ranks.upper_median, "p95": ranks.p95}).collect()}
    for k, vs in values.items():
        ordered = sorted(vs)
        assert got[k].mid == ordered[len(vs) // 2], k
        assert got[k].p95 == ordered[int(len(vs) * 0.95)], k


def test_ranks_of_a_million_values_in_bounded_windows(spark, monkeypatch):
    """10**6 distinct values around 2**40, and as many small ones that decide the index."""
    sizes = []
    hits = ranks._hits

    def measured(totals, group, bucket, picks):
        sizes.append(totals.groupBy(*group).count().agg(F.max("count")).first()[0])
        return hits(totals, group, bucket, picks)

    monkeypatch.setattr(ranks, "_hits", measured)
    rows = spark.range(10**6).select(F.lit("k").alias("k"), (F.lit(2**40) + F.col("id") * 7919).alias("v"))
    got = ranks.rank_select(rows, ["k"], "v", {"mid": ranks.upper_median, "p95": ranks.p95}).first()
    assert (got.mid, got.p95) == (2**40 + 500_000 * 7919, 2**40 + 950_000 * 7919)
    assert len(sizes) == 3 and max(sizes) <= 2**ranks.DIGIT_BITS


def test_windows_of_ten_years_stay_within_the_fan_out(spark):
    """A tick every five minutes for ten years, one key: the counter and the merged intervals."""
    n, step, fan_bits = 10 * 365 * 288, 300_000, 12
    start = F.lit(1_600_000_000_000) + F.col("id") * step
    kind = F.when(F.col("id") % 3 < 2, "add").otherwise("remove")
    ticks = spark.range(n).select(F.lit("a").alias("k"), start.alias("ts_ms"), kind.alias("kind"))
    adds, removes = n - n // 3, n // 3
    assert apps.peak_concurrency(ticks, ["k"]).first().peak in (adds - removes, adds - removes + 1)
    widest = max(
        ticks.select(F.shiftright("ts_ms", low).alias("at")).distinct()
        .groupBy(F.shiftright("at", fan_bits)).count().agg(F.max("count")).first()[0]
        for low in (0, 12, 24)
    )
    assert widest <= 2**fan_bits
    spans = ticks.withColumn("end", F.col("ts_ms") + F.when(F.col("kind") == "add", step).otherwise(step // 2))
    merged = intervals.merge_intervals(spans, ["k"], "ts_ms", "end").selectExpr("end_ms - start_ms as d")
    assert {tuple(r) for r in merged.groupBy("d").count().collect()} == {(step * 2 + step // 2, n // 3)} | (
        set() if n % 3 == 0 else {((n % 3) * step, 1)}
    )


def test_state_is_as_long_as_a_stage_has_attempts(spark):
    """10**5 events of one stage in three attempts."""
    events = spark.range(100_000).select(
        F.lit("a").alias("app_key"), F.lit(1).cast("bigint").alias("stage_id"), F.col("id").alias("seq"),
        F.floor(F.col("id") / 40_000).alias("attempt_id"), F.col("id").alias("submission_ms"),
        F.lit(0).cast("bigint").alias("completion_ms"), F.lit("s").alias("stage_name"),
        F.array().cast("array<bigint>").alias("parent_ids"),
    )
    row = attempts.stage_state(events).first()
    assert sorted((s.attempt_id, s.seq) for s in row.steps) == [(0, 0), (1, 40_000), (2, 80_000)]
    assert (row.reset_seq, row.start_seq, row.start_event_ms, row.end_seq) == (80_000, 99_999, 99_999, None)


def test_bucket_keeps_order(spark):
    rng = random.Random(1)
    values = sorted({rng.randint(-(2**62), 2**62) >> rng.randint(0, 61) for _ in range(5000)} | set(range(-300, 300)))
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r.b for r in rows.select("v", ranks.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) < 5000


def test_peak_concurrency(spark):
    rng = random.Random(2)
    ticks = {
        n: [(rng.randint(0, 60), rng.choice(["add", "remove"])) for _ in range(rng.randint(1, 25))]
        for n in range(500)
    }
    rows = spark.createDataFrame(
        [(n, t, k) for n, ts in ticks.items() for t, k in ts], "n long, ts_ms long, kind string"
    )
    for scale, bits, fan_bits in ((1, 6, 1), (1, 4, 2), (1, 3, 3), (2**35, 44, 12)):
        scaled = rows.withColumn("ts_ms", F.col("ts_ms") * scale)
        got = {r.n: r.peak for r in apps.peak_concurrency(scaled, ["n"], bits=bits, fan_bits=fan_bits).collect()}
        assert got == {n: model_peak(ts) for n, ts in ticks.items()}


def test_merge_intervals(spark):
    rng = random.Random(3)
    spans = {}
    for n in range(300):
        starts = [rng.randint(1, 300) for _ in range(rng.randint(1, 20))]
        spans[n] = [(s, s + rng.choice([0, 3, 40])) for s in starts]
    rows = spark.createDataFrame([(n, s, e) for n, v in spans.items() for s, e in v], "n long, s long, e long")
    for scale, bits, fan_bits in ((1, 9, 3), (1, 4, 2), (1, 3, 3), (2**34, 44, 12)):
        scaled = rows.select("n", F.col("s") * scale, F.col("e") * scale).toDF("n", "s", "e")
        merged = intervals.merge_intervals(scaled, ["n"], "s", "e", bits=bits, fan_bits=fan_bits).collect()
        got = {}
        for r in merged:
            got.setdefault(r.n, []).append((r.start_ms // scale, r.end_ms // scale))
        assert {n: sorted(v) for n, v in got.items()} == {n: model_merge(v) for n, v in spans.items()}


def test_longest_paths(spark):
    """Random acyclic graphs, with diamonds whose path count is exponential."""
    rng = random.Random(4)
    nodes, edges, expected = [], [], {}
    for job in range(30):
        size = 24 if job == 0 else rng.randint(1, 9)
        cost = [rng.randint(0, 50) for _ in range(size)]
        level, finish = {}, {}
        for n in range(size):
            low = max(0, n - 4)
            parents = list(range(low, n)) if job == 0 else rng.sample(range(n), rng.randint(0, min(n, 3)))
            edges += [("a", job, n, p) for p in parents]
            nodes.append(("a", job, n, cost[n]))
            level[n] = 1 + max((level[p] for p in parents), default=-1)
            finish[n] = cost[n] + max((finish[p] for p in parents), default=0)
            expected[(job, n)] = (level[n], finish[n])
    got = graph.longest_paths(
        spark.createDataFrame(nodes, "app_key string, job_id long, stage_id long, w long"),
        spark.createDataFrame(edges, "app_key string, job_id long, stage_id long, parent_id long"),
        ["w"],
    )
    assert {(r.job_id, r.stage_id): (r.level, r.w) for r in got.collect()} == expected


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 2,000 stages, and chains that part and meet again, end in a cycle or start in one."""
    folders, fresh = [], graph.fresh_dir
    monkeypatch.setattr(graph, "fresh_dir", lambda s, label: folders.append(fresh(s, label)) or folders[-1])
    rng = random.Random(14)
    parents = {(0, k): [k - 1] for k in range(1, 2000)} | {(0, 0): []}
    for job in range(1, 12):
        for k in range(rng.randrange(1, 120)):
            far = rng.random() < 0.08
            parents[(job, k)] = sorted({k - 1, rng.randrange(k)}) if k and far else [k - 1] if k else []
    # Job 20: a chain behind a cycle, job 21: a chain that a cycle feeds into, job 22: a parent outside.
    parents |= {(20, k): [k - 1] for k in range(1, 30)} | {(20, 0): [4]}
    parents |= {(21, k): [k - 1] for k in range(1, 9)} | {(21, 0): [], (21, 20): [21], (21, 21): [20], (21, 5): [4, 20]}
    parents |= {(22, 0): [99], (22, 1): [0], (22, 2): []}
    cost = {node: rng.randint(0, 50) for node in parents}
    best = {}
    for _ in range(2001):
        late = [n for n, ps in parents.items() if n not in best and all((n[0], p) in best for p in ps)]
        if not late:
            break
        for n in late:
            above = [best[(n[0], p)] for p in parents[n]]
            best[n] = (1 + max((a[0] for a in above), default=-1), cost[n] + max((a[1] for a in above), default=0))
    nodes = spark.createDataFrame([("a", *n, cost[n], 0) for n in parents], "app_key string, job_id long, stage_id long, w long, _w0 long")
    edges = spark.createDataFrame([("a", *n, p) for n, ps in parents.items() for p in ps], "app_key string, job_id long, stage_id long, parent_id long")
    got = {(r.job_id, r.stage_id): (r.level, r.w) for r in graph.longest_paths(nodes, edges, ["w"]).collect()}
    assert got == {n: best.get(n, (None, None)) for n in parents}
    assert got[(0, 1999)][0] == 1999
    assert sum(len(os.listdir(folder)) for folder in folders) < 40


def test_whatif_bounds_hold(spark):
    """Longest-task-first schedules lie between the bounds; checked for whole stages."""
    import heapq

    rng = random.Random(6)
    rows, real = [], {}
    for i in range(300):
        times = [rng.randint(0, 100) for _ in range(rng.randint(1, 30))]
        cores = rng.randint(1, 12)
        slots = [0] * min(cores, len(times))
        for t in sorted(times, reverse=True):
            heapq.heappush(slots, heapq.heappop(slots) + t)
        real[i] = (max(slots), cores, len(times), sum(times))
        rows.append((i, sum(times), max(times), len(times), cores))
    frame = spark.createDataFrame(rows, "i long, run_ms long, max_task_ms long, n_accepted long, cores long")
    low, high = graph._stage_bounds(F.col("cores"))
    for r in frame.select("i", low.alias("lo"), high.alias("hi")).collect():
        span, cores, n, work = real[r.i]
        assert r.lo <= span <= r.hi
        if cores == 1:
            assert r.lo == r.hi == work
        if cores >= n:
            assert r.lo == span


def test_simplify(spark):
    """Random trees, a plan with more than 1,200 nodes and one deeper than 30."""
    import json

    from loomlog.plans.flatten import flatten_plans
    from loomlog.plans.simplify import simplify_plans

    rng = random.Random(7)
    names = ["InputAdapter", "AdaptiveSparkPlan", "ColumnarToRow", "RowToColumnar",
             "SubqueryBroadcast", "Project", "Filter", "GenerateBloomFilter"]
    trees = [random_tree(rng, names) for _ in range(300)]
    wide = {"nodeName": "Union", "children": [
        {"nodeName": rng.choice(names), "children": [{"nodeName": "Scan x", "children": []}] * rng.randint(0, 3)}
        for _ in range(900)]}
    deep = {"nodeName": "Scan", "children": []}
    for i in range(500):
        deep = {"nodeName": "InputAdapter" if i % 3 else "Project", "children": [deep]}
    trees += [wide, deep]
    starts = spark.createDataFrame(
        [("a", i, i, json.dumps(t)) for i, t in enumerate(trees)],
        "app_key string, seq long, execution_id long, plan_json string",
    )
    nodes = flatten_plans(starts)
    got = {}
    for r in simplify_plans(nodes).collect():
        got.setdefault(r.seq, []).append((r.node_id, r.depth, r.node_name))
    for i, tree in enumerate(trees):
        assert [(d, n) for _, d, n in sorted(got.get(i, []))] == model_simplify(tree), i
    assert nodes.filter("seq = 301").count() == 501


def test_unread_plans_are_rows(spark):
    """A broken plan, a list and one of 200,000 levels end no task and are accounted for."""
    from loomlog.plans.flatten import flatten_plans, unread_plans

    deep = '{"nodeName":"x","children":[' * 200_000 + "]}" * 200_000
    texts = ['{"nodeName":"x"}', '{"nodeName":', "[1]", deep, None]
    starts = spark.createDataFrame(
        [("a", n, n if n else None, t) for n, t in enumerate(texts)],
        "app_key string, seq long, execution_id long, plan_json string",
    )
    assert [r.seq for r in flatten_plans(starts).collect()] == [0]
    got = {(r.seq, r.execution_id, r.reason) for r in unread_plans(starts).collect()}
    assert got == {(1, 1, "malformed"), (2, 2, "not an object"), (3, 3, "nested too deeply")}


def test_select_executions(spark):
    """Whole selection against the two-pass rule, with duplicates and many writes."""
    from loomlog.plans.executions import select_executions

    rng = random.Random(8)
    starts, sizes, expected = [], [], {}
    seq = 0
    for app in range(60):
        items = []
        for _ in range(rng.choice([3, 25, 80])):
            root = rng.choice(["Execute InsertInto", "CreateView Write", "A", "B", "C", "Writer"])
            items.append((seq, rng.randint(0, 60), root, rng.randint(1, 120 if app % 2 else 101), "d"))
            seq += 1
            if rng.random() < 0.2:
                items.append((seq, *items[-1][1:]))
                seq += 1
        starts += [(f"a{app}", s, d, f"{e}{root}{n}") for s, e, root, n, d in items]
        sizes += [(f"a{app}", s, e, n, root, "init") for s, e, root, n, d in items]

        def write(root):
            low = root.lower()
            return ("insert" in low or "write" in low) and "Create" not in root

        ordered = sorted(items, key=lambda x: -x[3])
        chosen = [x for x in ordered if write(x[2]) or x[3] > 100]
        used, taken = {}, {x[1:] for x in chosen}
        for x in ordered:
            if len(chosen) >= 30:
                break
            if x[1:] in taken:
                continue
            if used.get(x[2], 0) < 3:
                used[x[2]] = used.get(x[2], 0) + 1
                chosen.append(x)
                taken.add(x[1:])
        chosen.sort(key=lambda x: x[1])
        expected[f"a{app}"] = [x[1] for x in chosen[:30]]
    got = select_executions(
        spark.createDataFrame(starts, "app_key string, seq long, description string, plan_json string"),
        spark.createDataFrame(sizes, "app_key string, seq long, execution_id long, n_nodes long, root string, class string"),
    )
    by_app = {}
    for r in got.collect():
        by_app.setdefault(r.app_key, []).append((r.position, r.execution_id))
    assert {a: [e for _, e in sorted(v)] for a, v in by_app.items()} == expected


SOURCES = {
    "a.py": "import x\n\ndef other():\n    return 0\n\n\ndef target_fn(x):\n    return x + 1\n",
    "b.py": "\r\n".join(["class A:", "    async def run (self):", "        df = spark.read.parquet('/data/in')",
                         "        # a comment in between", "        return df.groupBy('k').count()", ""]),
    "c.py": "x = 1\n\n\n  def main(a):\n    pass\n    value = some_long_call(argument_number_one, two)\n",
}
FINDINGS = [
    ("return x + 1", "target_fn"),
    ("def other():\n    return 0", None),
    ("  def other():\n\n return 0  ", None),
    ("df = spark.read.parquet('/data/in')\nreturn df.groupBy('k').count()", None),
    ("value = some_long_call(argument_number_one, two) + 1", None),
    ("nothing like it", "main"),
    ("nothing like it", "target_fn"),
    ("nothing like it", "run"),
    (None, "gone"),
    ("", "other"),
    ("\n\n", None),
    ("pass", None),
    ("x = 1\nsomething else entirely", None),
    ("import x\nno\nno\ndef other():", None),
]


def test_locate_snippets(spark):
    for preferred in ("c.py", None, "missing.py"):
        sources = spark.createDataFrame(
            [("r", n, i, t) for i, (n, t) in enumerate(SOURCES.items())],
            "app_key string, file_name string, file_ord int, text string",
        )
        reports = spark.createDataFrame(
            [("r", preferred, [(i, s, f) for i, (s, f) in enumerate(FINDINGS)])],
            "app_key string, job_file string, "
            "findings array<struct<finding_no:int,snippet:string,function_name:string>>",
        )
        order = sorted(SOURCES, key=lambda n: (n != preferred))
        expected = {}
        for i, (snippet, function) in enumerate(FINDINGS):
            hits = [model_locate(SOURCES[n], snippet, None) for n in order]
            hits += [model_locate(SOURCES[n], None, function) for n in order]
            best = next((h for h in hits if h), (None, None, None))
            expected[i] = best[1:]
        got = snippets.locate_snippets(reports, sources).collect()
        assert {r.finding_no: (r.line_start, r.line_end) for r in got} == expected
        assert expected[0] == (8, 8)


def test_row_order_does_not_matter(spark):
    """Shuffled lines with fixed positions give the same stage table."""
    from logs import forked_log

    log = log_from(spark, forked_log())
    shuffled = log._replace(**{
        n: getattr(log, n).repartition(3).orderBy(F.rand(9)) for n in ("tasks", "stage_events", "job_starts")
    })
    assert sorted(map(str, stages.stage_table(log).collect())) == sorted(
        map(str, stages.stage_table(shuffled).collect())
    )
