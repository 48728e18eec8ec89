"""Line deduplication against a plain count, and the levels of its runs."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlog.llm import line_runs

SCHEMA = "doc_id long, text string, n string, top long, h1 string, batch int, lost string"
COMMON = ["  Subscribe to our Newsletter today! ", "ALL RIGHTS RESERVED, See The Terms.", "été çà Été exactly ten\tplus x", "-" * 25]


def plain_rows(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    holders = {}
    for k, (doc_id, text) in enumerate(rows):
        for found in {key(line) for line in (text or "").split("\n")}:
            if len(found) >= 20:
                holders.setdefault(found, {})[k] = doc_id
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), {})
            top = max((d for d in held.values() if d is not None), default=None)
            if len(held) < 3 or doc_id == top:
                kept.append(line)
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found.append((doc_id, len(lines), len(lines) - len(kept), sha))
    return sorted(found, key=lambda row: (row[0] is None, row))


def messy_rows(n=120):
    chance = random.Random(6)
    rows = [(None, None), (None, ""), (1, "\n\n"), (2, " \t\n"), (3, "x" * 19), (4, "x" * 20), (5, "é" * 19), (6, "y" * 100_000)]
    for k in range(7, n):
        lines = [chance.choice([f"own line {k} of this document", "", "short", *COMMON]) for _ in range(chance.randrange(12))]
        lines = [chance.choice([str.upper, str.lower, str])(line) if line.isascii() else line for line in lines]
        rows.append((k if k % 17 else None, "\n".join(lines)))
    # An id three times, rows that repeat as they are, two holders only, a line within one text only.
    rows += [(n, COMMON[0]), (n, COMMON[0] + "\nmore"), (n, "Ü" * 30), *rows[30:34]]
    rows += [(900, "only two documents hold this"), (901, "ONLY two documents hold this "), (902, "again and again and again\n" * 5)]
    rows += [(None, "only rows without an id hold it")] * 3
    rows += [(1000 + k, "\n".join(f"line {j} of a long shared passage" for j in range(3000))) for k in range(3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*row, "n", 1, "h", 2, "l") for row in rows], SCHEMA).repartition(3)


def got(found):
    return sorted((tuple(row) for row in found.collect()), key=lambda row: (row[0] is None, row))


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (7, 3)])
def test_dropped_lines_equal_a_plain_count(spark, batches, fanout):
    rows = messy_rows()
    found = line_runs.drop_common_lines(table(spark, rows), batches=batches, fanout=fanout)
    assert got(line_runs.digests(found)) == plain_rows(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_sql_equals_the_operator(spark):
    rows = messy_rows()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(line_runs.ORACLE).fetchall(), key=lambda row: (row[0] is None, row)) == plain_rows(rows)


def test_runs_are_levelled(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=2)
    shapes = []
    for batch in range(6):
        ids = [100 - 10 * batch - k for k in range(4)]
        lines = spark.createDataFrame([(h, -h, k) for k in ids for h in (1, 2 + batch % 2)], "h1 long, h2 long, doc_id long")
        runs.add(lines)
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    entries = [spark.table(name) for level in runs.levels for name in level]
    # Settled hashes are not added again, so each has one entry, with the largest id.
    assert sorted(tuple(row) for run in entries for row in run.collect()) == [(1, -1, 4, 100), (2, -2, 4, 100), (3, -3, 4, 90)]
    assert sorted(tuple(row) for row in runs.common().collect()) == [(1, -1, 100), (2, -2, 100), (3, -3, 90)]
    plan = runs._merged([name for level in runs.levels for name in level])._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    runs.forget()


def test_empty_table(spark):
    found = line_runs.drop_common_lines(table(spark, messy_rows()).filter(F.lit(False)))
    assert found.collect() == [] and found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
