"""Hard-negative mining against plain sorts over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import hard_negatives as hard

SCHEMA = "vec_id long, label int, embedding array<double>, q string, score long, rank string, block int"


def plain_mining(rows, positives=5, negatives=3, every=50):
    known = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(max(-(2.0**26), min(2.0**26, 256 * x))) for x in vector]
        known[vec_id] = min(known.get(vec_id, (label, whole)), (label, whole))
    found = []
    for anchor, (label, vector) in known.items():
        if anchor % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, other)), vec_id, mine == label)
            for vec_id, (mine, other) in known.items()
            if vec_id != anchor
        )
        for top, positive, _ in [row for row in scored if row[2]][:positives]:
            hits = [(-s, v) for s, v, same in scored if not same and 50 * -top <= 100 * -s <= 95 * -top]
            found += [(anchor, positive, k + 1, v, -top, s) for k, (s, v) in enumerate(hits[:negatives])]
    return sorted(found)


def mined(spark, rows, every=50):
    table = spark.createDataFrame([(*row, "q", 1, "r", 2) for row in rows], SCHEMA).repartition(3)
    found = hard.mine(hard.whole_rows(table, F.col("label"), "embedding"), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(row) for row in found.collect())


@pytest.mark.parametrize("leaf", [1, 4, 32])
@pytest.mark.parametrize("size", [(1, 1, 1), (5, 7, 3), (70, 64, 133), (64, 0, 9), (65, 33, 34)])
def test_strassen_is_exact(leaf, size):
    rng = np.random.default_rng(3)
    rows, inner, columns = size
    for bits in (3, 26, 31):
        a = rng.integers(-(2**bits), 2**bits, (rows, inner))
        b = rng.integers(-(2 ** min(bits, 26)), 2 ** min(bits, 26), (inner, columns))
        assert (hard.strassen(a, b, leaf) == a @ b).all()


def test_leaf_products_beyond_doubles_are_exact():
    a = np.full((3, 2), 2**31 - 1)
    b = np.full((2, 3), 2**30 - 1)
    assert (hard.strassen(a, b) == 2 * (2**31 - 1) * (2**30 - 1)).all()


def test_shares_round_as_fractions_do():
    scores = np.array([*range(-300, 300), 2**55 + 7, -(2**55) - 7])
    for percent in (50, 95):
        assert hard.share(scores, percent, False).tolist() == [percent * s // 100 for s in scores.tolist()]
        assert hard.share(scores, percent, True).tolist() == [-(-percent * s // 100) for s in scores.tolist()]


def test_merged_heaps_equal_one_heap():
    rng = np.random.default_rng(5)
    scores, ids = rng.integers(-5, 5, (4, 3, 40)), rng.permuted(np.tile(np.arange(40), (4, 3, 1)), axis=-1)
    heaps = hard.top(scores[..., :2], ids[..., :2], 5)
    for part in (slice(2, 3), slice(3, 30), slice(30, 40)):
        heaps = hard.merge(heaps, hard.top(scores[..., part], ids[..., part], 5), 5)
    assert all((a == b).all() for a, b in zip(heaps, hard.top(scores, ids, 5)))


@pytest.mark.parametrize("small", [False, True])
def test_mining_equals_plain_sorts(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(hard, "BLOCK", 7)
        monkeypatch.setattr(hard, "CHUNK", 60)
        monkeypatch.setattr(hard, "LEAST_CHUNK", 30)
    chance = random.Random(8)
    rows = []
    for k in range(400):
        # A third of all rows in one label, few different vectors, so that ties abound.
        label = 0 if k % 3 == 0 else chance.randrange(4)
        vector = [chance.choice([-0.5, 0.0, 0.25, 0.5]) + (0.5 if d == label else 0) for d in range(6)]
        rows.append((5 * k, label, vector))
    rows += [
        (None, 1, [1.0] * 6), (50, None, [1.0] * 6), (3, 1, None), (6, 1, [1.0, None]), (7, 1, [float("nan")] * 6),
        (8, 2, [float("inf")]), (9, 2, []), (100, 3, [0.25] * 8), (12, 1, [1e300, -1e300]), (13, 9, [0.1]), (-50, 1, [1.0] * 6),
        *rows[:40],
    ]
    assert mined(spark, rows) == plain_mining(rows)


def test_mining_of_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0]), (51, 1, [1.0]), (52, 1, [1.0])]) == []
    assert mined(spark, [(51, 1, [1.0]), (52, 2, [1.0])]) == []
    same = [(k, k % 2, [1.0, 0.0]) for k in range(0, 200)]
    assert mined(spark, same) == []
    assert mined(spark, [*same, (500, 1, [0.8, 0.0])]) == plain_mining([*same, (500, 1, [0.8, 0.0])])
