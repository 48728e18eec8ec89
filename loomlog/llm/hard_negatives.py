"""Hard-negative mining by exact integer products of anchors and candidates.

Vectors become whole numbers, so every score is an exact inner product. Anchors and candidates
meet in blocks: candidates are dealt to chunks and anchors to blocks by hashes of their ids, each
pair of block and chunk is one group of bounded size, and inside it tiles of anchors and candidates
are multiplied by Strassen's recursion over int64, padded with zeros to even sizes. A leaf product
runs in floating point only where the sum of its largest possible terms is below 2**53, which
makes it exact, and in int64 otherwise.

From each tile an anchor keeps a heap of its best candidates, which merges with the heaps of other
tiles, and so do the heaps of other chunks in a ranked limit per anchor. There are two rounds:

1. positives: only rows of one label group (a hash of the label) meet, each anchor keeps its best
   rows of the same label;
2. windows: all rows meet. Each positive of an anchor opens a window of scores, and keeps a heap of
   the best rows of another label inside it.

A round ships each candidate once for each block of ``BLOCK`` anchors and each anchor once for each
chunk, never a pair; a label that holds a third of all rows is cut into blocks and chunks like the
rest. The work is that of the stated anchors against all rows.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite component take no
part; components are clamped to 2**26 after scaling; vectors of different sizes are padded with
zeros, and one of no components scores 0; of several rows with one id the one with the smallest label,
then the smallest vector takes part; an anchor without a positive, or a positive without a row in its
window, gives no rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import materialize

POSITIVES, NEGATIVES = 5, 3
#: The window of a positive's score, in percent.
LOWEST, HIGHEST = 50, 95
SCALE = 256
GROUPS = 16
BLOCK, CHUNK, LEAST_CHUNK = 4096, 65_536, 2048
ANCHOR_TILE, CANDIDATE_TILE, LEAF = 256, 2048, 32
NO_SCORE = -(2**63 - 1)
NO_ID = 2**63 - 1
LIMIT = 2**26

Heaps = tuple[np.ndarray, np.ndarray]


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The exact product of two int64 matrices, by seven products of halves."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return _leaf(a, b)
    a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    whole = np.empty((2 * i, 2 * j), dtype=np.int64)
    whole[:i, :j] = m1 + m4 - m5 + m7
    whole[:i, j:] = m3 + m5
    whole[i:, :j] = m2 + m4
    whole[i:, j:] = m1 - m2 + m3 + m6
    return whole[:rows, :columns]


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] * _largest(a) * _largest(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def top(scores: np.ndarray, ids: np.ndarray, size: int) -> Heaps:
    """The best ``size`` of each row, by score from above, then id; heaps as sorted arrays."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :size]
    best, who = np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)
    missing = [(0, 0)] * (scores.ndim - 1) + [(0, max(0, size - best.shape[-1]))]
    return np.pad(best, missing, constant_values=NO_SCORE), np.pad(who, missing, constant_values=NO_ID)


def merge(one: Heaps, other: Heaps, size: int) -> Heaps:
    """The heaps over both parts."""
    return top(np.concatenate((one[0], other[0]), -1), np.concatenate((one[1], other[1]), -1), size)


def best_positives(scores: np.ndarray, mine: np.ndarray, labels: tuple, ids: np.ndarray, size: int) -> Heaps:
    """Heaps of one tile; ``ids`` ascend, so a stable sort leaves ties in order of ids."""
    right = (labels[0][:, None] == labels[1][None, :]) & (mine[:, None] != ids[None, :])
    scores = np.where(right, scores, NO_SCORE)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :size]
    best = np.take_along_axis(scores, order, 1)
    return top(best, np.where(best == NO_SCORE, NO_ID, ids[order]), size)


def best_in_windows(scores: np.ndarray, labels: tuple, ids: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> Heaps:
    """Heaps of one tile for each anchor and window: rows of another label, ``low <= score <= high``."""
    scores = np.where(labels[0][:, None] != labels[1][None, :], scores, NO_SCORE)
    order = np.argsort(-scores, axis=1, kind="stable")
    scores = np.take_along_axis(scores, order, 1)
    above = np.stack([(scores > edge[:, None]).sum(axis=1) for edge in high.T], axis=1)
    places = above[:, :, None] + np.arange(size)
    inside = places < scores.shape[1]
    places = np.where(inside, places, 0).reshape(len(scores), -1)
    best = np.take_along_axis(scores, places, 1).reshape(above.shape + (size,))
    who = ids[np.take_along_axis(order, places, 1)].reshape(best.shape)
    inside &= (best >= low[:, :, None]) & (best != NO_SCORE)
    return np.where(inside, best, NO_SCORE), np.where(inside, who, NO_ID)


def share(scores: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of whole scores, rounded down or up, without overflow."""
    hundreds, rest = np.divmod(scores, 100)
    part = percent * rest
    return percent * hundreds + (-(-part // 100) if up else part // 100)


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    array = lists.combine_chunks()
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.zeros((len(sizes), width), dtype=np.int64)
    whole[np.arange(width)[None, :] < sizes[:, None]] = array.flatten().to_numpy(zero_copy_only=False)
    return whole


def _width(*tables: pa.Table) -> int:
    return max((size or 0 for table in tables for size in table.column("q").combine_chunks().value_lengths().to_pylist()), default=0)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, list[tuple[slice, np.ndarray]]]]:
    """For each tile of anchors the tiles of candidates with their scores."""
    width = _width(anchors, rows)
    left, right = _matrix(anchors.column("q"), width), _matrix(rows.column("q"), width).T
    for a in range(0, len(left), ANCHOR_TILE):
        mine = slice(a, a + ANCHOR_TILE)
        yield mine, ((slice(c, c + CANDIDATE_TILE), strassen(left[mine], right[:, c : c + CANDIDATE_TILE])) for c in range(0, right.shape[1], CANDIDATE_TILE))


def whole_rows(rows: DataFrame, label: Column, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, with whole components."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    scaled = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    known = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).filter(usable)
    one = known.groupBy("vec_id").agg(F.min(F.struct("label", scaled.alias("q"))).alias("row"))
    return one.select("vec_id", "row.label", "row.q")


def _meet(anchors: DataFrame, rows: DataFrame, group: Column) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows with the keys ``group, block, chunk`` under which they meet.

    At most ``GROUPS`` counts come to the driver. A group with few rows is still cut into one chunk
    for each shuffle partition, down to ``LEAST_CHUNK`` rows.
    """
    counts = [table.groupBy(group.alias("g")).count().collect() for table in (anchors, rows)]
    n_anchors, n_rows = ({row["g"]: row["count"] for row in found} for found in counts)
    if not n_anchors:
        n_anchors = {-1: 1}
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = {g: math.ceil(n / BLOCK) for g, n in n_anchors.items()}
    chunks = {g: max(math.ceil(n / CHUNK), min(tasks, math.ceil(n / LEAST_CHUNK))) for g, n in n_rows.items()}

    def number(of: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in (of or {-1: 1}).items() for x in pair]), F.col("group"))

    def dealt(seed: int, into: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), number(into)).cast("int")

    def each(of: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), number(of) - 1))

    left = anchors.withColumn("group", group).withColumn("block", dealt(1, blocks)).withColumn("chunk", each(chunks))
    right = rows.withColumn("group", group).filter(F.col("group").isin(*blocks))
    return left, right.withColumn("chunk", dealt(2, chunks)).withColumn("block", each(blocks))


def _best(rows: DataFrame, keys: list[str], score: str, who: str, size: int) -> DataFrame:
    """The ranked limit that merges heaps; Spark applies it before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), who)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` come from ``whole_rows``; ``is_anchor`` is a condition on them.
    """
    rows = materialize(rows, "vectors")
    anchors = rows.filter(is_anchor)
    keys = ["group", "block", "chunk"]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        right = right.sort_by("vec_id")
        if len(left) and len(right):
            ids, labels, own, theirs = _numbers(right, "vec_id"), _numbers(right, "label"), _numbers(left, "vec_id"), _numbers(left, "label")
            for some, tiles in _tiles(left, right):
                heaps = None
                for part, scores in tiles:
                    new = best_positives(scores, own[some], (theirs[some], labels[part]), ids[part], positives)
                    heaps = new if heaps is None else merge(heaps, new, positives)
                at, _ = np.nonzero(heaps[0] != NO_SCORE)
                taken = heaps[0] != NO_SCORE
                found.append((own[some][at], heaps[1][taken], heaps[0][taken]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), columns)))

    left, right = _meet(anchors, rows, F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        nearest, "anchor_id long, positive_id long, positive_score long"
    )
    near = _best(near, ["anchor_id"], "positive_score", "positive_id", positives)
    opened = near.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("windows")
    )
    opened = opened.select(
        F.col("anchor_id").alias("vec_id"), "windows.positive_id", "windows.positive_score"
    )
    anchors = materialize(anchors.join(opened, "vec_id"), "anchors")

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        right = right.sort_by("vec_id")
        if len(left) and len(right):
            ids, labels, own, theirs = _numbers(right, "vec_id"), _numbers(right, "label"), _numbers(left, "vec_id"), _numbers(left, "label")
            sizes = np.array([len(x) for x in left.column("positive_id")])
            open_ = np.arange(positives)[None, :] < sizes[:, None]
            of, at = _matrix(left.column("positive_id"), positives), _matrix(left.column("positive_score"), positives)
            low = np.where(open_, share(at, lowest, True), 1)
            high = np.where(open_, share(at, highest, False), 0)
            for some, tiles in _tiles(left, right):
                heaps = None
                for part, scores in tiles:
                    new = best_in_windows(scores, (theirs[some], labels[part]), ids[part], low[some], high[some], negatives)
                    heaps = new if heaps is None else merge(heaps, new, negatives)
                taken = heaps[0] != NO_SCORE
                a, w, _ = np.nonzero(taken)
                found.append((own[some][a], of[some][a, w], at[some][a, w], heaps[1][taken], heaps[0][taken]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(names, columns)))

    left, right = _meet(anchors, rows, F.lit(0))
    hard = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        inside, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    hard = _best(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB, for the query's labels, anchors and vectors.
ORACLE = f"""
    with rows as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
      from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    scored as (
      select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.q, r.q)::bigint as score
      from rows a join rows r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
    positives as (
      select anchor_id, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
    select p.anchor_id, p.positive_id,
      row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
      s.vec_id as negative_id, p.positive_score, s.score as negative_score
    from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
      and {LOWEST} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGHEST} * p.positive_score
    qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= {NEGATIVES}
"""
