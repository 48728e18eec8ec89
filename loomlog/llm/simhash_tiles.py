"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits; a bit is one if it is set in more than half of the XXH64 values of a
text's word shingles. Texts whose fingerprints differ in at most ``RADIUS`` bits are linked, and
linked texts form a component.

Only distinct fingerprints are compared. Cut into ``RADIUS + 1`` blocks, two that are linked agree
in one block at least, so each block gives buckets to compare inside. A bucket is compared by
exclusive-or and bit counts in numpy. A large bucket is dealt into tiles of one population count
each, and a pair of tiles is skipped when the counts differ by more than the radius; each pair is
a unit of work of bounded size. A unit returns a spanning star of each of its components instead
of all pairs, so no link between different fingerprints is lost and no group is squared. Stars are
joined by rounds of minimum labels over distributed tables.

Defined cases: a null or empty text, and one of separators only, has fingerprint zero and is
linked like others; a null ``doc_id`` sorts after all numbers, and a component of such rows only
has a null ``component_id``; repeated rows are kept by ``near_components`` and reduced to one by
``keep_representatives``; an empty table gives no rows; other columns are carried by
``keep_representatives`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import slices
from loomlog.session import materialize
from loomlog.spread import SALT, salt_count, salted_join

WIDTH = 3
RADIUS = 2
SEED = 42
TILE = 2048
SMALL = 16
PRINTS = "row struct<unnumbered boolean, doc_id long, text_hash long>, fp long"


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The fingerprint of a text as an unsigned number."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate(([0], stops[:-1])).tolist()
    ends = (stops - 1).tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, fp`` per document: ``row`` orders documents, numbered ones by number first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(_row().alias("row"), text.alias("text"))

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(text, width) for text in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found.view(np.int64))], names=["row", "fp"]
            )

    return rows.mapInArrow(compute, PRINTS)


def _row() -> Column:
    number = F.col("doc_id").cast("long")
    return F.struct(
        number.isNull().alias("unnumbered"),
        number.alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
    )


def link_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``keys``: from, to. Small runs give their pairs, others stars.

    ``fps`` are unsigned, as numpy counts the bits of the absolute value of signed ones.
    """
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, min(SMALL, len(keys))):
        a, b = fps[:-shift], fps[shift:]
        hit = (keys[:-shift] == keys[shift:]) & small[shift:]
        if not hit.any():
            break
        hit &= np.bitwise_count(a ^ b) <= radius
        left.append(a[hit])
        right.append(b[hit])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        a, b = link_tile(np.unique(fps[start : start + size]), radius)
        left.append(a)
        right.append(b)
    empty = np.zeros(0, dtype=fps.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def link_tile(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the distinct ``fps``: centre, member.

    Sorted by population count, so a fingerprint meets only those whose counts are near enough.
    """
    counts = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order]
    low = np.searchsorted(counts, counts - radius, side="left")
    high = np.searchsorted(counts, counts + radius, side="right")
    free = np.ones(len(fps), dtype=bool)
    left, right = [], []
    for seed in range(len(fps)):
        if not free[seed]:
            continue
        free[seed] = False
        reached, stack = [], [seed]
        while stack:
            at = stack.pop()
            a, b = low[at], high[at]
            near = np.flatnonzero(free[a:b] & (np.bitwise_count(fps[a:b] ^ fps[at]) <= radius)) + a
            free[near] = False
            reached.append(near)
            stack += near.tolist()
        members = np.concatenate(reached)
        left.append(np.full(len(members), fps[seed]))
        right.append(fps[members])
    empty = np.zeros(0, dtype=fps.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that give all their components."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    blocks = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned(F.shiftleft("fp", 64 - high), 64 - high + low).alias("key"),
        )
        for k, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ]
    rows = fps.select("fp", F.explode(F.array(*blocks)).alias("at")).select("fp", "at.block", "at.key")
    counts = rows.groupBy("block", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    counts = materialize(counts, "tile-sizes")
    rows = salted_join(rows, counts, ["block", "key"], ["fp"], how="inner")
    ones = F.bit_count("fp").cast("int")
    parts = F.ceil(F.col("size") / F.lit(8 * tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # A tile holds one population count and one part; the unit of two tiles is named by the lesser
    # count, the difference, and the two parts, ordered where the counts are equal.
    other = F.explode(
        F.when(F.col("size") <= tile, F.array(F.struct(*[F.lit(0).alias(c) for c in "cdpq"]))).otherwise(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(-radius), F.lit(radius)),
                    lambda d: F.transform(
                        F.sequence(F.lit(0), parts - 1),
                        lambda p: F.struct(
                            F.least(ones, ones + d).alias("c"),
                            F.abs(d).alias("d"),
                            F.when(d > 0, own).when(d < 0, p).otherwise(F.least(own, p)).alias("p"),
                            F.when(d > 0, p).when(d < 0, own).otherwise(F.greatest(own, p)).alias("q"),
                        ),
                    ),
                )
            )
        )
    )
    units = rows.select("fp", "block", "key", other.alias("u"))
    units = units.select(F.xxhash64("block", "key", "u.c", "u.d", "u.p", "u.q").alias("unit"), "fp")
    units = units.repartition("unit").sortWithinPartitions("unit", "fp")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            sides = [pa.array(side.view(np.int64)) for side in link_runs(keys, held, radius)]
            return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

        keys, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("unit").to_numpy()))
            held = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield linked(keys[:whole], held[:whole])
                keys, held = keys[whole:], held[whole:]
        if len(keys):
            yield linked(keys, held)

    return units.mapInArrow(compare, "a long, b long").filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of every node in ``edges (a, b)``.

    Rounds of large and small stars: a node's greater neighbours move to its least one, then its
    lesser ones do. Every round is written, and the rounds end when nothing moves.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.filter("a != b").distinct(), "large-star")
        moved = _with_least(large)
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a != b").distinct(), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_least(edges: DataFrame) -> DataFrame:
    """``a, b, m``: every edge with the least neighbour of ``a``.

    The edges of a node are dealt to parts by a hash of the neighbour. Its minimum, taken over the
    minima of the parts, goes back only to parts that hold edges: never more rows than edges.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(salt_count(edges.sparkSession))).cast("int")
    edges = edges.select("a", "b", part.alias(SALT)).repartition("a", SALT)
    parts = edges.groupBy("a", SALT).agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list(SALT).alias("parts"))
    least = least.select("a", "m", F.explode("parts").alias(SALT))
    return edges.join(least, ["a", SALT]).drop(SALT)


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    both = edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum((mixed % 1_000_003).cast("long")))
    return tuple(both.first())


def near_components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``row, fp, rep`` per document: ``rep`` is the least row of its component."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min("row").alias("least")), "distinct-fingerprints")
    roots = materialize(components(links(least.select("fp"), radius)), "roots")
    marked = least.join(roots, least["fp"] == roots["node"], "left")
    marked = marked.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only fingerprints with links need their component's least row looked up.
    reps = marked.groupBy("root").agg(F.min("least").alias("rep"))
    by_fp = materialize(salted_join(marked, reps, ["root"], ["fp"], "inner").select("fp", "rep"), "reps")
    return salted_join(prints, by_fp, ["fp"], ["row"], "inner")


def keep_representatives(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the row with the least ``doc_id``."""
    found = near_components(docs, width, radius)
    reps = found.filter(F.col("row") == F.col("rep")).select(F.col("rep").alias("_rep_row")).distinct()
    reps = materialize(reps, "kept-rows")
    alias = docs.withColumn("_own_row", _row())
    kept = alias.join(reps, alias["_own_row"] == reps["_rep_row"], "left_semi")
    return kept.dropDuplicates(["_own_row"]).select(*docs.columns)
