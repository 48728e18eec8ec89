"""Near-copies by word shingles: candidates as operator 8 finds them, decided by the shingles.

Two texts are near-copies if the sets of their five-word shingles (A-Z lower-cased) overlap by
0.8 of their union or more, and near-copies form components. Candidates come first. Each text has a
SimHash of 512 bits over its set; sets of similarity 0.8 differ in 77 bits on average with a
deviation of 8, sets of 4 and 5 shingles in 96 with one of 9. Texts of ``RADIUS`` bits or fewer are
candidates, so a pair of 0.8 is missed by the bits with a chance of one in ten thousand at most.

No block of the bits need agree at such a radius, so the buckets to compare inside come from
``BANDS`` keys of ``ROWS`` least hash values each: a pair of similarity 0.8 shares a bucket but
for a chance of 3 in 100,000. A bucket is compared exactly, by exclusive-or and bit counts in
numpy, skipping pairs whose population counts differ beyond the radius.

Inside a component of candidates the sets themselves are compared, each pair of them that no
accepted pairs join already, so a candidate that is refused costs nothing but its comparison. Sets
are made again from the texts, for members of such components only, and travel once where a
component fits a unit.

A bucket of more than ``tile`` fingerprints is dealt into tiles, with some members in all of
them, and a component of more sets than that, or of more than ``SET_BYTES``, likewise.
After a first round of components, pairs across tiles matter only where a bucket still
holds several components, and only if one of the two lies outside its largest: those outside meet
all tiles in a second round. So no linked pair of a bucket stays apart, a group of copies of each
other costs in proportion to its rows, and every unit of work holds about two tiles. A large bucket
without a main component still costs its tiles times the tiles outside the main one.

Defined cases: a text of fewer words than a shingle is one shingle, and texts without words (null
ones too) are equal to each other; a null ``doc_id`` sorts after all numbers; of repeated rows one
stays; an empty table gives no rows; other columns are carried and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.simhash_tiles import _LOWER, SEED, SMALL, TILE, _row, components
from loomlog.llm.tokens import slices
from loomlog.session import materialize
from loomlog.spread import salted_join

WIDTH = 5
LANES = 8
RADIUS = 128
BANDS, ROWS = 20, 4
PIVOTS = 32
SET_BYTES = 1 << 22
SKETCH = "row struct<unnumbered boolean, doc_id long, text_hash long>, print binary, bands array<long>, shingles binary"

_CHUNK = 4080
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, size=LANES + BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    joined = b" ".join(words)
    stops = np.cumsum([len(word) + 1 for word in words], dtype=np.int64)
    starts = [0, *stops[:-1].tolist()]
    ends = (stops - 1).tolist()[min(width, len(words)) - 1 :] if words else [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64))


def sketch(text: str, width: int = WIDTH) -> tuple[bytes, list[int]]:
    """A text's fingerprint of ``64 * LANES`` bits and its bucket keys."""
    return sketch_of(shingle_hashes(text, width))


def sketch_of(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The same from a text's shingles."""
    import xxhash

    ones = np.zeros(64 * LANES, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK]
        # Each lane is a mix of the value of its own, so that its bits are independent ones.
        mixed = part[:, None] * _ODD[None, :LANES]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD[None, :LANES]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        # 255 rows of ones at most fit a byte.
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        for j, odd in enumerate(_ODD[LANES:]):
            least[j] = min(least[j], (part * odd).min())
    keys = least.astype("<u8").reshape(BANDS, ROWS)
    bands = [xxhash.xxh64_intdigest(keys[band].tobytes(), band) - (1 << 63) for band in range(BANDS)]
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), bands


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, print, bands, shingles`` per document; ``shingles`` names the set by a digest of 128 bits."""
    rows = docs.select(_row().alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            prints, bands, names = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, width)
                print_, keys = sketch_of(hashes)
                prints.append(print_)
                bands.append(keys)
                names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            columns = [pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *columns], names=["row", "print", "bands", "shingles"]
            )

    return rows.mapInArrow(compute, SKETCH)


def link_units(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows inside runs of equal ``keys``: from, to.

    Small runs give their pairs; of larger ones, the edges by which each component was walked.
    """
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for shift in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero((keys[:-shift] == keys[shift:]) & small[shift:])
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + shift]).sum(axis=1) <= radius]
        left.append(at)
        right.append(at + shift)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        a, b = walk(prints[start : start + size], radius)
        left.append(a + start)
        right.append(b + start)
    return np.concatenate(left), np.concatenate(right)


def walk(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a walk through each component of ``prints``.

    What is not reached yet stays sorted by population count, so a fingerprint meets only those
    whose counts are near enough, and each is reached once.
    """
    counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    rest = np.argsort(counts, kind="stable")
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            low, high = np.searchsorted(counts[rest], (counts[at] - radius, counts[at] + radius + 1))
            near = np.flatnonzero(np.bitwise_count(prints[rest[low:high]] ^ prints[at]).sum(axis=1) <= radius) + low
            if len(near):
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                stack += found.tolist()
                rest = np.delete(rest, near)
    return np.concatenate(left), np.concatenate(right)


def walk_sets(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The edges of a walk through each component of ``sets`` of distinct values that are near-copies.

    What is not reached yet stays sorted by size, so a set meets only those of a size near enough.
    """
    sizes = np.array([len(one) for one in sets], dtype=np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    own = np.zeros(len(codes), dtype=bool)
    rest = np.argsort(sizes, kind="stable")
    left, right = [], []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            size = int(sizes[at])
            low, high = np.searchsorted(sizes[rest], (-(-4 * size // 5), 5 * size // 4 + 1))
            tried = rest[low:high]
            if not len(tried):
                continue
            own[parts[at]] = True
            begins = np.cumsum(sizes[tried]) - sizes[tried]
            both = np.add.reduceat(own[np.concatenate([parts[k] for k in tried.tolist()])], begins, dtype=np.int64)
            own[parts[at]] = False
            near = np.flatnonzero(5 * both >= 4 * (size + sizes[tried] - both))
            found = tried[near].tolist()
            left += [at] * len(found)
            right += found
            stack += found
            rest = np.delete(rest, near + low)
    return left, right


def _compare_sets(units: DataFrame) -> DataFrame:
    """``a, b``: near-copies among rows ``unit, node, hashes`` of one unit."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held, current = [], [], {}, None

        def close() -> None:
            if len(held) > 1:
                names = list(held)
                a, b = walk_sets([np.frombuffer(data, dtype="<u8") for data in held.values()])
                left.extend(names[k] for k in a)
                right.extend(names[k] for k in b)
            held.clear()

        def edges() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in (left, right)], names=["a", "b"])
            left.clear()
            right.clear()
            return batch

        for batch in slices(batches):
            columns = [batch.column(name).to_pylist() for name in ("unit", "node", "hashes")]
            for unit, node, hashes in zip(*columns):
                if unit != current:
                    close()
                    current = unit
                held[node] = hashes
            if len(left) > TILE:
                yield edges()
        close()
        yield edges()

    units = units.repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(compare, "a binary, b binary").distinct()


def _compare(units: DataFrame, radius: int) -> DataFrame:
    """``a, b``: linked fingerprints among rows ``unit, node`` of one unit."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            a, b = link_units(keys, data, radius)
            sides = [pa.array([row.tobytes() for row in data[side]], pa.binary()) for side in (a, b)]
            return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

        keys, data = np.zeros(0, dtype=np.int64), np.zeros((0, LANES), dtype=np.uint64)
        for batch in slices(batches, 4 * TILE):
            held = np.frombuffer(b"".join(batch.column("node").to_pylist()), dtype="<u8").reshape(-1, LANES)
            keys = np.concatenate((keys, batch.column("unit").to_numpy()))
            data = np.concatenate((data, held))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield linked(keys[:whole], data[:whole])
                keys, data = keys[whole:], data[whole:]
        if len(keys):
            yield linked(keys, data)

    units = units.repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(compare, "a binary, b binary").filter("a != b").distinct()


def roots(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``node, root``: the least fingerprint of the component of each linked one of ``print, bands``."""
    rows = nodes.select(F.col("print").alias("node"), F.explode("bands").alias("key"))
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "copy-sizes")
    rows = salted_join(rows, sizes, ["key"], ["node"], "inner")
    rows = rows.withColumn("tiles", F.ceil(F.col("size") / F.lit(tile)).cast("int"))
    return _joined(rows, lambda units: _compare(units, radius))


def exact_roots(members: DataFrame, tile: int = TILE) -> DataFrame:
    """``node, root``: the same for sets of shingles, by similarity, of ``node, key, hashes``."""
    weight = F.sum(F.octet_length("hashes").cast("long"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), weight.alias("bytes")).filter("size > 1")
    tiles = F.greatest(F.ceil(F.col("size") / F.lit(tile)), F.ceil(F.col("bytes") / F.lit(SET_BYTES))).cast("int")
    sizes = materialize(sizes.select("key", "size", tiles.alias("tiles")), "copy-set-sizes")
    return _joined(salted_join(members, sizes, ["key"], ["node"], "inner"), _compare_sets, ["hashes"])


def _joined(rows: DataFrame, compare: Callable[[DataFrame], DataFrame], carried: list[str] | None = None) -> DataFrame:
    """``node, root`` of the linked ones among ``node, key, size, tiles`` and what ``compare`` reads."""
    carried = carried or []
    tiles = F.col("tiles")
    own = F.pmod(F.xxhash64("node", "key"), tiles).cast("int")
    pivot = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("size") / F.lit(PIVOTS))) == 0
    all_tiles = F.sequence(F.lit(0), tiles - 1)
    parts = F.when(tiles == 1, F.array(F.lit(0))).when(pivot, all_tiles).otherwise(F.array(own))
    units = rows.select("node", "key", *carried, F.explode(parts).alias("part"))
    units = units.select(F.xxhash64("key", "part").alias("unit"), "node", *carried)
    edges = materialize(compare(units), "copy-links")
    first = materialize(components(edges), "copy-roots")

    large = rows.filter("tiles > 1").select("node", "key", "size", own.alias("own"), "tiles", *carried)
    large = salted_join(large, first.select("node", "root"), ["node"], ["key"], "left")
    large = materialize(large.withColumn("root", F.coalesce("root", "node")), "copy-large")
    shares = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    mixed = mixed.select("key", F.col("top.root").alias("main"), (F.col("all") - F.col("top.n")).alias("others"))
    mixed = materialize(mixed.filter("others > 0"), "copy-mixed")
    if mixed.isEmpty():
        return first
    open_rows = salted_join(large, mixed, ["key"], ["node"], "inner")
    slots = F.ceil(F.col("others") * tiles / F.col("size")).cast("int")
    slot = F.pmod(F.xxhash64("key", "node", F.lit(1)), slots).cast("int")
    # Every row meets the rows outside the main component: unit (tile, slot) holds both.
    here = F.transform(F.sequence(F.lit(0), slots - 1), lambda s: F.struct(F.col("own").alias("t"), s.alias("s")))
    there = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(t.alias("t"), slot.alias("s")))
    both = F.when(F.col("root") == F.col("main"), here).otherwise(F.array_union(here, there))
    units = open_rows.select("node", "key", *carried, F.explode(both).alias("u"))
    units = units.select(F.xxhash64("key", "u.t", "u.s", F.lit(2)).alias("unit"), "node", *carried)
    # Rows of one component need no link of their own; its edges are in the first round.
    found = compare(units).union(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(materialize(found, "copy-links"))


def _members(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """``node, key, hashes`` of the sets that have a candidate; ``key`` is their component's root."""
    keyed = nodes.join(candidates.select(F.col("node").alias("print"), "root"), "print", "left")
    keyed = materialize(keyed.select("shingles", "least", F.coalesce("root", "print").alias("key")), "copy-keys")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    wanted = salted_join(keyed, materialize(several, "copy-several"), ["key"], ["shingles"], "left_semi")
    texts = docs.select(_row().alias("least"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(materialize(wanted, "copy-wanted"), "least").select("shingles", "key", "text")

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(text, width).astype("<u8").tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shingles"), batch.column("key"), pa.array(sets, pa.binary())], names=["node", "key", "hashes"]
            )

    # A repeated row comes as often as it is repeated.
    texts = texts.dropDuplicates(["shingles"])
    return materialize(texts.mapInArrow(compute, "node binary, key binary, hashes binary"), "copy-sets")


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs``, all columns: of each component of near-copies the least ``doc_id``."""
    drawn = materialize(sketches(docs, width), "sketches")
    nodes = drawn.groupBy("shingles").agg(F.min("row").alias("least"), F.min("print").alias("print"), F.min("bands").alias("bands"))
    nodes = materialize(nodes, "distinct-sketches")
    prints = nodes.groupBy("print").agg(F.min("bands").alias("bands"))
    candidates = materialize(roots(prints, radius, tile), "candidate-roots")
    members = _members(docs, nodes.select("shingles", "least", "print"), candidates, width)
    found = materialize(exact_roots(members, tile), "roots")
    marked = nodes.select("shingles", "least").join(found, F.col("shingles") == F.col("node"), "left")
    reps = marked.groupBy(F.coalesce("root", "shingles").alias("root")).agg(F.min("least").alias("_rep_row"))
    reps = materialize(reps.select("_rep_row"), "kept-rows")
    own = docs.withColumn("_own_row", _row())
    kept = own.join(reps, own["_own_row"] == reps["_rep_row"], "left_semi")
    return kept.dropDuplicates(["_own_row"]).select(*docs.columns)
