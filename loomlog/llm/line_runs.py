"""Line deduplication with levelled sorted runs of line hashes.

The hashes of the lines seen so far lie in runs: tables bucketed and sorted by hash, one entry
``h1, h2, n, top`` for a hash, ``n`` documents hold it, ``top`` is the largest ``doc_id`` of them.
Documents come in batches of descending ``doc_id``. Each new batch

1. reduces its lines to one entry a hash (partial sums, so a line that everyone holds is no hot key),
2. merge-anti-joins the runs: a hash that a run already knows from ``min_docs`` documents is
   settled, as its ``top`` cannot change any more, and the batch's entry for it goes,
3. adds the rest as a new run of level 0.

``fanout`` runs of a level are merged into one of the next, entries of one hash into one. So a batch
meets at most ``fanout - 1`` runs in each of log(batches) levels, all partitioned and sorted alike: the
joins shuffle the batch's entries only. Runs hold every hash, so counts cover all documents.

In the end a hash whose entries count ``min_docs`` documents or more is common, and its lines go from
every document but ``top``. The pairs of documents and common hashes are joined by hash, where the
adaptive skew join cuts a hot hash into parts; what a document loses is collected by document,
bounded by its own lines, and joined to the texts once.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; keys under ``min_chars``
code points are never dropped. Hashes have 128 bits (XXH3).

Defined cases: a null or empty text is one empty line; a text of any length is cut by one task; each
row is one document for the counts, so repeated rows count apart, and rows that share the largest
``doc_id`` all keep their lines; a null ``doc_id`` is below all others, and if only such rows hold a line,
they all keep it; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.tokens import slices
from loomlog.session import fresh_dir, materialize

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]
ROW = ["k1", "k2"]


def key_of(line: bytes) -> bytes:
    """Bytes strip and lower-case exactly the ASCII characters that a key ignores."""
    return line.strip().lower()


def hash_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, None for a short one."""
    import xxhash

    key = key_of(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _rows(docs: DataFrame) -> DataFrame:
    """``k1, k2, doc_id, text``; the keys name a row by its id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select(
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"),
        "doc_id",
        F.col("text").cast("binary").alias("text"),
    )


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``k1, k2, doc_id, hashes``: the different hashes of each row's lines; no shuffle."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                {h for line in set(text.as_py().split(b"\n")) if (h := hash_of(line, min_chars)) is not None}
                for text in batch.column("text")
            ]
            ends = np.cumsum([0, *map(len, found)])
            halves = np.frombuffer(b"".join(h for hashes in found for h in sorted(hashes)), dtype=">i8").astype("<i8")
            pairs = pa.StructArray.from_arrays([pa.array(halves[0::2]), pa.array(halves[1::2])], names=HASH)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=[*ROW, "doc_id", "hashes"])

    schema = "k1 long, k2 long, doc_id long, hashes array<struct<h1: long, h2: long>>"
    return _rows(docs).mapInArrow(cut, schema)


class LineRuns:
    """The runs of one deduplication; their files lie in the shared folder.

    Runs are tables of the session's catalog, as Spark keeps bucketing there; ``forget`` takes them
    out of it again. A batch must hold smaller ``doc_id`` than all batches before it.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self._spark, self._min_docs, self._fanout = spark, min_docs, fanout
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def add(self, lines: DataFrame) -> None:
        """A batch, given by ``h1, h2, doc_id`` with one row for each hash of each document."""
        own = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        for name in self._names():
            own = own.join(self._spark.table(name).filter(F.col("n") >= self._min_docs), HASH, "left_anti")
        self._write(own, 0)

    def common(self) -> DataFrame:
        """``h1, h2, top`` of the hashes that ``min_docs`` documents hold."""
        return self._merged(self._names()).filter(F.col("n") >= self._min_docs).select(*HASH, "top")

    def forget(self) -> None:
        self._drop(self._names())
        self.levels = []

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        runs = self._spark.table(names[0])
        for name in names[1:]:
            runs = runs.unionByName(self._spark.table(name))
        return runs.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = entries.select(*HASH, "n", "top").write.bucketBy(self._buckets, *HASH).sortBy(*HASH)
        writer.format("parquet").option("path", fresh_dir(self._spark, "line-run")).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self._fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._merged(merged), level + 1)
            self._drop(merged)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch_number(docs: DataFrame, batches: int) -> Column:
    """Numbers of about equal ranges of ``doc_id``, largest first; null in the last."""
    doc_id = F.col("doc_id").cast("long")
    shares = [1 - k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(doc_id, shares, 1000).alias("cuts")).first()["cuts"] if shares else None
    number = F.lit(batches - 1)
    for k, cut in reversed(list(enumerate(cuts or []))):
        number = F.when(F.col("doc_id") > F.lit(cut), k).otherwise(number)
    return number


def stored_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``line_hashes`` with their ``batch``, written by batch and read back."""
    spark = docs.sparkSession
    lines = line_hashes(docs, min_chars).withColumn("batch", _batch_number(docs, batches))
    path = fresh_dir(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def common_lines(
    lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``h1, h2, top`` of the common hashes of ``stored_lines``, by way of the levelled runs."""
    runs = LineRuns(lines.sparkSession, min_docs, fanout)
    for batch in range(batches):
        rows = lines.filter(F.col("batch") == batch).select("doc_id", F.explode("hashes").alias("h"))
        runs.add(rows.select("h.h1", "h.h2", "doc_id"))
    found = materialize(runs.common(), "common-lines")
    runs.forget()
    return found


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs``; ``kept`` is the text left."""
    lines = stored_lines(docs, min_chars, batches)
    common = common_lines(lines, min_docs, batches, fanout)
    pairs = lines.select(*ROW, "doc_id", F.explode("hashes").alias("h")).select(*ROW, "doc_id", "h.h1", "h.h2")
    lost = pairs.join(common, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = lost.groupBy(*ROW).agg(F.collect_set(F.struct(*HASH)).alias("lost"))
    rows = _rows(docs).join(lost, ROW, "left").select("doc_id", "text", "lost")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, totals, dropped = [], [], []
            for text, lost in zip(batch.column("text"), batch.column("lost")):
                text = text.as_py()
                totals.append(text.count(b"\n") + 1)
                dropped.append(0)
                if lost.is_valid:
                    gone = np.array([[pair["h1"], pair["h2"]] for pair in lost.as_py()], dtype=">i8").tobytes()
                    hashes = {gone[k : k + 16] for k in range(0, len(gone), 16)}
                    left = [line for line in text.split(b"\n") if hash_of(line, min_chars) not in hashes]
                    dropped[-1] = totals[-1] - len(left)
                    text = b"\n".join(left)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(totals, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return rows.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB.
ORACLE = f"""
    with rows as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    cut as (select row, doc_id, string_split(text, chr(10)) as parts from rows),
    lines as (
      select row, doc_id, unnest(parts) as line, unnest(range(len(parts))) as place from cut),
    keyed as (
      select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
    held as (select distinct row, doc_id, key from keyed where length(key) >= {MIN_CHARS}),
    common as (
      select key, max(doc_id) as top from held group by key having count(*) >= {MIN_DOCS}),
    marked as (
      select k.row, k.doc_id, k.line, k.place, c.key is not null and k.doc_id is distinct from c.top as gone
      from keyed k left join common c on k.key = c.key)
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
    from marked group by row
"""
