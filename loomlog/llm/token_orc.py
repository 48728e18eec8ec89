"""Token ids in ORC files, in ascending document order.

ORC stores the ids of each stripe run-length encoded, keeps minima and maxima of ``doc_id`` for
every row group, and Bloom filters beside them. So a reader opens stripes in parallel, and a
lookup by ``doc_id`` skips files, stripes and row groups by metadata alone.

Defined cases: a null text counts as empty and gets the end id only; null ``doc_id`` come first;
repeated rows are all kept, rows of one ``doc_id`` in the order of a hash of their text, then the
text; an empty table gives empty files and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.tokens import END_ID, encoder, slices, vocabulary_path

STORED = "part long, place long, doc_id long, part_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encodes every whole text and writes ids, ``END_ID`` last, as ORC below ``path``.

    One shuffle puts the texts into ranges of ``doc_id``; each range is sorted, encoded in that
    order and becomes one file. ``part`` numbers the ranges in order, ``place`` the documents of
    a range, ``part_start`` counts the ids before a document in its range.
    """
    vocabulary = vocabulary or vocabulary_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    key = F.xxhash64("text")
    ordered = (
        rows.withColumn("_key", key)
        .repartitionByRange("doc_id", "_key")
        .sortWithinPartitions("doc_id", "_key", "text")
        .select("doc_id", "text")
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches):
            data = [ids + end for ids in encoder(vocabulary).batch(batch.column("text").to_pylist())]
            counts = np.array([len(ids) // 4 for ids in data], dtype=np.int64)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()),
                pa.array(np.frombuffer(b"".join(data), dtype="<i4")),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(data), part)),
                    pa.array(np.arange(place, place + len(data))),
                    batch.column("doc_id"),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    lists,
                ],
                names=["part", "place", "doc_id", "part_start", "n_tokens", "ids"],
            )
            place, before = place + len(data), before + int(ends[-1]) if len(data) else before
        encoder(vocabulary).rest()

    writer = ordered.mapInArrow(encode, STORED).write
    for key, value in ORC_OPTIONS.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``, the number of ids of all documents before.

    Only one row per file is ordered as a whole; their number is the number of write tasks.
    """
    stored = spark.read.schema(STORED).orc(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    parts = parts.selectExpr(
        "part",
        "coalesce(sum(_ids) over (order by part rows between unbounded preceding and 1 preceding), 0) as _before",
    )
    starts = stored.join(F.broadcast(parts), "part")
    return starts.select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the statistics and Bloom filters."""
    return spark.read.schema(STORED).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by their unsigned CRC-32 as little-endian unsigned 32-bit integers."""

    def checksum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            stops = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip([0, *stops], stops)]
            columns = [batch.column(name) for name in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
