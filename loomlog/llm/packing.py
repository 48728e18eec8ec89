"""Packing documents into training sequences, balanced by estimated attention cost.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``, as attention stays inside a
piece. Whole stretches of ``capacity`` tokens are sequences by themselves. What is left of each
document is spread over groups of about ``GROUP_DOCS`` documents; inside a group the pieces are
taken in descending length, and each goes to the sequence of lowest cost that has room for it. A
piece for which no sequence has room is cut, and the largest room takes its first part.

A group has exactly the room that its tokens need: full sequences, and for the tokens beyond
them sequences whose capacities are powers of two. So there is no padding.

Defined cases: a null text counts as empty and has the end id only; a null ``doc_id`` and repeated
rows are packed like others (equal rows share a group); an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import END_ID, encoder, slices, vocabulary_path

CAPACITY = 1024
GROUP_DOCS = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
CUT = "doc_id long, doc_tokens long, full array<long>, rest binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def room_for(tokens: int, capacity: int) -> list[int]:
    """Capacities that hold ``tokens`` without padding, largest first."""
    left = tokens % capacity
    powers = [1 << bit for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
    return [capacity] * (tokens // capacity) + powers


def place(
    lengths: list[int], capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC
) -> list[tuple[int, int, int, int, int]]:
    """``(item, start, length, sequence, offset)`` of each piece.

    Descending items; lowest cost among the sequences with room for the whole item, the first of
    equals. The capacities together must hold all items.
    """
    size, room = np.array(capacities, dtype=np.int64), np.array(capacities, dtype=np.int64)
    cost = np.zeros(len(room))
    placed = []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            to = int(np.where(fits, cost, np.inf).argmin())
            if not fits[to]:
                to = int(room.argmax())
            part = min(left, int(room[to]))
            placed.append((item, start, part, to, int(size[to] - room[to])))
            room[to] -= part
            cost[to] += linear * part + quadratic * part * part
            start, left = start + part, left - part
    return placed


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its document, place there, checksum of its ids, sequence and offset.

    The only shuffle moves what is left of each document beyond whole sequences.
    """
    vocabulary = vocabulary or vocabulary_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in slices(batches):
            counts, full, rest = [], [], []
            for ids in encoder(vocabulary).batch(batch.column("text").to_pylist()):
                ids += end
                whole = len(ids) // step * step
                counts.append(len(ids) // 4)
                full.append([zlib.crc32(ids[k : k + step]) for k in range(0, whole, step)])
                rest.append(ids[whole:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(full, pa.list_(pa.int64())),
                    pa.array(rest, pa.binary()),
                ],
                names=["doc_id", "doc_tokens", "full", "rest"],
            )
        encoder(vocabulary).rest()

    def pack_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        encoder.cache_clear()  # all texts are encoded; the worker outlives this job
        group = group.sort_values(["doc_tokens", "doc_id", "rest"], ascending=False, kind="stable")
        ids, totals = group["doc_id"].tolist(), group["doc_tokens"].tolist()
        rests, fulls = group["rest"].tolist(), group["full"].tolist()
        lengths = [len(rest) // 4 for rest in rests]
        capacities = room_for(sum(lengths), capacity)
        base, sequence = key[0] << 32, len(capacities)
        found = []
        for item, start, length, to, offset in place(lengths, capacities):
            part = rests[item][4 * start : 4 * (start + length)]
            at = len(fulls[item]) * capacity + start
            found.append((ids[item], at, length, zlib.crc32(part), totals[item], base + to, offset))
        for doc, total, sums in zip(ids, totals, fulls):
            for k, checksum in enumerate(sums):
                found.append((doc, k * capacity, capacity, int(checksum), total, base + sequence, 0))
                sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        table = pd.DataFrame(found, columns=names)
        return table.astype({"doc_id": "Int64"})

    spread = F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest"), F.lit(groups))
    cut_rows = rows.mapInArrow(cut, CUT).withColumn("_group", spread)
    return cut_rows.groupBy("_group").applyInPandas(pack_group, PIECES)
