"""Periodic runs of words: stretches in which a block of words follows itself again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least ``MIN_LENGTH`` words and at least ``REPEATS`` periods that no neighbouring word extends.

The search is a sparse dynamic program over diagonals: at each word, its earlier occurrences at lag d
increment the match length of the active diagonal d, and a diagonal that breaks with sufficient
length emits its run at once. Most occurrences of a word can never belong to a run, so a word is
looked up together with the words after it, in windows whose length doubles with the lag:

* A run with period d has at least ``max((REPEATS - 1) * d, MIN_LENGTH - d)`` matches on its diagonal,
  so every lag up to the window length G is served by windows of G words (``_first_window`` is the
  shortest), and lags in (G / 2, G] are read off the windows of G words only.
* Inside a run of smallest period d <= G a window of G words has its *nearest* earlier occurrence at
  lag d exactly, as a nearer one would make the block a power of a shorter one. So each word has one
  lag in each scale, and the active diagonal is unbroken from the run's start to its end.
* A diagonal whose block is a power of a shorter one never holds the nearest occurrence, and
  stretches that are too short break before they are sufficient. So nothing else is emitted.

A window that occurs once cannot grow into one that occurs twice, so the doubling follows the repeated
windows only and ends at once in texts without repetition. A text of n words takes O(n log n) time at
each of at most log n scales, whatever its words; memory is a few arrays of n numbers. Texts are taken
together up to ``WORDS_AT_ONCE`` words, kept apart by marks that occur once.

Words are runs of bytes other than space and the control characters 9 to 13.

Defined cases: a null or blank text has no words and no runs; a text of any length is taken whole by
one task; null ``doc_id`` and repeated rows are kept, one row of output for each row; an empty table
gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import slices

MIN_LENGTH = 24
REPEATS = 3
WORDS_AT_ONCE = 200_000
RUN = "struct<start: long, length: long, period: long>"
_BLANK = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]


def _first_window(min_length: int) -> int:
    """The largest power of two that the matches of every run reach."""
    least = max(1, (REPEATS - 1) * min_length // REPEATS)
    return 1 << (least.bit_length() - 1)


def _repeated(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers of equal keys, by place; -1 where the key occurs once or there is none."""
    numbers = np.full(size, -1, dtype=np.int64)
    if len(keys):
        _, kind, counts = np.unique(keys, return_inverse=True, return_counts=True)
        more = counts[kind] > 1
        numbers[at[more]] = kind[more]
    return numbers


def _doubled(windows: np.ndarray, length: int) -> np.ndarray:
    """Numbers of windows twice as long; both halves of a repeated window are repeated."""
    size = max(0, len(windows) - length)
    first, second = windows[:size], windows[length : length + size]
    at = np.flatnonzero((first >= 0) & (second >= 0))
    return _repeated(first[at] * np.int64(len(windows) + 1) + second[at], at, size)


def _nearest(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window occurs earlier, ascending, and the lag to its nearest occurrence."""
    at = np.flatnonzero(windows >= 0)
    order = at[np.argsort(windows[at], kind="stable")]
    same = windows[order[1:]] == windows[order[:-1]]
    places, lags = order[1:][same], (order[1:] - order[:-1])[same]
    ascending = np.argsort(places)
    return places[ascending], lags[ascending]


def _diagonals(places: list[int], lags: list[int], window: int, min_length: int) -> Iterator[Run]:
    """Walks the words that have an occurrence at a lag of this scale, and emits what ends."""
    lag = first = length = 0
    for place, found in zip(places, lags):
        if found == lag and place == first + length:
            length += 1
            continue
        matches = length + window - 1
        if lag and matches >= max((REPEATS - 1) * lag, min_length - lag):
            yield first - lag, matches + lag, lag
        lag, first, length = found, place, 1
    matches = length + window - 1
    if lag and matches >= max((REPEATS - 1) * lag, min_length - lag):
        yield first - lag, matches + lag, lag


def word_runs(ids: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> list[Run]:
    """``(start, length, period)`` of all runs, ascending by start and period.

    ``ids`` are numbers of words; ``longest`` bounds the words of one text among them.
    """
    if longest < max(min_length, REPEATS):
        return []
    windows, length, found = _repeated(ids, np.arange(len(ids)), len(ids)), 1, []
    above, target = 0, _first_window(min_length)
    while REPEATS * above < longest:
        while length < target:
            windows = _doubled(windows, length)
            length *= 2
        if not len(windows) or windows.max() < 0:
            break
        places, lags = _nearest(windows)
        inside = (lags > above) & (lags <= target)
        found += _diagonals(places[inside].tolist(), lags[inside].tolist(), target, min_length)
        above, target = target, 2 * target
    return sorted(found, key=lambda run: (run[0], run[2]))


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """The runs of each text, given by its words."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    size = sum(map(len, texts)) + len(texts)
    ids = np.empty(size, dtype=np.int64)
    starts, at = [], 0
    for k, words in enumerate(texts):
        starts.append(at)
        ids[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        at += len(words)
        ids[at] = -1 - k
        at += 1
    found: list[list[Run]] = [[] for _ in texts]
    text = 0
    for start, length, period in word_runs(ids, max(map(len, texts), default=0), min_length):
        while text + 1 < len(starts) and starts[text + 1] <= start:
            text += 1
        found[text].append((start - starts[text], length, period))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words left after each run kept its first period only, joined by a space."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every document; no shuffle.

    ``runs`` lists ``start`` (word number), ``length`` and ``period``; ``collapsed`` is the text
    without the words that any run repeats after its first period.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        waiting = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_py().encode("utf-8", "replace").split()
                if texts and waiting + len(words) > WORDS_AT_ONCE:
                    yield _rows(ids, texts, min_length)
                    ids, texts, waiting = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                waiting += len(words)
        if texts:
            yield _rows(ids, texts, min_length)

    return rows.mapInArrow(search, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def _rows(ids: list[int | None], texts: list[list[bytes]], min_length: int) -> pa.RecordBatch:
    found = text_runs(texts, min_length)
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    listed = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(words) for words in texts], pa.int64()),
            pa.array(listed, kind),
            pa.array([collapsed(words, runs) for words, runs in zip(texts, found)], pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the ends of one text in ten repeat a block of its words.

    With ``h = crc32(doc_id as text)``, ``g = h div 10`` and n words, a text with ``h % 10 = 0`` has
    each word i from ``a = g % n`` on replaced by word ``a + (i - a) % p``, where
    ``p = 1 + (n - a) div (3 + g % 8)``. A null ``doc_id`` has no h, so its text stays.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("h"))
    words = F.filter(F.split("text", _BLANK), lambda word: word != "")
    g = F.floor(F.col("h") / 10).cast("long")
    chosen = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", g)
    chosen = chosen.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    chosen = chosen.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    edited = F.expr(
        "array_join(transform(sequence(0, size(words) - 1),"
        " i -> element_at(words, cast(if(i < a, i, a + (i - a) % p) + 1 as int))), ' ')"
    )
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of most periods, and digests of runs and kept words."""
    best = (
        "reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (top, r) -> case"
        " when top is null then r"
        " when cast(r.length as decimal(20)) * top.period > cast(top.length as decimal(20)) * r.period then r"
        " when cast(r.length as decimal(20)) * top.period = cast(top.length as decimal(20)) * r.period"
        " and struct(r.start, r.period) < struct(top.start, top.period) then r else top end)"
    )
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.withColumn("best", F.expr(best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(listed).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
