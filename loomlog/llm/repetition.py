"""Quality rules by repetition: how much of a text stands in repeated word runs and lines.

Words are runs of bytes other than space and the control characters 9 to 13. For each length of
``COVERAGE`` a rolling polynomial hash, extended word by word in numpy, names every window of so
many words; a window found before counts as repeated, and all its characters are covered. A text
is rejected when the covered share of its word characters exceeds the limit of that length, or
when lines that repeat an earlier line hold more than ``LINE_SHARE`` of them, or when symbols are
more than ``SYMBOL_SHARE`` of them. Only later occurrences are covered: a text without repetition
scores zero however common its words are.

Defined cases: a null text has no words, and like every text under ``MIN_WORDS`` words it fails
the base rule; null ``doc_id`` and repeated rows are kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import given_back, slices

MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50
#: Window length in words and the share of word characters that repeated windows may cover.
COVERAGE = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
LINE_SHARE = 0.30
SYMBOL_SHARE = 0.06
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "doc_id": "long",
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "dup_line_chars": "long",
    **{f"covered_{n}": "long" for n in COVERAGE},
    "base_failed": "boolean",
    "kept": "boolean",
}


def covered(flags: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window whose flag, at its first word, is set."""
    steps = np.zeros(len(flags) + length, dtype=np.int64)
    found = np.flatnonzero(flags)
    steps[found] += 1
    steps[found + length] -= 1
    return np.cumsum(steps)[: len(flags) + length - 1] > 0


def repeated(windows: np.ndarray, first_too: bool) -> np.ndarray:
    """Which windows occur twice or more; without the first occurrence unless ``first_too``."""
    _, first, kind, counts = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    flags = counts[kind] > 1
    if not first_too:
        flags[first] = False
    return flags


def measure(text: str) -> list:
    """The values of ``COLUMNS`` after ``doc_id``."""
    words = _WORD.findall(text)
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    chars, symbols = int(sizes.sum()), len(_SYMBOL.findall(text))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, _WORD.findall(line)))
        elif _WORD.search(line):
            seen.add(line)
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], dtype=np.uint64)
    n = len(words)
    repeat_words = 0
    if n >= REPEAT_WINDOW:
        # Exact: the number of the pair and the word after it, both below the number of words.
        _, pairs = np.unique(ids[:-1] * np.uint64(len(numbers)) + ids[1:], return_inverse=True)
        triples = pairs[:-1].astype(np.uint64) * np.uint64(len(numbers)) + ids[2:]
        repeat_words = int(covered(repeated(triples, True), REPEAT_WINDOW).sum())
    shares = []
    codes = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    rolling, length = codes.copy(), 1
    for target in COVERAGE:
        while length < target and len(rolling) > 1:
            rolling = rolling[:-1] * _BASE + codes[length:]
            length += 1
        hit = length == target and n >= target
        shares.append(int(sizes[covered(repeated(rolling, False), target)].sum()) if hit else 0)
    failed = n < MIN_WORDS or 100 * repeat_words > REPEAT_PERCENT * n
    kept = (
        not failed
        and dup_chars <= LINE_SHARE * chars
        and symbols <= SYMBOL_SHARE * chars
        and all(share <= limit * chars for share, limit in zip(shares, COVERAGE.values()))
    )
    return [n, chars, symbols, dup_lines, repeat_words, dup_chars, *shares, failed, kept]


def quality(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for every document; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))

    def rules(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(text) for text in batch.column("text").to_pylist()]
            if found:
                columns = [pa.array(list(column)) for column in zip(*found)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=list(COLUMNS))

    return rows.mapInArrow(rules, ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items()))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in given_back(batches):
            yield pa.array([measure(text.as_py() or "")[-1] for text in texts], pa.bool_())
            del texts

    return docs.filter(kept(F.col("text")))
