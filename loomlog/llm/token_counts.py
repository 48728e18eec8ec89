"""Token counts by section: whole texts are encoded once, tokens are given to sections by offset.

Sections are the lines of a text, each with the newline that ends it. A token may reach over the
end of a section; ``rule`` says whose it is: ``first`` gives it to the section of its first code
point, ``last`` to that of its last one. Either way each token counts once, so the counts of a
text add up to the length of its encoding.

Defined cases: a null or empty text has one empty section without tokens; a null ``doc_id`` and
repeated rows are kept as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import encoder, slices, vocabulary_path

COUNTS = "doc_id long, section long, start_char long, n_chars long, n_tokens long, n_crossing long"


def section_starts(text: str) -> np.ndarray:
    """Code point at which each line begins; a newline at the very end begins no line."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    starts = np.flatnonzero(codes == 10) + 1
    return np.concatenate(([0], starts[starts < len(codes)])).astype(np.int64)


def count_sections(
    starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach into another one.

    Sections are sorted and gapless, so a binary search finds the section of a code point.
    """
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    owner = first if rule == "first" else last
    counts = np.bincount(owner, minlength=len(sections))
    crossing = np.bincount(owner[first != last], minlength=len(sections))
    return counts, crossing


def token_counts(docs: DataFrame, vocabulary: str | None = None, rule: str = "first") -> DataFrame:
    """One row per document and section; no shuffle."""
    if rule not in ("first", "last"):
        raise ValueError(f"unknown rule: {rule}")
    vocabulary = vocabulary or vocabulary_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            row, number, start, chars, tokens, crossing = [], [], [], [], [], []
            for k, (text, (_, a, b)) in enumerate(zip(texts, encoder(vocabulary).spans(texts))):
                sections = section_starts(text)
                counts, over = count_sections(a, b, sections, rule)
                row.append(np.full(len(sections), k))
                number.append(np.arange(len(sections)))
                start.append(sections)
                chars.append(np.diff(sections, append=len(text)))
                tokens.append(counts)
                crossing.append(over)
            if not texts:
                continue
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (number, start, chars, tokens, crossing)]
            ids = batch.column("doc_id").take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays(
                [ids, *columns], names=["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"]
            )
        encoder(vocabulary).rest()

    return rows.mapInArrow(count, COUNTS)
