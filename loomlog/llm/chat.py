"""Chat formatting with a loss mask aligned by offsets.

A conversation becomes one text: ``<|turn|>role<|text|>text<|end|>`` per turn. Inside roles and
texts a backslash is put after the first character of every control string and before every
backslash, so no marker can be forged and the texts come back exactly. The whole text is encoded
once; turn spans and token spans are sorted, and two binary searches per assistant turn give its
tokens. A token that reaches over the end of a span counts with the part inside.

Defined cases: a null text or role is empty; turns are in the order of ``turn``, nulls first, then
role, then text; repeated rows are turns of their own; rows with a null ``conv_id`` form one
conversation without id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import encoder, vocabulary_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that chat templates in public use treat as control marks.
CONTROL = re.compile(r"\\|<(?=\||/?s>|/?unk>|/?pad>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\[(?=/?INST\]|/?SYS\])")
LOSS_ROLE = "assistant"
FORMATTED = (
    "conv_id long, n_turns long, formatted string, ids array<int>, "
    "loss_starts array<long>, loss_ends array<long>, loss_tokens long"
)


def escape(text: str) -> str:
    """Doubles backslashes and breaks control strings after their first character."""
    return CONTROL.sub(lambda match: match[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant texts in it."""
    parts, spans, place = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((place + len(head), place + len(head) + len(body)))
        parts += [head, body, END]
        place += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


def loss_spans(
    spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray
) -> tuple[list[int], list[int], int]:
    """Where the tokens of the spans cover them: starts, ends, and the number of tokens.

    Tokens that share a code point or touch are joined, so no character counts twice.
    """
    if not spans:
        return [], [], 0
    begin, stop = np.array(spans, dtype=np.int64).T
    first = np.searchsorted(ends, begin, side="right")
    last = np.searchsorted(starts, stop, side="left")
    from_, to, tokens = [], [], 0
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        if a >= b or begin[k] == stop[k]:
            continue
        tokens += b - a
        low, high = np.maximum(starts[a:b], begin[k]), np.minimum(ends[a:b], stop[k])
        breaks = np.flatnonzero(low[1:] > high[:-1]) + 1
        from_ += low[np.concatenate(([0], breaks))].tolist()
        to += high[np.concatenate((breaks - 1, [len(high) - 1]))].tolist()
    return from_, to, tokens


def format_chats(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per conversation: text, ids and the spans of the loss mask in code points.

    Rows are dealt by ``conv_id`` and sorted, then streamed: a task holds one conversation.
    """
    vocabulary = vocabulary or vocabulary_path()
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("string"), "role", "text")

    def finish(conv: str | None, turns: list[tuple[str, str]]) -> tuple:
        text, spans = render(turns)
        ids, starts, ends = encoder(vocabulary).spans([text])[0]
        return (None if conv is None else int(conv), len(turns), text, ids.astype(np.int32), *loss_spans(spans, starts, ends))

    def table(found: list[tuple]) -> pd.DataFrame:
        names = [part.split()[0] for part in FORMATTED.split(", ")]
        return pd.DataFrame(found, columns=names).astype({"conv_id": "Int64"})

    def stream(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, turns, found, size = "", [], [], 0
        for frame in frames:
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
                if turns and conv != current:
                    found.append(finish(current, turns))
                    size += len(found[-1][2])
                    turns = []
                    if size > 4_000_000:
                        yield table(found)
                        found, size = [], 0
                current = conv
                turns.append((role, text))
        if turns:
            found.append(finish(current, turns))
        if found:
            yield table(found)

    return rows.mapInPandas(stream, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text gives back: digests of its turns and of the text under the mask."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text, starts, ends in zip(frame["formatted"], frame["loss_starts"], frame["loss_ends"]):
                turns = parse(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = unescape("".join(text[a:b] for a, b in zip(starts, ends)))
                found.append(
                    (
                        len(turns),
                        hashlib.sha256(whole.encode()).hexdigest(),
                        len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(),
                        len(text),
                    )
                )
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            read_back = pd.DataFrame(found, columns=names, index=frame.index)
            read_back.insert(0, "conv_id", frame["conv_id"])
            read_back["loss_tokens"] = frame["loss_tokens"]
            yield read_back

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, loss_tokens long"
    )
    return formatted.mapInPandas(read, schema)
