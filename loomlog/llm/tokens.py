"""Whole-text encoding with a byte-level BPE file of the tokenizers library.

A byte-level BPE file cuts a text into pre-tokens by a public pattern and merges inside each of
them, so ids of a text are the ids of its pre-tokens in order. ``Encoder`` therefore asks the
library once for each distinct pre-token and keeps the answers of a worker in a bounded table.
Offsets need no second pass: in a byte-level vocabulary the length of a token is its number of
bytes, so spans are running sums of lengths.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

# Fixed value: the pattern by which byte-level BPE vocabularies cut text.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
END_ID = 0
#: Bytes of answers in each of a table's two generations, an entry's own bytes, and the longest key.
PIECES_BYTES, WORDS_BYTES = 44 << 20, 12 << 20
ENTRY_BYTES = 150
LONGEST_KEPT = 64

_BEFORE_WORD = re.compile(r" (?=\S)")
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: visible ones stand for
    themselves, the others follow from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: 256 + k for k, byte in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_SPACE = chr(_BYTE_LETTERS[32])


_packers = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _pack(ids: list[int]) -> bytes:
    return _packers[len(ids)](*ids) if len(ids) < len(_packers) else struct.pack(f"<{len(ids)}I", *ids)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts at a time."""
    for batch in given_back(batches):
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch


def given_back(batches: Iterable[pa.RecordBatch | pa.Array]) -> Iterator[pa.RecordBatch | pa.Array]:
    """The same batches; what Arrow holds of those before goes back to the system.

    Arrow's pool keeps freed memory, and a worker outlives its task, so the largest batches of all
    its stages would add up beside the JVM.
    """
    release = pa.default_memory_pool().release_unused
    for batch in batches:
        yield batch
        del batch
        release()
    release()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files lie; every worker has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table(dict):
    """Answers of a function by argument, in two generations of about ``limit`` bytes.

    Asked again, an older answer becomes a young one; ``make_room`` drops the rest of the older
    ones when the young ones are many. So what is frequent stays. Long arguments are not kept.
    """

    def __init__(self, answer: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self._answer, self._limit, self._bytes = answer, limit, 0
        self._older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self._older.pop(key, None)
        if found is None:
            found = self._answer(key)
            if len(key) > LONGEST_KEPT:
                return found
        self[key] = found
        self._bytes += len(key) + len(found) + ENTRY_BYTES
        return found

    def make_room(self) -> None:
        if self._bytes > self._limit:
            self._older, self._bytes = dict(self), 0
            self.clear()

    def rest(self) -> None:
        """Lets the older generation go, as other stages of the worker need memory, too."""
        self._older = {}


class _Pieces(_Table):
    """The same for pieces; words with points after them and pieces over a line's end, which
    hardly repeat, are put together and not kept."""

    def __init__(self, answer: Callable[[str], bytes], limit: int, points: _Table, cut: Callable[[str], bytes]) -> None:
        super().__init__(answer, limit)
        self._points, self._cut = points, cut

    def __missing__(self, piece: str) -> bytes:
        if piece[-1] in ".,":
            word = piece.rstrip(".,")
            if word.isalpha():
                return self[word] + self._points[piece[len(word) :]]
        if "\n" not in piece:
            return super().__missing__(piece)
        left, _, right = piece.partition("\n")
        first = right.rstrip(".,")
        if first.isalpha() and left.rstrip(".,").isalpha():
            points = right[len(first) :]
            known = self._points
            return self[left] + known["\n"] + known[first] + (known[points] if points else b"")
        return self._cut(" " + piece)


class Encoder:
    """Encodes texts to ids; equal to ``Tokenizer.encode`` of the file as loaded, with
    ``add_special_tokens=False``.

    A text is first cut at the strings of added tokens, which get their ids; each part is encoded
    on its own. A space before a visible character always starts a pre-token, so a part falls into
    pieces there. A piece of letters and closing points falls further into the word and the points;
    other pieces of common characters are cut by the pattern, and pieces with anything else go to
    the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merged = self._tokenizer.model.tokenize
        self._pretokens = regex.compile(PRETOKEN).findall
        self._known = _Table(self._merge, WORDS_BYTES)
        self._pieces = _Pieces(self._piece, PIECES_BYTES, self._known, self._cut)
        special = self._tokenizer.get_added_tokens_decoder()
        self._added = {token.content: _pack([i]) for i, token in special.items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._cut_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if special else None
        size = self._tokenizer.get_vocab_size()
        token = self._tokenizer.id_to_token
        self.token_bytes = np.array(
            [len(special[i].content.encode()) if i in special else len(token(i) or "") for i in range(size)],
            dtype=np.int64,
        )

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = []
        for text in texts:
            self._known.make_room()
            self._pieces.make_room()
            if self._cut_added and self._cut_added.search(text):
                parts = self._cut_added.split(text)
                found.append(b"".join(self._added[p] if k % 2 else self._part(p) for k, p in enumerate(parts)))
            else:
                found.append(self._part(text))
        return found

    def rest(self) -> None:
        """To be called at the end of a task."""
        self._known.rest()
        self._pieces.rest()

    def _part(self, text: str) -> bytes:
        head, *parts = _BEFORE_WORD.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")
        return self._cut(head) + b"".join(map(self._pieces.__getitem__, parts))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(data, dtype="<u4") for data in self.batch(texts)]

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids and, per id, the code points ``[start, end)`` it touches.

        Tokens that share the bytes of one code point all carry that code point.
        """
        found = []
        for text, ids in zip(texts, self.ids(texts)):
            ends = np.cumsum(self.token_bytes[ids])
            starts = ends - self.token_bytes[ids]
            if not text.isascii():
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                upto = np.cumsum((data & 0xC0) != 0x80)
                starts, ends = upto[starts] - 1, upto[ends - 1]
            found.append((ids, starts, ends))
        return found

    def _cut(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._known.__getitem__, self._pretokens(text)))
        return _pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``."""
        if not piece.isalpha():
            return self._cut(" " + piece)
        letters = _SPACE + piece if piece.isascii() else (" " + piece).encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _pack([token.id for token in self._merged(letters)])

    def _merge(self, pretoken: str) -> bytes:
        if pretoken[0] == " " and pretoken.isascii() and pretoken[1:].isalpha():
            return self._pieces[pretoken[1:]]
        return _pack([token.id for token in self._merged(pretoken.encode().decode("latin-1").translate(_BYTE_LETTERS))])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    return Encoder(path)
