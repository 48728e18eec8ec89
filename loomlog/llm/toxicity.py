"""Toxicity by noisy-channel deobfuscation.

A text reaches us through a channel that may replace letters by look-alikes, put separators
between letters, or repeat letters. A token that shows such noise becomes a lattice: at each
character the letters it may stand for, or nothing. Viterbi decoding takes the path of the lowest
cost under a character trigram model of the whole corpus plus the channel's costs. Tokens
without noise have one path only and are their own decoding; decoded tokens are kept per worker.

A look-alike may also be a mere number or punctuation, and a doubled letter is often right. So a token
has several readings: its plain word, and where any look-alike, doubled letter or separator lets the
channel in, the decodings of the word and of the token with the look-alikes at its ends. All of them
count, the strongest feature decides.

The restored text is scored by its words and the first letters of its words. A feature's weight is
the share of toxic texts among labelled texts that hold it, drawn to the base rate by a prior whose
strength grows with the number of features tested, so that chance finds stay below one half. The
``STRONGEST`` words of a text go into a logistic function. It is fitted on one half of the
sample with weights from the other half, so it knows how far a weight holds on unseen texts.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of ``doc_id``; the
language model counts every text.

Defined cases: a null text counts as empty, and a text without features scores ``NO_EVIDENCE``; a
null ``doc_id`` or ``toxic`` is no label, and an unlabelled row is scored like others; of repeated
labels the row is toxic if one says so; repeated rows are scored each; empty tables give no rows,
and without any label every score is ``NO_EVIDENCE``; with fewer than ``MIN_HALF`` labelled rows of a class in a
half there is no logistic step and a text scores by its strongest feature; a text and a token of any
length are read whole, in linear time; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokens import given_back, slices
from loomlog.session import materialize

SAMPLE = 20_000
FOLDS = 5
NO_EVIDENCE = 0.01
MIN_WEIGHT = 0.2
STRONGEST = 3
HEADS = (4, 5)
CHANCE_FINDS = 0.1
MIN_HALF = 30
#: Bytes of kept token weights in each of two generations, an entry's own bytes, the longest key.
KEPT_BYTES, ENTRY_BYTES, LONGEST_KEPT = 20 << 20, 130, 64
READ_TOKENS = 50_000

# What characters of common substitution alphabets stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~'` "
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâäçèéêëíìîïñóòôöúùûüßœ"
KINDS = 64
SUBSTITUTE_COST, DROP_COST, REPEAT_COST = 0.5, 0.2, 0.3
_LETTER_KIND = np.zeros(1 << 16, dtype=np.int64)
for _kind, _letter in enumerate(LETTERS):
    _LETTER_KIND[ord(_letter)] = _kind
_KIND = {letter: kind for kind, letter in enumerate(LETTERS)}
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ ][^\W_]){2,}(?!\S)")
_NOISE = re.compile(
    r"(?=.*[^\W\d_])(?=.*(?:[0134567890@$!|+(€£¡]|([^\W\d_])\1\1|[^\W\d_][.\-_*~'`]+[^\W\d_]))", re.DOTALL
)
_CHANNEL = re.compile(r"[0134567890@$!|+(€£¡]|([^\W\d_])\1|[^\W\d_][.\-_*~'`]+[^\W\d_]")
_LOOKS = re.compile(r"[0134567890@$!|+(€£¡]")
_DOUBLED = re.compile(r"(.)\1")
# What goes at the ends of a token: at the start runs of one kind, at the end runs of another.
_FROM_START = re.compile(r"[^\w@$€£(|+!¡]+|[!|+(]{2,}|@@+|\$\$+")
_END_SIGNS = frozenset("@$€£|+!")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all whole texts: a table of fixed size, ``KINDS`` cubed."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
                kinds = _LETTER_KIND[np.minimum(codes, 0xFFFF)]
                three = (kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:]
                total += np.bincount(three, minlength=KINDS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["three", "n"])

    summed = rows.mapInArrow(count, "three long, n long").groupBy("three").agg(F.sum("n").alias("n"))
    counts = np.zeros(KINDS**3, dtype=np.int64)
    for row in summed.toLocalIterator():
        counts[row["three"]] = row["n"]
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative logarithms of interpolated trigram probabilities, by the three letters' kinds."""
    three = counts.reshape(KINDS, KINDS, KINDS).astype(np.float64)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + KINDS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def decode(token: str, costs: np.ndarray) -> str:
    """The cheapest reading of a noisy token; ``token`` is in lower case.

    States are the last two letters read, and whether the last one was repeated just now.
    """
    # A reading is kept as its last letter and the reading before it, so its length costs nothing.
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for char in token:
        choices: list[tuple[str, float]] = []
        if char in _KIND and char != " ":
            choices.append((char, 0.0))
            if char == before:
                choices.append(("", REPEAT_COST))
        elif char in LOOK_ALIKE:
            choices += [(letter, SUBSTITUTE_COST) for letter in LOOK_ALIKE[char]]
            choices.append(("", 4 * SUBSTITUTE_COST))
        else:
            choices.append(("", DROP_COST))
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, read) in best.items():
            for letter, extra in choices:
                if letter:
                    kind = _KIND[letter]
                    state, price = (b, kind), cost + extra + float(costs[a, b, kind])
                else:
                    state, price = (a, b), cost + extra
                if state not in reached or price < reached[state][0]:
                    reached[state] = (price, (read, letter) if letter else read)
        best, before = reached, char
    ends = [(cost + float(costs[a, b, 0]), read) for (a, b), (cost, read) in best.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(read) for cost, read in ends if cost == least)


def _spelled(read: tuple | None) -> str:
    letters = []
    while read:
        read, letter = read
        letters.append(letter)
    return "".join(reversed(letters))


def _plain_end(char: str) -> bool:
    return not (char.isalnum() or char == "_" or char in _END_SIGNS)


def _stripped(token: str) -> str:
    """A token without what stands around its word, by walking in from both ends.

    A round takes one run at the start and one at the end; the walk never looks at a character
    of a run twice but for the one it stops at.
    """
    low, high = 0, len(token)
    while low < high:
        at = low
        run = _FROM_START.match(token, low, high)
        end = high
        if _plain_end(token[high - 1]):
            while end > low and _plain_end(token[end - 1]):
                end -= 1
        else:
            while end > low and token[end - 1] in _END_SIGNS:
                end -= 1
            if high - end == 1 and token[end] != "!":
                end = high
        if end == low and not (run and token[low] in "!|+("):
            return ""
        if run:
            at = run.end()
            if at > end:  # both runs hold the characters between: the start's goes first
                at, end = _meeting(token, at, high)
        if (at, end) == (low, high):
            break
        low, high = at, end
    return token[low:high]


def _meeting(token: str, at: int, high: int) -> tuple[int, int]:
    """Where the end's run starts if the start's run reaches into it."""
    rest = token[at:high]
    gone = not rest or _plain_end(rest[0]) or len(rest) > 1 or rest[0] == "!"
    return at, at if gone else high


def restore(token: str, costs: np.ndarray) -> str:
    """A token as a plain word in lower case."""
    word = _stripped(token.lower())
    return decode(word, costs) if _NOISE.match(word) or _SPACED.fullmatch(word) else word


def readings(token: str, costs: np.ndarray) -> list[str]:
    """The plain word of a token, and what else the channel may have made it from."""
    whole = token.lower()
    plain = whole.rstrip(".,")
    if plain.isalpha() and not _DOUBLED.search(plain):
        return [plain]  # neither noise nor look-alikes, and only points around it
    word = _stripped(whole)
    noisy = bool(_NOISE.match(word) or _SPACED.fullmatch(word))
    found = {decode(word, costs) if noisy else word}
    if not noisy and _CHANNEL.search(word):
        found.add(decode(word, costs))
    if len(_LOOKS.findall(whole)) > len(_LOOKS.findall(word)):
        found.add(decode(whole, costs))
    return sorted(found - {""})


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}-" for n in HEADS if len(word) > n]] if word else []


class _Weights(dict):
    """Weights of tokens, in two generations of about ``KEPT_BYTES``; frequent ones stay, long ones
    are not kept."""

    def __init__(self) -> None:
        super().__init__()
        self._bytes, self._older = 0, {}

    def add(self, token: str, ask: Callable[[str], float]) -> float:
        found = self._older.pop(token, None)
        if found is None:
            found = ask(token)
        if len(token) <= LONGEST_KEPT:
            self[token] = found
            self._bytes += 2 * len(token) + ENTRY_BYTES
        return found

    def make_room(self) -> None:
        if self._bytes > KEPT_BYTES:
            self._older, self._bytes = dict(self), 0
            self.clear()

    def rest(self) -> None:
        """Lets the older generation go, as other stages of the worker need memory, too."""
        self._older = {}


@functools.lru_cache(maxsize=1)
def _weights_of(model: str) -> _Weights:
    """The table of a model in this Python worker; it outlives the task."""
    return _Weights()


@dataclass
class Model:
    """What scoring needs: costs of letter trigrams and weights of features."""

    costs: np.ndarray
    weights: dict[str, float]
    slopes: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def token(self, token: str) -> float:
        """The weight of the strongest feature of a token's readings."""
        weight = self.weights.get
        return max([weight(name, 0.0) for word in readings(token, self.costs) for name in features(word)], default=0.0)

    def evidence(self, text: str) -> list[float]:
        """The weights of the strongest different tokens, descending."""
        kept = _weights_of(self.name)
        kept.make_room()
        found = [0.0] * STRONGEST
        for token in {*text.split(), *_SPACED.findall(text)}:
            weight = kept.get(token)
            if weight is None:
                weight = kept.add(token, self.token)
            if weight:
                found.append(weight)
        return sorted(found, reverse=True)[:STRONGEST]

    def score(self, text: str) -> float:
        found = self.evidence(text)
        if not found[0]:
            return NO_EVIDENCE
        if self.slopes is None:
            return found[0]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slopes[0] + float(self.slopes[1:] @ found)))))


def logistic(rows: np.ndarray, truth: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> np.ndarray:
    """Intercept and non-negative slopes of a logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(rows)), rows])
    slopes = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ slopes, -30, 30)))
        slope = x.T @ (truth - p) - ridge * slopes
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        slopes = slopes + np.linalg.solve(bend, slope)
    return np.concatenate((slopes[:1], np.maximum(slopes[1:], 0.0)))


def text_features(text: str, read: Callable[[str], list[str]]) -> set[str]:
    """All features of the readings of a text's tokens."""
    tokens = {*text.split(), *_SPACED.findall(text)}
    return {name for word in {word for token in tokens for word in read(token)} for name in features(word)}


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled rows outside the held-out fold."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.filter(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0)
    known = known.groupBy(doc_id.alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(doc_id.alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "_id").select("text", "toxic")


def _shared_heads(found: dict[str, np.ndarray], most: float = 0.8) -> dict[str, np.ndarray]:
    """Without the heads of which one word has nearly all occurrences: the word says as much."""
    largest: dict[str, int] = {}
    for word, n in found.items():
        for head in features(word)[1:] if not word.endswith("-") else ():
            largest[head] = max(largest.get(head, 0), int(n.sum()))
    return {name: n for name, n in found.items() if largest.get(name, 0) < most * n.sum()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts letter trigrams of all texts, then feature weights on the labelled sample."""
    costs = trigram_costs(trigram_counts(docs))
    rows = training_rows(docs, labels, sample).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    rows = materialize(rows.repartition(F.xxhash64("text")), "labelled")
    totals = {(row["toxic"], row["half"]): row["count"] for row in rows.groupBy("toxic", "half").count().collect()}
    toxic, clean = (np.array([totals.get((label, half), 0) for half in (0, 1)]) for label in (1, 0))
    if not toxic.sum() or not clean.sum():
        return Model(costs, {})

    def counted(part: DataFrame, wanted: frozenset[str] | None) -> dict[str, np.ndarray]:
        def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            read = functools.lru_cache(READ_TOKENS)(lambda token: readings(token, costs))
            for frame in frames:
                for text, half in zip(frame["text"], frame["half"]):
                    names = text_features(text, read)
                    found[half].update(names if wanted is None else names & wanted)
            for half in (0, 1):
                table = pd.DataFrame({"name": list(found[half]), "half": half, "n": list(found[half].values())})
                yield table.astype({"name": str, "half": "int32", "n": "int64"})

        each = [F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0)).alias(f"n{half}") for half in (0, 1)]
        summed = part.mapInPandas(count, "name string, half int, n long").groupBy("name").agg(*each)
        summed = summed.filter("n0 + n1 > 1")
        return {row["name"]: np.array([row["n0"], row["n1"]]) for row in summed.toLocalIterator()}

    # Both tables are bounded by the words of the sample.
    in_toxic = _shared_heads(counted(rows.filter("toxic = 1"), None))
    in_clean = counted(rows.filter("toxic = 0"), frozenset(in_toxic))

    def weights(halves: list[int]) -> dict[str, float]:
        t, c = int(toxic[halves].sum()), int(clean[halves].sum())
        base = min(0.45, max(t, 1) / max(t + c, 2))
        needed = math.log(max(2, len(in_toxic)) / CHANCE_FINDS) / math.log(1 / base)
        strength = needed / (1 - 2 * base)
        found = {}
        for name, n in in_toxic.items():
            hits, others = int(n[halves].sum()), int(in_clean.get(name, nothing)[halves].sum())
            weight = (hits + strength * base) / (hits + others + strength)
            if weight >= MIN_WEIGHT:
                found[name] = weight
        return found

    nothing = np.zeros(2, dtype=np.int64)
    first = Model(costs, weights([0]))

    def unseen(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "found": [first.evidence(text) for text in frame["text"]]})

    slopes = None
    if min(*toxic, *clean) >= MIN_HALF:
        tried = rows.filter("half = 1").mapInPandas(unseen, "toxic int, found array<double>").toPandas()
        slopes = logistic(np.array(tried["found"].tolist()), tried["toxic"].to_numpy())
    return Model(costs, weights([0, 1]), slopes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = np.array([model.score(text) for text in batch.column("text").to_pylist()], dtype=np.float64)
            ids = batch.column("doc_id").to_pylist()
            held = [doc is not None and zlib.crc32(str(doc).encode()) % FOLDS == 0 for doc in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in given_back(batches):
            yield pa.array([model.score(text.as_py() or "") < 0.5 for text in texts], pa.bool_())
            del texts
        _weights_of(model.name).rest()

    return docs.filter(clean(F.col("text")))
