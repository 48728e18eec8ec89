"""Runs of words against a search of every period on its own."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import periodic

SCHEMA = "doc_id long, text string, runs string, h long, words string, n_words int"


def plain_runs(words, min_length=24):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        place = period
        while place < len(words):
            end = place
            while end < len(words) and words[end] == words[end - period]:
                end += 1
            start, length = place - period, end - place + period
            if length >= max(min_length, 3 * period):
                found.setdefault((start, length), period)
            place = max(end, place + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def block_texts(chance, n):
    for _ in range(n):
        words = []
        while len(words) < chance.choice([0, 10, 60, 150]):
            letters = b"ab" + b"abcdefgh"[: chance.choice([0, 1, 8])]
            block = [bytes([chance.choice(letters)]) for _ in range(chance.choice([1, 2, 3, 5, 8, 16, 17, 33]))]
            words += block * chance.choice([1, 1, 2, 3, 4, 7])
            if chance.random() < 0.3:
                words.pop()
        yield words


@pytest.mark.parametrize("min_length", [1, 3, 5, 9, 12, 24])
def test_runs_equal_plain_search(min_length):
    chance = random.Random(min_length)
    for _ in range(150):
        texts = list(block_texts(chance, 3))
        assert periodic.text_runs(texts, min_length) == [plain_runs(words, min_length) for words in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=90), max_size=4))
def test_runs_over_two_words(texts):
    assert periodic.text_runs(texts, 6) == [plain_runs(words, 6) for words in texts]


def test_long_texts_take_little_time():
    chance = random.Random(2)
    began = time.time()
    for words in ([b"a"] * 10**6, [b"a", b"b"] * 500_000, [b"%d" % chance.randrange(2) for _ in range(10**6)]):
        periodic.text_runs([words])
    assert time.time() - began < 60
    assert periodic.text_runs([[b"a", b"b", b"c"] * 300_000 + [b"x"]]) == [[(0, 900_000, 3)]]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = " ".join(word for k, word in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha(listed), sha(kept))


def test_query_equals_plain_search(spark, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 500)
    chance = random.Random(4)
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\r\n"]
    texts = [None, "", " ", "\n\t", "a", "a" * 5000, "é\xa0b \x1c c\x85d e " * 30, "ab " * 24, "ab " * 23]
    texts += ["".join(w.decode() + chance.choice(blanks) for w in words) for words in block_texts(chance, 60)]
    texts += ["w " * 20_000, " ".join(str(chance.randrange(40)) for _ in range(3000)), "a b c d e f g h " * 3 + "a b x"]
    rows = [(None if k == 5 else 3 * k - 9, text) for k, text in enumerate(texts)]
    # Ids whose texts get a periodic end, of all lengths.
    planted = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows += [(k, " ".join(f"w{chance.randrange(60)}" for _ in range(chance.choice([1, 2, 30, 200])))) for k in planted]
    rows += [(planted[0], None), (planted[1], " "), rows[7], rows[7]]
    table = spark.createDataFrame([(*row, "r", 1, "w", 2) for row in rows], SCHEMA).repartition(3)
    found = periodic.digests(periodic.find_runs(periodic.with_planted_runs(table)))
    key = lambda row: tuple((x is None, x) for x in row)
    got = sorted((tuple(row) for row in found.collect()), key=key)
    assert got == sorted((plain_row(*row) for row in rows), key=key)
    assert sum(row[1] > 0 for row in got) > 30
    assert periodic.digests(periodic.find_runs(periodic.with_planted_runs(table.limit(0)))).collect() == []
