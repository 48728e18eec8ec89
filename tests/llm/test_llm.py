"""Each operator against a plain version, on messy rows."""

import base64
import gzip
import hashlib
import importlib.util
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from loomlog.llm import (
    chat,
    fingerprints,
    mixing,
    packing,
    queries,
    repetition,
    simhash_copies,
    simhash_tiles,
    token_counts,
    token_orc,
    tokens,
    toxicity,
    warc,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score double, copy string, row string, fp string, sequence_id string, _own_row string"
)
WORDS = "the of and ation blent Ströme été corazón x1 don't a,b 中文 😀 <|endoftext|> [INST] # | %".split()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def messy_texts(n=60, seed=5):
    chance = random.Random(seed)
    texts = [None, "", " ", "\n", "\n\n a", "one", "one two", "a b \x1c c\x85d", "é" * 9, "\\ <\\| a"]
    for _ in range(n):
        size = chance.choice([1, 2, 3, 8, 40, 200])
        texts.append("".join(chance.choice(WORDS) + chance.choice([" ", "  ", "\n", ", ", "."]) for _ in range(size)))
    texts.append(" ".join(chance.choice(WORDS) + str(chance.randrange(99)) for _ in range(20_000)))
    return texts + texts[12:20]


def messy_docs(spark, texts=None):
    texts = messy_texts() if texts is None else texts
    rows = [(None if k == 4 else 7 * k - 30, t, "en", None if k % 9 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)]
    rows = [(*row, 0.1, "c", "r", "f", "q", "o") for row in [*rows, *rows[10:13]]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def id_bytes(tokenizer, text, end=True):
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [0] * end
    return np.array(ids, dtype="<u4").tobytes()


# Encoding


def test_encoder_equals_the_library(tokenizer):
    chance = random.Random(2)
    pool = ["a", "b ", " ", "  ", "\n", "é", "ß", "😀", "'s", "1", "２", "٣", ".", ",", "\t", "\x1c", "\x85", " ",
            "\xa0", "ǅ", "中", "\r\n", "x's", "½", "ª", "µ", "İ", "é", "\x00", "​", "$"]
    texts = ["".join(chance.choices(pool, k=chance.randrange(30))) for _ in range(3000)]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for text, data in zip(texts, encoder.batch(texts)):
        assert data == id_bytes(tokenizer, text, end=False), text
    for text, (ids, starts, ends) in zip(texts, encoder.spans(texts)):
        whole = text.encode()
        at = np.cumsum([0, *encoder.token_bytes[ids]])
        assert at[-1] == len(whole)
        for a, b, start, stop in zip(at, at[1:], starts, ends):
            assert text[start:stop].encode().find(whole[a:b]) >= 0


def test_encoder_tables_stay_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_BYTES", 4000)
    monkeypatch.setattr(tokens, "WORDS_BYTES", 2000)
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for text in [t for t in messy_texts() if t][:50] + ["x" * 3000 + " " + "y" * 3000]:
        assert encoder.batch([text]) == [id_bytes(tokenizer, text, end=False)]
    assert sum(map(len, encoder._pieces)) < 4000 and not any(len(key) > tokens.LONGEST_KEPT for key in encoder._pieces)


def test_added_tokens_get_their_ids(tokenizer):
    encoder = tokens.Encoder(tokens.vocabulary_path())
    assert encoder.ids(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]
    texts = ["<|endoftext|>", "<|endoftext|><|endoftext|> a", " x <|endoftext|> y", "<|endoftext|", "\n<|endoftext|>\n"]
    assert encoder.batch(texts) == [id_bytes(tokenizer, text, end=False) for text in texts]


# 1: chat


def test_chat(spark):
    chance = random.Random(3)
    rows, convs = [], defaultdict(list)
    for conv in [*range(30), None]:
        for turn in range(chance.randrange(1, 6)):
            role = chance.choice(["user", "assistant", "assistant", None, "<|end|>\n"])
            text = chance.choice([None, "", "</s>[INST] ok [/INST]", "<\\|turn|>", "a\\", "é<|end|>😀", " x \n", "\\\\<s>[/INST]"])
            rows.append((conv, turn, role, text, "clash"))
            convs[conv].append((role or "", text or ""))
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(rows.repartition(4))
    found = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert set(found) == set(convs)
    for conv, turns in convs.items():
        row = found[conv]
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for row in formatted.collect():
        for mark in ("</s>", "[INST]", "[/INST]"):
            assert mark not in row["formatted"]
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_escape_is_reversible():
    chance = random.Random(4)
    for _ in range(3000):
        text = "".join(chance.choices(["\\", "<", "|", ">", "[", "INST]", "/", "s>", "a", "</s>", "<|end|>", "\n"], k=9))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(mark in hidden for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


# 2: mixing


def plain_poisson(mean, point):
    total, count, p = 0.0, 0, math.exp(-mean)
    while True:
        total += p
        if total > point:
            return count
        count += 1
        p *= mean / count


def test_poisson_counts():
    points = np.random.default_rng(1).random(400)
    for mean in (0.01, 0.5, 1.0, 7.3, 60.0):
        assert mixing.poisson_counts(np.full(400, mean), points).tolist() == [plain_poisson(mean, u) for u in points]
    big = mixing.poisson_counts(np.full(400, 1e9), points)
    assert abs(big.mean() - 1e9) < 4 * math.sqrt(1e9 / 400) and big.std() == pytest.approx(math.sqrt(1e9), rel=0.15)


@pytest.mark.parametrize("weights", [None, {"s1": 3.0, "s2": 1.0}])
def test_mix(spark, weights):
    docs = messy_docs(spark)
    rows = docs.select("doc_id", "text", "source").collect()
    chars = Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    weight = {s: (c**0.5 if weights is None else weights.get(s, 0.0)) if c else 0.0 for s, c in chars.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(chars.values()) / c if c else 1.0 for s, c in chars.items()}
    expected = Counter()
    for r in rows:
        name = str(r["doc_id"]) if r["doc_id"] is not None else "t" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        point = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) / 16**13
        n = plain_poisson(rate[r["source"]], point) if rate[r["source"]] else 0
        for k in range(1, n + 1):
            expected[r["doc_id"], r["text"], r["source"], k, n] += 1
    mixed = mixing.mix(docs, weights)
    assert mixed.columns == [*docs.columns, "_copy", "n_copies"]
    found = Counter(tuple(r) for r in mixed.select("doc_id", "text", "source", "_copy", "n_copies").collect())
    assert found == expected
    assert mixing.mix(empty(spark)).count() == 0


# 3: toxicity


def test_decode_reads_noise():
    text = " ".join(["idiot pathetic the moron of and that tion"] * 50)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype="<u4")
    kinds = toxicity._LETTER_KIND[codes]
    three = (kinds[:-2] * 64 + kinds[1:-1]) * 64 + kinds[2:]
    costs = toxicity.trigram_costs(np.bincount(three, minlength=64**3))
    for noisy, plain in {"1d10t": "idiot", "IDIOOOT!!": "idiot", "i.d.i.o.t": "idiot", "p@thet1c,": "pathetic",
                         "m0r0n": "moron", "The": "the", "of$$$": "of", "i d i o t": "idiot", "": "", "2024": "2024"}.items():
        assert toxicity.restore(noisy, costs) == plain


def letter_costs(text):
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype="<u4")
    kinds = toxicity._LETTER_KIND[codes]
    three = (kinds[:-2] * 64 + kinds[1:-1]) * 64 + kinds[2:]
    return toxicity.trigram_costs(np.bincount(three, minlength=64**3))


def test_all_noise_of_the_channel_is_read():
    costs = letter_costs(" ".join(["idiot stupid ass dumbass the moron of and that tion"] * 50))
    model = toxicity.Model(costs, {"idiot": 0.9, "stupid": 0.8, "ass": 0.7, "dumbass": 0.6, "moron": 0.9})
    hidden = "m" + "." * 70 + "oron"
    for noisy, weight in {"stuupid": 0.8, "iiddiioott": 0.9, "455": 0.7, "@$$": 0.7, "a$$": 0.7, "dumba$$": 0.6, "ass": 0.7,
                          hidden: 0.9, "1d10t!!": 0.9, "2024": 0.0, "the": 0.0}.items():
        assert model.token(noisy) == weight, noisy
    assert toxicity.decode("x" + "a0" * 20_000, costs).startswith("x")


def edges_by_rule(token):
    """One pattern after the other until nothing changes."""
    edge = re.compile(r"^[^\w@$€£(|+!¡]+|[^\w@$€£|+!]+$|^[!|+(]{2,}|[@$€£|+!]{2,}$|!+$|^@@+|^\$\$+")
    word, before = token, ""
    while word != before:
        word, before = edge.sub("", word), word
    return word


def test_ends_are_stripped_in_linear_time():
    chance = random.Random(12)
    for _ in range(20_000):
        token = "".join(chance.choices("aé1_.-(|+!@$€£¡*,~'`&", k=chance.randrange(1, 10)))
        assert toxicity._stripped(token) == edges_by_rule(token), token
    costs = np.ones((toxicity.KINDS,) * 3, dtype=np.float32)
    began = time.time()
    for token in ("a" + "-" * 10**6 + "a", "!!-" * 300_000 + "a", "a" + "-!!" * 300_000, "ab4" * 100_000):
        assert toxicity.readings(token, costs)
    assert time.time() - began < 40


def test_plain_tokens_have_one_reading():
    costs = letter_costs("the quick brown fox and a lazy dog")
    for token in ("word", "Word.", "été,", "the.,.", "straße"):
        assert toxicity.readings(token, costs) == [token.lower().rstrip(".,")]


def test_decode_takes_the_cheapest_path():
    rng = np.random.default_rng(3)
    costs = rng.random((64, 64, 64)).astype(np.float32) * 3

    def readings(token, before="", a=0, b=0, cost=0.0, text=""):
        if not token:
            yield cost + float(costs[a, b, 0]), text
            return
        char = token[0]
        if char in toxicity._KIND:
            choices = [(char, 0.0)] + ([("", toxicity.REPEAT_COST)] if char == before else [])
        elif char in toxicity.LOOK_ALIKE:
            choices = [(x, toxicity.SUBSTITUTE_COST) for x in toxicity.LOOK_ALIKE[char]] + [("", 4 * toxicity.SUBSTITUTE_COST)]
        else:
            choices = [("", toxicity.DROP_COST)]
        for letter, extra in choices:
            if letter:
                kind = toxicity._KIND[letter]
                yield from readings(token[1:], char, b, kind, cost + extra + float(costs[a, b, kind]), text + letter)
            else:
                yield from readings(token[1:], char, a, b, cost + extra, text)

    chance = random.Random(6)
    for _ in range(200):
        token = "".join(chance.choices("aab1|.0s$", k=7))
        best = min(readings(token))
        assert best[1] == toxicity.decode(token, costs)


def test_toxicity_learns_and_holds_out(spark):
    chance = random.Random(8)
    vocabulary = ["".join(chance.choices("aeinrstl", k=chance.randrange(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for doc in range(900):
        words = chance.choices(vocabulary, k=40)
        toxic = int(doc % 6 == 0)
        if toxic:
            words[chance.randrange(40)] = chance.choice(["grumpf", "blofeld", "gr0mpf" if doc % 12 else "grumpf"])
        rows.append((doc, " ".join(words), "en", "s", 1, 0.1, "c", "r", "f", "q", "o"))
        if doc % 10:
            labels.append((doc, 1, toxic))
    labels += [(None, 1, 1), (3, 1, None)]
    docs = spark.createDataFrame([*rows, (None, None, *rows[0][2:])], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 901 and found[None]["score"] == toxicity.NO_EVIDENCE
    for doc, row in found.items():
        if doc is not None:
            assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
            assert row["predicted"] == int(row["score"] >= 0.5)
    held = [doc for doc, row in found.items() if row["held_out"]]
    right = sum(found[doc]["predicted"] == int(doc % 6 == 0) for doc in held)
    assert right / len(held) > 0.95
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {doc for doc, row in found.items() if not row["predicted"]}
    none = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty(spark), none).count() == 0


# 4: packing


def test_pack(spark, tokenizer):
    docs = messy_docs(spark)
    found = packing.pack(docs).collect()
    left = defaultdict(list)
    for doc, text in pairs(docs):
        left[doc].append(id_bytes(tokenizer, text))
    by_doc = defaultdict(list)
    for row in found:
        by_doc[row["doc_id"]].append(row)
    assert set(by_doc) == set(left)
    for doc, texts in left.items():
        sizes = Counter((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        if len(texts) == 1:
            place = 0
            for row in sorted(by_doc[doc], key=lambda r: r["start"]):
                part = texts[0][4 * row["start"] : 4 * (row["start"] + row["length"])]
                assert row["start"] == place and row["ids_crc32"] == zlib.crc32(part)
                assert row["doc_tokens"] == len(texts[0]) // 4
                place += row["length"]
            assert place == len(texts[0]) // 4
        assert sum(k[1] * n for k, n in sizes.items()) == sum(len(t) for t in texts) // 4
    sequences = defaultdict(list)
    for row in found:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    padding = 0
    for parts in sequences.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 1024
        padding += 0 if place & (place - 1) == 0 else 1024 - place
    assert padding == 0
    assert packing.pack(empty(spark)).count() == 0


def test_place_balances_cost():
    chance = random.Random(9)
    lengths = [chance.randrange(1, 1024) for _ in range(300)]
    capacities = packing.room_for(sum(lengths), 1024)
    placed = packing.place(lengths, capacities)
    size, cost = Counter(), [0.0] * len(capacities)
    room = list(capacities)
    for item, start, length, to, offset in placed:
        whole = lengths[item] - start
        assert offset == capacities[to] - room[to] and length == min(whole, room[to])
        if length == whole:
            assert cost[to] == min(c for c, r in zip(cost, room) if r >= whole)
        else:
            assert max(room) < whole and room[to] == max(room)
        room[to] -= length
        cost[to] += packing.LINEAR * length + packing.QUADRATIC * length**2
        size[item] += length
    assert [size[k] for k in range(300)] == lengths


# 5: WARC


def test_warc_round_trip(spark, tmp_path):
    chance = random.Random(1)
    body = ["x" * 1000, "é" * 500, "WARC/1.1\r\n\r\n" * 200, "", None, "short", "y" * 999]
    rows = [(k, f"http://a/{k}\r\nX: y", chance.choice(body)) for k in range(60)]
    rows += [(None, None, "x" * 1000), rows[3], (-1, "u", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_pages(pages.repartition(3), str(tmp_path / "w"), records_per_file=7)
    read = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert all(r["kind"] == "record" for r in read) and len(read) == len(rows)
    largest = defaultdict(lambda: None)
    for page, _, html in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            largest[html] = max(page, largest[html] if largest[html] is not None else page)
    expected = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = largest[html or ""]
        revisit = len(data) >= 1000 and page != first
        expected[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r[n] for n in names) for r in read) == expected
    for r in read:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def test_salvage_after_damage():
    def record(n):
        block = f"HTTP/1.1 200 OK\r\n\r\npage {n} ".encode() * 9
        digest = hashlib.sha1(block).hexdigest()
        return (f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{digest}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"  # fmt: skip

    whole = [record(n) for n in range(6)]
    flipped = whole[2].replace(b"page 2", b"page X", 1)
    for parts, good in (
        ([whole[0], flipped, whole[3]], [0, 3]),
        ([b"junk", whole[1], whole[2][:40], whole[4]], [1, 4]),
        ([gzip.compress(whole[0]), gzip.compress(whole[1])[:-9], gzip.compress(whole[2]), whole[5]], [0, 2, 5]),
        ([gzip.compress(whole[0] + whole[1]), b"\x1f\x8b\x08bad", gzip.compress(whole[4]), b"tail"], [0, 1, 4]),
        ([whole[0].replace(b"Content-Length", b"Content-Lost"), whole[1]], [1]),
        ([], []),
    ):
        data = b"".join(parts)
        found = list(warc.salvage(data))
        pages = [warc._page(h["warc-record-id"]) for _, _, h, _, _ in found if h is not None]
        assert pages == good
        spans = sorted({(a, b) for a, b, _, _, _ in found})
        assert [a for a, _ in spans] + [len(data)] == [0] + [b for _, b in spans] if spans else not data
        assert all(reason for _, _, h, _, reason in found if h is None)


def test_salvage_inside_members():
    def record(n, base32=False):
        block = f"HTTP/1.1 200 OK\r\n\r\npage {n} ".encode() + random.Random(n).randbytes(3000)
        digest = hashlib.sha1(block)
        name = base64.b32encode(digest.digest()).decode() if base32 else digest.hexdigest()
        return (f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{name}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"  # fmt: skip

    whole = [record(n) for n in range(8)]
    flipped = whole[2].replace(b"page 2", b"page X", 1)
    five = b"".join([*whole[:2], flipped, *whole[3:5]])
    broken = bytearray(gzip.compress(b"".join(whole[:5])))
    broken[-3000:-2900] = b"\xff" * 100
    for parts, good in (
        ([gzip.compress(five), whole[5]], [0, 1, 3, 4, 5]),
        ([gzip.compress(b"junk" + whole[0]), gzip.compress(flipped), gzip.compress(b""), gzip.compress(whole[6])], [0, 6]),
        ([gzip.compress(b"".join(whole[:5]))[:-2000]], [0, 1, 2, 3]),
        ([gzip.compress(b"".join(whole[:5]))[:-2000], gzip.compress(whole[7])], [0, 1, 2, 3, 7]),
        ([b"junk", bytes(broken), whole[6]], [0, 1, 2, 3, 6]),
        ([record(0, True), gzip.compress(record(1, True)), record(2, True).replace(b"page 2", b"page X", 1)], [0, 1]),
    ):
        data = b"".join(parts)
        found = list(warc.salvage(data))
        assert [warc._page(h["warc-record-id"]) for _, _, h, _, _ in found if h is not None] == good
        spans = sorted({(a, b) for a, b, _, _, _ in found})
        assert [a for a, _ in spans] + [len(data)] == [0] + [b for _, b in spans]
        assert any(h is None for _, _, h, _, _ in found) and all(reason for _, _, h, _, reason in found if h is None)


# 6: token files


def test_token_files(spark, tokenizer, tmp_path):
    docs = messy_docs(spark)
    path = str(tmp_path / "t")
    token_orc.write_tokens(docs, path)
    found = token_orc.with_checksum(token_orc.read_tokens(spark, path)).collect()
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    left, start = Counter(), 0
    starts = {}
    for doc, text in rows:
        data = id_bytes(tokenizer, text)
        left[doc, len(data) // 4, zlib.crc32(data)] += 1
        starts.setdefault(doc, start)
        start += len(data) // 4
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == left
    seen = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in found)
    assert [a for a, _, _ in seen] == [0, *np.cumsum([n for _, n, _ in seen])[:-1].tolist()]
    for r in found:
        assert r["start"] >= starts[r["doc_id"]]
    some = [doc for doc, _ in rows if doc is not None][10]
    one = token_orc.find_tokens(spark, path, [some]).collect()
    assert all(np.array(r["ids"], dtype="<u4").tobytes() in [id_bytes(tokenizer, t) for d, t in rows if d == some] for r in one)
    token_orc.write_tokens(empty(spark), str(tmp_path / "none"))
    assert token_orc.with_checksum(token_orc.read_tokens(spark, str(tmp_path / "none"))).count() == 0


# 7: token counts


@pytest.mark.parametrize("rule", ["first", "last"])
def test_token_counts(spark, tokenizer, rule):
    docs = messy_docs(spark)
    found = defaultdict(Counter)
    for r in token_counts.token_counts(docs, rule=rule).collect():
        found[r["doc_id"]][tuple(r)[1:]] += 1
    expected = defaultdict(Counter)
    for doc, text in pairs(docs):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
        line_of = [k for k, line in enumerate(lines) for _ in line]
        char_of = [k for k, c in enumerate(text) for _ in c.encode()]
        place, counts, crossing = 0, Counter(), Counter()
        for token in tokenizer.encode(text, add_special_tokens=False).tokens:
            chars = [char_of[place], char_of[place + len(token) - 1]]
            a, b = (line_of[c] for c in chars)
            counts[a if rule == "first" else b] += 1
            crossing[a if rule == "first" else b] += a != b
            place += len(token)
        start = 0
        for k, line in enumerate(lines):
            expected[doc][k, start, len(line), counts[k], crossing[k]] += 1
            start += len(line)
    assert found == expected
    assert token_counts.token_counts(empty(spark)).count() == 0


# 8: SimHash near-duplicates


def plain_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    parent = list(range(len(prints)))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[top(a)] = top(b)
    return [top(k) for k in range(len(prints))]


def test_simhash_components(spark):
    chance = random.Random(11)
    texts = messy_texts()[:-9]
    base = " ".join(chance.choice(WORDS) + str(k) for k in range(400)).split()
    for k in range(40):
        words = list(base)
        words[chance.randrange(400)] = f"new{k}"
        texts.append(" ".join(words))
    docs = messy_docs(spark, texts)
    rows = pairs(docs)
    prints = [plain_print(text) for _, text in rows]
    least = {}
    top = plain_components(prints)
    for (doc, _), root in zip(rows, top):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    expected = Counter((doc, p, least.get(root)) for (doc, _), p, root in zip(rows, prints, top))
    found = simhash_tiles.near_components(docs).collect()
    assert Counter((r["row"]["doc_id"], r["fp"] % 2**64, r["rep"]["doc_id"]) for r in found) == expected
    assert len(set(top)) < len(rows) - 30
    kept = simhash_tiles.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(top)) and {i for i in ids if i is not None} >= set(least.values())
    assert simhash_tiles.near_components(empty(spark)).count() == 0


def test_links_with_large_buckets(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, size=3, dtype=np.int64).tolist()
    prints = set(centre)
    while len(prints) < 900:
        prints.add(rng.choice(list(prints)[-300:]).item() ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash_tiles.links(frame, 2, tile=16)
    roots = {r["node"]: r["root"] for r in simhash_tiles.components(edges).collect()}
    found = [roots.get(p, p) for p in prints]
    top = plain_components([p % 2**64 for p in prints])
    assert len(set(zip(found, top))) == len(set(found)) == len(set(top))


@pytest.mark.parametrize("tile", [2048, 16])
@pytest.mark.parametrize("family", [2, 5, 40])
def test_links_of_negative_fingerprints(spark, tile, family):
    rng = np.random.default_rng(9)
    prints = {2**63, 2**63 + 1, 2**64 - 1, 2**64 - 4, 1, 0}
    for centre in rng.integers(0, 2**64, size=400 // family, dtype=np.uint64).tolist():
        # The high bit and one bit more, both at once or one.
        prints |= {centre, *(centre ^ (k % 2 or not k) << 63 ^ 1 << int(rng.integers(0, 63)) for k in range(family - 1))}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash_tiles.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, tile=tile)
    roots = {r["node"]: r["root"] for r in simhash_tiles.components(edges).collect()}
    found, top = [roots.get(p, p) for p in signed], plain_components(prints)
    assert len(set(zip(found, top))) == len(set(found)) == len(set(top))


def test_least_neighbour_of_every_edge(spark):
    pairs = [(0, b) for b in range(5, 200)] + [(a, a + 1) for a in range(300, 320)] + [(300, 7)]
    found = simhash_tiles._with_least(spark.createDataFrame(pairs, "a long, b long")).collect()
    least = {a: min(b for x, b in pairs if x == a) for a, _ in pairs}
    assert sorted(map(tuple, found)) == sorted((a, b, least[a]) for a, b in pairs)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (400, 450)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash_tiles.components(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, 201)}, 500: 400, 450: 400}


def similarity(a, b):
    a, b = (set(simhash_copies.shingle_hashes(text).tolist()) for text in (a, b))
    return len(a & b) / len(a | b)


def test_shingle_hashes():
    for text in [text or "" for text in messy_texts(20)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        assert set(simhash_copies.shingle_hashes(text).tolist()) == {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles}


@pytest.mark.parametrize("tile", [8, 2048])
def test_near_copies(spark, tile):
    chance = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, family = [None, "", " \n", "one", "ONE", "one two", "a b c d e f"], [0, 0, 0, 1, 1, 2, 3]
    for k, (size, copies) in enumerate([(60, 3), (300, 60), (300, 40), (1500, 5)] + [(120, 1)] * 60):
        base = chance.choices(vocabulary, k=size)
        for copy in range(copies):
            words = list(base)
            for place in range(copy % 2 * size // 120):
                words[chance.randrange(size)] = f"new{copy}-{place}"
            texts.append(" ".join(words))
            family.append(10 + k)
    docs = messy_docs(spark, texts)
    kept = simhash_copies.keep_one_of_each(docs, tile=tile)
    assert kept.columns == docs.columns
    left = Counter(family[texts.index(r["text"])] for r in kept.collect())
    assert left == dict.fromkeys(family, 1)


@pytest.mark.parametrize("tile", [8, 2048])
def test_near_copies_equal_brute_force(spark, tile):
    chance = random.Random(14)
    frame, texts = [f"t{k}" for k in range(170)], []
    for k in range(40):  # pages of one template: any two are of similarity 0.6 to 0.75
        texts.append(" ".join(frame[:85] + [f"p{k}-{j}" for j in range(chance.randrange(18, 30))] + frame[85:]))
    for k in range(60):  # 4 and 5 shingles, 8 and 10, 12 and 15 with 0.8 exactly
        words = [f"s{k}-{j}" for j in range((9, 14, 19)[k % 3])]
        texts += [" ".join(words), " ".join(words[: (8, 12, 16)[k % 3]])]
    for k in range(30):
        words = [f"e{k}-{j}" for j in range(200)]
        texts.append(" ".join(words))
        for place in chance.sample(range(5, 195), chance.randrange(2, 8)):
            words[place] = "x"
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    sets = [set(simhash_copies.shingle_hashes(text).tolist()) for text in texts]
    parent = list(ids)
    for a in ids:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if p == old else p for p in parent]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash_copies.keep_one_of_each(docs, tile=tile).collect()}
    assert kept == set(parent) and 40 < len(kept) < len(ids) - 60


def test_near_copies_over_tiles(spark):
    rng = np.random.default_rng(8)
    prints, heads = [], rng.integers(0, 2**63, size=(4, simhash_copies.LANES), dtype=np.uint64)
    for k in range(600):
        row = heads[[0, 0, 0, 1, 2, 3][k % 6]] if k < 300 else np.frombuffer(prints[k - 300], dtype="<u8")
        flips = np.zeros(64 * simhash_copies.LANES, dtype=np.uint8)
        flips[rng.choice(len(flips), size=rng.integers(20, 90), replace=False)] = 1
        prints.append((row ^ np.packbits(flips).view("<u8")).tobytes())
    nodes = spark.createDataFrame([(p, [7, 100 + k % 5]) for k, p in enumerate(prints)], "print binary, bands array<long>")
    found = {bytes(r["node"]): bytes(r["root"]) for r in simhash_copies.roots(nodes, tile=16).collect()}
    top = plain_components([int.from_bytes(p, "little") for p in prints], simhash_copies.RADIUS)
    pairs_seen = set(zip([found.get(p, p) for p in prints], top))
    assert len(pairs_seen) == len({a for a, _ in pairs_seen}) == len(set(top)) > 1


def test_sketch_distance_follows_similarity():
    chance = random.Random(4)
    base = [f"w{chance.randrange(5000)}" for _ in range(800)]
    for edits in (0, 5, 15, 17, 60, 400):
        words = list(base)
        for place in chance.sample(range(800), edits):
            words[place] = f"n{place}"
        a, b = " ".join(base), " ".join(words)
        near = similarity(a, b)
        apart = np.bitwise_count(np.frombuffer(simhash_copies.sketch(a)[0], "<u8") ^ np.frombuffer(simhash_copies.sketch(b)[0], "<u8")).sum()
        assert abs(apart - 512 * math.acos(2 * near / (1 + near)) / math.pi) < 45
        assert apart <= simhash_copies.RADIUS or near < 0.8
        assert apart > simhash_copies.RADIUS or near > 0.6


# 9: quality


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = [any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(words) - 3) + 1)) for k in range(len(words))]
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    values = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit)]
    for n in repetition.COVERAGE:
        seen, cover = set(), [False] * len(words)
        for k in range(len(words) - n + 1):
            window = tuple(words[k : k + n])
            if window in seen:
                cover[k : k + n] = [True] * n
            seen.add(window)
        values.append(sum(len(w) for w, c in zip(words, cover) if c))
    return values


def test_quality(spark):
    chance = random.Random(12)
    texts = messy_texts()[:-9] + [" ".join(chance.choices("ab cd ef gh".split(), k=n)) for n in (5, 9, 49, 50, 51, 120)]
    texts += [" ".join(f"w{k}" for k in range(60)), "\n".join(["one two three"] * 30), "w " * 70]
    docs = messy_docs(spark, texts)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"covered_{n}" for n in repetition.COVERAGE]]
    found = repetition.quality(docs).collect()
    expected = Counter((doc, *plain_quality(text)) for doc, text in pairs(docs))
    assert Counter((r["doc_id"], *[r[m] for m in measures]) for r in found) == expected
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = repetition.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found) > 0
    assert repetition.quality(empty(spark)).count() == 0


# 10: fingerprints


def plain_votes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    votes, total = [0] * 128, 0
    for one, two in zip(words, [*words[1:], None]):
        size = len(one.encode()) + len((two or "").encode())
        weight = min(fingerprints.MAX_WEIGHT, 1 + size // 4)
        a = xxhash.xxh64_intdigest(one.encode(), 42)
        a = xxhash.xxh64_intdigest(two.encode(), a) if two is not None else a
        b = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), a)
        total += weight
        for bit in range(64):
            votes[bit] += weight * (a >> bit & 1)
            votes[64 + bit] += weight * (b >> bit & 1)
    return tuple(sum(1 << bit for bit in range(64) if 2 * votes[base + bit] > total) for base in (0, 64))


def test_fingerprints(spark):
    docs = messy_docs(spark, messy_texts()[:-9])
    rows = pairs(docs)

    def signed_hash(text):
        value = xxhash.xxh64_intdigest(text.encode(), 42)
        return value - 2**64 if value >= 2**63 else value

    rows.sort(key=lambda r: (r[0] is None, -(r[0] if r[0] is not None else signed_hash(r[1])), signed_hash(r[1])))
    expected = Counter()
    prints = [plain_votes(text) for _, text in rows]
    bits = lambda p, q: sum((x ^ y).bit_count() for x, y in zip(p, q))
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        e, n = plain_votes(edited), prints[(k + 1) % len(rows)]
        near = sum(bits(prints[k], p) <= fingerprints.RADIUS for p in prints) - 1
        expected[
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "%016x%016x" % prints[k], "%016x%016x" % e,
            1 - bits(prints[k], e) / 128, 1 - bits(prints[k], n) / 128, near,
        ] += 1
    assert Counter(tuple(r) for r in fingerprints.fingerprint_documents(docs).collect()) == expected
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0


def test_next_documents_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES_AT_ONCE", 2)
    chance = random.Random(13)
    ids = sorted({chance.randrange(-(2**40), 2**40) for _ in range(50)} | set(range(2000, 2100)) | {5000, 9000}, reverse=True)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    found = {r["text"]: r["next_text"] for r in fingerprints.next_documents(docs).collect()}
    assert found == {f"t{a}": f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]])}


def test_near_fingerprints(spark):
    rng = np.random.default_rng(7)
    prints = {tuple(int(x) for x in rng.integers(-(2**62), 2**62, 2))}
    while len(prints) < 120:
        a = list(prints)[rng.integers(len(prints))]
        prints.add((a[0] ^ (1 << int(rng.integers(62))), a[1] ^ (1 << int(rng.integers(62)))))
    frame = spark.createDataFrame(list(prints), "h1 long, h2 long")
    for radius in (1, 3, 4):
        found = [tuple(r) for r in fingerprints.near_fingerprints(frame, radius).collect()]
        apart = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b))
        expected = {(*a, *b) for a in prints for b in prints if 0 < apart(a, b) <= radius}
        assert len(found) == len(set(found)) and set(found) == expected


# Queries and pipeline


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)", n)[1]))[0] == "op1_chat_format"
    assert len(queries.QUERIES) == 13 and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline_stages_equal_plain_selection(spark, tmp_path):
    import corpus_pipeline

    chance = random.Random(21)
    vocabulary = ["".join(chance.choices("aeinrstl", k=chance.randrange(3, 9))) for _ in range(2000)]
    rows, labels, junk, toxic = [], [], set(), set()
    for doc in range(400):
        words = chance.choices(vocabulary, k=chance.choice([20, 80, 200]))
        if doc % 8 == 0:
            words[3] = words[9] = "grumpf"
            toxic.add(doc)
        labels.append((doc, 1, int(doc % 8 == 0)))
        text = " ".join(words)
        if doc % 50 == 1:
            text = " ".join(["spam here again"] * 40)
        rows.append([doc, text, "en", f"s{doc % 3}", len(text)])
    for doc in range(0, 400, 20):
        rows.append([1000 + doc, rows[doc + 3][1], "en", "s9", 0])
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    kept = set(text)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found = {r["doc_id"] for r in docs.collect()}
        if name == "quality rules":
            kept = {d for d in kept if repetition.measure(text[d])[-1]}
        elif name == "toxicity":
            wrong = (kept - found) ^ (kept & {d for d in kept if "grumpf" in text[d]})
            assert len(wrong) <= 3
            kept = found
        else:
            by_print = {}
            for d in sorted(kept):
                by_print.setdefault(plain_print(text[d]), d)
            kept = set(by_print.values())
        assert found == kept
    packed = corpus_pipeline.run(spark, folder)
    mixed = mixing.mix(docs)
    assert sum(r["length"] for r in packed.collect()) == sum(
        len(tokens.encoder(tokens.vocabulary_path()).batch([r["text"]])[0]) // 4 + 1 for r in mixed.collect()
    )


def test_library_works_without_this_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    for folder, _, files in os.walk(root):
        inside = os.path.relpath(folder, root)
        if ".git" in inside.split(os.sep) or "llm" in inside.split(os.sep) or "__pycache__" in inside:
            continue
        os.makedirs(copy / inside, exist_ok=True)
        for name in files:
            if name.endswith(".py") and name != "corpus_pipeline.py":
                (copy / inside / name).write_bytes(open(os.path.join(folder, name), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    assert importlib.util.find_spec("loomlog.llm") is not None
