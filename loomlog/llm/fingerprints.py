"""SimHash document fingerprints in Spark's own functions.

Terms are pairs of neighbouring words. A term's two XXH64 values vote with a weight that grows
with its length, as longer pairs are rarer: each bit adds the weight when set, and a bit of the
fingerprint is one when its votes are more than half of all. Votes of two bits share one 64-bit
sum, 32 bits each, so a text of up to 300 million words cannot overflow them, and tasks add up
their part of a text before the shuffle.

``near_fingerprints`` finds all pairs within a Hamming radius through block tables: 128 bits
in ``radius + 1`` blocks, one permuted table per block, joined on the block that must agree.

``next_documents`` gives each document the one that follows in descending ``doc_id``. Documents
are ordered inside ranges of 1024 ids, the ranges inside ranges of those, and so on, so no window
holds more than a bounded number of different ids.

Defined cases: a null text counts as empty, and a text without words has fingerprint zero; rows
without ``doc_id`` follow after all others, ordered by a hash of their text; repeated rows follow
each other in the order of that hash; in a table of one row the row follows itself; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.session import materialize
from loomlog.spread import salted_join

BITS = 128
RADIUS = 3
RANGE_BITS = 10
RANGES_AT_ONCE = 4096
MAX_WEIGHT = 7


def _ordered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("last", F.col("doc_id").isNull())
    place = F.coalesce(F.col("doc_id"), F.col("text_hash"))
    return rows.withColumn("place", place).withColumn("bucket", F.shiftright("place", RANGE_BITS))


def _next_buckets(buckets: DataFrame) -> DataFrame:
    """``last, bucket, next_last, next_bucket`` for distinct buckets, the first after the last."""
    order = [F.col("last").asc(), F.col("bucket").desc()]
    after = F.struct("last", "bucket")
    if buckets.count() <= RANGES_AT_ONCE:
        whole = Window.orderBy(*order)
        first = F.first(after).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        found = buckets.withColumn("_next", F.coalesce(F.lead(after).over(whole), first))
    else:
        inner = buckets.withColumn("parent", F.shiftright("bucket", RANGE_BITS))
        inside = Window.partitionBy("last", "parent").orderBy(F.col("bucket").desc())
        inner = inner.withColumn("_inside", F.lead(after).over(inside))
        parents = materialize(inner.groupBy("last", "parent").agg(F.max("bucket").alias("head")), "ranges")
        up = _next_buckets(parents.select("last", F.col("parent").alias("bucket")))
        up = up.withColumnsRenamed({"bucket": "parent"})
        heads = parents.select(
            F.col("last").alias("next_last"), F.col("parent").alias("next_bucket"), F.col("head").alias("_head")
        )
        up = up.join(heads, ["next_last", "next_bucket"])
        up = up.select("last", "parent", F.struct(F.col("next_last").alias("last"), F.col("_head").alias("bucket")).alias("_up"))
        found = inner.join(up, ["last", "parent"]).withColumn("_next", F.coalesce("_inside", "_up"))
    return found.select("last", "bucket", F.col("_next.last").alias("next_last"), F.col("_next.bucket").alias("next_bucket"))


def next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key, next_key, next_text``; ``key`` names a row, also among equal ones."""
    rows = _ordered(docs)
    lead_row = F.struct(F.bitwise_not("place").alias("reversed"), "text_hash")
    buckets = rows.groupBy("last", "bucket").agg(F.min(lead_row).alias("head"))
    buckets = materialize(buckets.select("last", "bucket", F.bitwise_not("head.reversed").alias("place"), "head.text_hash"), "buckets")
    chain = materialize(_next_buckets(buckets.select("last", "bucket")), "bucket-chain")
    # One text per bucket: its first document's, which follows the last one of the bucket before.
    heads = rows.join(buckets, ["last", "bucket", "place", "text_hash"], "left_semi")
    heads = heads.groupBy("last", "bucket").agg(F.min("text").alias("_head"))
    heads = heads.withColumnsRenamed({"last": "next_last", "bucket": "next_bucket"})
    follows = materialize(chain.join(heads, ["next_last", "next_bucket"]), "bucket-heads")
    inside = Window.partitionBy("last", "bucket").orderBy(F.col("place").desc(), "text_hash", "text")
    rows = rows.withColumn("n", F.row_number().over(inside).cast("long")).withColumn("_inside", F.lead("text").over(inside))
    rows = rows.join(follows, ["last", "bucket"])
    ends = F.col("_inside").isNull()
    next_key = F.struct(
        F.when(ends, F.col("next_last")).otherwise(F.col("last")).alias("last"),
        F.when(ends, F.col("next_bucket")).otherwise(F.col("bucket")).alias("bucket"),
        F.when(ends, F.lit(1)).otherwise(F.col("n") + 1).cast("long").alias("n"),
    )
    return rows.select(
        "doc_id",
        "text",
        F.struct("last", "bucket", "n").alias("key"),
        next_key.alias("next_key"),
        F.coalesce("_inside", "_head").alias("next_text"),
    )


def term_votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, h1, h2``: the fingerprint of each row's ``text`` as two 64-bit halves."""
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    rows = texts.select(*keys, F.filter(words, lambda w: w != "").alias("words"))
    after = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.col("words").alias("one"), after.alias("two"))
    terms = rows.select(*keys, F.explode_outer(pairs).alias("pair"))
    length = F.coalesce(F.octet_length("pair.one"), F.lit(0)) + F.coalesce(F.octet_length("pair.two"), F.lit(0))
    weight = F.when(F.col("pair").isNull(), 0).otherwise(F.least(F.lit(MAX_WEIGHT), F.lit(1) + F.shiftright(length, 2)))
    terms = terms.select(
        *keys,
        F.xxhash64("pair.one", "pair.two").alias("a"),
        F.xxhash64("pair.one", "pair.two", F.lit(1)).alias("b"),
        weight.cast("long").alias("w"),
    )
    two_bits = F.lit((1 << 32) + 1)
    sums = [
        F.sum(F.shiftrightunsigned(half, bit).bitwiseAND(two_bits) * F.col("w")).alias(f"{half}{bit}")
        for half in ("a", "b")
        for bit in range(32)
    ]
    votes = terms.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    return votes.select(*keys, _half("a").alias("h1"), _half("b").alias("h2"))


def _half(half: str) -> Column:
    """64 bits from 32 sums of two votes each."""
    low = (1 << 32) - 1
    bits = F.lit(0).cast("long")
    for bit in range(32):
        votes = F.col(f"{half}{bit}")
        set_low = votes.bitwiseAND(F.lit(low)) * 2 > F.col("w")
        set_high = F.shiftrightunsigned(votes, 32) * 2 > F.col("w")
        bits = bits.bitwiseOR(F.when(set_low, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
        top = (1 << (bit + 32)) - ((1 << 64) if bit == 31 else 0)
        bits = bits.bitwiseOR(F.when(set_high, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def hexadecimal(h1: str, h2: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in (h1, h2)]))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits of two fingerprints."""
    differ = sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b))
    return F.lit(1.0) - differ / F.lit(float(BITS))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``h1, h2, g1, g2``: ordered pairs of different fingerprints within ``radius`` bits.

    ``prints`` holds distinct ``h1, h2``. Fingerprints within the radius agree in a block at
    least; a pair is taken from the first block in which it agrees. The distance is part of the
    join condition, so only pairs within the radius leave the join.
    """
    if not 1 <= radius < 16:
        raise ValueError(f"radius out of range: {radius}")
    per_half = -(-(radius + 1) // 2)
    cuts = [64 * k // per_half for k in range(per_half + 1)]

    def block(half: Column, k: int) -> Column:
        low, high = cuts[k], cuts[k + 1]
        return F.shiftrightunsigned(F.shiftleft(half, 64 - high), 64 - high + low)

    def keys(h1: Column, h2: Column) -> list[Column]:
        return [block(half, k) for half in (h1, h2) for k in range(per_half)]

    table = [
        F.struct(F.lit(number).alias("table"), key.alias("key"))
        for number, key in enumerate(keys(F.col("h1"), F.col("h2")))
    ]
    rows = prints.select("h1", "h2", F.explode(F.array(*table)).alias("at")).select("h1", "h2", "at.table", "at.key")
    left = rows.alias("l")
    right = rows.alias("r")
    distance = F.bit_count(F.col("l.h1").bitwiseXOR(F.col("r.h1"))) + F.bit_count(F.col("l.h2").bitwiseXOR(F.col("r.h2")))
    mine = keys(F.col("l.h1"), F.col("l.h2"))
    theirs = keys(F.col("r.h1"), F.col("r.h2"))
    earlier = F.lit(False)
    for number, (a, b) in enumerate(zip(mine, theirs)):
        earlier = earlier | ((F.col("l.table") > number) & (a == b))
    same = (F.col("l.table") == F.col("r.table")) & (F.col("l.key") == F.col("r.key"))
    pairs = left.join(right, same & (distance > 0) & (distance <= radius) & ~earlier)
    return pairs.select("l.h1", "l.h2", F.col("r.h1").alias("g1"), F.col("r.h2").alias("g2"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited text replaces the last half of the code points by as many from the start of the
    next document. ``n_near`` counts the other rows whose fingerprint lies within ``radius`` bits.
    """
    rows = next_documents(docs)
    chars = F.length("text").cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "key", "next_key", "text", chars.alias("n_chars"), edited.alias("edited"))
    # The digests and both texts travel once: the aggregation groups what one task already holds.
    both = F.array(
        F.struct(F.lit(False).alias("is_edited"), F.col("text")),
        F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")),
    )
    about = F.struct("doc_id", "n_chars", "next_key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    texts = rows.select("key", about.alias("about"), F.explode(both).alias("one"))
    texts = texts.select("key", "about", "one.is_edited", "one.text")
    votes = materialize(term_votes(texts, ["key", "about", "is_edited"]), "votes")
    own = votes.filter(~F.col("is_edited")).select("key", "about.*", "h1", "h2")
    after = votes.filter("is_edited").select("key", F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    following = own.select(F.col("key").alias("next_key"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    prints = materialize(own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")), "prints")
    pairs = near_fingerprints(prints.select("h1", "h2"), radius)
    counted = pairs.join(prints.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rows"), ["g1", "g2"])
    near = counted.groupBy("h1", "h2").agg(F.sum("rows").alias("others"))
    near = prints.join(near, ["h1", "h2"], "left").select(
        "h1", "h2", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")
    )
    found = own.join(after, "key").join(following, "next_key")
    # All copies of a text share a fingerprint, so they are spread; most others have no neighbour.
    found = salted_join(found, near.filter("n_near > 0"), ["h1", "h2"], ["key"])
    found = found.withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal("h1", "h2").alias("fingerprint"),
        hexadecimal("e1", "e2").alias("edited_fingerprint"),
        likeness(("h1", "h2"), ("e1", "e2")).alias("near_edited"),
        likeness(("h1", "h2"), ("n1", "n2")).alias("near_next"),
        "n_near",
    )
