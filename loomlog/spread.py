"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
SALTS = 16
WHOLE = -1  # salt of a key that is not cut into parts
HOT_ROWS = 1_000_000
ROW_BYTES = 32  # of a row in memory beside its values, at least


def fits_broadcast(rows: DataFrame) -> bool:
    """Whether Spark's size for ``rows`` is below the session's broadcast threshold.

    The size is that of the files for written tables; for computed rows it is an estimate
    from above, so those rarely qualify.
    """
    spark = rows.sparkSession
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    session = spark._jsparkSession.sessionState().conf()
    return int(str(size)) <= session.autoBroadcastJoinThreshold()


def fits_memory(rows: DataFrame) -> bool:
    """``fits_broadcast``, and the rows as they lie in memory are below the threshold as well.

    Files of repeating values take a few bytes a row, a broadcast row takes its full width in the
    driver. Only what passes the first test is counted.
    """
    if not fits_broadcast(rows):
        return False
    conf = rows.sparkSession._jsparkSession.sessionState().conf()
    width = int(rows._jdf.schema().defaultSize()) + ROW_BYTES
    return rows.count() * width <= conf.autoBroadcastJoinThreshold()


def salt_count(spark) -> int:
    """Parts of a key: more where the session deals rows to more partitions."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // SALTS)


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    salts: int | None = None,
    keep_salt: bool = False,
) -> DataFrame:
    """Join ``facts`` to one-row-per-key ``dim`` without piling a hot key into one task.

    A ``dim`` whose size Spark knows to be below the broadcast threshold is broadcast, and
    the facts stay where they are. Otherwise every key is cut into ``salts`` parts: fact rows
    are spread by a hash of ``spread`` and ``dim`` is repeated, so the hottest shuffle
    partition shrinks by that factor. With ``keep_salt`` the salt stays, and a following
    aggregation on ``keys + [SALT]`` reuses the join's partitioning.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps fact rows only: {how}")
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), list(keys), how)
    salts = salts or salt_count(dim.sparkSession)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = facts.withColumn(SALT, salt)
    right = dim.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, [*keys, SALT], how)
    return joined if keep_salt else joined.drop(SALT)


def hot_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    keep_salt: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``salted_join`` for a ``dim`` of very many keys: only keys that need it are cut into parts.

    Keys with more than ``hot_rows`` fact rows are counted out first, which reads the key columns
    alone; there are at most rows / ``hot_rows`` of them. All others have one part, so ``dim`` is
    shuffled once instead of once per salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"hot_join keeps fact rows only: {how}")
    if fits_memory(dim):
        return facts.join(F.broadcast(dim), list(keys), how)
    salts = salt_count(dim.sparkSession)
    hot = _hot_keys(facts, keys, hot_rows)
    left = _cut(facts, hot, keys, spread, salts)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    parts = F.when(F.col("_hot"), every).otherwise(F.array(F.lit(WHOLE)))
    right = dim.join(hot, list(keys), "left").withColumn(SALT, F.explode(parts)).drop("_hot")
    # What Spark takes for the size of ``dim`` may be that of its files, whatever it is in memory.
    joined = left.join(many(right), [*keys, SALT], how)
    return joined if keep_salt else joined.drop(SALT)


def _hot_keys(facts: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    counted = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return F.broadcast(counted.filter(F.col("_rows") > hot_rows).select(*keys, F.lit(True).alias("_hot")))


def _cut(rows: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str | Column], salts: int) -> DataFrame:
    """Adds the salt: a part's number for rows of a hot key, ``WHOLE`` for others."""
    cut = F.col("_hot").isNotNull()
    for key in keys:  # rows that match nothing need not lie together
        cut = cut | F.col(key).isNull()
    salt = F.when(cut, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(WHOLE)
    return rows.join(hot, list(keys), "left").withColumn(SALT, salt).drop("_hot")


def in_parts(
    rows: DataFrame, keys: Sequence[str], spread: Sequence[str], values: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``keys``, ``values`` and a salt, dealt by keys and salt: rows of a key that is not hot lie in one task."""
    cut = _cut(rows, _hot_keys(rows, keys, hot_rows), keys, spread, salt_count(rows.sparkSession))
    return cut.select(*keys, *values, SALT).repartition(*keys, SALT)


def many(rows: DataFrame) -> DataFrame:
    """Rows per stage, job or executor, to be joined by sorting: their files, by whose size Spark would
    broadcast them, are a small part of what they take in memory."""
    return rows.hint("merge")


def at_least_cores(rows: DataFrame) -> DataFrame:
    """Spreads rows over all cores where their files make fewer partitions than that.

    For inputs whose work per row is heavy; large inputs keep their partitions and no
    shuffle is added.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores)
