"""Exact order statistics that never sort one group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import materialize
from loomlog.spread import SALT, WHOLE, in_parts

Pick = Callable[[Column], Column]

VALUE_BITS = 44
DIGIT_BITS = 13
WINDOW_ROWS = 2**DIGIT_BITS


def upper_median(n: Column) -> Column:
    """0-based index ``n // 2``."""
    return F.floor(n / F.lit(2)).cast("bigint")


def p95(n: Column) -> Column:
    """0-based index ``int(0.95 * n)``."""
    return F.floor(n.cast("double") * F.lit(0.95)).cast("bigint")


def value_bucket(value: Column, more_bits: int = 0) -> Column:
    """Order-preserving bucket: the length of the magnitude and its leading bits, six or more.

    With ``more_bits`` buckets are finer, and keep order only inside one of the coarse ones.
    """
    size = F.abs(value)
    shift = F.when(size < 64, F.lit(0)).otherwise(F.floor(F.log2(size)).cast("int") - 5)
    if more_bits:
        bucket = F.call_function("shiftright", size, F.greatest(shift - more_bits, F.lit(0)))
    else:
        bucket = shift * F.lit(64) + F.call_function("shiftright", size, shift)
    return (F.signum(value) * bucket).cast("bigint")


def rank_select(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Pick],
    bits: int = VALUE_BITS,
    hot_rows: int = WINDOW_ROWS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``keys`` plus, per pick, the value at its 0-based index in sorted order.

    Values are first counted per (keys, value). Rows of a key lie in one task, where a running sum finds
    the wanted values; only a key of more than ``hot_rows`` rows is cut into parts, and its counts go
    through ``_select_by_buckets``. Parts are dealt by a hash of ``spread``, or of all columns. Rows that
    ``hot_join`` has dealt, with its salt, stay where they are; its ``hot_rows`` bound the windows then.

    What is picked, and the counts of hot keys, is written, so that ``rows`` are read once, not once per use.
    NULL values come first; a pick that falls on one is NULL. Rows with NULL among their keys give none.
    """
    keys = list(keys)
    if SALT not in rows.columns:
        rows = in_parts(rows, keys, spread or rows.columns, [value], hot_rows)
    parts = [*keys, SALT]
    counts = rows.groupBy(*parts, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*parts)
    running = part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_n", F.sum("_c").over(part)).withColumn("_upto", F.sum("_c").over(running))
    wanted = F.lit(False)
    for pick in picks.values():
        wanted = wanted | _within(pick, F.col("_upto") - F.col("_c"), F.col("_upto"))
    wanted = (F.col(SALT) != WHOLE) | (wanted & F.col("_v").isNotNull())
    stored = materialize(ranked.filter(wanted), "value-counts")
    found = stored.filter(F.col(SALT) == WHOLE).groupBy(*keys).agg(*_picked(picks))
    hot = stored.filter(F.col(SALT) != WHOLE)
    if hot.isEmpty():
        return found
    counts = materialize(hot.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c")), "hot-value-counts")
    return found.unionByName(_select_by_buckets(counts, keys, picks, bits))


def _select_by_buckets(counts: DataFrame, keys: list[str], picks: dict[str, Pick], bits: int) -> DataFrame:
    """``rank_select`` of ``keys, _v, _c`` for keys of any length, none of which is sorted in one task.

    Counts are summed into at most a few thousand buckets per key; a running sum over the buckets
    finds the one that holds each wanted index. Only the values of such buckets go on, and each
    further round cuts a bucket by the next ``DIGIT_BITS`` bits, until the last ranks single
    values. For magnitudes below ``2**bits`` no window holds more than ``2**DIGIT_BITS`` rows
    or those few thousand; larger ones stay right, and only the last window gets longer.

    Every round reads its values twice, for the sums and for the cut, so the values of the first buckets
    are written as well.
    """
    whole_key = Window.partitionBy(*keys)
    path = [*keys, "_b0"]
    buckets = counts.withColumn("_b0", value_bucket(F.col("_v")))
    totals = buckets.groupBy(*path).agg(F.sum("_c").alias("_bc"))
    spans = totals.withColumn("_n", F.sum("_bc").over(whole_key)).withColumn("_start", F.lit(0).cast("bigint"))
    hits = _hits(spans, keys, "_b0", picks)
    held = materialize(buckets.join(hits, path), "held-values")
    for digit in range(1, max(0, -(-(bits - 6) // DIGIT_BITS))):
        name = f"_b{digit}"
        cut = held.withColumn(name, value_bucket(F.col("_v"), digit * DIGIT_BITS))
        totals = cut.groupBy(*path, name).agg(
            F.sum("_c").alias("_bc"), F.max("_n").alias("_n"), F.max("_start").alias("_start")
        )
        hits = _hits(totals, path, name, picks)
        path = [*path, name]
        held = cut.drop("_n", "_start").join(hits, path)
    in_bucket = Window.partitionBy(*path).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_upto", F.col("_start") + F.sum("_c").over(in_bucket))
    return ranked.groupBy(*keys).agg(*_picked(picks))


def _picked(picks: dict[str, Pick]) -> list[Column]:
    return [
        F.max(F.when(_within(pick, F.col("_upto") - F.col("_c"), F.col("_upto")), F.col("_v"))).alias(name)
        for name, pick in picks.items()
    ]


def _within(pick: Pick, start: Column, end: Column) -> Column:
    index = pick(F.col("_n"))
    return (index >= start) & (index < end)


def _hits(totals: DataFrame, group: list[str], bucket: str, picks: dict[str, Pick]) -> DataFrame:
    """The buckets of each group that hold a wanted index, with the count before them."""
    running = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    spans = totals.withColumn("_start", F.col("_start") + F.sum("_bc").over(running) - F.col("_bc"))
    inside = F.lit(False)
    for pick in picks.values():
        inside = inside | _within(pick, F.col("_start"), F.col("_start") + F.col("_bc"))
    return spans.filter(inside).select(*group, bucket, "_start", "_n")
