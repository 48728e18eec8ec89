"""Running totals over long ordered keys as a tree, so that no window holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_BITS = 12
TIME_BITS = 44  # milliseconds of five centuries


def carried(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    state: dict[str, str],
    bits: int = TIME_BITS,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """``rows`` with ``<name>_before``: each state over the key's rows at smaller ``at``.

    ``rows`` has one row per key and ``at``, a whole number. ``state`` names columns and how
    they combine: ``sum``, ``max``, ``last`` (the nearest value that is not NULL), or
    ``low:<sum>``, the least value of a column added to what the summed column had reached
    before its row. Sums before the first row are 0, the others NULL there.

    All these combine in any grouping, so rows are scanned inside ranges of ``2**fan_bits``
    places, ranges inside ranges of those, and so on until ``bits`` are used up: no window holds
    more rows than a range has places. Places beyond ``bits`` stay right; then only the topmost
    window, of one row per range of ranges, gets longer. Rows with a NULL key are dropped.
    """
    return _level(rows, list(keys), at, state, bits, fan_bits, 0)


def _level(
    rows: DataFrame, keys: list[str], at: str, state: dict[str, str], bits: int, fan_bits: int, depth: int
) -> DataFrame:
    if bits <= fan_bits:
        return _inside(rows, keys, at, state)
    up = f"_range{depth}"
    local = _inside(rows.withColumn(up, F.shiftright(at, fan_bits)), [*keys, up], at, state)
    totals = local.groupBy(*keys, up).agg(*(_total(name, kind, at) for name, kind in state.items()))
    carry = _level(totals, keys, up, state, bits - fan_bits, fan_bits, depth + 1).select(
        *keys, up, *(F.col(f"{name}_before").alias(f"_carry_{name}") for name in state)
    )
    joined = local.join(carry, [*keys, up])
    whole = {f"{name}_before": _combined(name, kind) for name, kind in state.items()}
    return joined.withColumns(whole).drop(up, *(f"_carry_{name}" for name in state))


def _inside(rows: DataFrame, keys: list[str], at: str, state: dict[str, str]) -> DataFrame:
    """The states before each row, over the rows of its window alone."""
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    plain = {
        "sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
        "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
    }
    found = rows.withColumns(
        {f"{name}_before": plain[kind](name) for name, kind in state.items() if kind in plain}
    )
    lows = {
        f"{name}_before": F.min(_reached(name, kind)).over(earlier)
        for name, kind in state.items()
        if kind not in plain
    }
    return found.withColumns(lows) if lows else found


def _reached(name: str, kind: str) -> Column:
    return F.col(f"{kind.removeprefix('low:')}_before") + F.col(name)


def _total(name: str, kind: str, at: str) -> Column:
    """A range's state as a whole."""
    if kind == "sum":
        total = F.sum(name)
    elif kind == "max":
        total = F.max(name)
    elif kind == "last":
        total = F.max_by(name, F.when(F.col(name).isNotNull(), F.col(at)))
    else:
        total = F.min(_reached(name, kind))
    return total.alias(name)


def _combined(name: str, kind: str) -> Column:
    """What came before the range, then what came before the row inside it."""
    carry, local = F.col(f"_carry_{name}"), F.col(f"{name}_before")
    if kind == "sum":
        return carry + local
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.least(carry, F.col(f"_carry_{kind.removeprefix('low:')}") + local)
