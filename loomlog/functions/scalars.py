"""Scalar column functions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def whole(value: str | Column) -> Column:
    """Integer or integer text as BIGINT; missing or anything else is 0."""
    return F.coalesce(_c(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def safe_pct(numerator: str | Column, denominator: str | Column) -> Column:
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, n * F.lit(100.0) / d.cast("double")).otherwise(F.lit(0.0))


def scaled(value: str | Column, factor: int = 1000) -> Column:
    """A double as a scaled integer, for exact comparison between engines."""
    return F.floor(_c(value) * F.lit(float(factor)) + F.lit(0.5)).cast("bigint")


def bound(value: str | Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` as a variable.

    Keeps formulas that mention their input many times from multiplying the plan.
    """
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def half_even(value: str | Column, digits: int = 3) -> Column:
    """Round the exact binary value of a double, ties to even, at any magnitude.

    ``round`` and ``bround`` work on the shortest decimal text (2.675 -> 2.68). Here the whole
    part is taken off first. The fraction is split into a part with 20 bits and a small rest;
    both products with the power of ten and the comparison with one half are then exact. Where
    neighbouring doubles lie further apart than the last digit, a value is its own rounding.
    """
    power = F.lit(float(10**digits))
    grid = F.lit(float(2**20))

    def nearest(x: Column) -> Column:
        units = F.floor(x).cast("double")
        fraction = x - units
        coarse = F.floor(fraction * grid).cast("double") / grid
        product = coarse * power
        base = F.floor(product).cast("double")
        above = (product - base - F.lit(0.5)) + (fraction - coarse) * power
        below = units * power + base
        up = (above > 0) | ((above == 0) & (F.pmod(below, F.lit(2.0)) != 0))
        rounded = F.when(up, below + 1).otherwise(below) / power
        return F.when(F.abs(x) < F.lit(2.0 ** math.ceil(52 - digits * math.log2(10))), rounded).otherwise(x)

    return bound(_c(value).cast("double"), nearest)


def whole_div(a: str | Column, b: str | Column) -> Column:
    """Division of integers without a detour over doubles; NULL for a divisor of 0."""
    return F.call_function("div", _c(a), F.nullif(_c(b), F.lit(0)))


def fixed(value: str | Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded as ``half_even`` does."""
    return F.format_string(f"%.{digits}f", half_even(value, digits))


def ns_to_ms(value: str | Column) -> Column:
    """Floor of nanoseconds in milliseconds, taken per task before summing."""
    return whole_div(value, F.lit(1_000_000))


def task_duration(finish: str | Column = "finish_ms", launch: str | Column = "launch_ms") -> Column:
    return _c(finish) - _c(launch)


def shuffle_read_bytes(
    total: str | Column = "sr_total_bytes",
    remote: str | Column = "sr_remote_bytes",
    local: str | Column = "sr_local_bytes",
) -> Column:
    """Total bytes read; remote + local where the total is missing or 0."""
    return F.coalesce(F.nullif(_c(total), F.lit(0)), _c(remote) + _c(local), F.lit(0))


def resource_amount(value: str | Column) -> Column:
    return whole(value)


def spark_version(app_start: str | Column, prop: str | Column) -> Column:
    return F.coalesce(_c(app_start), _c(prop), F.lit("unknown"))


def stage_name(name: str | Column, stage_id: str | Column = "stage_id") -> Column:
    return F.coalesce(_c(name), F.concat(F.lit("Stage "), _c(stage_id).cast("string")))


def host_of_task(task_host: str | Column, executor_host: str | Column) -> Column:
    return F.coalesce(
        F.nullif(_c(task_host), F.lit("")), F.nullif(_c(executor_host), F.lit("")), F.lit("unknown")
    )


def group_name(name: str | Column) -> Column:
    """Stage name without its trailing source reference and parenthesised number."""
    # The two suffix patterns.
    without_source = F.regexp_replace(_c(name), r"\s+at\s+\S+$", "")
    without_number = F.regexp_replace(without_source, r"\s*\(\d+\)\s*$", "")
    return F.regexp_replace(without_number, r"^\s+|\s+$", "")


def short_name(name: str | Column, width: int = 35) -> Column:
    return F.substring(_c(name), 1, width)


def fmt_bytes(value: str | Column) -> Column:
    """Bytes with one decimal in the largest unit below 1024, up to PB."""

    def text(v: Column) -> Column:
        size, unit = v / F.lit(float(1024**5)), F.lit(" PB")
        for step, name in reversed(list(enumerate((" B", " KB", " MB", " GB", " TB")))):
            fits = v < F.lit(float(1024 ** (step + 1)))
            size = F.when(fits, v / F.lit(float(1024**step))).otherwise(size)
            unit = F.when(fits, F.lit(name)).otherwise(unit)
        return F.concat(fixed(size, 1), unit)

    return bound(_c(value).cast("double"), text)


def fmt_ms(value: str | Column) -> Column:
    def text(v: Column) -> Column:
        return (
            F.when(v < 1000, F.format_string("%d ms", v))
            .when(v < 60_000, F.concat(fixed(v / F.lit(1000.0), 1), F.lit(" s")))
            .otherwise(F.concat(fixed(v / F.lit(60000.0), 1), F.lit(" min")))
        )

    return bound(value, text)


def fmt_thousands(value: str | Column) -> Column:
    return F.format_string("%,d", _c(value))


def fmt_float(value: str | Column) -> Column:
    """A rounded double the way a report prints it: at least one decimal, no padding."""
    trimmed = F.regexp_replace(F.format_string("%.3f", _c(value)), r"0{1,2}$", "")
    return F.regexp_replace(trimmed, r"\.$", ".0")


def stage_flags() -> dict[str, Column]:
    """Boolean stage flags with the thresholds of the report."""
    return {
        "has_skew": F.coalesce(F.col("skew_ratio"), F.lit(0.0)) > 3.0,
        "has_spill": F.col("disk_spill_bytes") > 0,
        "has_heavy_shuffle": (F.col("shuffle_read_bytes") + F.col("shuffle_write_bytes"))
        > 524_288_000,
        "has_low_cpu": (F.col("cpu_efficiency") < 0.1) & (F.col("num_tasks") >= 10),
    }


def anomaly_texts() -> Column:
    """Messages of one stage row in fixed order: skew, spill, gc, low cpu."""
    flags = stage_flags()
    where = F.concat(F.lit(" in stage "), F.col("stage_id").cast("string"))
    spilled_mb = fixed(F.col("disk_spill_bytes") / F.lit(1048576.0), 0)
    messages = F.array(
        F.when(
            flags["has_skew"],
            F.concat(F.lit("skew="), fixed("skew_ratio", 1), F.lit("x"), where),
        ),
        F.when(flags["has_spill"], F.concat(F.lit("disk_spill="), spilled_mb, F.lit("MB"), where)),
        F.when(
            F.col("gc_overhead_pct") > 5.0,
            F.concat(F.lit("gc="), fixed("gc_overhead_pct", 1), F.lit("%"), where),
        ),
        F.when(
            flags["has_low_cpu"], F.concat(F.lit("low_cpu="), fixed("cpu_efficiency", 3), where)
        ),
    )
    return F.filter(messages, lambda m: m.isNotNull())


# Attention and critical thresholds of each measure.
SEVERITY = {
    "skew": (2.0, 5.0),
    "gc_pressure": (5.0, 15.0),
    "shuffle_bound": (10.0, 25.0),
    "spill": (0.0, 1.0),
    "low_utilization": (30.0, 70.0),
    "driver_overhead": (20.0, 40.0),
}


def severity(kind: str, metric: str | Column) -> Column:
    """``critical``, ``attention`` or NULL for a metric value."""
    attention, critical = SEVERITY[kind]
    m = _c(metric)
    return F.when(m > critical, F.lit("critical")).when(m > attention, F.lit("attention"))
