"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the characters of the output, and so a mean repetition rate:
share times total over what the source has. A document's number of copies inverts the Poisson
distribution of that mean at a point that a hash of seed and ``doc_id`` chooses, so a document
gets the same number wherever and however often it is computed, and no task needs another one's
state. The copies are shuffled globally: dealt and sorted by a hash of seed, document and copy.

Defined cases: a null source is a source of its own; a source whose texts are all null or empty
has no characters to repeat and keeps each row once; a null ``doc_id`` is hashed by its text;
repeated rows get equal counts; an empty table gives no rows. Other columns are carried along;
the added ones take names that the input does not have.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import materialize
from loomlog.spread import salted_join

TEMPERATURE = 0.5
SEED = "mix-1"
HASH_DIGITS = 13  # of hexadecimal: 52 bits, exact in a double


def uniform(text: Column) -> Column:
    """A number in [0, 1) from a hash of ``text``."""
    digits = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")
    return digits / F.lit(float(16**HASH_DIGITS))


@functools.lru_cache(maxsize=4096)
def poisson_window(mean: float) -> tuple[int, np.ndarray]:
    """First count and cumulative probabilities of the counts that carry the distribution.

    The window reaches twelve deviations to both sides; what lies outside is below 1e-30.
    """
    reach = 12 * math.sqrt(mean) + 40
    first = max(0, math.floor(mean - reach))
    counts = np.arange(first, math.ceil(mean + reach) + 1, dtype=np.float64)
    start = first * math.log(mean) - mean - math.lgamma(first + 1)
    logs = start + np.concatenate(([0.0], np.cumsum(math.log(mean) - np.log(counts[1:]))))
    return first, np.cumsum(np.exp(logs))


def poisson_counts(means: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The smallest count whose cumulative probability exceeds each point."""
    counts = np.zeros(len(means), dtype=np.int64)
    for mean in np.unique(means):
        if mean > 0:
            rows = means == mean
            first, cumulative = poisson_window(float(mean))
            counts[rows] = first + np.searchsorted(cumulative, points[rows], side="right")
    return counts


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``_source, _rate``: the mean number of copies of each source's documents.

    ``weights`` names the target weight of each source; sources that it does not name get none.
    Without weights the target of a source is its number of characters to the power
    ``temperature``, which lifts small sources. The output is about as long as the input.
    """
    chars = F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("_chars")
    found = docs.groupBy(_source().alias("_source")).agg(chars)
    if weights is None:
        weight = F.pow(F.col("_chars").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("_source") == f"s{source}", float(value)).otherwise(weight)
    found = materialize(found.withColumn("_weight", F.when(F.col("_chars") > 0, weight).otherwise(0.0)), "mix")
    whole = found.agg(F.sum("_weight").alias("_weights"), F.sum("_chars").alias("_all"))
    rate = F.col("_weight") / F.col("_weights") * F.col("_all") / F.col("_chars")
    rate = F.when(F.col("_weights") > 0, F.when(F.col("_chars") > 0, rate).otherwise(1.0)).otherwise(1.0)
    return materialize(found.join(F.broadcast(whole)).select("_source", rate.alias("_rate")), "mix-rates")


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {other.lower() for other in taken}:
        name = f"_{name}"
    return name


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: str = SEED,
    copy: str = "copy",
    copies: str = "n_copies",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in random order, with the number of the copy."""
    taken = docs.columns
    copy, copies = free_name(copy, taken), free_name(copies, taken)
    names = {n: free_name(n, taken) for n in ("_source", "_rate", "_row")}

    @F.pandas_udf("long")
    def counts(means: pd.Series, points: pd.Series) -> pd.Series:
        return pd.Series(poisson_counts(means.to_numpy(), points.to_numpy()))

    row = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    means = rates(docs, weights).withColumnsRenamed(names)
    rows = docs.withColumn(names["_source"], _source()).withColumn(names["_row"], row)
    rows = salted_join(rows, means, [names["_source"]], [names["_row"]])
    point = uniform(F.concat(F.lit(f"{seed}:"), F.col(names["_row"])))
    rows = rows.withColumn(copies, counts(F.col(names["_rate"]), point)).filter(F.col(copies) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    order = F.md5(F.concat(F.lit(f"{seed}:shuffle:"), F.col(names["_row"]), F.lit(":"), F.col(copy).cast("string")))
    rows = rows.drop(names["_source"], names["_rate"]).withColumn(names["_row"], order)
    rows = rows.repartition(names["_row"]).sortWithinPartitions(names["_row"])
    return rows.select(*taken, copy, copies)
