"""Locates quoted code snippets in the source files of an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.scalars import bound
from loomlog.spread import at_least_cores, salted_join

LEAST = 15  # shortest line that counts as a partial match
PREFIX = 50


def _unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _line_at(text: Column, position: Column) -> Column:
    """Line number of a 1-based character position."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def _matches(report_sources: DataFrame) -> DataFrame:
    """Best match of each finding in each of its report's files: ``tier, from, to``."""
    src, snippet = F.col("_src"), F.col("_snippet")
    lines, wanted = F.col("_lines"), F.col("_wanted")
    first = F.get(wanted, F.lit(0))
    n_lines, n_wanted = F.size(lines), F.size(wanted)
    places = F.sequence(F.lit(0), n_lines - 1)

    def earliest(test) -> Column:
        return F.get(F.filter(places, test), F.lit(0))

    exact = F.instr(src, snippet)
    exact_line = _line_at(src, exact)
    n_breaks = F.length(snippet) - F.length(F.replace(snippet, F.lit("\n")))
    has_lines = n_wanted > 0
    block = earliest(
        lambda i: (F.get(lines, i) == first) & (F.slice(lines, i + 1, n_wanted) == wanted)
    )
    second = F.get(wanted, F.lit(1))
    near = earliest(
        lambda i: (F.get(lines, i) == first)
        & ((n_wanted == 1) | F.array_contains(F.slice(lines, i + 2, n_wanted + 2), second))
    )
    part = earliest(
        lambda i: (F.length(F.get(lines, i)) >= LEAST)
        & F.exists(
            wanted,
            lambda t: (F.length(t) >= LEAST)
            & (
                F.contains(t, F.get(lines, i))
                | F.contains(F.get(lines, i), F.substring(t, 1, PREFIX))
            ),
        )
    )

    def found(tier: int, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(tier).alias("tier"), start.cast("int").alias("a"), end.cast("int").alias("b")
        )

    def lines_from(tier: int, place: Column) -> Column:
        hit = bound(place, lambda i: F.when(i.isNotNull(), found(tier, i + 1, i + n_wanted)))
        return F.when(has_lines, hit)

    whole = F.when(exact > 0, found(1, exact_line, exact_line + n_breaks))
    in_text = F.coalesce(
        whole, lines_from(2, block), lines_from(3, near), lines_from(4, part)
    )
    in_text = F.when(snippet != "", in_text)
    header = F.concat(
        F.lit(r"(?md)^\s*(?:async\s+def|def)\s+\Q"), F.col("function_name"), F.lit(r"\E\s*\(")
    )
    at = F.regexp_instr("text", header)
    named = F.when(
        (F.col("function_name") != "") & (at > 0),
        found(9, _line_at(F.col("text"), at), _line_at(F.col("text"), at)),
    )
    return report_sources.withColumn("_hit", F.coalesce(in_text, named)).filter(
        F.col("_hit").isNotNull()
    )


def locate_snippets(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """``app_key, finding_no, line_start, line_end`` of every finding, NULL where not found.

    ``reports`` holds one row per application with ``job_file`` and its ``findings``, an
    array of (finding_no, snippet, function_name) as long as the report document; ``sources``
    holds (app_key, file_name, file_ord, text). Files are tried in order, the preferred one
    first, for the snippet, and only then for the function header. Each file row meets its
    report's findings inside the row, and only matches leave it.
    """
    matched = salted_join(at_least_cores(sources), reports, ["app_key"], ["file_name", "file_ord"], "inner")
    files = matched.withColumn("_src", _unix(F.col("text"))).withColumn(
        "_lines", F.transform(F.split("_src", "\n", -1), _strip)
    )
    findings = files.select(
        "*", F.inline("findings")
    ).withColumn(
        "_snippet",
        F.regexp_replace(_unix(F.coalesce("snippet", F.lit(""))), r"^\n+|\n+\z", ""),
    )
    wanted = F.filter(F.transform(F.split("_snippet", "\n", -1), _strip), lambda t: t != "")
    hits = _matches(findings.withColumn("_wanted", wanted))
    place = F.when(F.col("file_name") == F.col("job_file"), -1).otherwise(F.col("file_ord"))
    in_text = F.when(F.col("_hit.tier") == 9, 1).otherwise(0)
    best = hits.groupBy("app_key", "finding_no").agg(
        F.min_by("_hit", F.struct(in_text.alias("x"), place.alias("y"))).alias("h")
    )
    every = reports.select("app_key", F.inline("findings"))
    return every.join(best, ["app_key", "finding_no"], "left").select(
        "app_key",
        "finding_no",
        F.col("h.a").alias("line_start"),
        F.col("h.b").alias("line_end"),
    )
