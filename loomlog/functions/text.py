"""Text operators on whole documents; each document is one row and never leaves its task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line boundaries of a text, beyond the plain newline.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
HEAD_LINES = 500


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def all_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def collapse_runs(rows: DataFrame, text: str, out: str, keep: int = 2) -> DataFrame:
    """Adds ``out``: ``text`` with runs of more than ``keep`` equal lines cut to ``keep`` and a marker.

    Works on the array of run starts: the length of a run is the distance to the next start.
    Lines and starts are columns of their own, so each is computed once per document.
    """
    lines, starts = F.col("_lines"), F.col("_starts")

    def run(start: Column, number: Column) -> Column:
        length = F.coalesce(F.get(starts, number + 1), F.size(lines)) - start
        line = F.get(lines, start)
        # The marker text.
        marker = F.concat(
            F.lit("[... repeated line omitted "),
            (length - keep).cast("string"),
            F.lit(" times ...]"),
        )
        return F.when(length <= keep, F.array_repeat(line, length)).otherwise(
            F.concat(F.array_repeat(line, keep), F.array(marker))
        )

    places = F.sequence(F.lit(0), F.size(lines) - 1)
    joined = F.array_join(F.flatten(F.transform(starts, run)), "\n")
    return (
        rows.withColumn("_lines", all_lines(F.col(text)))
        .withColumn(
            "_starts",
            F.filter(places, lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1))),
        )
        .withColumn(out, F.when(F.col(text) == "", F.col(text)).otherwise(joined))
        .drop("_lines", "_starts")
    )


def head_lines(text: str | Column, limit: int = HEAD_LINES) -> Column:
    """The first ``limit`` lines with a closing note; shorter texts as they are."""
    body = _c(text)
    lines = F.split(body, "\n", -1)
    total = F.size(lines)
    # The closing note.
    note = F.concat(
        F.lit(f"\n# ... (truncated, showing first {limit} of "),
        total.cast("string"),
        F.lit(" lines)"),
    )
    shown = F.concat(F.array_join(F.slice(lines, 1, limit), "\n"), note)
    return F.when(total > limit, shown).otherwise(body)


def source_lines(sources: DataFrame) -> DataFrame:
    """``source_line`` rows: one per line of each source file, numbered from 1."""
    return sources.select(
        "app_key", "file_name", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).select("app_key", "file_name", (F.col("pos") + 1).alias("line_no"), "line")
