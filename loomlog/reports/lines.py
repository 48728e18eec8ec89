"""The human-readable report of each application, as a table of lines.

Lines carry a sort position ``(section, item, item_key, line_no)``; the table needs no
gathering and holds reports of any length. A line that lists the members of a group may be as long
as its application, so a line may come in several pieces. ``report_documents`` folds them into
texts in chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.scalars import (
    fixed,
    fmt_bytes,
    fmt_float,
    fmt_ms,
    fmt_thousands,
    short_name,
    stage_flags,
    whole_div,
)
from loomlog.operators.groups import (
    anomaly_summary,
    first_anomalies,
    group_stage_ids,
    repeated_groups,
    solo_stages,
    stage_groups,
)
from loomlog.operators.rollups import executor_outliers
from loomlog.operators.numbering import PART_ITEMS, list_parts, text_chunks

POSITION = ["section", "item", "item_key", "line_no", "piece"]
SHOWN_ANOMALIES = 10
COMPACT_CHARS = 5000
COMPACT_HEAD = 3000

# Headings, table heads, notes and marks of the report.
WARN = "⚠️"
DISK = "💾"
ANOMALY_HEADING = f"## {WARN} Anomaly Summary"
EFFICIENCY_HEAD = (
    "",
    "## Job-Level Efficiency",
    "| Metric | Value | Interpretation |",
    "|---|---|---|",
)
EXECUTOR_HEAD = (
    "",
    "## Executor-Level Metrics",
    "| Executor | Cores | Tasks | GC ms | GC% | CPU Efficiency |",
    "|---|---|---|---|---|---|",
)
OUTLIER_HEAD = ("", "**Outlier executors** (GC > 5% or CPU efficiency < 0.05):")
GROUP_HEAD = ("", "## Stage Groups (repeated operations)")
STAGE_HEAD = (
    "",
    "## Stage Breakdown",
    "| Stage | Name | Tasks | Duration | Input | Shuffle R | Shuffle W | SW Time | Fetch Wait "
    "| Spill Mem | Spill Disk | Peak Mem | Skew | CPU Eff | GC% | Deser ms |",
    "|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|---|",
)
PLAN_NOTICE = (
    "",
    "## SQL Physical Plan (Structured)",
    "(interactive rendering available in desktop UI)",
)
SPLIT_MARK = "\n\n...\n\n"
TRUNCATION_NOTE = "\n\n*(truncated — compact mode)*"


def _text(*parts: str | Column) -> Column:
    """Concatenation where plain strings are literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _lines(
    rows: DataFrame,
    section: int,
    texts: list[Column | str | None],
    item: Column | None = None,
    item_key: Column | None = None,
) -> DataFrame:
    """Explodes a list of texts per row into positioned lines; NULL texts are left out."""
    array = F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts))
    return _array_lines(rows, section, array, item, item_key)


def _array_lines(
    rows: DataFrame,
    section: int,
    array: Column,
    item: Column | None = None,
    item_key: Column | None = None,
) -> DataFrame:
    return rows.select(
        "app_key",
        F.lit(section).alias("section"),
        (F.lit(0) if item is None else item).cast("bigint").alias("item"),
        (F.lit("") if item_key is None else item_key).alias("item_key"),
        F.posexplode(array).alias("line_no", "text"),
        F.lit(0).cast("bigint").alias("piece"),
    ).filter(F.col("text").isNotNull())


def _pieces(rows: DataFrame, section: int, text: Column, item: Column, item_key: Column | None = None) -> DataFrame:
    """Line 0 of an item in pieces, one for each row, in the order of ``part``."""
    return rows.select(
        "app_key",
        F.lit(section).alias("section"),
        item.cast("bigint").alias("item"),
        (F.lit("") if item_key is None else item_key).alias("item_key"),
        F.lit(0).alias("line_no"),
        text.alias("text"),
        F.col("part").alias("piece"),
    )


def _heading(rows: DataFrame, section: int, texts: tuple[str, ...]) -> DataFrame:
    """A section heading for every application that has rows in it."""
    return _lines(rows.select("app_key").distinct(), section, list(texts), F.lit(-1))


def overview_lines(summary: DataFrame) -> DataFrame:
    def row(label: str, *value: str | Column) -> Column:
        return _text(f"| {label} | ", *value, " |")

    return _lines(
        summary,
        1,
        [
            _text("# Spark Log Report — ", F.col("app_name")),
            "",
            "## Application Overview",
            "| Field | Value |",
            "|---|---|",
            row("App ID", "`", F.col("app_id"), "`"),
            row("Spark Version", F.col("spark_version")),
            row("Total Duration", fmt_ms("total_duration_ms")),
            row("Stages", F.col("num_stages")),
            row("Tasks", F.col("num_tasks")),
            row("Executors", F.col("executor_count")),
            row(
                "Executor Memory",
                fmt_thousands("executor_memory_mb"),
                " MB on-heap + ",
                fmt_thousands("executor_overhead_mb"),
                " MB overhead",
            ),
            row("Executor Cores", F.col("executor_cores"), " vcores/executor"),
            row("SQL Executions", F.col("sql_execution_count")),
            row("Input", fmt_bytes("total_input_bytes")),
            row("Output", fmt_bytes("total_output_bytes")),
            row("Shuffle Read", fmt_bytes("total_shuffle_read_bytes")),
            row("Shuffle Write", fmt_bytes("total_shuffle_write_bytes")),
        ],
    )


def efficiency_lines(summary: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Applications without any task show zeros."""
    names = ("cpu_efficiency", "gc_overhead_pct", "deser_overhead_pct")
    rows = summary.select("app_key").join(efficiency, "app_key", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})
    return _lines(
        rows,
        2,
        [
            *EFFICIENCY_HEAD,
            _text(
                "| CPU Efficiency | ",
                fixed("cpu_efficiency", 3),
                " | ratio CPU time / wall-clock run time (1.0 = fully compute-bound) |",
            ),
            _text(
                "| GC Overhead | ",
                fixed("gc_overhead_pct", 2),
                "% | % of task wall-clock spent in GC (>5% is concerning) |",
            ),
            _text(
                "| Deserialize Overhead | ",
                fixed("deser_overhead_pct", 2),
                "% | % of task wall-clock spent deserializing inputs |",
            ),
        ],
    )


def executor_lines(executors: DataFrame) -> DataFrame:
    table = _lines(
        executors,
        3,
        [
            _text(
                "| ",
                F.col("executor_id"),
                " | ",
                F.col("cores"),
                " | ",
                F.col("tasks"),
                " | ",
                fmt_thousands("gc_ms"),
                " | ",
                fixed("gc_pct", 2),
                "% | ",
                fixed("cpu_efficiency", 3),
                " |",
            )
        ],
        item_key=F.col("executor_id"),
    )
    outliers = executor_outliers(executors)
    listed = _lines(
        outliers,
        4,
        [
            _text(
                "- Executor ",
                F.col("executor_id"),
                " (",
                F.col("host"),
                "): gc=",
                fixed("gc_pct", 2),
                "%, cpu_eff=",
                fixed("cpu_efficiency", 3),
            )
        ],
        item_key=F.col("executor_id"),
    )
    return (
        _heading(executors, 3, EXECUTOR_HEAD)
        .unionByName(table)
        .unionByName(_heading(outliers, 4, OUTLIER_HEAD))
        .unionByName(listed)
    )


def group_lines(stages: DataFrame, groups: DataFrame) -> DataFrame:
    """Tables of the groups with several stages, in order of their first stage."""
    keys = ["app_key", "group_name"]
    rows = repeated_groups(groups).join(
        first_anomalies(stages, SHOWN_ANOMALIES).drop("n_anomalies"), keys, "left"
    )
    n = F.col("n_stages")

    def share(name: str) -> Column:
        return whole_div(name, n)

    def row(label: str, name: str, fmt) -> Column:
        return _text(f"| {label} | ", fmt(F.col(name)), " | ", fmt(share(name)), " |")

    flag = F.when(F.col("n_anomalies") > 0, F.lit(f" {WARN}")).otherwise(F.lit(""))
    titled = repeated_groups(groups).join(group_stage_ids(stages), keys)
    opening = F.when(F.col("part") == 0, _text('### "', F.col("group_name"), '" ×', n, " stages (IDs: ")).otherwise(F.lit(","))
    closing = F.when(F.col("part") == whole_div(n - 1, F.lit(PART_ITEMS)), _text(")", flag)).otherwise(F.lit(""))
    ids = F.array_join(F.transform("stage_ids", lambda s: s.cast("string")), ",")
    title = _pieces(titled, 5, F.concat(opening, ids, closing), F.col("first_stage_id"), F.col("group_name"))
    texts = F.array(
        F.lit(None).cast("string"),
        F.lit("| Metric | Total | Per-Stage Avg |"),
        F.lit("|---|---|---|"),
        row("Tasks", "total_tasks", fmt_thousands),
        row("Duration", "total_duration_ms", fmt_ms),
        row("Input", "total_input_bytes", fmt_bytes),
        row("Shuffle Read", "total_shuffle_read_bytes", fmt_bytes),
        row("Shuffle Write", "total_shuffle_write_bytes", fmt_bytes),
        F.when(
            F.col("total_disk_spill_bytes") > 0,
            row("Disk Spill", "total_disk_spill_bytes", fmt_bytes),
        ),
        _text(
            "| Skew Ratio | min=",
            fmt_float("skew_ratio_min"),
            "× avg=",
            fmt_float("skew_ratio_avg"),
            "× max=",
            fmt_float("skew_ratio_max"),
            "× | — |",
        ),
        F.when(
            F.col("worst_gc_pct") > 5.0,
            _text("| Worst GC Overhead | ", fixed("worst_gc_pct", 2), "% | — |"),
        ),
    )
    listed = F.when(
        F.col("n_anomalies") > 0,
        F.concat(
            F.array(F.lit(""), _text("**Anomalies (", F.col("n_anomalies"), "):**")),
            F.transform(
                F.coalesce("anomalies", F.array(F.lit("…"))), lambda a: F.concat(F.lit("- "), a)
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))
    body = _array_lines(
        rows,
        5,
        F.concat(texts, listed, F.array(F.lit(""))),
        F.col("first_stage_id"),
        F.col("group_name"),
    )
    return _heading(rows, 5, GROUP_HEAD).unionByName(title).unionByName(body)


def stage_lines(stages: DataFrame) -> DataFrame:
    rows = solo_stages(stages)
    flags = stage_flags()

    def mark(flag: str, sign: str) -> Column:
        return F.when(flags[flag], F.lit(f" {sign}")).otherwise(F.lit(""))

    cells = [
        F.col("stage_id"),
        short_name("stage_name"),
        F.col("num_tasks"),
        fmt_ms("duration_ms"),
        fmt_bytes("input_bytes"),
        fmt_bytes("shuffle_read_bytes"),
        fmt_bytes("shuffle_write_bytes"),
        fmt_ms("sw_time_ms"),
        fmt_ms("fetch_wait_ms"),
        fmt_bytes("mem_spill_bytes"),
        F.concat(fmt_bytes("disk_spill_bytes"), mark("has_spill", DISK)),
        fmt_bytes("peak_mem_bytes"),
        F.concat(fmt_float("skew_ratio"), mark("has_skew", WARN)),
        fmt_float("cpu_efficiency"),
        fmt_float("gc_overhead_pct"),
        F.col("deser_ms"),
    ]
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", *(c.cast("string") for c in cells)), F.lit(" |")
    )
    body = _lines(rows, 6, [line], F.col("stage_id"))
    return _heading(rows, 6, STAGE_HEAD).unionByName(body)


def plan_lines(summary: DataFrame) -> DataFrame:
    return _lines(summary.filter(F.col("n_plans") > 0), 7, list(PLAN_NOTICE))


def anomaly_lines(stages: DataFrame) -> DataFrame:
    """One line per kind of anomaly, naming its stages."""
    hits = anomaly_summary(stages)
    who = F.concat(F.lit("Stage "), F.col("stage_id").cast("string"))
    label = (
        F.when(F.col("kind") == "skewed", _text(who, " (", fmt_float("skew_ratio"), "×)"))
        .when(F.col("kind") == "disk_spill", _text(who, " (", fmt_bytes("disk_spill_bytes"), ")"))
        .when(F.col("kind") == "low_cpu", _text(who, " (", fixed("cpu_efficiency", 3), ")"))
        .otherwise(who)
    )
    counts = hits.groupBy("app_key", "kind").agg(F.count(F.lit(1)).alias("n_hits"))
    lists = list_parts(hits, ["app_key", "kind"], ["stage_id"], label, "labels").join(counts, ["app_key", "kind"])
    # Line titles in order.
    titles = {
        "skewed": "Skewed stages",
        "disk_spill": "Disk spill",
        "heavy_shuffle": "Heavy shuffle",
        "low_cpu": "Low CPU efficiency",
    }
    order, title = F.lit(0), F.lit("")
    for number, (kind, words) in enumerate(titles.items(), start=1):
        order = F.when(F.col("kind") == kind, number).otherwise(order)
        title = F.when(F.col("kind") == kind, F.lit(words)).otherwise(title)
    opening = F.when(F.col("part") == 0, _text("- **", title, "** (", F.col("n_hits"), "): ")).otherwise(F.lit(", "))
    body = _pieces(lists, 8, F.concat(opening, F.array_join("labels", ", ")), order)
    return _heading(hits, 8, ("", ANOMALY_HEADING)).unionByName(body)


def report_lines(
    summary: DataFrame, efficiency: DataFrame, executors: DataFrame, stages: DataFrame
) -> DataFrame:
    """All lines of all reports; ``stages`` are the rounded stage metrics."""
    sections = [
        overview_lines(summary),
        efficiency_lines(summary, efficiency),
        executor_lines(executors),
        group_lines(stages, stage_groups(stages)),
        stage_lines(stages),
        plan_lines(summary),
        anomaly_lines(stages),
    ]
    return reduce(DataFrame.unionByName, sections)


def report_documents(lines: DataFrame, size: int = PART_ITEMS) -> DataFrame:
    """``app_key, chunk_no, n_pieces, text``: a report is its chunks' texts, one after the other."""
    first = F.col("section").eqNullSafe(F.lit(1)) & (F.col("item") == 0) & (F.col("line_no") == 0)
    broken = F.when((F.col("piece") > 0) | first, F.col("text")).otherwise(F.concat(F.lit("\n"), F.col("text")))
    return text_chunks(lines.withColumn("text", broken), ["app_key"], POSITION, size)


def compact_report(text: Column) -> Column:
    """Short reports as they are; long ones as head and anomaly section, or cut with a note."""
    at = F.instr(text, ANOMALY_HEADING)
    with_anomalies = F.concat(
        F.substring(text, 1, COMPACT_HEAD), F.lit(SPLIT_MARK), F.substring(text, at, F.length(text))
    )
    cut = F.concat(F.substring(text, 1, COMPACT_CHARS), F.lit(TRUNCATION_NOTE))
    return (
        F.when(F.length(text) <= COMPACT_CHARS, text).when(at > 1, with_anomalies).otherwise(cut)
    )


def reduction_size(archives: DataFrame, documents: DataFrame) -> DataFrame:
    """Bytes a report saves against its log.

    ``archives`` holds ``app_key, archive_bytes``, ``documents`` the chunks ``app_key, text`` of each report.
    """
    sizes = documents.groupBy("app_key").agg(F.sum(F.octet_length("text")).alias("report_bytes"))
    return archives.join(sizes, "app_key").select(
        "app_key",
        "archive_bytes",
        "report_bytes",
        F.greatest(F.lit(0), F.col("archive_bytes") - F.col("report_bytes")).alias("saved_bytes"),
    )
