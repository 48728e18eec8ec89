"""Line source for plain, compressed and rolling text logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_STEP = 2**46  # seq distance between two files of one application
ROW_MASK = 2**33 - 1  # row-in-partition bits of monotonically_increasing_id


def strip_lines(lines: DataFrame) -> DataFrame:
    """Trim white space on both ends and drop blank lines."""
    trimmed = F.regexp_replace("line", r"^[ \t\r\n\u000B\f]+|[ \t\r\n\u000B\f]+$", "")
    return lines.withColumn("line", trimmed).filter(F.col("line") != "")


def app_of_path(path: Column) -> Column:
    """The application a log file belongs to: see ``text_lines``."""
    rolling = F.regexp_extract(path, r"/eventlog_v2_([^/]+)/[^/]+$", 1)
    plain = F.regexp_replace(
        F.regexp_extract(path, r"([^/]+)$", 1),
        r"\.(gz|zst|zstd|lz4|snappy|bz2|inprogress|txt|json)$",
        "",
    )
    return F.coalesce(F.nullif(rolling, F.lit("")), plain)


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``app_key, file_name, seq, line`` of event logs below ``paths``.

    The application is the file name without a compression or in-progress suffix, or the
    id in an ``eventlog_v2_<id>`` folder, whose ``events_<n>_<id>`` files follow each other
    by ``n``. Files stay splittable: ``seq`` is the split's byte offset plus the row number
    in the task. A row is at least one byte long and all splits of a file but its last
    fill a task of their own, so ``seq`` rises strictly along a file whatever the splits.
    """
    raw = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    path = F.col("_metadata.file_path")
    file_no = F.regexp_extract(path, r"/events_(\d+)_[^/]*$", 1).try_cast("bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))
    lines = raw.select(
        app_of_path(path).alias("app_key"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        (
            F.coalesce(file_no, F.lit(0)) * F.lit(FILE_STEP)
            + F.col("_metadata.file_block_start")
            + row
        ).alias("seq"),
        F.col("value").alias("line"),
    )
    return strip_lines(lines)
