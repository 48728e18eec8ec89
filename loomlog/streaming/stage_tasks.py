"""Stage rollup over a growing log folder: the batch functions on a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.operators.rollups import stage_tasks_all
from loomlog.sources.events import parse_events, task_facts
from loomlog.sources.lines import app_of_path, strip_lines


def stream_stage_tasks(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Running ``stage_tasks_all``; write it in ``complete`` or ``update`` mode."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    lines = raw.select(
        app_of_path(F.col("_metadata.file_path")).alias("app_key"),
        F.lit(0).cast("bigint").alias("seq"),
        F.col("value").alias("line"),
    )
    return rollup_lines(strip_lines(lines))


def rollup_lines(lines: DataFrame) -> DataFrame:
    """``stage_tasks_all`` of a stream of ``app_key, seq, line``.

    All its aggregates combine in any order, so no line position is needed and files may
    arrive in any sequence. The state holds one row per stage.
    """
    return stage_tasks_all(task_facts(parse_events(lines)))


class Snapshots:
    """The complete result after each batch, as Parquet in a folder of the batch's number.

    A batch that is run again after a failure replaces its own folder, so a restart from the
    checkpoint counts nothing twice.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.latest: int | None = None

    def start(self, rows: DataFrame) -> StreamingQuery:
        """A run over what the source holds now, continued from the checkpoint if there is one."""
        writer = rows.writeStream.outputMode("complete").foreachBatch(self._write)
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(availableNow=True).start()

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        self.latest = batch

    def read(self, spark: SparkSession) -> DataFrame:
        if self.latest is None:
            raise ValueError("no batch has been written")
        return spark.read.parquet(f"{self.folder}/batch-{self.latest}")
