"""``spark.read.format("loomlog_zip")``: a data source over folders of ZIP archives.

    register(spark)
    rows = spark.read.format("loomlog_zip").load("/logs/2024")

gives the rows of ``archives.archive_rows``. Partitions are planned by size: small archives share one
until it holds ``SPLIT_BYTES``, and an archive larger than that is cut by its central directory
into stretches of members of about so many packed bytes. So one huge archive does not become one task.
As with Spark's own file sources the listing is made where the query is planned; for very many
folders ``archives.archive_members`` lists in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomlog.sources import archives

SPLIT_BYTES = 64 << 20

#: Archive, key, length, why it cannot be listed, first member and the one after the last.
Stretch = tuple[str, str, int | None, str | None, int, int | None]


class ZipLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomlog_zip"

    def schema(self) -> str:
        return archives.ROW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


class ZipReader(DataSourceReader):
    def __init__(self, root: str, split_bytes: int) -> None:
        self._root, self._split = root.rstrip("/") or "/", split_bytes

    def partitions(self) -> list[InputPartition]:
        plans: list[list[Stretch]] = []
        shared: list[Stretch] = []
        held = 0
        for path, length, kind, error in sorted(archives.list_path(self._root, True), key=lambda entry: entry[0]):
            if kind == "folder":
                continue
            key = archives._key(self._root, path, False)
            if length is not None and length > self._split:
                plans += [[(path, key, length, error, a, b)] for a, b in self._stretches(path)]
                continue
            shared.append((path, key, length, error, 0, None))
            held += length or 0
            if held >= self._split:
                plans.append(shared)
                shared, held = [], 0
        plans += [shared] if shared else []
        return [InputPartition(plan) for plan in plans] or [InputPartition([])]

    def _stretches(self, path: str) -> list[tuple[int, int | None]]:
        members = archives.read_directory(path)[1]
        found, first, held = [], 0, 0
        for member in members:
            held += member.packed_bytes
            if held >= self._split:
                found.append((first, member.number + 1))
                first, held = member.number + 1, 0
        return found + [(first, None)] if first < len(members) or not found else found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, key, length, error, first, after in partition.value:
            magic, members, failed = ("", [], error) if error else archives.read_directory(path)
            reason = archives.refusal(length, magic, members, failed)
            if reason is None:
                yield from archives.member_rows(path, key, members[first:after])
            elif first == 0:
                empty = [pa.array([None], kind) for kind in (pa.string(), pa.int64(), pa.int64(), pa.string())]
                columns = [pa.array([key]), *empty, pa.array([path]), pa.array([reason])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in archives.ROW_SCHEMA.split(", ")])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipLogs)
