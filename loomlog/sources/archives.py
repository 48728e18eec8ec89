"""Archive source: ZIP files of text logs, one archive per application.

Only file listing and the ZIP codec run in Python. Archives are listed by name and size
(Spark's file sources would skip empty ones), folder by folder in tasks; their directories become a
member table, and each member is then streamed by its own task in batches of bounded bytes, so neither
an archive nor a member has to fit in memory or in one cell.

Nothing that is wrong with one file ends the job: a folder or an archive that cannot be read, a
directory that is damaged, and a member that is encrypted, packed by an unknown method or does not
inflate to its checksum become rows with a reason. Lines of a member before its damage are kept.

``app_key`` is the archive's path below its root without the suffix, or its whole path if several roots
are given, so archives of one name in two folders stay two applications.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import materialize

# Archive limits.
MAX_FILES = 1000
MAX_RATIO = 100
MAX_ZIP_MB = 500
MAX_UNCOMPRESSED_MB = 1000

MEMBER_SCHEMA = (
    "archive string, app_key string, archive_bytes bigint, magic string, member_no bigint, member string, "
    "file_bytes bigint, packed_bytes bigint, error string"
)
FILE_SCHEMA = "root string, path string, length bigint, kind string, error string"
LINE_SCHEMA = "app_key string, file_name string, file_seq bigint, line_no bigint, line string"
ROW_SCHEMA = f"{LINE_SCHEMA}, archive string, reason string"
BATCH_BYTES = 4 << 20
MEMBER_STEP = 2**40  # seq distance between two members of one archive
METHODS = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
#: What file systems and the codec raise for a file that is absent, damaged or not understood.
READ_ERRORS = (OSError, ValueError, NotImplementedError, RuntimeError, EOFError, zipfile.BadZipFile, zlib.error)


class Member(NamedTuple):
    """One entry of an archive's directory; ``error`` where it cannot be read."""

    number: int
    name: str
    file_bytes: int
    packed_bytes: int
    error: str | None


def _locate(path: str):
    """File system and inner path of a path or URI; plain paths are shared mounts."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    filesystem, inner = _locate(path)
    return filesystem.open_input_file(inner)


def list_path(path: str, recursive: bool) -> list[tuple[str, int | None, str, str | None]]:
    """``path, length, kind, error`` of what lies below a folder, or of a file itself.

    ``kind`` is ``file``, ``folder`` or ``error``.
    """
    from pyarrow import fs

    try:
        filesystem, inner = _locate(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        own = filesystem.get_file_info(inner)
        if own.type == fs.FileType.File:
            return [(path, own.size, "file", None)]
        found = filesystem.get_file_info(fs.FileSelector(inner, recursive=recursive))
    except READ_ERRORS as error:
        return [(path, None, "error", _said(error))]
    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
    return [(prefix + f.path, f.size, kinds[f.type], None) for f in found if f.type in kinds]


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def read_directory(path: str) -> tuple[str, list[Member], str | None]:
    """The first two characters of an archive, its members, and why it cannot be read."""
    try:
        with _open(path) as handle:
            magic = handle.read(2).decode("latin-1")
            if magic != "PK":
                return magic, [], None
            handle.seek(0)
            with zipfile.ZipFile(handle) as archive:
                files = [i for i in archive.infolist() if not i.filename.endswith("/")]
    except (zipfile.BadZipFile, ValueError):
        return "??", [], None
    except READ_ERRORS as error:
        return "", [], _said(error)

    def problem(info: zipfile.ZipInfo) -> str | None:
        if info.flag_bits & 1:
            return "encrypted"
        return None if info.compress_type in METHODS else "unknown_method"

    return magic, [Member(k, i.filename, i.file_size, i.compress_size, problem(i)) for k, i in enumerate(files)], None


def _list_roots(recursive: bool):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == "folder":
                    listed = [(row.root, *entry) for entry in list_path(row.path, recursive)]
                    listed = [entry for entry in listed if not recursive or entry[3] != "folder"]
                    yield pd.DataFrame(listed, columns=names)
                else:
                    yield pd.DataFrame([tuple(row)], columns=names)

    return found


def _key(root: str, path: str, several: bool) -> str:
    if several or not path.startswith(root):
        below = path
    else:
        below = path.rsplit("/", 1)[-1] if path == root else path[len(root) :].lstrip("/")
    return re.sub(r"\.zip$", "", below, flags=re.I)


def archive_members(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per archive member; an archive without members keeps one row of NULLs.

    Roots are listed first, then each of their folders by a task of its own.
    """
    folders = [path] if isinstance(path, str) else list(path)
    several = len(folders) > 1
    rows = [(folder.rstrip("/") or "/", folder, None, "folder", None) for folder in folders]
    tasks = 3 * spark.sparkContext.defaultParallelism
    roots = spark.createDataFrame(rows, FILE_SCHEMA).repartition(len(folders), "path")
    first = roots.mapInPandas(_list_roots(False), FILE_SCHEMA)
    listed = first.repartition(tasks, "path").mapInPandas(_list_roots(True), FILE_SCHEMA)

    def directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]
        for batch in batches:
            for file in batch.itertuples(index=False):
                length = None if pd.isna(file.length) else int(file.length)
                head = (file.path, _key(file.root, file.path, several), length)
                magic, members, error = ("", [], file.error) if file.kind == "error" else read_directory(file.path)
                table = [(*head, magic, *member) for member in members] or [(*head, magic, None, None, None, None, error)]
                yield pd.DataFrame(table, columns=names).astype(
                    {c: "Int64" for c in ("archive_bytes", "member_no", "file_bytes", "packed_bytes")}
                )

    return listed.repartition(tasks, "path").mapInPandas(directories, MEMBER_SCHEMA)


def refusal(length: int | None, magic: str, members: Sequence[Member], error: str | None) -> str | None:
    """The audit's verdict for one archive, as ``archive_audit`` gives it."""
    if error is not None:
        return "unreadable"
    if length == 0:
        return "empty"
    if magic != "PK":
        return "bad_magic"
    if len(members) > MAX_FILES:
        return "too_many_files"
    thick = any(m.packed_bytes > 0 and m.file_bytes > MAX_RATIO * m.packed_bytes for m in members)
    return "compression_ratio" if thick else None


def archive_audit(members: DataFrame) -> DataFrame:
    """Guard verdict per archive: ``reason`` is NULL for accepted archives."""
    ratio = F.when(F.col("packed_bytes") > 0, F.col("file_bytes") / F.col("packed_bytes"))
    stats = members.groupBy("archive").agg(
        F.max("archive_bytes").alias("archive_bytes"),
        F.max("magic").alias("magic"),
        F.count("member").alias("n_files"),
        F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("uncompressed_bytes"),
        F.max(ratio).alias("max_ratio"),
        F.max(F.when(F.col("member").isNull(), F.col("error"))).alias("error"),
    )
    reason = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("archive_bytes") == 0, "empty")
        .when(F.col("magic") != "PK", "bad_magic")
        .when(F.col("n_files") > MAX_FILES, "too_many_files")
        .when(F.col("max_ratio") > MAX_RATIO, "compression_ratio")
    )
    return stats.select(
        "archive",
        "archive_bytes",
        "n_files",
        "uncompressed_bytes",
        "max_ratio",
        (F.col("archive_bytes") > MAX_ZIP_MB * 1024 * 1024).alias("over_zip_mb"),
        (F.col("uncompressed_bytes") > MAX_UNCOMPRESSED_MB * 1024 * 1024).alias(
            "over_uncompressed_mb"
        ),
        reason.alias("reason"),
        "error",
    )


def member_rows(path: str, key: str, members: Iterable[Member]) -> Iterator[pa.RecordBatch]:
    """``ROW_SCHEMA`` of some members of one archive: lines, or a reason where a member breaks."""
    names = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        nonlocal held
        columns = list(zip(*rows))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        rows.clear()
        held = 0
        return found

    def broken(member: Member, reason: str) -> None:
        rows.append((key, member.name, member.number, None, None, path, reason))

    try:
        with _open(path) as handle, zipfile.ZipFile(handle) as archive:
            entries = [i for i in archive.infolist() if not i.filename.endswith("/")]
            for member in members:
                if member.error:
                    broken(member, member.error)
                    continue
                try:
                    # By its place, as two members may have one name.
                    with archive.open(entries[member.number]) as stream:
                        for line_no, raw in enumerate(stream):
                            text = raw.strip()
                            if text:
                                line = text.decode("utf-8", errors="replace")
                                rows.append((key, member.name, member.number, line_no, line, path, None))
                                held += len(text)
                                if held > BATCH_BYTES:
                                    yield batch()
                except READ_ERRORS as error:
                    broken(member, f"damaged: {_said(error)}")
    except READ_ERRORS as error:
        rows.append((key, None, None, None, None, path, f"unreadable: {_said(error)}"))
    if rows:
        yield batch()


def archive_rows(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Stripped, non-blank lines of all members of accepted archives, and a row with a ``reason``
    for each refused archive and each member that could not be read to its end.

    The member table is tiny and would be coalesced to one task, so the number of
    partitions is given: by default three per core of the cluster.
    """
    spark = members.sparkSession
    members = materialize(members, "members")
    audit = archive_audit(members)
    refused = audit.filter(F.col("reason").isNotNull()).select("archive", "reason")
    accepted = audit.filter(F.col("reason").isNull()).select("archive")
    wanted = members.filter(F.col("member").isNotNull()).join(accepted, "archive", "left_semi")
    columns = ["archive", "app_key", "member_no", "member", "file_bytes", "packed_bytes", "error"]
    spread = wanted.select(*columns).repartition(
        tasks or 3 * spark.sparkContext.defaultParallelism, "archive", "member_no"
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                member = Member(row["member_no"], row["member"], row["file_bytes"], row["packed_bytes"], row["error"])
                yield from member_rows(row["archive"], row["app_key"], [member])

    keys = members.select("archive", "app_key").distinct()
    closed = refused.join(keys, "archive").selectExpr(
        "app_key", "string(null) as file_name", "bigint(null) as file_seq", "bigint(null) as line_no",
        "string(null) as line", "archive", "reason",
    )
    return spread.mapInArrow(stream, ROW_SCHEMA).unionByName(closed)


def lines_only(rows: DataFrame) -> DataFrame:
    """The lines among ``archive_rows``, with their place ``seq`` in the application."""
    lines = rows.filter(F.col("line").isNotNull()).drop("archive", "reason")
    return lines.withColumn("seq", F.col("file_seq") * F.lit(MEMBER_STEP) + F.col("line_no"))


def archive_lines(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """The lines of all members of accepted archives."""
    return lines_only(archive_rows(members, tasks))
