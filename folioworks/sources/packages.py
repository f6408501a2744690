"""Packages (ZIP files) as tables of parts."""

from __future__ import annotations

import lzma
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import base_name
from ..functions.names import is_container
from ..session import width
from .files import open_seekable, open_small, opened
from .listing import list_files

PART_SCHEMA = (
    "container string, path string, ordinal int, part_name string, is_dir boolean, "
    "file_size long, compress_size long, crc long, date_time timestamp_ntz, "
    "external_attr long, create_system int, error string"
)
_PART_COLUMNS = [field.split()[0] for field in PART_SCHEMA.split(", ")]

_SMALLEST_ZIP = 22  # bytes of an empty archive

# What a damaged member raises; a bzip2 decoder raises plain OSErrors.  Failing
# reads are not among these (see ReadFailed): Spark repeats the task instead of
# blaming the package.
DAMAGED = (
    zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, NotImplementedError, OSError,
    RuntimeError, ValueError,
)

# Rows and bytes a task gathers before it hands them over.
_BATCH_ROWS = 4096
_BATCH_BYTES = 32 * 1024 * 1024


def named_containers(files: DataFrame, suffix: str) -> DataFrame:
    """Add ``container``, the file name, and keep only packages."""
    named = files.withColumn("container", base_name("path"))
    return named.filter(is_container("container", suffix)).select(
        "container", "path", "modificationTime", "length"
    )


def list_containers(spark: SparkSession, folder: str, suffix: str = ".docx") -> DataFrame:
    """The packages directly in ``folder``, without reading any of them.

    Every name counts that has the suffix and is no editor's lock file; empty files,
    too, which are listed as packages that cannot be opened.
    """
    return named_containers(list_files(spark, folder), suffix)


def open_zip(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(open_small(path))


@dataclass(frozen=True)
class Share:
    """How the members of packages are dealt out to tasks.

    ``members``: length of the runs a package is cut into; ``tasks``: their
    number, the session's shuffle width by default.
    """

    members: int = 64
    tasks: int | None = None


class Batches:
    """Collects rows into frames of bounded size."""

    def __init__(self, columns: list[str]):
        self.columns, self.rows, self.size = columns, [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.size += size
        return len(self.rows) >= _BATCH_ROWS or self.size >= _BATCH_BYTES

    def take(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.rows, columns=self.columns, dtype=object)
        self.rows, self.size = [], 0
        return frame


def _timestamp(info: zipfile.ZipInfo) -> datetime | None:
    try:
        return datetime(*info.date_time)
    except ValueError:
        return None


def _directory(path: str) -> list[zipfile.ZipInfo]:
    with open_seekable(path) as src:
        if src.size() < _SMALLEST_ZIP:
            raise zipfile.BadZipFile("File is not a zip file")
        with zipfile.ZipFile(src) as z:
            return z.infolist()


def explode_parts(containers: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per member, in archive order, from the archives' directories.

    Only the directory at the end of each file is fetched, whatever the size
    of the package.  A file that is no archive gives one row with ``error``
    and no part.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(_PART_COLUMNS)
        for frame in frames:
            for container, path in zip(frame["container"], frame["path"]):
                try:
                    members = _directory(path)
                except (zipfile.BadZipFile, ValueError) as problem:
                    row = (container, path) + (None,) * 9 + (str(problem) or repr(problem),)
                    if batch.add(row):
                        yield batch.take()
                    continue
                for ordinal, m in enumerate(members):
                    row = (
                        container, path, ordinal, m.filename, m.is_dir(), m.file_size,
                        m.compress_size, m.CRC, _timestamp(m), m.external_attr,
                        m.create_system, None,
                    )
                    if batch.add(row):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    listed = containers.select("container", "path")
    return listed.repartition(tasks or width(listed.sparkSession), "path").mapInPandas(
        scan, PART_SCHEMA
    )


def readable(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("error").isNull()).drop("error")


def unreadable(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("error").isNotNull()).select("container", "path", "error")


def by_package_slice(parts: DataFrame, share: Share) -> DataFrame:
    """Place parts so that neighbours share a task and no package fills one.

    A slice is a run of members of one package; a task opens the package once
    per slice and reads forward.
    """
    piece = F.floor(F.col("ordinal") / share.members)
    tasks = share.tasks or width(parts.sparkSession)
    return parts.repartition(tasks, F.col("path"), piece).sortWithinPartitions(
        "path", "ordinal"
    )


def read_parts(
    parts: DataFrame, share: Share = Share(), first_bytes: int | None = None
) -> DataFrame:
    """Add ``content`` to part rows; ``first_bytes`` reads no further than that.

    Select the wanted parts before: only their bytes are fetched.  A damaged
    part has no content but a ``problem``.
    """
    columns = parts.columns
    schema = T.StructType([*parts.schema.fields]).add("content", "binary").add("problem", "string")

    def with_contents(rows: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        contents, problems = zip(*found)
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(contents, pa.binary()), pa.array(problems, pa.string())],
            [*columns, "content", "problem"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows' own columns are passed on as they came, cut where contents get large.
        with opened(open_zip) as package:
            for batch in batches:
                found, size, first = [], 0, 0
                paths, ordinals = (
                    batch.column(columns.index(name)).to_pylist() for name in ("path", "ordinal")
                )
                for path, ordinal in zip(paths, ordinals):
                    found.append(read_member(package, path, ordinal, first_bytes))
                    size += len(found[-1][0] or b"")
                    if size >= _BATCH_BYTES:
                        yield with_contents(batch.slice(first, len(found)), found)
                        found, size, first = [], 0, first + len(found)
                if found:
                    yield with_contents(batch.slice(first), found)

    return by_package_slice(parts, share).mapInArrow(read, schema)


def read_member(
    package: Callable[[str], zipfile.ZipFile], path: str, ordinal: int, first: int | None = None
) -> tuple[bytes | None, str | None]:
    """Bytes of one member, or what is wrong with it."""
    try:
        z = package(path)
        with z.open(z.infolist()[ordinal]) as member:
            return member.read(-1 if first is None else first), None
    except DAMAGED as problem:
        return None, str(problem) or repr(problem)


def check_parts(parts: DataFrame, share: Share = Share()) -> DataFrame:
    """Recompute every member's checksum: ``crc_ok`` per part.

    The bytes are inflated in blocks and dropped in the task that reads them,
    so a whole collection can be tested without moving its contents.
    """

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(open_zip) as package:
            for frame in frames:
                yield frame.assign(
                    crc_ok=[
                        _member_ok(package, path, ordinal, size, crc)
                        for path, ordinal, size, crc in zip(
                            frame["path"], frame["ordinal"], frame["file_size"], frame["crc"]
                        )
                    ]
                ).drop(columns=["path", "file_size", "crc"])

    wanted = parts.select("container", "path", "ordinal", "part_name", "file_size", "crc")
    return by_package_slice(wanted, share).mapInPandas(
        test, "container string, ordinal int, part_name string, crc_ok boolean"
    )


def _member_ok(
    package: Callable[[str], zipfile.ZipFile], path: str, ordinal: int, size: int, crc: int
) -> bool:
    total, actual = 0, 0
    try:
        z = package(path)
        with z.open(z.infolist()[ordinal]) as member:
            while block := member.read(fv.COPY_BLOCK):
                total += len(block)
                actual = zlib.crc32(block, actual)
    except DAMAGED:
        return False
    return total == size and actual == crc


def verify_crc(parts_with_content: DataFrame) -> DataFrame:
    """``crc_ok`` for parts whose bytes are already at hand."""
    ok = (F.crc32("content") == F.col("crc")) & (
        F.octet_length("content") == F.col("file_size")
    )
    return parts_with_content.withColumn("crc_ok", ok).drop("content")
