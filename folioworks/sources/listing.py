"""Listing folders as a Spark data source, in batch and as a stream.

Spark's file sources pass over empty files and over names that start with ``_`` or
``.``, and list on the driver.  This source asks the file system itself, in tasks, a
partition for each folder, and hands over names and sizes as Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from .files import locate

NAME = "folder_listing"
FILES = "path string, modificationTime timestamp, length long"

_BATCH_ROWS = 10_000


@dataclass
class Folder(InputPartition):
    path: str


def _list(folder: Folder) -> Iterator[pa.RecordBatch]:
    """The files directly in a folder."""
    fs, name = locate(folder.path)
    found = fs.get_file_info(pafs.FileSelector(name, recursive=False))
    files = [f for f in found if f.type == pafs.FileType.File]
    root = folder.path.rstrip("/")
    for at in range(0, len(files), _BATCH_ROWS):
        some = files[at : at + _BATCH_ROWS]
        times = pa.array([(f.mtime_ns or 0) // 1000 for f in some], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{root}/{f.base_name}" for f in some], pa.string()),
                times.cast(pa.timestamp("us", tz="UTC")),
                pa.array([f.size for f in some], pa.int64()),
            ],
            ["path", "modificationTime", "length"],
        )


def _folders(options) -> list[Folder]:
    return [Folder(path) for path in options["path"].split("\n")]


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").load(folder)``; several folders are
    separated by line breaks."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Folder]:
        return _folders(self.options)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        yield from _list(partition)


class _StreamReader(DataSourceStreamReader):
    """Every batch is one listing of everything there; offsets only count listings.

    What has been seen before is for the reader of the stream to take out: file
    times are no order that new files keep.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"listed": 0}

    def latestOffset(self) -> dict:
        return {"listed": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return _folders(self.options)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        yield from _list(partition)

    def commit(self, end: dict) -> None:
        pass


def list_files(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, modificationTime, length`` of the files directly in the folders."""
    spark.dataSource.register(FolderListing)
    return spark.read.format(NAME).load("\n".join(folders))


def stream_files(spark: SparkSession, *folders: str) -> DataFrame:
    """A listing of the folders in every batch."""
    spark.dataSource.register(FolderListing)
    return spark.readStream.format(NAME).load("\n".join(folders))


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that no row of ``seen`` has with the same time and size."""
    return files.join(seen, ["path", "modificationTime", "length"], "left_anti")


