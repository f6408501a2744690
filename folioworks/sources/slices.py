"""Bytes by reference: contents stored in slice files and addressed by place.

A task that makes new contents appends them to a file of its own; what travels on
is a small struct ``file, offset, size``.  Whoever needs the bytes fetches just that
range.  Files have names of their own, so a repeated task never touches what
another one has written; its strays go with the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .files import locate

#: Where some bytes lie.
SLICE = "struct<file:string, offset:long, size:long>"


class SliceWriter:
    """Appends contents to a file that is made when the first one comes."""

    def __init__(self, folder: str):
        self.file, self._folder, self._out, self._at = "", folder, None, 0

    def add(self, content: bytes | memoryview) -> tuple[str, int, int]:
        if self._out is None:
            fs, folder = locate(self._folder)
            fs.create_dir(folder, recursive=True)
            name = f"slice-{uuid.uuid4().hex}"
            self.file = f"{self._folder}/{name}"
            self._out = fs.open_output_stream(f"{folder}/{name}")
        self._out.write(content)
        place = (self.file, self._at, len(content))
        self._at += len(content)
        return place

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


@contextmanager
def slice_writer(folder: str) -> Iterator[SliceWriter]:
    """A writer for one task; places count once the task has ended."""
    writer = SliceWriter(folder)
    try:
        yield writer
    finally:
        writer.close()


def read_slice(file, place) -> bytes:
    """The bytes at ``place``; ``file`` opens a path (see ``files.opened``)."""
    name, offset, size = place["file"], place["offset"], place["size"]
    source = file(name)
    source.seek(offset)
    content = source.read(size)
    if len(content) != size:
        raise EOFError(f"{name} ends before {offset + size}")
    return content


def stored_contents(rows: DataFrame, folder: str, content: str = "new_content") -> DataFrame:
    """Replace a binary column by ``new_slice``: where its bytes now lie; null stays null.

    The bytes go to slice files in the task that has them.  Store the result (see
    ``session.written``) before it is used twice.
    """
    others = [c for c in rows.columns if c != content]
    rows = rows.select(*others, content)
    place = T.StructType.fromDDL(f"new_slice {SLICE}")
    schema = T.StructType([*rows.schema.fields[:-1], *place.fields])
    fields = pa.struct([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Contents are written from the Arrow buffers; no batch of them becomes Python objects.
        with slice_writer(folder) as slices:
            for batch in batches:
                places = [
                    as_struct(slices.add(memoryview(c.as_buffer()))) if c.is_valid else None
                    for c in batch.column(batch.num_columns - 1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(places, fields)], [*others, "new_slice"]
                )

    return rows.mapInArrow(store, schema)


def as_struct(place: tuple[str, int, int] | None) -> dict | None:
    return None if place is None else dict(zip(("file", "offset", "size"), place))
