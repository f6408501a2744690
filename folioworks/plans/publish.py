"""Writing packages and putting the chosen versions in place."""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import width
from ..sources.files import copy_file, locate, move, open_small, opened, place
from ..sources.packages import DAMAGED
from ..sources.slices import SLICE, read_slice

_HEAD = -1  # ordinal of the row that opens a package
_WRITTEN = "container string, path string, length long, problem string"
_WRITTEN_ARROW = pa.schema(
    [("container", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("problem", pa.string())]
)
_RESULTS = 256  # packages that a task reports at once


def write_packages(
    containers: DataFrame, replacements: DataFrame, folder: str, tasks: int | None = None
) -> DataFrame:
    """Write each package again with its replaced parts.

    ``containers``: ``container, path``; ``replacements``: ``container,
    ordinal, new_part_name, new_slice``, where the slice says in which file the new
    bytes lie (see ``sources.slices``): no contents pass through the shuffle.  A
    name and its slice may come in separate rows of one ordinal.

    A package is one file and so has one writer, but that writer streams:
    members are copied in blocks, in archive order, and the replacements are
    fetched one at a time, so memory does not grow with the package.  Where
    ``path`` is null the package consists of its replacements alone.
    Replacements of containers that are not listed are passed over.
    """

    def reported(results: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*results), _WRITTEN_ARROW)]
        return pa.RecordBatch.from_arrays(columns, schema=_WRITTEN_ARROW)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        results = []
        with opened() as file:
            for container, group in groupby(rows, key=lambda row: row[0]):
                _, source, ordinal, _, _ = next(group)
                if ordinal != _HEAD:
                    continue  # replacements of a package that is not to be written
                target = f"{folder}/{container}"
                length, problem = None, None
                try:
                    length = place(target, lambda out: _fill(out, source, _merged(group, file)))
                except DAMAGED as damage:
                    problem = str(damage) or repr(damage)
                results.append((container, target, length, problem))
                if len(results) == _RESULTS:
                    yield reported(results)
                    results = []
        if results:
            yield reported(results)

    none = F.lit(None)
    heads = containers.select(
        "container",
        "path",
        F.lit(_HEAD).alias("ordinal"),
        none.cast("string").alias("new_part_name"),
        none.cast(SLICE).alias("new_slice"),
    )
    bodies = replacements.select(
        "container",
        none.cast("string").alias("path"),
        F.col("ordinal").cast("int").alias("ordinal"),
        "new_part_name",
        "new_slice",
    )
    return (
        heads.unionByName(bodies)
        # By a hash of its own: see ``operators.naming``.
        .repartition(tasks or width(heads.sparkSession), F.xxhash64("container"))
        .sortWithinPartitions("container", "ordinal")
        .mapInArrow(write, _WRITTEN)
    )


def _like(member: zipfile.ZipInfo, name: str) -> zipfile.ZipInfo:
    """Same metadata under ``name``, always deflated."""
    info = zipfile.ZipInfo(name, member.date_time)
    info.compress_type = zipfile.ZIP_DEFLATED
    info.external_attr = member.external_attr
    info.create_system = member.create_system
    return info


def _merged(rows: Iterator[tuple], file) -> Iterator[tuple[int, str | None, bytes]]:
    """One (ordinal, name, content) from the rows that share an ordinal."""
    for ordinal, same in groupby(rows, key=lambda row: row[2]):
        name, where = None, None
        for row in same:
            name = name if row[3] is None else row[3]
            where = where if row[4] is None else row[4]
        yield ordinal, name, read_slice(file, where)


def _fill(out, source: str | None, replacements: Iterator[tuple]) -> None:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        if source is None:
            for _, name, content in replacements:
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                target.writestr(info, content)
            return
        pending = next(replacements, None)
        with open_small(source) as src, zipfile.ZipFile(src) as original:
            for ordinal, member in enumerate(original.infolist()):
                if pending is not None and pending[0] == ordinal:
                    target.writestr(_like(member, pending[1] or member.filename), pending[2])
                    pending = next(replacements, None)
                elif member.is_dir():
                    target.writestr(_like(member, member.filename), b"")
                else:
                    info = _like(member, member.filename)
                    info.file_size = member.file_size  # decides on the 64-bit form
                    with original.open(member) as part, target.open(info, "w") as copy:
                        shutil.copyfileobj(part, copy, fv.COPY_BLOCK)


def publish(judged: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Put each container's chosen version into ``folder``.

    ``judged``: ``container, path, staged, version``.  The new version is
    renamed into place, any other choice copies the original.  Repeating a
    task is harmless: what it would rename is already there.
    """

    def place_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [
                _place_version(row.path, row.staged, row.version, f"{folder}/{row.container}")
                for row in frame.itertuples(index=False)
            ]
            yield pd.DataFrame(
                {
                    "container": frame["container"],
                    "path": [f"{folder}/{c}" for c in frame["container"]],
                    "length": sizes,
                }
            )

    rows = judged.select("container", "path", "staged", "version")
    return rows.repartition(tasks or width(rows.sparkSession), "container").mapInPandas(
        place_all, "container string, path string, length long"
    )


def _place_version(original: str, staged: str | None, version: str, target: str) -> int:
    if version != "new":
        return copy_file(original, target)
    fs, source = locate(staged)
    _, name = locate(target)
    if fs.get_file_info(source).type == pafs.FileType.File:
        move(fs, source, name)
    placed = fs.get_file_info(name)
    if placed.type != pafs.FileType.File:
        raise FileNotFoundError(f"neither {staged} nor {target} exists")
    return placed.size
