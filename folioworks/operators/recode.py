"""Running a caller's image codec over the candidate parts of a collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import ext
from ..functions.formats import MAGIC, format_mismatch, not_png
from ..settings import DEFAULTS, Settings
from ..sources.files import opened
from ..sources.images import PICTURE, Decoder, Picture, picture
from ..sources.packages import DAMAGED, Batches, Share, by_package_slice, open_zip, read_member
from ..sources.slices import SLICE, SliceWriter, as_struct, slice_writer
from .classify import accept

Codec = Callable[[bytes, str], bytes]

EMPTY_RESULT = "the codec gave no bytes"

DECISION_COLUMNS = (
    "container", "ordinal", "part_name", "reason", "old_size", "new_size", "accepted",
)
_RECODED = (
    "container string, path string, ordinal int, part_name string, old_size long, "
    f"new_size long, new_slice {SLICE}, codec_error string, problem string"
)
_RECODED_COLUMNS = [
    "container", "path", "ordinal", "part_name", "old_size", "new_size", "new_slice",
    "codec_error", "problem",
]
_HEAD_BYTES = 32


def _recoded(
    content: bytes, name: str, codec: Codec, slices: SliceWriter
) -> tuple[int | None, dict | None, str | None]:
    """New size, where a smaller result was stored, and what the codec raised."""
    try:
        new = codec(content, name)
        if not new:
            return None, None, EMPTY_RESULT
    except Exception as raised:  # any codec trouble: keep the part
        return None, None, str(raised) or repr(raised)
    smaller = len(new) < len(content)  # no rule takes a larger one
    return len(new), as_struct(slices.add(new)) if smaller else None, None


_MARK_OF = {
    extension: bytes.fromhex(dict(MAGIC)[kind])
    for kind, extensions in (("PNG", fv.PNG_EXTENSIONS), ("JPEG", fv.JPEG_EXTENSIONS))
    for extension in extensions
}


def _read_fitting(package, path: str, ordinal: int, extension: str) -> tuple:
    """First bytes; the whole content where ``format_mismatch`` finds nothing against
    them; what is wrong with the part, as far as it was read."""
    head = None
    try:
        z = package(path)
        with z.open(z.infolist()[ordinal]) as member:
            head = member.read(_HEAD_BYTES)
            if extension in _MARK_OF and head.startswith(_MARK_OF[extension]):
                return head, head + member.read(), None
            return head, None, None
    except DAMAGED as problem:
        return head, None, str(problem) or repr(problem)


def recode_fitting(
    parts: DataFrame, codec: Codec, folder: str, share: Share = Share()
) -> DataFrame:
    """As :func:`recode`, for parts whose first bytes are what their names promise.

    A part is opened once: of the others only the first bytes are read, and
    ``format_reason`` says why they stay.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches([*_RECODED_COLUMNS, "head"])
        with opened(open_zip) as package, slice_writer(folder) as slices:
            for frame in frames:
                for container, path, ordinal, name, size, extension in frame.itertuples(
                    index=False, name=None
                ):
                    done = (None, None, None)
                    head, old, problem = _read_fitting(package, path, ordinal, extension)
                    if problem is not None:
                        size = None
                    elif old is not None:
                        size, done = len(old), _recoded(old, name, codec, slices)
                    if batch.add((container, path, ordinal, name, size, *done, problem, head)):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    rows = parts.select(
        "container", "path", "ordinal", "part_name", "file_size", ext("part_name").alias("extension")
    )
    recoded = by_package_slice(rows, share).mapInPandas(run, f"{_RECODED}, head binary")
    # A damaged part goes on without a reason; ``decide`` reports it.
    why = F.when(F.col("problem").isNull(), format_mismatch("head", ext("part_name")))
    return recoded.withColumn("format_reason", why).drop("head")


def recode(parts: DataFrame, codec: Codec, folder: str, share: Share = Share()) -> DataFrame:
    """Apply ``codec(content, part_name)`` to each part.

    Parts are read, recoded and dropped one by one where they are.  A smaller
    replacement goes to a slice file below ``folder``; its place travels on.  What
    the codec raises is a reason to keep that part, not a failure of the job.
    Store the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(_RECODED_COLUMNS)
        with opened(open_zip) as package, slice_writer(folder) as slices:
            for frame in frames:
                for container, path, ordinal, name in frame.itertuples(index=False, name=None):
                    old, problem = read_member(package, path, ordinal)
                    size = None if old is None else len(old)
                    done = (None, None, None) if problem else _recoded(old, name, codec, slices)
                    if batch.add((container, path, ordinal, name, size, *done, problem)):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    rows = parts.select("container", "path", "ordinal", "part_name")
    return by_package_slice(rows, share).mapInPandas(run, _RECODED)


def convert(
    parts: DataFrame,
    decode: Decoder,
    codec: Codec,
    folder: str,
    share: Share = Share(),
    min_colors: int = fv.MIN_COLORS,
) -> DataFrame:
    """Judge each PNG part by its pixels and recode the opaque photographic ones.

    A part is opened once: its first bytes say whether it is a PNG, the decoder
    gives its pixels (see ``sources.images``), and only what they qualify meets the
    codec.  The columns are those of :func:`recode`, ``file_size``, ``head`` (first
    bytes) and those of ``PICTURE``.  Store the result before using it twice.
    """
    columns = [*_RECODED_COLUMNS, "head", *(c.split()[0] for c in PICTURE.split(", "))]
    png = bytes.fromhex(dict(MAGIC)["PNG"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(columns)
        with opened(open_zip) as package, slice_writer(folder) as slices:
            for frame in frames:
                for container, path, ordinal, name in frame.itertuples(index=False, name=None):
                    old, problem = read_member(package, path, ordinal)
                    seen, done = Picture(), (None, None, None)
                    if problem is None and old.startswith(png):
                        seen = picture(old, decode, min_colors)
                        if seen.photographic and not seen.has_alpha:
                            done = _recoded(old, name, codec, slices)
                    size, head = (None, None) if old is None else (len(old), old[:_HEAD_BYTES])
                    if batch.add(
                        (container, path, ordinal, name, size, *done, problem, head, *astuple(seen))
                    ):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    rows = parts.select("container", "path", "ordinal", "part_name")
    return by_package_slice(rows, share).mapInPandas(
        run, f"{_RECODED}, head binary, {PICTURE}"
    ).withColumn("file_size", F.col("old_size"))


def pixel_reason() -> Column:
    """Why a part from :func:`convert` stays a PNG, null where only the codec decides."""
    error = F.format_string(fv.KEPT_ERROR_PNG, F.col("decode_error"))
    pixels = (
        F.when(~F.col("decodable"), error)
        .when(F.col("has_alpha"), F.lit(fv.KEPT_ALPHA))
        .when(~F.col("photographic"), F.lit(fv.KEPT_FEW_COLORS))
    )
    return F.when(F.col("problem").isNull(), F.coalesce(not_png("head"), pixels))


def decide(recoded: DataFrame, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Accept or refuse each recoded part, with the reason for a refusal."""
    pattern = fv.KEPT_ERROR if mode == "recompress" else fv.KEPT_ERROR_PNG
    judged = accept(recoded, mode, settings)
    failed = F.col("new_size").isNull()
    return judged.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn(
        "reason",
        F.when(failed, F.format_string(pattern, F.coalesce("codec_error", "problem"))).otherwise(
            F.col("reason")
        ),
    )
