"""Decoding image parts with a caller's decoder, and what their pixels say.

The decoder is a slot like the codec: ``decode(content)`` gives the samples of an
image as an array of 8-bit values, (height, width) or (height, width, channels)
with one channel for gray, two for gray and alpha, three for colours and four for
colours and alpha, and raises for bytes no image comes from.  It runs in the task
that has just read the member; no picture is stored as a file of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.formats import sniff_format
from .files import opened
from .packages import Batches, Share, by_package_slice, open_zip, read_member

Decoder = Callable[[bytes], np.ndarray]

PICTURE = (
    "width int, height int, channels int, decodable boolean, has_alpha boolean, "
    "sample_colors int, photographic boolean, decode_error string"
)


@dataclass(frozen=True)
class Picture:
    """What the pixels of one image say; the fields of ``PICTURE``.

    ``has_alpha``: some pixel is not fully opaque.  ``photographic``: more than
    ``min_colors`` distinct colours in a nearest-neighbour sample of at most 512
    pixels on the long side, transparency left out.
    """

    width: int | None = None
    height: int | None = None
    channels: int | None = None
    decodable: bool | None = None
    has_alpha: bool | None = None
    sample_colors: int | None = None
    photographic: bool | None = None
    error: str | None = None


def picture(content: bytes, decode: Decoder, min_colors: int = fv.MIN_COLORS) -> Picture:
    """Decode one image and judge it; what the decoder raises is its ``error``."""
    try:
        pixels = np.asarray(decode(content))
        if pixels.ndim == 2:
            pixels = pixels[:, :, None]
        height, width, channels = pixels.shape
        if not pixels.size:
            raise ValueError("an image without pixels")
        alpha = channels in (2, 4) and bool(pixels[:, :, -1].min() < 255)
        colors = sampled_colors(pixels)
    except Exception as raised:  # any decoder trouble: no image
        return Picture(-1, -1, -1, False, False, 0, False, str(raised) or repr(raised))
    return Picture(width, height, channels, True, alpha, colors, colors > min_colors)


def inspect_images(
    parts: DataFrame,
    decode: Decoder,
    share: Share = Share(),
    min_colors: int = fv.MIN_COLORS,
) -> DataFrame:
    """``container, ordinal`` of image parts with the columns of ``PICTURE``.

    Each part is read, decoded and dropped in one task.  Every part has one row:
    ``problem`` says why its bytes could not be read, ``decodable`` and
    ``decode_error`` what came of them.
    """
    columns = ["container", "ordinal", "problem", *(c.split()[0] for c in PICTURE.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(columns)
        with opened(open_zip) as package:
            for frame in frames:
                for container, path, ordinal in frame.itertuples(index=False, name=None):
                    content, problem = read_member(package, path, ordinal)
                    seen = Picture() if problem else picture(content, decode, min_colors)
                    if batch.add((container, ordinal, problem, *astuple(seen))):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    rows = parts.select("container", "path", "ordinal")
    return by_package_slice(rows, share).mapInPandas(
        run, f"container string, ordinal int, problem string, {PICTURE}"
    )


def head_profile(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add ``head_format, head_width, head_height, head_channels`` from first bytes.

    The fields of PNG, GIF and BMP headers lie at fixed offsets, so 32 bytes of a
    member are enough and nothing is decoded.  JPEG and others, whose sizes lie
    behind segments of any length, have a null size.
    """

    def digits(first: int, count: int) -> Column:
        return F.hex(F.substring(F.col(content), first + 1, count))

    def number(first: int, count: int) -> Column:
        return F.conv(digits(first, count), 16, 10).try_cast("long")

    def little(first: int, count: int) -> Column:
        pairs = (digits(first + k, 1) for k in reversed(range(count)))
        return F.conv(F.concat(*pairs), 16, 10).try_cast("long")

    kind = sniff_format(content)
    colour = number(25, 1)
    channels = (
        F.when(colour.isin(0, 3), 1).when(colour == 2, 3).when(colour == 4, 2).when(colour == 6, 4)
    )
    # Where headers keep width and height.
    return rows.withColumns(
        {
            "head_format": kind,
            "head_width": F.when(kind == "PNG", number(16, 4)).when(kind == "GIF", little(6, 2)).when(
                kind == "BMP", little(18, 4)
            ),
            "head_height": F.when(kind == "PNG", number(20, 4)).when(kind == "GIF", little(8, 2)).when(
                kind == "BMP", little(22, 4)
            ),
            "head_channels": F.when(kind == "PNG", channels),
        }
    )


def sampled_colors(pixels: np.ndarray, side: int = fv.SAMPLE_SIDE) -> int:
    """Distinct colours of the sample, all of the image when it is small; no alpha."""
    height, width, channels = pixels.shape
    longest = max(height, width)
    if longest > side:
        factor = side / longest
        rows = _nearest(height, max(1, round(height * factor)))
        columns = _nearest(width, max(1, round(width * factor)))
        pixels = pixels[np.ix_(rows, columns)]
    colours = 1 if channels < 3 else 3
    flat = pixels[:, :, :colours].reshape(-1, colours).astype(np.uint32)
    packed = flat[:, 0]
    for channel in range(1, colours):
        packed = (packed << 8) | flat[:, channel]
    return len(np.unique(packed))


def _nearest(size: int, wanted: int) -> np.ndarray:
    """Source index of each sampled line: the one under its centre."""
    step = size / wanted
    centres = np.cumsum(np.concatenate(([step * 0.5], np.full(wanted - 1, step))))
    return np.minimum(centres.astype(np.int64), size - 1)
