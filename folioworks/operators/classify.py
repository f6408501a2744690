"""Which parts of a package are worth working on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import ext, is_media
from ..functions.sizes import resized, small_enough, smaller
from ..settings import DEFAULTS, Settings


def only_large(containers: DataFrame, limit: int, size: str = "length") -> DataFrame:
    return containers.filter(F.col(size) > limit)


def missing_required(
    containers: DataFrame, parts: DataFrame, name: str = fv.CONTENT_TYPES_PART
) -> DataFrame:
    """Containers without the part ``name``."""
    having = parts.filter(F.col("part_name") == name).select("container")
    return containers.join(having, "container", "left_anti")


def classify_parts(parts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``extension``, ``disposition`` and ``reason``.

    Dispositions: ``directory``, ``verbatim`` (not media), ``kept`` (media that
    is left as it is, with a reason) and ``candidate``.
    """
    limit = settings.min_part_bytes
    e = F.col("extension")
    recodable = [*fv.JPEG_EXTENSIONS, *fv.PNG_EXTENSIONS]
    kilobytes = F.floor(F.col("file_size") / 1024).cast("long")
    why_kept = (
        F.when(e.isin(*fv.VECTOR_EXTENSIONS), F.lit(fv.KEPT_VECTOR))
        .when(
            ~e.isin(*recodable),
            F.format_string(fv.KEPT_EXTENSION, F.when(e == "", F.lit("?")).otherwise(e)),
        )
        .when(
            F.col("file_size") < limit,
            F.format_string(fv.KEPT_SMALL, kilobytes, F.lit(limit // 1024)),
        )
    )
    media = is_media("part_name")
    return (
        parts.withColumn("extension", ext("part_name"))
        .withColumn("reason", F.when(~F.col("is_dir") & media, why_kept))
        .withColumn(
            "disposition",
            F.when(F.col("is_dir"), F.lit("directory"))
            .when(~media, F.lit("verbatim"))
            .when(F.col("reason").isNotNull(), F.lit("kept"))
            .otherwise(F.lit("candidate")),
        )
    )


def candidates(
    parts: DataFrame,
    extensions: Sequence[str] = fv.PNG_EXTENSIONS,
    min_size: int = fv.MIN_PART_BYTES,
) -> DataFrame:
    """Media parts of the given extensions, at least ``min_size`` bytes unpacked."""
    return parts.filter(
        is_media("part_name")
        & ext("part_name").isin(*extensions)
        & (F.col("file_size") >= min_size)
    )


def resize_plan(
    images: DataFrame,
    limit: int = fv.MAX_DIMENSION,
    width: str = "width",
    height: str = "height",
) -> DataFrame:
    """Add the size each image gets and whether it differs from its own."""
    longest = F.greatest(width, height)
    return images.select(
        "*",
        resized(width, longest, limit).alias("new_width"),
        resized(height, longest, limit).alias("new_height"),
        (longest > limit).alias("resized"),
    )


def accept(df: DataFrame, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``accepted`` and ``reason`` from ``old_size`` and ``new_size``."""
    if mode == "recompress":
        ok, refusal = smaller("old_size", "new_size"), fv.KEPT_NOT_SMALLER
    elif mode == "convert":
        ok = small_enough("old_size", "new_size", settings.min_saving)
        refusal = fv.KEPT_NOT_ENOUGH
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("accepted", ok).withColumn(
        "reason", F.when(~F.col("accepted"), F.lit(refusal))
    )
