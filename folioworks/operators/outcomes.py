"""What a pass achieved, per container and for the whole collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import ext, fmt_mb, is_media, reduction_pct


def outcomes(decisions: DataFrame) -> DataFrame:
    """Per container: sizes before and after, parts processed and skipped.

    ``decisions`` has one row per part with ``old_size``, ``new_size`` (null
    where the part stays), ``accepted`` and ``reason``.  The sizes here are
    those of the parts; ``with_package_sizes`` puts the packages' own.
    """
    done = F.coalesce(F.col("accepted"), F.lit(False))
    final = F.when(done, F.col("new_size")).otherwise(F.col("old_size"))
    return (
        decisions.groupBy("container")
        .agg(
            F.sum("old_size").alias("size_before"),
            F.sum(final).alias("size_after"),
            F.count_if(done).alias("processed"),
            F.count_if(~done & F.col("reason").isNotNull()).alias("skipped"),
        )
        .withColumn("reduction_pct", reduction_pct("size_before", "size_after"))
    )


def with_package_sizes(containers: DataFrame, counts: DataFrame, published: DataFrame) -> DataFrame:
    """Outcomes in terms of package files.

    ``containers``: ``container, length``; ``published``: ``container,
    size_after, version, failure``.  Containers without decisions count zero.
    The counts stay as they were even when the proof rejected the new version;
    ``published_count`` is what reached the output.
    """
    zero = F.lit(0).cast("long")
    return (
        containers.select("container", F.col("length").alias("size_before"))
        .join(published, "container")
        .join(counts.select("container", "processed", "skipped"), "container", "left")
        .withColumn("processed", F.coalesce("processed", zero))
        .withColumn("skipped", F.coalesce("skipped", zero))
        .withColumn(
            "published_count",
            F.when(F.col("version") == "new", F.col("processed")).otherwise(zero),
        )
        .withColumn("reduction_pct", reduction_pct("size_before", "size_after"))
    )


def detail_lines(decisions: DataFrame) -> DataFrame:
    """One text line per processed or skipped part, which decisions consist of.

    Rows with ``container`` and ``ordinal`` rather than one array per
    container: a package may hold any number of parts.  No filter here: it
    would be pushed down and evaluate the decision's expressions twice.
    """
    done = F.coalesce(F.col("accepted"), F.lit(False))
    renamed = "new_part_name" in decisions.columns
    sizes = [fmt_mb("old_size"), fmt_mb("new_size")]
    if renamed:
        text = F.format_string(fv.LINE_DETAIL_RENAMED, "part_name", "new_part_name", *sizes)
    else:
        text = F.format_string(fv.LINE_DETAIL_DONE, "part_name", *sizes)
    kept = F.format_string(fv.LINE_DETAIL, "part_name", "reason")
    return decisions.select(
        "container", F.col("ordinal").cast("long").alias("ordinal"),
        F.when(done, text).otherwise(kept).alias("line"),
    )


def corpus_summary(results: DataFrame) -> DataFrame:
    """One row: files, failures, totals and the total reduction."""
    zero = F.lit(0).cast("long")
    totals = results.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("failure").isNotNull()).alias("failures"),
        F.coalesce(F.sum("size_before"), zero).alias("total_before"),
        F.coalesce(F.sum("size_after"), zero).alias("total_after"),
    )
    return totals.withColumn(
        "reduction_pct", reduction_pct("total_before", "total_after")
    ).select(
        "*",
        fmt_mb("total_before").alias("before_text"),
        fmt_mb("total_after").alias("after_text"),
    )


def media_weight(
    parts: DataFrame,
    extensions: Sequence[str] = fv.PNG_EXTENSIONS,
    containers: DataFrame | None = None,
) -> DataFrame:
    """Compressed bytes and number of media parts of the given extensions."""
    counted = is_media("part_name") & ext("part_name").isin(*extensions)
    weight = parts.groupBy("container").agg(
        F.coalesce(F.sum(F.when(counted, F.col("compress_size"))), F.lit(0)).alias("weight"),
        F.count_if(counted).alias("parts"),
    )
    if containers is None:
        return weight
    zero = F.lit(0).cast("long")
    return containers.select("container").join(weight, "container", "left").select(
        "container",
        F.coalesce("weight", zero).alias("weight"),
        F.coalesce("parts", zero).alias("parts"),
    )


def over_limit(
    results: DataFrame,
    parts: DataFrame,
    limit: int = fv.ALERT_BYTES,
    extensions: Sequence[str] = fv.PNG_EXTENSIONS,
) -> DataFrame:
    """Containers still over the limit and how much of them is PNG."""
    large = results.filter(F.col("size_after") > limit).select("container", "size_after")
    zero = F.lit(0).cast("long")
    share = F.try_divide(F.col("weight").cast("double"), F.col("size_after").cast("double"))
    return (
        large.join(media_weight(parts, extensions), "container", "left")
        .withColumn("weight", F.coalesce("weight", zero))
        .withColumn("parts", F.coalesce("parts", zero))
        .withColumn("weight_pct", F.coalesce(share * F.lit(100.0), F.lit(0.0)))
    )
