"""Following renamed parts through references and content-type declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import is_internal, resolve_target, rewrite_target


def rewrite_references(
    rels: DataFrame, renames: DataFrame, image_type: str = fv.IMAGE_REL_TYPE
) -> DataFrame:
    """Add ``new_target`` and ``changed``: image references to renamed parts.

    References that cannot be rewritten get keys of their own, which no part
    has (names hold no NUL), so that they spread over all tasks like the rest.
    A part that very many references share is split by adaptive execution: no
    later step relies on how this join's result is distributed.
    """
    eligible = F.col("rel_type").eqNullSafe(F.lit(image_type)) & is_internal("target")
    keyed = rels.withColumn(
        "part_name",
        F.when(eligible, resolve_target("rels_path", "target")).otherwise(
            F.concat(F.lit("\0"), F.col("pos").cast("string"))
        ),
    )
    known = renames.select("container", "part_name", "new_part_name")
    return (
        keyed.join(known, ["container", "part_name"], "left")
        .withColumn("changed", F.col("new_part_name").isNotNull())
        .withColumn(
            "new_target",
            F.when(F.col("changed"), rewrite_target("target", "new_part_name")).otherwise(
                F.col("target")
            ),
        )
        .drop("part_name", "new_part_name")
    )


def changed_rels(rewritten: DataFrame) -> DataFrame:
    """Per ``.rels`` part whether any of its references changed."""
    return rewritten.groupBy("container", "rels_path").agg(
        F.bool_or("changed").alias("changed"),
        F.count_if("changed").alias("changed_references"),
    )


def jpeg_extension(content_types: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """The JPEG extension each container already declares, else ``jpeg``."""
    default = F.col("kind") == "default"
    declared = content_types.groupBy("container").agg(
        F.bool_or(default & (F.col("key") == "jpeg")).alias("_jpeg"),
        F.bool_or(default & (F.col("key") == "jpg")).alias("_jpg"),
    )
    if containers is not None:
        declared = containers.select("container").join(declared, "container", "left")
    only_jpg = F.coalesce(F.col("_jpg") & ~F.col("_jpeg"), F.lit(False))
    return declared.select(
        "container",
        F.when(only_jpg, F.lit("jpg")).otherwise(F.lit("jpeg")).alias("jpeg_extension"),
    )


def rewrite_content_types(
    content_types: DataFrame, renames: DataFrame, extensions: DataFrame
) -> DataFrame:
    """Declarations after the renames.

    Overrides of renamed parts go; the JPEG default comes where a container
    with renames lacks it.  ``extensions`` is ``container, jpeg_extension``.
    """
    gone = renames.select(
        "container",
        F.lit("override").alias("kind"),
        F.concat(F.lit("/"), "part_name").alias("key"),
    )
    kept = content_types.join(gone, ["container", "kind", "key"], "left_anti")
    return kept.unionByName(missing_defaults(content_types, renames, extensions))


def missing_defaults(
    content_types: DataFrame, renames: DataFrame, extensions: DataFrame
) -> DataFrame:
    """The ``Default`` declarations that containers with renames still lack."""
    touched = renames.select("container").distinct()
    wanted = (
        extensions.join(touched, "container", "left_semi")
        .select(
            "container",
            F.lit("default").alias("kind"),
            F.col("jpeg_extension").alias("key"),
            F.lit("image/jpeg").alias("content_type"),
        )
    )
    have = content_types.select("container", "kind", "key")
    added = wanted.join(have, ["container", "kind", "key"], "left_anti")
    return added.withColumn("pos", F.lit(None).cast("int")).select(*content_types.columns)
