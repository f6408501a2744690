"""New names for converted parts, free of collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stem

# A stem with every trailing "_conv<number>" removed.  Two parts can only
# compete for a name when these roots are equal: each new name is a stem, or a
# stem plus one such suffix, plus the extension of its container.
_SUFFIXES = r"(_conv[0-9]+)+\z"

_RENAMES = "container string, ordinal long, part_name string, new_part_name string"


def _root(name_stem: str):
    return F.regexp_replace(name_stem, _SUFFIXES, "")


def assign_names(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each candidate ``stem.ext``, or ``stem_conv2.ext``, ``_conv3``...

    ``candidates``: ``container, ordinal, part_name, jpeg_extension``, named in
    archive order; ``existing``: ``container, part_name`` of all members.

    A candidate alone with its root whose plain name is free gets it at once.
    The others, usually few, are sorted by (container, root, archive order) and
    walked in that order.  A task holds the names of one root at a time, never
    more than the directory of one archive, which opening it loads as well.
    """
    keys = ["container", "_root"]
    named = candidates.select(
        "container",
        F.col("ordinal").cast("long").alias("ordinal"),
        "part_name",
        stem("part_name").alias("_stem"),
        F.col("jpeg_extension").alias("_ext"),
    ).withColumn("_root", _root("_stem"))
    taken = existing.select("container", "part_name").withColumn(
        "_root", _root(stem("part_name"))
    )
    # Existing names matter when they carry an extension a candidate may get.
    targets = taken.filter(
        F.lower(F.substring_index("part_name", ".", -1)).isin("jpeg", "jpg")
    )
    in_group = named.groupBy(*keys).agg(F.count("*").alias("_n"))
    blocked = targets.select(*keys).distinct().withColumn("_blocked", F.lit(True))
    contested = in_group.join(blocked, keys, "left").filter(
        (F.col("_n") > 1) | F.col("_blocked").isNotNull()
    ).select(*keys)

    plain = named.join(contested, keys, "left_anti").select(
        "container",
        "ordinal",
        "part_name",
        F.concat("_stem", F.lit("."), "_ext").alias("new_part_name"),
    )
    rows = (
        targets.join(contested, keys, "left_semi")
        .select(*keys, F.lit(-1).cast("long").alias("ordinal"), "part_name",
                F.lit(None).cast("string").alias("_stem"), F.lit(None).cast("string").alias("_ext"))
        .unionByName(named.join(contested, keys, "left_semi"))
    )
    # Both sides of the union may come from joins dealt by these keys.  Spark then drops a
    # repartition by the same keys, and adaptive execution merges each side's partitions
    # for itself: a root's taken names and its candidates would be in different tasks.
    # A hash of the keys is no such key.
    walked = (
        rows.repartition(F.xxhash64(*keys))
        .sortWithinPartitions(*keys, "ordinal")
        .mapInPandas(_walk, _RENAMES)
    )
    return plain.unionByName(walked)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, taken, next_suffix = None, set(), {}
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False, name=None):
            container, root, ordinal, part_name, name_stem, extension = row
            if (container, root) != group:
                group, taken, next_suffix = (container, root), set(), {}
            if ordinal < 0:
                taken.add(part_name)
                continue
            # Names are never given back, so the search for one stem resumes
            # where it last ended.
            suffix = next_suffix.get(name_stem, 1)
            while True:
                tail = "" if suffix == 1 else f"_conv{suffix}"
                new_name = f"{name_stem}{tail}.{extension}"
                suffix += 1
                if new_name not in taken:
                    break
            next_suffix[name_stem] = suffix
            taken.add(new_name)
            out.append((container, ordinal, part_name, new_name))
        yield pd.DataFrame(
            out, columns=["container", "ordinal", "part_name", "new_part_name"]
        )
