"""Targets of references between parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, col


def is_internal(target: ColumnOrName) -> Column:
    t = col(target)
    external = t.startswith("http://") | t.startswith("https://")
    return t.isNotNull() & (t != "") & ~external


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*?)/+[^/]*\z", 1)


def _normalised(path: Column) -> Column:
    """Collapse ``.``, ``..`` and repeated slashes; unpoppable ``..`` stay."""

    def step(stack: Column, segment: Column) -> Column:
        depth = F.size(stack)
        top = F.try_element_at(stack, F.lit(-1))
        keep = (segment != "..") | (depth == 0) | (top == "..")
        return (
            F.when(segment.isin("", "."), stack)
            .when(keep, F.array_append(stack, segment))
            .otherwise(F.slice(stack, F.lit(1), depth - 1))
        )

    start = F.lit([]).cast("array<string>")
    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.regexp_replace(joined, r"^\z", ".")


def resolve_target(rels_path: ColumnOrName, target: ColumnOrName) -> Column:
    """Path inside the package that ``target`` means.

    Relative targets start at the folder of the part that owns the ``.rels``
    file, which is the parent of the folder holding that file.
    """
    t = col(target)
    owner = _folder(_folder(col(rels_path)))
    # Normalising drops the empty segment an empty owner leaves.
    relative = _normalised(F.concat(owner, F.lit("/"), t))
    return F.when(t.startswith("/"), F.ltrim(t, F.lit("/"))).otherwise(relative)


def rewrite_target(target: ColumnOrName, new_part: ColumnOrName) -> Column:
    """Keep the prefix as written, replace the last path segment."""
    prefix = F.regexp_extract(col(target), r"(?s)^.*/", 0)
    return F.concat(prefix, F.substring_index(col(new_part), "/", -1))
