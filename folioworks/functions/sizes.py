"""Sizes, savings and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, col


def fmt_mb(n_bytes: ColumnOrName) -> Column:
    """MiB with one decimal, dot for thousands and comma for the decimal."""
    text = F.format_number(col(n_bytes) / F.lit(1048576.0), 1)
    return F.concat(F.translate(text, ",.", ".,"), F.lit(" MB"))


def reduction_pct(before: ColumnOrName, after: ColumnOrName) -> Column:
    b = col(before).cast("double")
    a = col(after).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(
        (F.lit(1.0) - F.try_divide(a, b)) * F.lit(100.0)
    )


def fmt_percent(value: ColumnOrName, digits: int = 1) -> Column:
    """Fixed decimals without thousands separators."""
    return F.translate(F.format_number(col(value), digits), ",", "")


def smaller(old: ColumnOrName, new: ColumnOrName) -> Column:
    """First pass: any saving at all."""
    return col(new) < col(old)


def small_enough(old: ColumnOrName, new: ColumnOrName, min_saving: float) -> Column:
    """Second pass: a saving of at least ``min_saving``."""
    return ~(col(new) > col(old) * F.lit(1 - min_saving))


def resized(side: ColumnOrName, longest: ColumnOrName, limit: int) -> Column:
    """One side after fitting the longest one into ``limit`` pixels."""
    scale = F.lit(float(limit)) / col(longest)
    scaled = F.greatest(F.lit(1), F.rint(col(side) * scale).cast("int"))
    return F.when(col(longest) <= limit, col(side).cast("int")).otherwise(scaled)
