"""Device readings held as VARIANT values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .columns import ColumnOrName, col

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def is_number(value: ColumnOrName) -> Column:
    """Integer or float; a boolean is not a number here."""
    return F.schema_of_variant(col(value)).rlike(_NUMBER)


def tenth(value: ColumnOrName) -> Column:
    """``value / 10`` at one decimal, rounding the stored double half-even.

    ``round`` rounds the shortest decimal text half-up, which differs on values
    such as 0.25; ``format_number`` rounds the exact double.
    """
    text = F.format_number(col(value) / F.lit(10.0), 1)
    return F.translate(text, ",", "").cast("double")


def rescaled(
    code: ColumnOrName, value: ColumnOrName, codes: Sequence[str] = fv.TENTHS_CODES
) -> Column:
    """Divide listed numeric readings by ten, pass everything else through."""
    number = F.try_variant_get(col(value), "$", "double")
    listed = col(code).isin(list(codes)) & is_number(value)
    return F.when(listed, tenth(number).cast("variant")).otherwise(col(value))


def poll_stamp(polled_at: ColumnOrName) -> Column:
    """Arrival time to the second, as local time without a zone."""
    arrived = F.coalesce(col(polled_at), F.localtimestamp())
    return F.date_format(arrived, fv.STAMP_PATTERN)
