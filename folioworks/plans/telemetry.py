"""One batch of device responses turned into rows, drift, errors and headers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import readings as rd


@dataclass(frozen=True)
class Intake:
    readings: DataFrame
    errors: DataFrame
    empty: DataFrame


def take_in(
    responses: DataFrame,
    hints: DataFrame,
    context: str,
    tenths: Sequence[str] = fv.TENTHS_CODES,
) -> Intake:
    """Separate good responses from failed and empty ones; rescale the good."""
    ok, failed = rd.split_responses(responses)
    polls, empty = rd.non_empty(ok)
    errors = rd.explain_errors(
        failed.select(*rd.POLL, F.col("code"), "msg"), hints, context
    )
    return Intake(
        readings=rd.rescale(rd.explode_readings(polls), tenths),
        errors=errors,
        empty=empty.select(*rd.POLL),
    )


def column_codes(headers: DataFrame) -> list[str]:
    """The columns a table under these headers needs.

    Column names are schema and so must be known to the driver.  As for any
    pivot, ``spark.sql.pivotMaxValues`` is the most a table can have; pass an
    explicit choice of codes where devices have more between them.
    """
    limit = int(headers.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    codes = headers.select(F.explode("codes").alias("code")).distinct()
    found = codes.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"headers name more than {limit} codes; choose the columns")
    return sorted(row.code for row in found)
