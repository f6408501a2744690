"""From code/value readings to wide rows under locked headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import poll_stamp, rescaled

POLL = ("device_id", "poll_id", "polled_at")
# Columns of the wide table that no reading may take.
RESERVED = (*POLL, fv.STAMP_COLUMN)


def split_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful responses and all the others."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return responses.filter(ok), responses.filter(~ok)


def non_empty(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses with at least one reading, and those without any."""
    some = F.coalesce(F.size("result") > 0, F.lit(False))
    return responses.filter(some), responses.filter(~some)


def explode_readings(responses: DataFrame) -> DataFrame:
    """One row per reading, numbered as in the payload."""
    return responses.select(
        *POLL, F.posexplode("result").alias("pos", "_reading")
    ).select(*POLL, "pos", "_reading.code", "_reading.value")


def last_per_code(readings: DataFrame, keys: Sequence[str] = POLL) -> DataFrame:
    """A code repeated within one poll keeps its last value."""
    return readings.groupBy(*keys, "code").agg(
        F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos")
    )


def rescale(readings: DataFrame, codes: Sequence[str] = fv.TENTHS_CODES) -> DataFrame:
    return readings.withColumn("value", rescaled("code", "value", codes))


def explain_errors(errors: DataFrame, hints: DataFrame, context: str) -> DataFrame:
    """Add ``message``: context, error code and text, and a hint when known.

    ``hints`` is ``code, hint``.  It is joined without a broadcast hint, so
    its real size decides.
    """
    code = F.coalesce(F.col("code").cast("string"), F.lit("None"))
    text = F.coalesce("msg", F.lit("None"))
    head = F.format_string("%s (code=%s): %s", F.lit(context), code, text)
    tail = F.concat(F.lit("\nDica: "), "hint")
    return (
        errors.join(hints, "code", "left")
        .withColumn("message", F.concat(head, F.coalesce(tail, F.lit(""))))
        .drop("hint")
    )


def stamp(polls: DataFrame) -> DataFrame:
    return polls.withColumn(fv.STAMP_COLUMN, poll_stamp("polled_at"))


def poll_maps(readings: DataFrame, keys: Sequence[str] = POLL) -> DataFrame:
    """One map of code to value for each poll, ``values``; of a repeated code the last counts.

    One aggregate whatever the number of codes; a poll's payload bounds its entries.
    Readings without a code are left out.
    """
    entry = F.struct("pos", "code", "value")
    gathered = F.collect_list(F.when(F.col("code").isNotNull(), entry))

    def later_first(x: Column, y: Column) -> Column:
        return F.when(x["pos"] > y["pos"], -1).when(x["pos"] < y["pos"], 1).otherwise(0)

    polls = readings.groupBy(*keys).agg(gathered.alias("_entries"))
    polls = polls.withColumn("_entries", F.array_sort("_entries", later_first))
    polls = polls.withColumn("_codes", F.col("_entries.code"))
    distinct = F.array_distinct("_codes")
    last = F.transform(
        distinct, lambda code: F.get("_entries", F.array_position("_codes", code).cast("int") - 1)["value"]
    )
    return polls.select(*keys, F.map_from_arrays(distinct, last).alias("values"))


def to_wide(
    readings: DataFrame, codes: Sequence[str], keys: Sequence[str] = POLL
) -> DataFrame:
    """One row per poll, one column per code, null where a code is missing.

    ``readings`` may repeat a code: the last one counts.  The columns are taken
    from one map per poll, so no separate step and no job to find the codes.
    """
    polls = poll_maps(readings, keys)
    return polls.select(*keys, *[F.col("values").getItem(c).alias(c) for c in codes])


def codes_per_poll(readings: DataFrame) -> DataFrame:
    """The sorted codes of every poll; a payload bounds their number."""
    return readings.groupBy(*POLL).agg(
        F.array_sort(F.collect_set("code")).alias("poll_codes")
    )


def derive_headers(readings: DataFrame) -> DataFrame:
    """The codes of each device's first poll, in code-point order.

    First the codes per poll, then the earliest poll per device; both combine
    before the shuffle and neither joins back.  A reading named like one of the
    table's own columns gets no column and so shows up as drift.
    """
    first = F.min_by("poll_codes", F.struct("polled_at", "poll_id"))
    reserved = F.array(*[F.lit(name) for name in RESERVED])
    return codes_per_poll(readings).groupBy("device_id").agg(
        F.array_except(first, reserved).alias("codes")
    )


def with_header(polls: DataFrame, headers: DataFrame) -> DataFrame:
    """Attach ``codes``, the header of each row's device (empty if unknown).

    One device may send most of the polls.  Headers that fit are broadcast by
    their measured size; otherwise adaptive execution splits that device's rows,
    which nothing downstream needs together.
    """
    joined = polls.join(headers.select("device_id", "codes"), "device_id", "left")
    empty = F.lit([]).cast("array<string>")
    return joined.withColumn("codes", F.coalesce("codes", empty))


def drift(readings: DataFrame, headers: DataFrame) -> DataFrame:
    """Per poll the sorted codes its device's header does not know."""
    judged = with_header(codes_per_poll(readings), headers)
    return (
        judged.withColumn("new_codes", F.array_except("poll_codes", "codes"))
        .filter(F.size("new_codes") > 0)
        .select(*POLL, "new_codes")
    )


def lock_columns(
    readings: DataFrame, headers: DataFrame, codes: Sequence[str]
) -> DataFrame:
    """Wide rows of every poll, with only the codes its device's header has.

    The readings are widened first, which leaves one row per poll to meet its
    header.  A poll with nothing but new codes still yields its empty row.
    """
    wide = with_header(to_wide(readings, codes), headers).withColumnRenamed("codes", "_header")
    values = [
        F.when(F.array_contains("_header", F.lit(c)), F.col(c)).alias(c) for c in codes
    ]
    return stamp(wide).select(*POLL, fv.STAMP_COLUMN, *values)
