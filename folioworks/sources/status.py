"""Device status payloads: lists of code/value pairs with values of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUS_SCHEMA = (
    "poll_id string, device_id string, polled_at timestamp_ntz, success boolean, "
    "code long, msg string, result array<struct<code string, value variant>>"
)
#: What a service's error codes mean for its users: a table of the caller's.
HINT_SCHEMA = "code long, hint string"


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """Landed responses, one JSON object per line."""
    return spark.read.schema(STATUS_SCHEMA).json(folder)


def stream_status(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(STATUS_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder)


def no_hints(spark: SparkSession) -> DataFrame:
    """For a service without known remedies: errors are told by code and text alone."""
    return spark.createDataFrame([], HINT_SCHEMA)
