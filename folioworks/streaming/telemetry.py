"""Device responses as a stream appended to tables with locked columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import readings as rd
from ..plans.telemetry import column_codes, take_in
from ..sources.status import no_hints, stream_status

HEADER_SCHEMA = "device_id string, codes array<string>, run string, batch_id long"


@dataclass(frozen=True)
class TelemetryTables:
    """Where the tables of one intake lie; all are partitioned by ``run`` (a
    stream's checkpoint has its own) and ``batch_id``."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def headers(self, spark: SparkSession) -> DataFrame:
        """All locked headers."""
        return spark.read.schema(HEADER_SCHEMA).parquet(self.path("headers"))

    def headers_without(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame:
        """Headers locked by other runs, and by this one before the batch."""
        own = (F.col("run") == run) & (F.col("batch_id") >= batch_id)
        try:
            return self.headers(spark).filter(~own)
        except AnalysisException as missing:  # nothing has been stored yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], HEADER_SCHEMA)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The wide rows; batches may know different columns."""
        return spark.read.option("mergeSchema", "true").parquet(self.path("rows")).drop("run")


def run_key(checkpoint: str, query_id: str | None) -> str:
    """Names a stream's folders: its query id, which a new checkpoint renews."""
    return hashlib.sha1((query_id or checkpoint).encode()).hexdigest()[:16]


def batch_folder(folder: str, run: str, batch_id: int) -> str:
    """Each batch of each run owns a folder; a repeated batch replaces it."""
    return f"{folder}/run=r{run}/batch_id={batch_id}"


def _store(df: DataFrame, folder: str, run: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(folder, run, batch_id))


def append_batch(
    responses: DataFrame,
    batch_id: int,
    tables: TelemetryTables,
    hints: DataFrame,
    codes: Sequence[str] | None = None,
    tenths: Sequence[str] = fv.TENTHS_CODES,
    context: str = "status",
    run: str = "",
) -> None:
    """Add one batch of a run.  Its own headers do not count when it is repeated."""
    spark = responses.sparkSession
    intake = take_in(responses, hints, context, tenths)
    known = tables.headers_without(spark, f"r{run}", batch_id)
    fresh = rd.derive_headers(intake.readings).join(known, "device_id", "left_anti")
    _store(fresh, tables.path("headers"), run, batch_id)
    headers = tables.headers_without(spark, f"r{run}", batch_id + 1)
    wanted = column_codes(headers) if codes is None else list(codes)
    _store(rd.lock_columns(intake.readings, headers, wanted), tables.path("rows"), run, batch_id)
    _store(rd.drift(intake.readings, headers), tables.path("drift"), run, batch_id)
    _store(intake.errors, tables.path("errors"), run, batch_id)
    _store(intake.empty, tables.path("empty"), run, batch_id)


def run_telemetry(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    codes: Sequence[str] | None = None,
    tenths: Sequence[str] = fv.TENTHS_CODES,
    hints: DataFrame | None = None,
    context: str = "status",
    max_files_per_trigger: int | None = None,
) -> TelemetryTables:
    """Take in everything that has landed in ``source`` since the last run.

    The header table is the only state, and outlives the checkpoint: a run with a
    new one adds to the tables.  Every table is written per batch, so
    a batch that is run again after a failure leaves the same rows.  ``hints``
    (``code, hint``) are added to the texts of errors.
    """
    tables = TelemetryTables(target)
    known_hints = no_hints(spark) if hints is None else hints

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            run = run_key(checkpoint, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
            append_batch(batch, batch_id, tables, known_hints, codes, tenths, context, run)
        finally:
            batch.unpersist()

    query = (
        stream_status(spark, source, max_files_per_trigger)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return tables
