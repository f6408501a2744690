"""The first pass over packages as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.recode import Codec
from ..plans.first_pass import run_first_pass
from ..session import scratch_dir, scratch_scope, written
from ..settings import DEFAULTS, Settings
from ..sources.listing import FILES, stream_files, unseen
from ..sources.packages import named_containers
from .telemetry import batch_folder, run_key


def run_corpus(
    spark: SparkSession,
    source: str,
    target: str,
    results: str,
    checkpoint: str,
    codec: Codec,
    settings: Settings = DEFAULTS,
    max_files_per_trigger: int | None = None,
) -> None:
    """Reduce the packages that have appeared since the last run.

    Only file names and sizes enter the stream.  A batch lists ``source`` in tasks
    and leaves out the files that the log below ``checkpoint`` has, with the same
    time and size.  The outcomes go to ``results`` under the batch's ``run`` (see
    ``run_key``) and ``batch_id``, at most ``max_files_per_trigger`` packages at a
    time, each time as a ``chunk``.  Publishing renames files into place, so what
    is repeated after a failure replaces its own output.  What the steps store
    is removed when they have ended, also after a failure: nothing stays but the
    packages, the outcomes and the log.
    """
    log = f"{checkpoint.rstrip('/')}/seen"

    def process(batch: DataFrame, batch_id: int) -> None:
        run = run_key(checkpoint, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        chunk = _chunks(spark, batch_folder(log, run, batch_id))  # some, if it is repeated
        while True:
            with scratch_scope():
                new = unseen(named_containers(batch, settings.suffix), _seen(spark, log))
                if max_files_per_trigger is not None:
                    new = new.orderBy("container").limit(max_files_per_trigger)
                new = written(new, scratch_dir(spark))
                if new.isEmpty():
                    return
                done = run_first_pass(spark, source, target, codec, settings, new)
                done.outcomes.write.mode("overwrite").parquet(
                    f"{batch_folder(results, run, batch_id)}/chunk={chunk}"
                )
                new.select("path", "modificationTime", "length").coalesce(1).write.mode(
                    "overwrite"
                ).parquet(f"{batch_folder(log, run, batch_id)}/chunk={chunk}")
            chunk += 1

    query = (
        stream_files(spark, source)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _logged(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a folder of the log holds; nothing before the first batch."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _seen(spark: SparkSession, log: str) -> DataFrame:
    """The files that have been taken."""
    return _logged(spark, log, FILES).select("path", "modificationTime", "length")


def _chunks(spark: SparkSession, folder: str) -> int:
    """How many chunks of a batch the log has."""
    return _logged(spark, folder, f"{FILES}, chunk int").select("chunk").distinct().count()
