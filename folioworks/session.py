"""Where a job may put intermediate tables, and how wide it should be."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder of this session.

    ``spark.checkpoint.dir`` names that folder.  Only a local session without
    the setting (tests) gets a temporary one: a cluster's executors could not
    see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return registered(f"{base.rstrip('/')}/folioworks-{uuid.uuid4().hex}")


# Folders of the runs under way, by the scope that will remove them.
_scopes: list[list[str]] = []


def registered(folder: str) -> str:
    """Have the innermost scope remove ``folder`` when it ends."""
    if _scopes:
        _scopes[-1].append(folder)
    return folder


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Remove what is stored in the block's scratch folders when it ends, failed or not.

    What the block leaves behind must have been written elsewhere by then: every
    table read from a scratch folder is gone.
    """
    from .sources.files import remove_folder

    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for folder in _scopes.pop():
            remove_folder(folder)


# Parquet looks at its buffers only every 100 rows unless told otherwise; rows
# that carry a part's bytes are too large for that.
_LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "16",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "16",
}


def written(df: DataFrame, path: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once and go on from the stored rows.

    Cuts the lineage and fixes the result of steps that have side effects or
    run Python, so that a lost executor never repeats them half-way.  Steps that
    open packages have many tasks and few rows; those rows are gathered into
    files of a good size first.  Rows with contents are written where they are.
    """
    if large_rows:
        df.write.mode("overwrite").options(**_LARGE_ROWS).parquet(path)
    else:
        df.hint("rebalance").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of packages one task should have to read: a minute or so of image work,
# and still only 100,000 tasks for 100 TB.
TASK_BYTES = 1024 * 1024 * 1024


# Tasks for each core, so that a slow or well-filled one is made up for by the others.
TASKS_PER_CORE = 3


def few_tasks(spark: SparkSession) -> int:
    """Tasks that keep every core busy to the end of a step."""
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def tasks_for(containers: DataFrame) -> int:
    """Tasks for reading packages of this total size, at least ``few_tasks``."""
    total = containers.agg(F.sum("length").alias("n")).first().n or 0
    return max(few_tasks(containers.sparkSession), -(-total // TASK_BYTES))


def width(spark: SparkSession) -> int:
    """Number of tasks for steps whose input rows are small but work is not,
    where the amount of work is not known.

    Given explicitly to ``repartition``, because adaptive execution would merge
    such partitions by their byte size.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
