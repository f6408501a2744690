"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from ..session import scratch_dir, width

__all__ = ["extended", "forget_encoder", "free_name", "held_out", "read", "release_memory", "scratch_dir", "stored", "width"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from: crc32(id as text) mod 4 is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def extended(docs: DataFrame, more: str) -> StructType:
    """The schema of ``docs`` with the columns of a DDL string behind its own."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])


def free_name(docs: DataFrame, wanted: str, *endings: str) -> str:
    """``wanted``, with as many underscores as it takes that no column has that name
    (with none of the ``endings``), in any case."""
    taken = {c.lower() for c in docs.columns}
    while any(f"{wanted}{end}".lower() in taken for end in endings or ("",)):
        wanted += "_"
    return wanted


def forget_encoder() -> None:
    """Drops the words that this worker remembers for packing, and gives freed memory back.

    Workers serve all stages in turn; tasks of the others call this first, so that
    their arrays and those words do not share a worker's memory.
    """
    packing = sys.modules.get("folioworks.llm.packing")
    if packing:
        packing.encoder_of.cache_clear()
    release_memory()


def release_memory() -> None:
    """Gives what this worker has freed back to the system: Arrow's pool and, with glibc, the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
