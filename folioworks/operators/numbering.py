"""Position of each row in a total order, without sorting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_dir, written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these


def with_progress(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``ordinal`` (1-based) and ``total`` in the order of ``order``.

    The rows are range-sorted and stored once, which fixes which row lies where.
    A row's position is the number of rows in the earlier ranges plus its
    position in its own; only one count per range meets in one place.
    """
    spark = rows.sparkSession
    ranged = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = written(ranged, scratch_dir(spark))
    placed = stored.withColumn("_range", F.shiftrightunsigned("_id", _ROW_BITS))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range: as many as the sort had partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = sizes.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything).alias("total"),
    )
    within = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn("ordinal", F.col("_before") + within + 1)
        .drop("_id", "_range", "_before")
    )
