"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import scratch_dir, stored

#: Parts of the shuffle order of one source, and of the interleaved order, that are ranked on their own.
PARTS = 4096


def _placed(rows: DataFrame, keys: list[str], part: Column, order: list, name: str) -> DataFrame:
    """0-based place of each row among those of equal ``keys`` by ``part`` and then ``order``.

    Rows are numbered within (keys, part) only; the number of rows in earlier
    parts is added from counts, of which a key has ``PARTS`` at most.  So no
    task sorts a whole source.
    """
    rows = rows.withColumn("part", part)
    counts = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)))
    return numbered.join(counts, [*keys, "part"]).withColumn(
        name, F.col("own") - 1 + F.col("before")).drop("own", "before", "part")


def interleaved(docs: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, source, position, shard, slot) of every row.

    Rows are shuffled within their source by a hash of seed and id, take the
    fractional rank (rank + 1/2) / rows of the source, and are sorted by it; the
    sequence is cut into ``shards`` runs whose lengths differ by at most one
    (law ``rows``), so each holds every source in proportion, to within a row or
    two.  ``slot`` is the place within the shard.

    Texts are only measured, not moved.  A null source is a source of its own;
    a null text has no bytes; ties between repeated rows are broken by their
    size and checksum, and rows equal in all of these are interchangeable.
    """
    base = scratch_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("stratum"), "source",
    ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    rows = stored(rows, f"{base}/measured")
    tie = ["doc_id", "size", "text_crc32"]
    # The 12 upper bits of the shuffle key, in its order.
    part = F.shiftright("key", 52)
    ranked = _placed(rows, ["stratum"], part, ["key", *tie], "rank")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
    ranked = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("rank") + 0.5) / F.col("rows"))
    ranked = stored(ranked.drop("rank", "rows"), f"{base}/ranked")
    part = F.floor(F.col("fraction") * PARTS).cast("int")
    placed = _placed(ranked.withColumn("all", F.lit(0)), ["all"], part, ["fraction", "stratum", "key", *tie], "position")
    total = rows.count()
    # Shard s begins at floor(s * total / shards): whole numbers, exact for any size.
    shard = F.expr(f"cast(((position + 1) * {shards} - 1) div {max(total, 1)} as int)")
    return placed.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"position - (shard * {total}L) div {shards}")).select(
        "doc_id", "size", "text_crc32", "source", "position", "shard", "slot")
