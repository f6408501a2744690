"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    arc,
    chat,
    crf,
    crosspolytope,
    decontaminate,
    forest,
    langid,
    ledger,
    licences,
    packing,
    repair,
    sharding,
    treap,
)
from .tables import held_out, read, scratch_dir, stored

KEEP = 0.7


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in a document."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back, and one that speaks the template's own language."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.with_loss(chat.formatted(rows.unionByName(extra))))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through legacy archives to WARC, read back."""
    return arc.archived(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every hundredth vector."""
    return crosspolytope.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return licences.scanned(read(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of the corpus's mixture."""
    return sharding.interleaved(read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = crf.fit(docs, read(spark, sf_dir, "labels"))
    return crf.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= KEEP).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    return langid.identified(docs.select("doc_id", "text"), langid.fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_bits").alias("bits"), F.col("lang_rejected").alias("rejected"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    how = forest.Forest(shingle=3, percent=85)
    return forest.near_duplicates(read(spark, sf_dir, "documents"), how).withColumnRenamed("id", "doc_id")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = read(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("long"))
    done = repair.summarised(repair.repaired(repair.damaged(rows))).withColumnRenamed("conv_id", "repaired_id")
    every = rows.select("conv_id").distinct()
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").drop("repaired_id").fillna(
        {**none, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return treap.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and the current policy's verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    entries = stored(ledger.ledger(docs), f"{scratch_dir(spark)}/ledger")
    return entries.withColumns({"base_failed": ledger.failed(ledger.BASE), "kept": ~ledger.failed(ledger.CURRENT)})


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_chat_format, op3_arc_to_warc, op4_cross_polytope, op5_licence_scan, op6_shard, op7_quality,
    op8_language, op9_pack, op10_near_duplicates, op11_repair, op12_ranked_search, op13_quality_rules)}
