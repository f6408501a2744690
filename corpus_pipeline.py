"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.

In every stage: rows are the units, whatever their ids (null and repeated ones,
too); other columns of ``docs`` are kept as they are, also those named like
something a stage computes; texts of any length are read whole; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import crf, decontaminate, forest, langid, packing
from folioworks.llm.tables import free_name, read, scratch_dir, stored

KEEP = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good on the whole.

    A null text, an empty one or one of white space has no line and goes; equal
    texts get the same verdict, and a score of exactly ``KEEP`` stays.
    """
    model = crf.fit(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return crf.scored(docs, model, score).filter(F.col(score) >= KEEP).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the corpus.

    A text that is null or without letters goes; equal texts get the same verdict, and
    of two languages that fit alike the first by name is taken, which rejects nothing.
    """
    prefix = free_name(docs, "lang", "_pred", "_score", "_bits", "_rejected")
    out = langid.identified(docs, langid.fit(docs), prefix)
    return out.filter(~F.col(f"{prefix}_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id.

    Rows whose id is null or another row's, too, are told apart by numbers above
    all ids: each is compared by its own text, equal rows are copies of each other,
    and a row with an id of its own goes before them.  Null and empty texts are
    copies of nothing.
    """
    unit = free_name(docs, "unit")
    again = stored(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), f"{scratch_dir(spark)}/again")
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    above = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    numbered = docs.join(again, same, "left_semi").withColumn(unit, F.lit(above) + F.monotonically_increasing_id())
    numbered = stored(numbered, f"{scratch_dir(spark)}/numbered")  # numbers must not change
    units = docs.join(again, same, "left_anti").withColumn(unit, F.col("doc_id").cast("long")).unionByName(numbered)
    copies = forest.near_duplicates(units, id_col=unit).filter("not kept").select(F.col("id").alias(unit))
    copies = stored(copies, f"{scratch_dir(spark)}/copies")  # its size is known to the join
    return units.join(copies, unit, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    A null or empty text holds none.  A map over the rows, each judged by its own text.
    """
    return decontaminate.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is one piece, its end token; repeated rows are packed each
    by itself, pieces of equal length in the order of their ids.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The stages learn models, estimate similarity and tokenise: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    base = scratch_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return docs
