"""The stages by themselves and together."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf_dir), f"{pipeline.scratch_dir(spark)}/{name}")
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= left and len(kept) > 0.8 * len(left), name
        left = kept
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_an_empty_table(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert dict(pipeline.STAGES)[name](spark, docs, sf_dir).count() == 0


ITEM = " ".join(f"question{n}" for n in range(20)) + " " + " ".join(f"answer{n}" for n in range(12))
PROSE = " ".join(f"Some words of text number {n} stand here, one after another, without much sense." for n in range(12))
LONG = " ".join(f"Sentence {n} of a rather long document goes on and on." for n in range(9000))


@pytest.fixture()
def corner(spark, tmp_path):
    """Tables with nulls, ties, repeated rows, empty and long texts, and names that the stages use themselves."""
    texts = [(1, PROSE), (1, PROSE), (2, PROSE), (2, "Quite another text about rivers, hills and birds that live in the woods. " * 3),
             (3, None), (4, ""), (5, " \n"), (None, PROSE), (None, "A fourth text, of the sea and of ships that go far away. " * 3),
             (6, f"{PROSE[:300]} {ITEM}"), (None, ITEM), (7, LONG), (8, "12 34 56"), (9, "\U0001f642 \U0001f642"), (10, "\u0301\u0302")]
    rows = [(i, t, "en" if k % 2 else "xx", "s", None if t is None else len(t), k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int")
    for name in ("quality_score", "lang_pred", "Lang_Rejected", "unit", "id", "label", "component_id", "kept", "item_id", "piece", "group"):
        docs = docs.withColumn(name, F.lit("own"))
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_every_kind_of_row(spark, corner, name):
    docs, sf_dir = corner
    out = dict(pipeline.STAGES)[name](spark, docs, sf_dir)
    if name == "packing":
        pieces = out.collect()
        assert {r.doc_id for r in pieces if r.piece == 0} == {r.doc_id for r in docs.collect()}
        assert sum(r.piece == 0 for r in pieces) == docs.count()
        return
    assert out.columns == docs.columns
    rows = out.collect()
    kept = {r.row for r in rows}
    assert len(kept) == len(rows) and all(r.quality_score == r.Lang_Rejected == r.unit == r.kept == "own" for r in rows)
    if name == "near_duplicates":  # (1, PROSE) twice, (2, PROSE) and a null id's are one class; no other row goes
        assert len(kept & {0, 1, 2, 7}) == 1 and kept >= set(range(15)) - {0, 1, 2, 7}
    if name == "decontamination":
        assert kept == set(range(15)) - {9, 10}
    if name == "language":
        assert not kept & {4, 5, 6, 12, 13, 14}


def test_run_is_the_chain_of_its_stages(spark, corner):
    docs, sf_dir = corner
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf_dir), f"{pipeline.scratch_dir(spark)}/{name}")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = sorted(map(str, docs.select(*key).collect()))
    assert sorted(map(str, pipeline.run(spark, sf_dir).select(*key).collect())) == want
