"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioworks.llm import queries
from folioworks.llm.treap import Ranking, ranked

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, top=50):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_all, words = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, own in asked.items():
        scored = []
        for i, t in docs:
            m = 50 + 50 * len(t) * n_all // words
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m))
                        for x in own if x in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out |= {(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])}
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.01)), 900)}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 90)))) for k in range(700)]
    docs += [(k, docs[3][1].upper() + "!") for k in range(2000, 2120)]  # ties beyond the last place
    docs += [(5, docs[5][1]), (None, docs[3][1]), (None, docs[9][1]), (9000, None), (9001, ""), (9002, " -- \n"),
             (9003, " ".join(word() for _ in range(30_000))), (9004, "Ünï_çødé wörd"), (-4, "x" * 70_000)]
    items = [(k, docs[3 * k][1]) for k in range(40)] + [(40, None), (41, ""), (42, "nowhere"), (43, "wörd, ünï"), (None, "w1 w2"),
                                                        (0, "w7 w8"), (0, "w7 w8"), (44, " ".join(word() for _ in range(3000)))]
    return docs, items


@pytest.mark.parametrize("how", [Ranking(), Ranking(top=7, block_postings=900, block_documents=64, batch=3), Ranking(item_bytes=2000)])
def test_equals_scoring_everything(spark, documents, case, how):
    docs, items = case
    table = documents(docs).repartition(3).withColumns({"rank": F.lit(1), "score": F.lit(2), "item_id": F.lit(3), "n": F.lit(4)})
    got = [tuple(r) for r in ranked(table, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(0)), how).collect()]
    assert len(got) == len(set((r[0], r[1]) for r in got))
    assert set(got) == brute(docs, items, how.top)


def test_empty_tables(spark, documents, case):
    docs, items = case
    table, asked = documents(docs), spark.createDataFrame(items, ITEMS)
    assert ranked(table.limit(0), asked).count() == 0
    assert ranked(table, asked.limit(0)).count() == 0
    assert ranked(table, asked.filter("item_id = 40")).count() == 0


def test_query(spark, tmp_path, documents, case):
    docs, items = case
    documents(docs).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op12_ranked_search(spark, str(tmp_path))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert {tuple(r) for r in out.collect()} == brute(docs, items)
