"""Search of test items against scoring every item for every passage."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioworks.llm import words as W
from folioworks.llm.decontaminate import Search, build_index, contaminated, retrieve, uncontaminated, windows

ITEMS = "item_id long, text string"


def test_retrieval_equals_scoring_everything():
    rng = random.Random(1)
    items = [" ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    texts = [" ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(0, 900))) for _ in range(20)]
    texts[3] += " " + items[7]
    how = Search(threshold=0.45, block=4)
    index = build_index(list(range(60)), items, how)
    data, offsets = W.utf8(pa.array(texts))
    hashes, _, _, rows = W.words(data, offsets, W.ALPHANUMERIC)
    window, item, score = retrieve(index, hashes, rows, how)
    got = {(int(w), int(i)): round(float(s), 9) for w, i, s in zip(window, item, score)}
    weight = {(int(t), int(i)): w for t in range(len(index.terms))
              for i, w in zip(index.items[index.at[t] : index.at[t + 1]], index.weights[index.at[t] : index.at[t + 1]])}
    expected, (first, count) = {}, windows(rows, index.stride)
    for r in range(len(texts)):
        for k in range(count[r]):
            start = rows[r] + k * index.stride
            terms = set(np.searchsorted(index.terms, h) for h in hashes[start : min(start + 2 * index.stride, rows[r + 1])]
                        if h in index.terms)
            for i in range(60):
                s = sum(weight.get((int(t), i), 0) for t in terms)
                if s >= how.threshold:
                    expected[int(first[r] + k), i] = round(min(float(s), 1.0), 9)
    assert got == expected and expected and index.frequent.any()


def test_finds_copies_and_leaves_clean_documents(spark, documents):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(14, 70)))) for k in range(30)] + [(90, None), (91, ""), (None, "x y")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, f"{filler(rng.randrange(0, 700))} {items[k][1].upper()}! {filler(300)}") for k in range(30)]
    docs += [(100 + k, filler(400)) for k in range(20)] + [(200, None), (201, ""), (202, filler(20_000))]
    half = items[4][1].split()
    docs.append((300, " ".join(half[: len(half) // 2]) + " " + filler(100)))  # the question alone
    found = contaminated(documents(docs).withColumn("item_id", F.lit(1)),
                         spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(30)]
    assert all(r.overlap == 1.0 and r.score > 0.99 for r in found)


def test_turns_change_nothing(spark, documents):
    """Partial copies near the threshold: what is found is the same with one index and with many."""
    rng = random.Random(7)
    word = lambda: f"v{min(int(rng.expovariate(0.01)), 500)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40)))) for k in range(200)] + [(500, ""), (501, None)]
    docs = []
    for k in range(200):
        words = items[k][1].split()
        kept = " ".join(w for w in words if rng.random() < rng.choice([0.8, 0.9, 1.0]))
        docs.append((k, " ".join([*(word() for _ in range(80)), kept, *(word() for _ in range(80))])))
    table, asked = documents(docs), spark.createDataFrame(items, ITEMS)
    how = {"threshold": 0.7, "overlap": 0.5, "part_overlap": 0.2, "run": 2}
    one, many = (sorted(map(tuple, contaminated(table, asked, Search(**how, index_bytes=n)).collect())) for n in (10**7, 900))
    assert len(one) > 50 and [(r[0], r[1], *(round(x, 9) for x in r[2:])) for r in one] == [
        (r[0], r[1], *(round(x, 9) for x in r[2:])) for r in many]
    clean = {r.doc_id for r in uncontaminated(table, asked, Search(**how, index_bytes=900)).collect()}
    assert clean == set(range(200)) - {r[0] for r in one}


def test_rows_are_judged_by_their_own_text(spark, documents):
    item = " ".join(f"i{n}" for n in range(20))
    docs = documents([(1, f"a {item} b"), (1, "nothing here"), (None, item), (None, "clean"), (2, None), (3, ""), (1, f"a {item} b")])
    docs = docs.withColumn("item_id", F.lit(5)).withColumn("clean", F.lit("x"))
    asked = spark.createDataFrame([(0, item)], ITEMS)
    out = uncontaminated(docs, asked)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [
        ("1", "nothing here"), ("2", "None"), ("3", ""), ("None", "clean")]
    assert len(contaminated(docs, asked).collect()) == 3
    assert uncontaminated(docs, asked.limit(0)).count() == 7


def test_several_turns_and_empty_tables(spark, documents):
    items = [(k, " ".join(f"i{k}x{n}" for n in range(20))) for k in range(12)]
    docs = documents([(k, items[k][1]) for k in range(12)])
    table = spark.createDataFrame(items, ITEMS)
    out = contaminated(docs, table, Search(index_bytes=300)).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(k, k) for k in range(12)]
    assert contaminated(docs, table.limit(0)).count() == 0
    assert contaminated(docs.limit(0), table).count() == 0


def test_answers_of_their_own_column(spark, documents):
    """A question without its answer is no contamination, wherever the answer's words begin."""
    part = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    asked = spark.createDataFrame(
        [(1, part("q", 30), part("a", 6)), (2, part("r", 30), None), (3, None, part("s", 12)), (4, part("t", 4), part("u", 40)), (5, None, "")],
        "item_id long, text string, solution string")
    docs = documents([(1, f"{part('q', 30)} and {part('a', 6)}"), (2, part("q", 30)), (3, part("r", 30)), (4, part("s", 12)),
                      (5, part("u", 40)), (6, f"{part('t', 4)} {part('u', 40)}"), (7, "a0 and a1")])
    found = lambda **how: sorted((r.doc_id, r.item_id) for r in contaminated(docs, asked, Search(**how)).collect())
    whole = [(1, 1), (3, 2), (4, 3), (6, 4)]
    assert found(answer="solution") == found(answer="solution", index_bytes=100) == whole
    assert (2, 1) in found() and (5, 4) not in found()  # by the question's last third
    row = contaminated(docs, asked, Search(answer="solution", part_overlap=0.0, overlap=0.5)).filter("doc_id = 2").first()
    assert (row.question_overlap, row.answer_overlap) == (1.0, 0.0)
