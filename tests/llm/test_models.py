"""Quality, language, licences and neighbours: held-out accuracy and brute force."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import crf, crosspolytope, langid, licences
from folioworks.llm.tables import held_out, read

ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "123 !!!"), (9005, "Zx\n" * 20_000), (9006, "ß"), (9007, "🙂 𝔘nï")]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    odds, turn, lines = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    good, pairs = crf.marginals(odds, lines, turn)
    expected, both = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(lines[:-1], lines[1:]):
        ways = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([math.exp(sum(odds[a + k] * y for k, y in enumerate(w)) + sum(turn[x, y] for x, y in zip(w, w[1:]))) for w in ways])
        weight /= weight.sum()
        for p, w in zip(weight, ways):
            expected[a:b] += p * np.array(w)
            for x, y in zip(w, w[1:]):
                both[x, y] += p
    assert np.allclose(good, expected) and np.allclose(pairs, both)


def test_quality_on_held_out_rows(spark, documents):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = crf.fit(docs, labels)
    out = crf.scored(docs.withColumn("quality_score_before", F.lit(1)), model).filter(held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    assert ((out["quality_score"] >= 0.7) == (out["quality"] == 1)).mean() > 0.93
    odd = {r.doc_id: r.quality_score for r in crf.scored(documents(ODD), model).collect()}
    assert odd[9001] == odd[9002] == odd[9003] == 0 and all(0 <= s <= 1 for s in odd.values())
    assert crf.scored(docs.limit(0), model).count() == 0
    empty = crf.fit(docs, labels.limit(0))
    assert {round(r.quality_score, 6) for r in crf.scored(docs.limit(5), empty).collect()} == {0.5}


def test_every_labelled_row_teaches_quality(spark, documents):
    good, bad = "A plain line of words.\n" * 3, "BUY NOW!!! ||| $$$ WIN!!!\n" * 3
    docs = documents([(k, good if k % 2 else bad) for k in range(80)] + [(1000, "#;#;#\n" * 900)])
    labels = docs.selectExpr("doc_id", "case when doc_id = 1000 then 0 else doc_id % 2 end as quality")
    few, more = (crf.fit(docs, x, crf.Training(rounds=20)) for x in (labels.filter("doc_id < 1000"), labels))
    assert not np.allclose(few.weights, more.weights)  # a text of 900 lines counts
    grouped = crf.fit(docs, labels, crf.Training(documents=20, rounds=20))
    score = {r.doc_id: r.quality_score for r in crf.scored(docs, grouped).collect()}
    assert score[1] >= 0.7 > score[0] and score[1000] < 0.7


def test_quality_moves_no_texts(spark, documents, monkeypatch, tmp_path):
    # Long lines without repeats: a text is far larger than its lines' features.
    docs = documents([(k, " ".join(f"{k}{'!' * (k % 2)}-{j * j * 7919 + k}" for j in range(9000))) for k in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    monkeypatch.setattr(crf, "scratch_dir", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        crf.fit(docs, labels, crf.Training(rounds=5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert stored < 200_000 < docs.agg(F.sum("n_chars")).first()[0] / 20


def test_language_on_held_out_rows(spark, documents):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    out = langid.identified(docs, model).filter(held_out(F.col("doc_id"))).toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.99 and out["lang_rejected"].mean() < 0.01
    odd = {r.doc_id: r for r in langid.identified(documents(ODD), model).collect()}
    assert {i for i, r in odd.items() if r.lang_pred == "und"} == {9001, 9002, 9003, 9004}
    assert all(odd[i].lang_rejected and odd[i].lang_score == 0 for i in (9001, 9002, 9003, 9004))
    strange = documents([(1, "qxj zqk wvx kjq xzv " * 60)])
    assert langid.identified(strange, model).first().lang_rejected
    nothing = langid.fit(docs.limit(0))
    assert langid.identified(docs.limit(3), nothing).filter("lang_pred <> 'und'").count() == 0


def test_every_training_text_counts_for_rejection(documents):
    text = "der hund und die katze und der mann " * 9
    plain = [(k, text + "aber " * (k % 7), "de") for k in range(5000)]
    odd = [(k, "wxq jyq qyx " * 25, "de") for k in range(5000, 5040)]
    model = langid.fit(documents([*plain, *odd]))
    seen = langid.identified(documents([*plain, *odd]), model)
    bits = seen.filter(~held_out(F.col("doc_id"))).toPandas()["lang_bits"].to_numpy()
    assert np.isclose(model.mean[0], bits.mean(), rtol=1e-9) and np.isclose(model.spread[0], bits.std(), rtol=1e-6)
    texts = [t for _, t, _ in [*plain[:7], *odd[:1]]]
    entropy, letters = model.entropies(texts)
    most = model.surprise(entropy, np.zeros(8, np.int64), letters).max()
    assert np.isclose(model.cut, 2.5 * max(most, 4.0)) and most > 4


def test_model_sums_to_one(documents):
    text = "der hund und die katze und der mann " * 5
    model = langid.fit(documents([(k, text + "aber" * k, "de") for k in range(8)]))
    letters = model.codes[1]
    for context in ("", "u", "un", "und", "zzz", "der"):
        packed = 0
        for c in context:
            packed = (packed << 16) | ord(c)
        p = np.exp2(model.scores_of((np.int64(packed) << np.int64(16)) | letters))[:, 0].sum()
        assert 0.9 < p <= 1.0 + 1e-6  # what is missing is kept for characters never seen


def test_a_small_limit_of_entries_changes_no_score(spark, documents):
    rows = [(k, "der hund und die katze " * 9 + "aber" * k, "de") for k in range(9)] + [(k, "le chat et le chien " + "ou" * k, "fr") for k in range(20, 29)]
    docs, odd = documents(rows), documents([*rows, *ODD, (1, "katze chat zzz")]).withColumn("best", F.lit("x"))
    sent, tabled = (langid.fit(docs, langid.Training(entries=n)) for n in (2_000_000, 20))
    key = ["doc_id", "text"]
    a, b = (langid.identified(odd, m).toPandas().sort_values(key).reset_index(drop=True) for m in (sent, tabled))
    assert isinstance(tabled, langid.TableModel) and list(a.columns) == list(b.columns)
    for c in ("doc_id", "lang_pred", "lang_rejected", "best"):
        assert (a[c] == b[c]).all()
    assert np.allclose(a["lang_bits"], b["lang_bits"], atol=1e-4) and np.allclose(a["lang_score"], b["lang_score"], atol=1e-3)
    # Nothing is pruned: each context of the table sums to one over the letters and those never seen.
    letters = [r.code for r in tabled.scores[1].collect()]
    for context in ("", "u", "un", "und", "zzz"):
        packed = 0
        for c in context:
            packed = (packed << 16) | ord(c)
        codes = spark.createDataFrame([((packed << 16) | x,) for x in letters], "code long")
        p = np.exp2(np.array([r.p for r in tabled.scores_of(codes).collect()])).sum(axis=0)
        assert ((0.9 < p) & (p <= 1 + 1e-6)).all()


def test_pieces_of_a_long_text_make_no_difference(documents, monkeypatch):
    model = langid.fit(documents([(k, "le chat et le chien sont la", "fr") for k in range(8)]))
    text = ["le chien est la et " * 200, "chat"]
    whole = model.entropies(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    cut = model.entropies(text)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(1)
    templates = [rng.integers(0, 4, n).tolist() for n in (12, 7, 20)]
    automaton = licences.Automaton(templates)
    tokens = rng.integers(0, 5, 300).tolist()

    def known(part):
        return any(t[k : k + len(part)] == part for t in templates for k in range(len(t)))

    longest = [max(n for n in range(k + 2) if n == 0 or known(tokens[k + 1 - n : k + 1])) for k in range(len(tokens))]
    peaks = [(k + 1 - n, n) for k, n in enumerate(longest) if n >= 3 and (k + 1 == len(longest) or longest[k + 1] <= n)]
    got = list(automaton.matches(tokens, 3))
    assert [m[:2] for m in got] == peaks
    for start, n, state in got:
        part = tokens[start : start + n]
        ends = {k for k, t in enumerate(templates) if any(t[i : i + n] == part for i in range(len(t)))}
        assert set(automaton.ends[state]) == ends
        assert all(templates[k][e - n + 1 : e + 1] == part for k, e in automaton.ends[state].items())


def test_places_equal_plain_scan():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 3, n).tolist() for n in (1, 2, 2, 3, 5)] + [[0, 1], [1, 0, 1]]
    tokens = rng.integers(0, 4, 400).tolist()
    expected = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(tokens)) if tokens[i : i + len(p)] == p)
    assert sorted(licences.Automaton(phrases).places(tokens)) == expected


def test_phrases_of_the_caller(documents):
    rows = [(1, "gpl and lgpl"), (1, "gpl and lgpl"), (2, "a b a b c"), (3, None), (4, "b"), (5, "b a")]
    out = licences.scanned(documents(rows), phrases={"gpl": "one", "a b": "two", "b a b": "three", " ": "none"}).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out if r.n_base) == [
        (1, 1, 0, 0, "one"), (1, 1, 0, 0, "one"), (2, 3, 0, 2, "three,two")]
    assert len(out) == 6 and all(r.score == (1.0 if r.n_base else 0.0) for r in out)


def test_licences_equal_plain_scan(documents):
    texts = ["Released under the MIT License.", "mit\nlicense MIT-LICENSE cc by-nc", None, "", "gnu general public", "x" * 100_000,
             licences.TEMPLATES["mit-text"].upper().replace(" ", ", "), "the apache_license ünder apache  license",
             " ".join(licences.TEMPLATES["bsd-text"].split()[:9]) + " oh well", "cc by", "of the software and to the terms of the"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {r.doc_id: r for r in licences.scanned(documents(list(enumerate(texts))).withColumn("labels", F.lit("z"))).collect()}
    for k, text in enumerate(texts):
        w = word.findall((text or "").translate(lower))
        at = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = out[k]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[6].labels == "mit-text" and out[0].labels == "mit,mit-notice" and out[10].labels == ""
    assert licences.scanned(documents([])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(crosspolytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(crosspolytope.hadamard(crosspolytope.hadamard(x)), x)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_neighbours_reach_the_recall(spark, block_rows):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 24)).astype(np.float32)
    points[100:260] = points[100]  # a group of copies
    rows = [(k, p.tolist(), 0) for k, p in enumerate(points)]
    rows += [(700, None, 0), (800, [0.0] * 24, 0), (900, [float("nan")] * 24, 0), (1000, [1.0, None] * 12, 0), (1100, [float("inf")] * 24, 0),
             (1200, [1.0] * 3, 0), (None, [1.0] * 24, 0), (500, points[500].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(5)
    how = crosspolytope.Tables(block_rows=block_rows)
    out = crosspolytope.search(df, F.col("vec_id") % 100 == 0, how).collect()
    hit, v = 0, points.astype(float)
    for q in range(0, 600, 100):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        distance = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(600), distance)) if i != q][:10]
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - distance[r.vec_id]) < 1e-9 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len(set(best) & {r.vec_id for r in own})
    assert hit >= 0.9 * 60 and {r.query_id for r in out} == set(range(0, 600, 100))
    few = crosspolytope.search(df.filter("vec_id < 4"), F.col("vec_id") == 0, how).collect()
    assert len(few) == 3
    assert crosspolytope.search(df.limit(0), F.col("vec_id") == 0, how).count() == 0


def test_only_letters_make_a_language(spark, documents):
    """Emoji, digits of any plane and lone marks are no letters; letters beyond 16 bits are."""
    rows = [(k, "the cat sat on the mat and saw the other cat", "en") for k in range(40)]
    rows += [(100 + k, "el gato vio al otro gato en la casa del rey", "es") for k in range(40)]
    model = langid.fit(documents(rows))
    table = langid.fit(documents(rows), langid.Training(entries=10))
    odd = {"\U0001f642\U0001f642 \U0001f642": False, "\u0301 \u0302": False, "\U0001d7d8\U0001d7d9": False, "12 -": False,
           "\U00010400\U00010401": True, "e\u0301l gato": True, "the cat": True, "\u0915\u093f": True}
    asked = documents([(k, t) for k, t in enumerate(odd)]).withColumn("LANG_PRED", F.lit("x")).withColumn("lang_bits", F.lit("x"))
    for m in (model, table):
        got = {r.text: (r.lang_pred, r.lang_rejected) for r in langid.identified(asked, m).collect()}
        for text, letters in odd.items():
            assert (got[text][0] != "und") == letters, text
            assert letters or got[text][1]


def test_a_clashing_score_column_is_replaced(spark, documents):
    docs = documents([(k, f"line {k}\nanother line of text") for k in range(30)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    model = crf.fit(docs, labels)
    out = crf.scored(docs.withColumn("Quality_Score", F.lit("x")), model)
    assert [c for c in out.columns if c.lower() == "quality_score"] == ["quality_score"]
    assert {r.quality_score for r in out.collect()} != {"x"}
    again = crf.scored(docs.union(docs), model).groupBy("doc_id").agg(F.count_distinct("quality_score").alias("n")).collect()
    assert {r.n for r in again} == {1}
