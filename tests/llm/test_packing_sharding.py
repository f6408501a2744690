"""Packing and sharding: exact laws and brute force."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import packing, sharding

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.tokenizer_path()), reason="no vocabulary")


@needs_vocabulary
def test_pieces_are_the_tokenizers_ids(documents):
    from tokenizers import Tokenizer

    texts = ["Hello  WORLD, it's 42!", "", None, " \n\t", "a <|endoftext|> b", "É́ ünï x y\x0bz", "x" * 9000, "w1 " * 9000,
             "same", "same"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    df = documents([(k, t) for k, t in enumerate(texts)]).withColumn("piece", F.lit("x"))
    out = packing.pack(df).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = np.array(ids[r.start : r.start + 4096], dtype="<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for rows in by_bin.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        assert sum(r.length for r in rows) <= 4096
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["product", "residual"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 4097, 3000)
    bins = packing.Bins(documents=5, cost=0.7, rule=rule)
    big = lengths**2 / 4096**2 > 0.7
    number, offset = packing.best_fit(lengths[~big], bins)
    own = lengths[~big]
    for b in range(number.max() + 1):
        here = number == b
        assert own[here].sum() <= 4096 and here.sum() <= 5 and (own[here] / 4096.0).dot(own[here] / 4096.0) <= 0.7 + 1e-9
        assert sorted(offset[here]) == np.cumsum([0, *own[here][np.argsort(offset[here])]])[:-1].tolist()


@pytest.mark.parametrize("rule", ["product", "residual"])
@pytest.mark.parametrize("bins", [{}, {"documents": 5, "cost": 0.7}, {"tokens": 60, "documents": 4, "weights": (0.1, 1.0, 1.0)}])
def test_best_fit_equals_looking_at_every_bin(rule, bins):
    bins = packing.Bins(rule=rule, **bins)
    lengths = np.random.default_rng(6).integers(1, int(bins.tokens * bins.cost**0.5), 700)
    held: list[list[int]] = []
    want = {}
    share = 1 / bins.tokens, 1 / bins.documents, 1 / (bins.cost * bins.tokens**2)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        need = size * share[0], share[1], size * size * share[2]
        best = None
        for number, own in enumerate(held):
            full = [*own, size]
            if sum(full) > bins.tokens or len(full) > bins.documents or 1 - sum(x * x for x in full) * share[2] <= -1e-9:
                continue
            free = ((bins.tokens - sum(full)) * share[0], 1 - len(full) * share[1], 1 - sum(x * x for x in full) * share[2])
            w = bins.weights
            cost = (w[0] * need[0] * free[0] + w[1] * need[1] * free[1] + w[2] * need[2] * free[2] if rule == "product"
                    else (w[0] * free[0]) ** 2 + (w[1] * free[1]) ** 2 + (w[2] * free[2]) ** 2)
            best = min(best or (cost, number), (cost, number))
        number = best[1] if best else len(held)
        if best is None:
            held.append([])
        want[i] = number, sum(held[number])
        held[number].append(size)
    number, offset = packing.best_fit(lengths, bins)
    assert [(int(a), int(b)) for a, b in zip(number, offset)] == [want[i] for i in range(len(lengths))]


@needs_vocabulary
def test_query_has_the_contracts_types(spark, sf_dir):
    from folioworks.llm import queries

    assert queries.op9_pack(spark, sf_dir).dtypes == [
        ("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"),
        ("sequence_id", "bigint"), ("offset", "bigint")]


def test_best_fit_leaves_little_room():
    lengths = np.random.default_rng(5).integers(1, 2000, 5000)
    number, _ = packing.best_fit(lengths, packing.Bins())
    assert number.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1


def test_shards_hold_the_mixture(documents):
    rows = [(k, "t" * (k % 50), None, "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(1003)]
    rows += [(2000, None, None, None), (2000, None, None, None), (2001, "é", None, "")]
    df = documents(rows).withColumn("rank", F.lit(1)).withColumn("part", F.lit(2)).withColumn("key", F.lit("k"))
    out = sharding.interleaved(df, 40).collect()
    assert len(out) == len(rows) and sorted(r.position for r in out) == list(range(len(rows)))
    size = Counter(r.shard for r in out)
    assert set(size) == set(range(40)) and max(size.values()) - min(size.values()) <= 1
    for s in size:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(size[s]))
    of = Counter(r.source for r in out)
    for source, n in of.items():
        there = Counter(r.shard for r in out if r.source == source)
        assert all(abs(there[s] - n / 40) <= 2 for s in range(40))
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 2001} == {(18, zlib.crc32("é".encode()))}
    # Brute force: the same order from plain sorting.
    keys = {r.doc_id: k for r, k in zip(out, range(len(out)))}
    frac, by = {}, defaultdict(list)
    hashed = df.select("doc_id", "source", F.xxhash64(
        F.lit(17), "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("h")).collect()
    for r in hashed:
        by[r.source].append((r.h, r.doc_id))
    for source, own in by.items():
        for rank, (h, i) in enumerate(sorted(own)):
            frac.setdefault(i, ((rank + 0.5) / len(own), "" if source is None else "s" + source, h))
    plain = sorted((i for i in keys if i != 2000), key=lambda i: frac[i])
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position) if r.doc_id != 2000] == plain
    assert sharding.interleaved(df.limit(0), 40).count() == 0
    assert sorted(r.shard for r in sharding.interleaved(df.limit(3), 40).collect()) == sorted({((p + 1) * 40 - 1) // 3 for p in range(3)})


@needs_vocabulary
def test_ids_by_word_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path(), 50)
    draw = random.Random(5)
    pool = [chr(c) for c in range(1, 0x250)] + list(" \n\t'stremld.,!0129abcABC") * 12
    latin = [c for c in pool if c.isascii() or c >= "À"]
    texts = ["".join(draw.choices(latin if k % 2 else pool, k=draw.randint(0, 40))) for k in range(2000)]
    texts += ["", "it's DON'T we'LL", "x<|endoftext|> y", "\u212a\u212b \u1e9e \u0130 \u0391\u03a3 \u03a3", "e\u0301 \u0301", "\x1c\x85 a"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = [ids for k in range(0, len(texts), 100) for ids in encoder.encode(texts[k : k + 100])]
    assert got == want
    assert encoder.encode([None]) == [b""]


def test_other_stages_drop_the_remembered_words():
    from folioworks.llm import packing
    from folioworks.llm.tables import forget_encoder

    first = packing.encoder_of(packing.tokenizer_path(), 100)
    assert packing.encoder_of(packing.tokenizer_path(), 100) is first
    forget_encoder()
    assert packing.encoder_of.cache_info().currsize == 0
