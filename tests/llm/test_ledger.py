"""Measurements and verdicts against plain Python over whole texts."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioworks.llm import ledger, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len({k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}), len(lines),
            sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words),
            sum(x.lstrip(" \t\x0b\x0c\r")[0] in "-*" for x in lines), sum(x.rstrip(" \t\x0b\x0c\r").endswith("...") for x in lines))


def bits(m):
    words, chars, symbols, dup, repeat, lines, lettered, listed, trailing = m
    rules = (words < 50, 100 * repeat > 50 * words, chars > 15 * words, chars < 2 * words, 10 * symbols > words, 100 * dup > 30 * lines,
             100 * lettered < 70 * words, 100 * listed > 90 * lines, 100 * trailing > 30 * lines)
    return sum(1 << k for k, rule in enumerate(rules) if rule)


def made():
    rng = random.Random(4)
    pieces = ["a", "b", "#", "$5", "käse", "-", "* x", "...", "und...", "\n", "\n", " ", "\t", "日本語", "🙂", "word", "\r\n", "\x0b", "12", " ", "\x00"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 400))) for _ in range(150)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60))) for _ in range(100)]
    texts += [" ".join(f"w{rng.randrange(2000)}" for _ in range(60)) for _ in range(30)]
    texts += [None, "", " \n\t", "\n", "x\n", "\nx", "one", "a a a", "a a a a", "x" * 300_000, ("some words here\n" * 40_000), texts[0], texts[0]]
    return list(enumerate(texts))


def test_measurements_and_bits(spark, documents):
    table = documents(made()).withColumns({"failures": F.lit("x"), "N_WORDS": F.lit(1), "best": F.lit(2)}).repartition(3)
    got = ledger.ledger(table)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "best", *ledger.MEASURES, "failures"]
    found = {r.doc_id: (tuple(r[m] for m in ledger.MEASURES), r.failures) for r in got.collect()}
    assert found == {k: (measures(t), bits(measures(t))) for k, t in made()}
    assert ledger.ledger(table.limit(0)).count() == 0


def test_query(spark, tmp_path, documents):
    documents(made()).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_quality_rules(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", **{m: "bigint" for m in ledger.MEASURES}, "failures": "bigint",
                                "base_failed": "boolean", "kept": "boolean"}
    for r in out.collect():
        m = measures(dict(made())[r.doc_id])
        assert (r.failures, r.base_failed, r.kept) == (bits(m), bool(bits(m) & 3), bits(m) == 0)


def test_policies_and_ablations(spark, documents):
    entries = ledger.ledger(documents(made()))
    failures = [bits(measures(t)) for _, t in made()]
    got = {(r.policy, r.version, r.rule): r for r in ledger.ablations(entries).collect()}
    names = [r.name for r in ledger.RULES]
    assert len(got) == sum(len(p.rules) for p in ledger.POLICIES)
    for policy in ledger.POLICIES:
        assert entries.filter(ledger.failed(policy)).count() == sum(bool(f & policy.mask()) for f in failures)
        for rule in policy.rules:
            bit, mask = 1 << names.index(rule), policy.mask()
            r = got[policy.name, policy.version, rule]
            others = 0
            for f in failures:
                others |= f & mask & ~bit if f & bit else 0
            assert (r.failed, r.alone, r.kept, r.kept_without, r.with_others) == (
                sum(bool(f & bit) for f in failures), sum(f & mask == bit for f in failures), sum(not f & mask for f in failures),
                sum(not f & mask & ~bit for f in failures), others)
    assert all(r.failed == r.kept == 0 for r in ledger.ablations(entries.limit(0)).collect())
