"""Near-duplicate classes against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm.components import components
from folioworks.llm.forest import Forest, _confirmed, _filed, _open_pairs, _open_regions, _regions, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def found(df, how):
    return {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(df, how).collect()}


@pytest.mark.parametrize("width,percent,region_rows,sparse", [(3, 85, 4096, 2), (5, 80, 4096, 0), (3, 85, 20, 2)])
def test_equals_all_pairs(documents, width, percent, region_rows, sparse):
    rng = random.Random(3)
    rows, n = [], 0
    for group in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(25):  # copies on either side of the threshold
            rows.append((n, edited(rng, base, rng.randrange(0, 9))))
            n += 1
        rows.append((n, " ".join(base).upper()))
        n += 1
    rows += [(n, " "), (n + 1, None), (n + 2, ""), (n + 3, "one"), (n + 4, "One"), (n + 5, "one two"), (n + 6, "Ünï one two x"),
             (n + 7, "long " * 30_000)]
    how = Forest(shingle=width, percent=percent, region_rows=region_rows, sparse=sparse)
    got, expected = found(documents(rows), how), classes(rows, width, percent)
    assert got == expected


def test_one_row_per_id_and_no_row_without(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    out = near_duplicates(documents(rows)).collect()
    assert sorted((r.id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 1, False)]


def test_empty_table_and_clashing_columns(documents):
    assert near_duplicates(documents([])).count() == 0
    df = documents([(1, "a b"), (2, "a b")]).withColumn("id", F.lit(0)).withColumn("signature", F.lit("x"))
    assert {r.component_id for r in near_duplicates(df).collect()} == {1}


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1400)}


def regions_of(signature, forest, order):
    """A number for each different prefix of one order."""
    prefix = signature[:, order * forest.depth : (order + 1) * forest.depth]
    return (np.unique(prefix, axis=0, return_inverse=True)[1].ravel() + 1_000_000 * order).tolist()


def crowd_with_a_pair(spark, forest, orders, crowd):
    """Signatures of a crowd in order 0's region and of the pair (0, 1) in the regions of ``orders``."""
    rng = np.random.default_rng(5)
    signature = rng.integers(0, 65536, (crowd + 2, forest.hashes), dtype=np.uint16)
    signature[:, : forest.depth] = signature[0, : forest.depth]
    signature[1] = signature[0]
    parted = [t for t in range(1, forest.orders) if t not in orders]
    signature[1, [t * forest.depth for t in parted]] ^= 1
    rows = [(int(key), n, n, signature[n].tobytes(), t) for t in orders
            for n, key in enumerate(regions_of(signature, forest, t))]
    rows = spark.createDataFrame(rows, "region long, id long, label long, signature binary, order int")
    return rows, _open_regions(rows)


def test_pair_of_a_crowded_region_is_compared_in_a_later_order(spark):
    forest = Forest(region_rows=20, sparse=1000)
    regions = _regions(*crowd_with_a_pair(spark, forest, (0, 2), 60), forest)
    assert {(r.a, r.b) for r in _open_pairs(regions, forest).collect()} == {(0, 1)}


@pytest.mark.parametrize("linked", [0, 45])
def test_pair_of_a_crowded_region_is_compared_there(spark, linked):
    forest = Forest(region_rows=20, sparse=1000)
    rows, _ = crowd_with_a_pair(spark, forest, (0,), 60)
    rows = rows.withColumn("label", F.when(F.col("id") <= linked, 0).otherwise(F.col("id"))) if linked else rows
    rows = rows.withColumn("label", F.when(F.col("id") == 1, 1).otherwise(F.col("label")))
    regions = _regions(rows, _open_regions(rows), forest)
    assert [(r.a, r.b) for r in _open_pairs(regions, forest).collect()] == [(0, 1)]
    # Every pair of two labels meets once, and no cell has more than two blocks.
    cells = regions.select("region", "id", "label", "side").toPandas()
    met = cells.merge(cells, on="region")
    met = met[(met.id_x < met.id_y) & (met.label_x != met.label_y) & ((met.side_x == 0) | (met.side_x != met.side_y))]
    label = dict(zip(cells["id"], cells["label"]))
    assert sorted(zip(met.id_x, met.id_y)) == [(a, b) for a in range(62) for b in range(a + 1, 62) if label[a] != label[b]]
    assert cells.groupby("region").size().max() < 62


def test_crowded_regions_lose_no_link(documents):
    rng = random.Random(3)
    rows = []
    for _ in range(2):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 9))) for k in range(30)]
    assert found(documents(rows), Forest(shingle=3, percent=85, region_rows=8)) == classes(rows, 3, 85)


@pytest.mark.parametrize("tasks", [1, 7])
def test_walk_tells_the_regions_of_sorted_orders(spark, tasks):
    """Against runs of sorted signatures found by plain recursion; task edges may only add shallow rows."""
    forest = Forest(orders=3, depth=4, shallow=2, crowd=5)
    rng = np.random.default_rng(8)
    signature = rng.integers(0, 3, (600, forest.hashes), dtype=np.uint16)
    signature[:80] = signature[0]  # a crowd of equal prefixes
    signature[:80, -1] = np.arange(80)
    signature[300:, 0] = np.arange(300) + 9  # rows without neighbours in the first order
    want = set()

    def split(order, depth, rows):
        prefix = lambda r, d: signature[r, order * 4 : order * 4 + d].tobytes()
        groups = {}
        for r in rows:
            groups.setdefault(prefix(r, depth), []).append(r)
        for key, own in groups.items():
            if depth == forest.depth:
                want.update((order, depth, key, r) for r in own if len(own) > 1)
                continue
            heads = list({prefix(r, forest.depth): r for r in reversed(own)}.values())
            if 1 < len(heads) <= forest.crowd:
                want.update((order, depth, key, r) for r in heads)
            elif len(heads) > forest.crowd:
                split(order, depth + 1, own)
            if depth == forest.shallow:
                split(order, forest.depth, own)

    for order in range(forest.orders):
        split(order, forest.shallow, range(600))
    rows = spark.createDataFrame([(r, signature[r].tobytes()) for r in range(600)], "id long, signature binary")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        got = {(r.region, r.id, r.order) for r in _filed(rows, forest).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    named = spark.createDataFrame([(o, d, bytearray(k), r) for o, d, k, r in want], "order int, depth int, prefix binary, id long")
    want_rows = {(r.region, r.id, r.order) for r in named.select(F.xxhash64("order", "depth", "prefix").alias("region"), "id", "order").collect()}
    deepest = {(r.region, r.id, r.order) for r in named.filter(f"depth = {forest.depth}").select(
        F.xxhash64("order", "depth", "prefix").alias("region"), "id", "order").collect()}
    size = {}
    for region, *_ in got:
        size[region] = size.get(region, 0) + 1
    several = {x for x in got if size[x[0]] > 1}
    assert deepest <= several
    if tasks == 1:
        assert several == want_rows


def test_texts_are_not_shuffled_for_few_pairs(spark, documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")])
    # By its estimate this is a large table, as after the joins that pairs come from.
    pairs = spark.range(5_000_000).filter("id = 1").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = _confirmed(pairs, docs, "doc_id", "text", Forest())
    plan = found._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]
