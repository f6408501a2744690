"""Ranked lexical search over a K2-treap of the term-document grid.

Documents are tokenised once; of their terms those that some item asks for are
stored with their counts.  Each task then cuts its documents into blocks, builds
a K2-treap for each block and answers all items from it.

A K2-treap is a quadtree over the grid (rows: terms, columns: documents) that
keeps only cells with postings: a cell has four bits for its quadrants, the place
of its first child, and the largest impact below it.  An item walks down the
paths of all its rows at once: a state is a range of documents with one cell for
each row, and its bound is the sum of the rows' weights times their cells'
maxima.  States are taken best first; a state whose bound is below the score of
the item's last place cannot hold a result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import scratch_dir, stored


@dataclass(frozen=True)
class Ranking:
    top: int = 50
    # Postings in one treap; a single document may exceed it.
    block_postings: int = 2_000_000
    # Most documents in one treap, so that a cell's code and value fit 64 bits.
    block_documents: int = 1 << 18
    # UTF-8 bytes of items searched together; more are searched in turns.  So many
    # bytes hold fewer than 2**21 distinct terms.
    item_bytes: int = 8_000_000
    # States expanded in one step of a search.
    batch: int = 128


@dataclass(frozen=True)
class Items:
    """Distinct terms of all items (sorted hashes) and each item's terms in them."""

    ids: list[int | None]
    terms: np.ndarray
    own: list[np.ndarray]


def item_terms(ids: list[int | None], texts: list[str | None]) -> Items:
    """Items by id; rows with the same id make one item with the terms of all."""
    hashes, _, _, at = W.words(*W.utf8(pa.array(texts, pa.string())), W.ALPHANUMERIC)
    terms, place = np.unique(hashes, return_inverse=True)
    gathered: dict[int | None, list[np.ndarray]] = {}
    for k, item in enumerate(ids):
        gathered.setdefault(item, []).append(place[at[k] : at[k + 1]])
    return Items(list(gathered), terms, [np.unique(np.concatenate(p)) for p in gathered.values()])


def counted(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of whole texts: words in each, and (row offsets, term, count) of the given terms in them."""
    for _, _, data, offsets in W.groups(column):
        hashes, _, _, rows = W.words(data, offsets, W.ALPHANUMERIC)
        if not len(terms):
            yield np.diff(rows), np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
        known = np.flatnonzero(terms[place] == hashes)
        row = np.searchsorted(rows, known, side="right") - 1
        key, count = np.unique(row * len(terms) + place[known], return_counts=True)
        yield np.diff(rows), np.searchsorted(key // len(terms), np.arange(len(rows))), key % len(terms), count


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, term, tf): a document's number of words, and its counts of the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most item_bytes of item text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for n, at, term, tf in counted(batch.column(1), shared.value):
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
                first += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, term array<int>, tf array<int>")


# Place of a quadrant among the children of a cell with these four bits; -1: it has none.
_PLACE = np.array([[bin(bits & ((1 << quadrant) - 1)).count("1") if bits >> quadrant & 1 else -1 for quadrant in range(4)]
                   for bits in range(16)], dtype=np.int64)


_SPREAD = sum((np.arange(2048) >> k & 1) << (2 * k) for k in range(11))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**22 with a zero before each."""
    return _SPREAD[x & 2047] | _SPREAD[x >> 11] << 22


class Treap:
    """Quadtree over ``n_rows`` x ``n_docs`` cells with the largest value below each cell.

    Level 0 is the root.  Rows are spread evenly over the grid's side, so that
    single rows part early.  Each level ends with an empty cell that absent
    quadrants lead to.
    """

    def __init__(self, row: np.ndarray, doc: np.ndarray, value: np.ndarray, n_rows: int, n_docs: int):
        self.depth = max(n_rows - 1, n_docs - 1, 1).bit_length()
        self.shift = self.depth - max(n_rows - 1, 1).bit_length()
        cells = (_spread(row << self.shift) << 1 | _spread(doc)) << 20 | value
        cells.sort()
        code, top = cells >> 20, (cells & 0xFFFFF).astype(np.int32)
        self.most: list[np.ndarray] = [np.append(top, np.int32(0))]
        self.bits: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        for _ in range(self.depth):
            parent = code >> 2
            start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            self.bits.append(np.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), start), 0).astype(np.uint8))
            self.first.append(np.append(start, 0).astype(np.int32))
            top = np.maximum.reduceat(top, start)
            self.most.append(np.append(top, np.int32(0)))
            code = parent[start]
        for levels in (self.most, self.bits, self.first):
            levels.reverse()

    def quadrants(self, rows: np.ndarray) -> np.ndarray:
        """Upper bit of the quadrant that each row lies in, by level."""
        return np.array([(rows << self.shift) >> (self.depth - 1 - level) & 1 for level in range(self.depth)]) * 2

    def children(self, level: int, cells: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        place = _PLACE[self.bits[level][cells], quadrant]
        return np.where(place < 0, len(self.most[level + 1]) - 1, self.first[level][cells] + place)


def best(treap: Treap, rows: np.ndarray, weights: np.ndarray, n_docs: int, least: int, how: Ranking) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of all that may be among the item's ``top``, given that
    ``top`` others with a score of at least ``least`` are known (0: none).

    A superset: ties with the last place are all returned.
    """
    quadrants = treap.quadrants(rows)
    root = np.zeros((1, len(rows)), dtype=np.int64)
    queue = [(-int((treap.most[0][root] * weights).sum()), 0, 0, np.zeros(1, np.int64), root, None)]
    docs, scores, pushed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    held = np.zeros(0, dtype=np.int64)
    while queue and -queue[0][0] >= max(least, 1):
        _, _, level, ranges, cells, bounds = heapq.heappop(queue)
        if len(ranges) > how.batch:  # the best of them now, the others later
            pushed += 1
            cut = slice(how.batch, None)
            heapq.heappush(queue, (-int(bounds[how.batch]), pushed, level, ranges[cut], cells[cut], bounds[cut]))
            ranges, cells = ranges[: how.batch], cells[: how.batch]
        below = [treap.children(level, cells, quadrants[level] + half) for half in (0, 1)]
        cells = np.concatenate(below)
        ranges = np.concatenate([ranges * 2, ranges * 2 + 1])
        level += 1
        bounds = (treap.most[level][cells] * weights).sum(axis=1)
        open_ = np.flatnonzero(bounds >= max(least, 1))
        if not len(open_):
            continue
        if level == treap.depth:
            docs.append(ranges[open_])
            scores.append(bounds[open_])
            held = np.concatenate([held, bounds[open_]])
            if len(held) >= how.top:
                held = -np.partition(-held, how.top - 1)[: how.top]
                least = max(least, int(held.min()))
            continue
        open_ = open_[np.argsort(-bounds[open_], kind="stable")]
        pushed += 1
        heapq.heappush(queue, (-int(bounds[open_[0]]), pushed, level, ranges[open_], cells[open_], bounds[open_]))
    found, score = np.concatenate(docs), np.concatenate(scores)
    good = (score >= max(least, 1)) & (found < n_docs)
    return found[good], score[good]


class _Places:
    """The best documents of one item so far: highest score, then smallest id, null ids last."""

    def __init__(self, top: int):
        self.top, self.least = top, 0
        self.ids, self.null, self.scores = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        ids, null, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.null, null), (self.scores, scores)))
        order = np.lexsort((ids, null, -scores))[: self.top]
        self.ids, self.null, self.scores = ids[order], null[order], scores[order]
        self.least = int(self.scores[-1]) if len(order) == self.top else 0


def _answers(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, row_of: np.ndarray,
             mean: tuple[int, int], how: Ranking) -> Iterator[pa.RecordBatch]:
    places = [_Places(how.top) for _ in items.ids]
    n_all, words_all = mean

    def search(parts: list[tuple[np.ndarray, ...]]) -> None:
        ids, null, n, count, term, tf = (np.concatenate([p[k] for p in parts]) for k in range(6))
        doc = np.repeat(np.arange(len(ids)), count)
        length = 50 + (50 * n * n_all) // words_all
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[doc])
        treap = Treap(row_of[term], doc, impact, len(row_of), len(ids))
        there = np.zeros(len(row_of), dtype=bool)
        there[term] = True
        for place, own in zip(places, items.own):
            own = own[there[own] & (weights[own] > 0)]
            if len(own):
                found, score = best(treap, row_of[own], weights[own], len(ids), place.least, how)
                place.add(ids[found], null[found], score)

    parts: list[tuple[np.ndarray, ...]] = []
    postings = documents = 0
    for batch in batches:
        ids, n, term, tf = (batch.column(k) for k in range(4))
        count = np.diff(term.offsets.to_numpy())
        upto = np.concatenate([[0], np.cumsum(count)])
        arrays = (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), n.to_numpy(),
                  count, term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
        first = 0
        while first < len(ids):  # as many rows as still fit, one at least
            end = int(np.searchsorted(upto, upto[first] + how.block_postings - postings, side="right")) - 1
            end = min(max(end, first + (not parts)), first + how.block_documents - documents, len(ids))
            if end > first:
                cut, inner = slice(first, end), slice(upto[first], upto[end])
                parts.append((*(a[cut] for a in arrays[:4]), *(a[inner] for a in arrays[4:])))
                postings += int(upto[end] - upto[first])
                documents += end - first
                first = end
            if first < len(ids):
                if postings:
                    search(parts)
                parts, postings, documents = [], 0, 0
    if postings:
        search(parts)
    for item, place in zip(items.ids, places):
        if len(place.ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(place.ids), pa.int64()), pa.array(place.ids, pa.int64(), mask=place.null),
                 pa.array(place.scores, pa.int64())], ["item_id", "doc_id", "score"])


def _turn(docs: DataFrame, rows: list, how: Ranking) -> DataFrame:
    spark = docs.sparkSession
    items = item_terms([r.item_id for r in rows], [r.text for r in rows])
    grid = stored(postings(docs, items.terms), f"{scratch_dir(spark)}/postings")
    n_all, words_all = grid.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(items.terms), dtype=np.int64)
    for r in grid.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row for each item term
        df[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    row_of = np.empty(len(df), dtype=np.int64)
    row_of[np.argsort(-df, kind="stable")] = np.arange(len(df))  # rows of like density lie side by side
    shared = spark.sparkContext.broadcast((items, weights, row_of))  # at most item_bytes of item text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answers(batches, *shared.value, (n_all, words_all), how)

    found = grid.filter("size(term) > 0").mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top).select(
        "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, how: Ranking = Ranking()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns of either are
    ignored, whatever their names.  A null or empty text has no terms: such a
    document is found by no item and doesn't count, such an item finds nothing.
    Texts of any length are taken whole.  Equal scores go by ascending doc_id, null
    ids last.  Repeated documents are ranked each by itself; rows of items with one
    id (null is an id, too) are one item with the terms of all its rows.  Without
    documents or items the result is empty.

    Counts and lengths are those of all documents, so turns of ``item_bytes``, blocks
    and partitions leave the result as it is.  No document is shuffled; each task
    passes on ``top`` rows for each item.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    turns = int(-(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // how.item_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(turns):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).collect()
        if rows:
            out = out.unionByName(_turn(docs, rows, how))
    return out
