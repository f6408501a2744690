"""Benchmark decontamination: BM25 over test items, evaluated as block-max WAND."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import forget_encoder, scratch_dir, stored


@dataclass(frozen=True)
class Search:
    """``threshold``: share of an item's own BM25 score a passage must reach.

    A passage is a window of twice the longest item's words (at least twice
    ``least_stride``), moved by half of that, so every copy of an item lies
    wholly in one.  Confirmed are items of which ``overlap`` of the words, and
    ``part_overlap`` of the question's and of the answer's words, lie in runs of
    ``run`` words that the passage shares.  ``answer`` names the items' column
    with the answer, which then stands behind the text, the question; without
    one, the answer is the last third of an item's words.
    """

    threshold: float = 0.6
    overlap: float = 0.8
    part_overlap: float = 0.5
    run: int = 5
    least_stride: int = 64
    answer: str | None = None
    block: int = 16
    k1: float = 1.2
    b: float = 0.75
    # UTF-8 bytes of items in one index; a larger benchmark is searched in turns.
    index_bytes: int = 16_000_000
    # UTF-8 bytes of texts that a task searches at a time; a longer text is searched alone.
    group_bytes: int = W.GROUP_BYTES


@dataclass(frozen=True)
class Index:
    """Postings by term, of items and of blocks of items with their maxima."""

    item_ids: np.ndarray
    item_words: list[np.ndarray]
    question_words: np.ndarray  # how many of an item's words are its question
    terms: np.ndarray  # sorted word hashes
    frequent: np.ndarray  # terms that alone never make a candidate
    at: np.ndarray  # term -> its postings
    items: np.ndarray
    weights: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_weights: np.ndarray
    skipped: np.ndarray  # block -> most that its items get from frequent terms
    stride: int


@dataclass(frozen=True)
class Statistics:
    """Of all items with words, whichever index holds them."""

    items: int
    mean_words: float
    terms: np.ndarray  # sorted hashes, those of one index at least
    df: np.ndarray  # how many items hold each


def build_index(item_ids: list[int], texts: list[str | None], how: Search, all_items: Statistics | None = None,
                answers: list[str | None] | None = None) -> Index | None:
    """Index the items that have words, each its text and then its answer; None if none has.

    A term's weight is its BM25 score in the item over the sum of all of the
    item's terms, so a passage that holds the whole item scores 1.  The counts
    behind it are those of ``all_items``, by default of the items given.
    """
    own = _words_of(texts)
    count = np.array([len(w) for w in own], dtype=np.int64)
    if answers is None:
        question = count - np.maximum(count // 3, 1)
    else:
        question = count
        own = [np.concatenate(both) for both in zip(own, _words_of(answers))]
    full = np.array([i for i, w in enumerate(own) if len(w)], dtype=np.int64)
    if not len(full):
        return None
    own = [own[i] for i in full]
    length = np.array([len(w) for w in own])
    terms, term = np.unique(np.concatenate(own), return_inverse=True)
    item = np.repeat(np.arange(len(own)), length)
    pair, tf = np.unique(term.astype(np.int64) * len(own) + item, return_counts=True)
    term, item = pair // len(own), pair % len(own)
    df = np.bincount(term, minlength=len(terms))
    if all_items is None:
        all_items = Statistics(len(own), float(length.mean()), terms, df)
    held = all_items.df[np.searchsorted(all_items.terms, terms)]
    idf = np.log1p((all_items.items - held + 0.5) / (held + 0.5))
    norm = how.k1 * (1 - how.b + how.b * length[item] / all_items.mean_words)
    weight = idf[term] * tf * (how.k1 + 1) / (tf + norm)
    weight = weight / np.bincount(item, weights=weight)[item]
    # The most frequent terms are skipped as long as no item gets half of the
    # threshold from them; they are looked at for candidates only.
    frequent = np.zeros(len(terms), dtype=bool)
    mass = np.zeros(len(own))
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    for t in np.argsort(-df, kind="stable"):
        here = slice(begin[t], begin[t + 1])
        if df[t] < 2 or (mass[item[here]] + weight[here] > how.threshold / 2).any():
            break
        mass[item[here]] += weight[here]
        frequent[t] = True
    n_blocks = -(-len(own) // how.block)
    key = term * n_blocks + item // how.block
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    skipped = np.zeros(n_blocks)
    np.maximum.at(skipped, np.arange(len(own)) // how.block, mass)
    return Index(
        np.array(item_ids, dtype=np.int64)[full], own, question[full], terms, frequent, begin, item, weight,
        np.searchsorted(key[first] // n_blocks, np.arange(len(terms) + 1)), key[first] % n_blocks,
        np.maximum.reduceat(weight, first), skipped, max(how.least_stride, int(length.max())))


def _words_of(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    hashes, _, _, at = W.words(data, offsets, W.ALPHANUMERIC)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:])]


def _expanded(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a list of terms: which of the list each posting belongs to, and the postings."""
    count = at[terms + 1] - at[terms]
    owner = np.repeat(np.arange(len(terms)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[terms][owner]


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(key, return_inverse=True)
    return keys, np.bincount(place, weights=value, minlength=len(keys))


def retrieve(index: Index, hashes: np.ndarray, rows: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (window, item, score) at or above the threshold.

    ``rows``: n + 1 word offsets.  Windows are numbered as by :func:`windows`.
    A window's bound for a block of items is the sum of its rare terms' block
    maxima plus what the block can get from the skipped terms; only blocks
    whose bound reaches the threshold are scored, with all terms.
    """
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == hashes)
    term = place[known]
    row = np.searchsorted(rows, known, side="right") - 1
    first, count = windows(rows, index.stride)
    step = (known - rows[row]) // index.stride
    inside = np.stack([first[row] + step, first[row] + step - 1])
    valid = np.stack([step < count[row], step >= 1])
    n_terms = len(index.terms)
    pairs = np.concatenate([inside[k][valid[k]] * n_terms + term[valid[k]] for k in (0, 1)])
    n_blocks, n_items = len(index.skipped), len(index.item_ids)
    rare = pairs[~index.frequent[pairs % n_terms]]
    rare = np.unique(rare)
    owner, post = _expanded(index.block_at, rare % n_terms)
    keys, bound = _summed((rare // n_terms)[owner] * n_blocks + index.blocks[post], index.block_weights[post])
    keys = keys[bound + index.skipped[keys % n_blocks] >= how.threshold - 1e-9]
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    pairs = np.unique(pairs[np.isin(pairs // n_terms, keys // n_blocks)])
    owner, post = _expanded(index.at, pairs % n_terms)
    window, item = (pairs // n_terms)[owner], index.items[post]
    open_ = np.isin(window * n_blocks + item // how.block, keys)
    keys, score = _summed(window[open_] * n_items + item[open_], index.weights[post][open_])
    good = score >= how.threshold - 1e-9
    return keys[good] // n_items, keys[good] % n_items, np.minimum(score[good], 1.0)


def windows(rows: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First window number and number of windows of each row; window k of a row
    holds its words from k * stride, 2 * stride of them."""
    count = np.maximum(-(-np.diff(rows) // stride) - 1, 1)
    return np.cumsum(count) - count, count


def _covered(item: np.ndarray, passage: np.ndarray, run: int) -> np.ndarray:
    """For each word of the item: does it lie in a run of ``run`` words (all of a
    shorter item) that the passage has too?"""
    run = min(run, len(item))
    keys = W.position_keys(run)

    def runs(x: np.ndarray) -> np.ndarray:
        n = len(x) - run + 1
        return sum((x[k : k + n] * keys[k] for k in range(run)), np.zeros(max(n, 0), np.uint64))

    shared = np.isin(runs(item), runs(passage)) if len(passage) >= run else np.zeros(len(item) - run + 1, bool)
    out = np.zeros(len(item), dtype=bool)
    for k in range(run):
        out[k : k + len(shared)] |= shared
    return out


def _search(index: Index, column: pa.Array, how: Search) -> Iterator[tuple[int, int, float, float, float, float]]:
    for first_row, _, data, offsets in W.groups(column, how.group_bytes):
        hashes, _, _, rows = W.words(data, offsets, W.ALPHANUMERIC)
        window, item, score = retrieve(index, hashes, rows, how)
        first, _ = windows(rows, index.stride)
        best: dict[tuple[int, int], tuple[float, ...]] = {}
        for w, i, s in zip(window.tolist(), item.tolist(), score.tolist()):
            row = int(np.searchsorted(first, w, side="right")) - 1
            start = int(rows[row]) + (w - int(first[row])) * index.stride
            words = index.item_words[i]
            hit = _covered(words, hashes[start : min(start + 2 * index.stride, rows[row + 1])], how.run)
            cut = index.question_words[i]
            question, answer = (part.mean() if len(part) else 1.0 for part in (hit[:cut], hit[cut:]))
            if hit.mean() >= how.overlap and min(question, answer) >= how.part_overlap:
                found = (float(hit.mean()), s, float(question), float(answer))
                best[row, i] = max(best.get((row, i), found), found)
        for (row, i), (overlap, s, question, answer) in best.items():
            yield first_row + row, int(index.item_ids[i]), s, overlap, question, answer


def _indexes(items: DataFrame, how: Search) -> Iterator[Index | None]:
    """The items in turns of about ``index_bytes``, weighted by the counts of all of them."""
    question, answer = F.col("text").cast("string"), F.col(how.answer).cast("string") if how.answer else F.lit(None).cast("string")
    items = items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long"), F.concat_ws("\n", question, answer).alias("text"), question.alias("question"), answer.alias("answer"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = int(-(-total // how.index_bytes)) or 1
    turn_of = F.pmod(F.xxhash64("item_id"), F.lit(turns))

    def index_of(turn: int, all_items: Statistics | None = None) -> Index | None:
        rows = items.filter(turn_of == turn).orderBy("item_id", "question", "answer").collect()
        answers = [r.answer for r in rows] if how.answer else None
        return build_index([r.item_id for r in rows], [r.question for r in rows], how, all_items, answers)

    if turns == 1:
        yield index_of(0)
        return

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = batch.column(1).to_numpy()
            for first, _, data, offsets in W.groups(batch.column(0)):
                hashes, _, _, at = W.words(data, offsets, W.ALPHANUMERIC)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])[: len(row)]
                row, hashes = row[fresh], hashes[fresh]
                head = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]  # carries its item's length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(turn[first + row]), pa.array(np.where(head, n[row], 0))],
                    ["term", "turn", "words"])

    spark = items.sparkSession
    held = items.select("text", turn_of.alias("turn")).mapInArrow(words, "term long, turn long, words long")
    held = stored(held, f"{scratch_dir(spark)}/item-words")
    n_items, n_words = held.filter("words > 0").agg(F.count("*"), F.sum("words")).first()
    counts = stored(held.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("turn").alias("turns")), f"{scratch_dir(spark)}/item-df")
    for turn in range(turns):
        own = counts.filter(F.array_contains("turns", F.lit(turn).cast("long"))).select("term", "df").toArrow()
        terms = own.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        yield index_of(turn, Statistics(
            n_items, (n_words or 0) / max(n_items, 1), terms[order], own.column("df").to_numpy()[order]))


def contaminated(docs: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of every
    test item found in a document, with its best passage.

    A map over the documents: they are neither shuffled nor cut.  Items come to
    the driver in turns of ``index_bytes`` (an item is never cut); what is found
    doesn't depend on the turns, since the weights count all items.  Null and
    empty texts and items match nothing; repeated rows are each reported; of two
    passages that score alike the first counts; items with a null id are left out;
    where an item has no question or no answer, the other part alone decides.
    Other columns are ignored, whatever their names; without documents or items
    the result is empty.
    """
    return reduce(DataFrame.union, [_searched(docs, index, how) for index in _indexes(items, how)])


def uncontaminated(docs: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """``docs`` without the rows in whose text a test item is found.

    A map: each row is judged by its own text, whatever its id and other columns.
    """
    place = docs.schema.fieldNames().index("text")
    for index in _indexes(items, how):
        docs = _without(docs, index, place, how)
    return docs


def _without(docs: DataFrame, index: Index | None, place: int, how: Search) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(index) if index else None)  # at most index_bytes of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        index = Index(**shared.value) if shared.value else None
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            if index is not None:
                clean[[f[0] for f in _search(index, batch.column(place).cast(pa.string()), how)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _searched(docs: DataFrame, index: Index | None, how: Search) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(index) if index else None)  # at most index_bytes of items
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        forget_encoder()
        index = Index(**shared.value)
        for batch in batches:
            found = list(_search(index, batch.column(1), how))
            if found:
                ids = batch.column(0).take(pa.array([f[0] for f in found]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found]) for k in range(1, 6))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
