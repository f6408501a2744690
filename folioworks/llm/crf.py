"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import words as W
from .tables import extended, forget_encoder, held_out, scratch_dir, stored

# Byte classes: lower, upper, digit, blank, sentence marks, "!", "|", other signs, above ASCII.
_CLASSES = 9
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6

FEATURES = 16

# Rows judged at once when the score is calibrated.
_ROWS = 500


@dataclass(frozen=True)
class Training:
    """The model is fitted on all labelled rows that aren't held out, in groups of about
    ``documents`` rows, dealt by a hash of their id; the groups' weights are averaged by
    their lines.  Texts of more than ``most_lines`` lines teach in chains of so many."""

    documents: int = 4000
    most_lines: int = 400
    rounds: int = 120
    rate: float = 0.1
    penalty: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log-odds of "good", for a line's features and its neighbours'
    turn: np.ndarray  # 2 x 2 scores of (label before, label)
    slope: float  # calibration of the document score
    shift: float


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a non-blank byte, its length in bytes, and the rows' line offsets."""
    starts, ends = W.spans(data, offsets, data != 10)
    hashes, at, stop, _ = W.words(data, offsets, W.NOT_SPACE)
    line_of = np.searchsorted(starts, at, side="right") - 1
    n_words = np.bincount(line_of, minlength=len(starts))
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[again], minlength=len(starts))
    letters = np.bincount(line_of, weights=stop - at, minlength=len(starts))
    size = ends - starts
    byte_line = np.repeat(np.arange(len(starts)), size)
    counts = np.bincount(byte_line * _CLASSES + _CLASS[data[data != 10]], minlength=len(starts) * _CLASSES)
    counts = counts.reshape(-1, _CLASSES)
    kept = n_words > 0
    starts, counts, size, n_words, repeats, letters = (x[kept] for x in (starts, counts, size, n_words, repeats, letters))
    share = counts / np.maximum(size, 1)[:, None]
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    again = repeats / np.maximum(n_words - 1, 1)
    out = np.empty((len(starts), FEATURES), dtype=np.float32)
    out[:, :5] = share[:, [2, 3, 4, 7, 8]] * [4, 2, 4, 8, 1]
    out[:, 5], out[:, 6], out[:, 7] = share[:, 5] * 8, share[:, 6] * 8, upper
    out[:, 8], out[:, 9], out[:, 10] = np.log1p(size) / 5, np.log1p(n_words) / 3, letters / n_words / 10
    out[:, 11] = again
    out[:, 12:] = np.stack([upper > 0.6, share[:, 7] > 0.04, share[:, 5] + share[:, 6] > 0.03, again > 0.3], axis=1)
    return out, size.astype(np.float64), np.searchsorted(starts, offsets)


def _windowed(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its row."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    first, last = lines[:-1][np.diff(lines) > 0], lines[1:][np.diff(lines) > 0] - 1
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(features), 1), np.float32), features, before, after], axis=1)


def marginals(odds: np.ndarray, lines: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all rows at once: P(good) of each line and, summed
    over the lines, the expected label pairs (2 x 2).

    Rows advance together, longest first, so a step handles only the rows that
    still have a line.  Messages are scaled at every step.
    """
    count = np.diff(lines)
    order = np.argsort(-count, kind="stable")
    begin, count = lines[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest), side="left")
    edge = np.exp(turn)
    factor = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], axis=1)
    ahead = np.empty((len(odds), 2))
    back = np.ones((len(odds), 2))
    for t in range(longest):
        here = begin[: live[t]] + t
        m = factor[here] * (ahead[here - 1] @ edge) if t else factor[here]
        ahead[here] = m / m.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        here = begin[: live[t + 1]] + t
        m = (factor[here + 1] * back[here + 1]) @ edge.T
        back[here] = m / m.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    later = np.ones(len(odds), dtype=bool)
    later[begin[count > 0]] = False
    later = np.flatnonzero(later)
    pair = ahead[later - 1][:, :, None] * edge * (factor[later] * back[later])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


def _fit_chain(x: np.ndarray, label: np.ndarray, lines: np.ndarray, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the conditional likelihood; labels weigh alike as classes."""
    weights, turn = np.zeros(x.shape[1]), np.zeros((2, 2))
    later = np.ones(len(x), dtype=bool)
    later[lines[:-1][np.diff(lines) > 0]] = False
    later = np.flatnonzero(later)
    seen = np.bincount(label[later - 1] * 2 + label[later], minlength=4).reshape(2, 2)
    moment = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    for k in range(1, how.rounds + 1):
        good, pairs = marginals(x @ weights, lines, turn)
        gradient = np.concatenate([(label - good) @ x / len(x) - how.penalty * weights,
                                   ((seen - pairs) / max(len(later), 1) - how.penalty * turn).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * gradient
        moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
        step = how.rate * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        weights, turn = weights + step[:-4], turn + step[-4:].reshape(2, 2)
    return weights, turn


def _document_scores(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals, weighted by their length."""
    total = W.reduced(np.add, size, lines, 0.0)
    return W.reduced(np.add, good * size, lines, 0.0) / np.maximum(total, 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _log_odds(features: np.ndarray, size: np.ndarray, lines: np.ndarray, model: Model) -> np.ndarray:
    """The rows' document scores as log-odds, before calibration."""
    good, _ = marginals(_windowed(features, lines) @ model.weights, lines, model.turn)
    return _logit(_document_scores(good, size, lines))


def _stacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lines' features that a binary column holds for each row, and the rows' line offsets."""
    rows = [np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in column.to_pylist()]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Learn from labelled rows that aren't held out.

    Lines start with their document's label; after a first fit, the lines of
    low-quality documents that look good by themselves count as good, so that
    a clean paragraph in a bad document teaches nothing wrong.  Without both
    labels among the rows the score is constant at their share of label 1.

    Features are made where the texts are read, of all rows that aren't held out; they,
    not the texts, are joined with the labels.  The join is a merge at every size: what
    moves grows with the lines, and no label table has to fit into a task.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    base = scratch_dir(docs.sparkSession)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            for first, end, data, offsets in W.groups(batch.column(1)):
                features, size, lines = line_features(data, offsets)
                size, bounds = size.astype(np.uint32), list(zip(lines[:-1].tolist(), lines[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first),
                     *(pa.array([x[i:j].tobytes() for i, j in bounds], pa.binary()) for x in (features, size))],
                    ["doc_id", "features", "sizes"])

    texts = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    made = texts.mapInArrow(featured, extended(texts.select("doc_id"), "features binary, sizes binary"))
    train = written(
        made.join(known.hint("merge"), "doc_id").select("doc_id", "quality", "features", "sizes"),
        f"{base}/train", large_rows=True)
    share = train.agg(F.count("*").alias("n"), F.mean("quality").alias("mean"), F.min("quality").alias("low"), F.max("quality").alias("high")).first()
    if share.n == 0 or share.low == share.high:
        return Model(np.zeros(1 + 3 * FEATURES), np.zeros((2, 2)), 0.0, float(_logit(np.array(share.mean if share.n else 0.5))))

    groups = max(1, round(share.n / how.documents))

    def learned(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        features, of_row = _stacked(table.column("features"))
        count = np.diff(of_row)
        chains = np.concatenate([np.diff(np.append(np.arange(0, n, how.most_lines), n)) for n in count.tolist()])
        lines = np.concatenate([[0], np.cumsum(chains)])
        x = _windowed(features, lines).astype(np.float64)
        label = np.repeat(table.column("quality").to_numpy(), count)
        weights, turn = _fit_chain(x, label, lines, how)
        alone = x @ weights > 1
        weights, turn = _fit_chain(x, np.where((label == 0) & alone, 1, label), lines, how)
        return pa.table({"lines": pa.array([len(x)], pa.int64()), "w": pa.array([[*weights.tolist(), *turn.ravel().tolist()]])})

    with_lines = train.filter(F.octet_length("sizes") > 0)
    dealt = with_lines.select(
        "doc_id", "quality", "features", F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(groups)).alias("group"))
    fits = dealt.repartition(groups, "group").groupBy("group").applyInArrow(learned, "lines long, w array<double>")
    n = 1 + 3 * FEATURES
    means = stored(fits, f"{base}/fits").agg(*[
        (F.sum(F.col("w")[k] * F.col("lines")) / F.sum("lines")).alias(f"w{k}") for k in range(n + 4)]).first()
    if means[0] is None:  # no text has a line
        return Model(np.zeros(n), np.zeros((2, 2)), 0.0, float(_logit(np.array(share.mean))))
    mean = np.array(means)
    bare = Model(mean[:n], mean[n:].reshape(2, 2), 1.0, 0.0)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                quality, features, sizes = batch.slice(at, _ROWS).columns
                features, lines = _stacked(features)
                size = np.concatenate([np.frombuffer(v, np.uint32) for v in sizes.to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [quality, pa.array(_log_odds(features, size, lines, bare))], ["quality", "z"])

    # Logistic calibration of the document score, on all training rows with a line.
    seen = with_lines.select("quality", "features", "sizes").mapInArrow(judged, "quality int, z double")
    seen = stored(seen, f"{base}/seen")
    slope, shift = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") * float(slope) + float(shift)))))
        z, h, off = F.col("z"), p * (1 - p) + 1e-6, F.col("quality") - p
        m = seen.agg(*(F.mean(c) for c in (off * z, off, h * z * z, h * z, h))).first()
        step = 0.5 * np.linalg.solve(np.array([[m[2] + 1e-3, m[3]], [m[3], m[4]]]), np.array([m[0] - 1e-3 * slope, m[1]]))
        slope, shift = slope + step[0], shift + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(bare.weights, bare.turn, float(max(slope, 0.0)), float(shift))


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for _, _, data, offsets in W.groups(column):
        features, size, lines = line_features(data, offsets)
        z = _log_odds(features, size, lines, model)
        p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))
        out.append(np.where(np.diff(lines) > 0, p, 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def scored(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with ``column``, the score (0 to 1) of each whole text.

    Null texts, empty ones and those of white space only have no line and score
    0.  Texts of any length are read whole; repeated rows score alike, each by
    itself; an empty table stays empty.  Other columns are passed through and never
    read; one that is named like ``column``, in any case, is replaced.
    """
    docs = docs.drop(column)
    fields = docs.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            score = pa.array(score_texts(batch.column(fields.index("text")), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, column])

    return docs.mapInArrow(run, extended(docs, f"`{column}` double"))
