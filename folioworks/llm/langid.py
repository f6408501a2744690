"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import extended, forget_encoder, held_out, scratch_dir, stored

ORDER = 4
PIECE = 500_000
_BITS = np.int64(16)


@dataclass(frozen=True)
class Training:
    """n-grams are counted over every training text, and the model keeps them all.
    Up to ``entries`` of them, over all languages and orders, are sent to the
    executors; a larger model stays a table that the texts' n-grams are joined
    with, to the same scores.  The rejection threshold is fitted on all training
    texts, too."""

    entries: int = 2_000_000


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each character its 16-bit code if it is a letter or a mark, else 0; and which codes are letters.

    Lower-case forms stand for both cases.  Letters beyond 16 bits share the codes
    of the private use area; marks there count as nothing.
    """
    code, letter = np.zeros(0x110000, dtype=np.uint16), np.zeros(65536, dtype=bool)
    for at in range(0x110000):
        kind = unicodedata.category(chr(at))[0]
        if at > 0xFFFF:
            if kind == "L":
                code[at] = 0xE000 + at % 6400
        elif kind in "LM":
            code[at] = ord(chr(at).lower()[0])
            letter[code[at]] |= kind == "L"
    letter[0xE000 : 0xE000 + 6400] = True
    return code, letter


_tables: tuple[np.ndarray, np.ndarray] | None = None


def _known() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        _tables = _characters()
    return _tables


def folded(text: str) -> np.ndarray:
    """Letters and marks in lower case, with a 0 for each run of anything else, and one at the end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.concatenate([_known()[0][code], np.zeros(1, np.uint16)])
    kept = out > 0
    kept[1:] |= out[:-1] > 0
    return out[kept]


def is_letter(chars: np.ndarray) -> np.ndarray:
    """Which folded characters are letters: no marks, no gaps."""
    return _known()[1][chars]


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(characters, row of each), in pieces of about ``PIECE`` characters.

    A long text is cut between words, where the model starts anew anyway.
    """
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text):
            end = min(at + PIECE, len(text))
            if end < len(text):
                gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                end = gap if gap > at else end
            part = folded(text[at:end])
            held.append(part)
            rows.append(np.full(len(part), row))
            size, at = size + len(part), end
            if size >= PIECE:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(rows)


def grams(chars: np.ndarray) -> np.ndarray:
    """The packed 4-gram ending at each character; the context stops at the word's start."""
    now = chars.astype(np.int64)
    packed, before = now.copy(), now
    alive = np.ones(len(now), dtype=bool)
    for k in range(1, ORDER):
        before = np.concatenate([[0], before[:-1]])
        alive &= before > 0
        packed |= np.where(alive, before, 0) << (_BITS * k)
    return packed


@dataclass(frozen=True)
class Model:
    """Sorted n-gram codes of each order with a row of log2 probabilities, a
    column for each language, and likewise the back-off weights of contexts."""

    languages: list[str]
    codes: list[np.ndarray]
    scores: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    short: float
    cut: float

    def scores_of(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log2 P of each n-gram's last character under every language."""
        if order == 0:
            return np.broadcast_to(self.scores[0], (len(packed), len(self.languages)))
        keys = self.codes[order]
        if not len(keys):
            return self.scores_of(packed, order - 1)
        at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
        out = self.scores[order][at]
        lost = np.flatnonzero(keys[at] != packed)
        if len(lost):
            missing = packed[lost]
            lower = self.scores_of(missing & ((np.int64(1) << (_BITS * (order - 1))) - 1), order - 1)
            ctx, known = missing >> _BITS, self.contexts[order]
            place = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            weight = np.where((known[place] == ctx)[:, None], self.backoffs[order][place], np.float32(0))
            out[lost] = lower + weight
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character for each row and language, and the letters of each row."""
        total = np.zeros((len(texts), len(self.languages)))
        n, letters = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for chars, rows in pieces(texts):
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            # In float64: a long text adds up millions of terms.
            total[rows[first]] -= np.add.reduceat(self.scores_of(grams(chars)), first, axis=0, dtype=np.float64)
            n += np.bincount(rows, minlength=len(texts))
            letters += np.bincount(rows[is_letter(chars)], minlength=len(texts))
        return total / np.maximum(n, 1)[:, None], letters

    def surprise(self, entropy: np.ndarray, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """How far a row's lowest cross-entropy lies above its language's own, in standard deviations."""
        scale = np.sqrt(self.spread[best] ** 2 + self.short / np.maximum(letters, 1))
        return (entropy[np.arange(len(best)), best] - self.mean[best]) / scale


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, code, c): how often each 4-gram occurs in each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate([p[k] for p in held[lang]]) for k in (0, 1))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(counts, first)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in held:
                codes, counts = merged(lang)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "c"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for chars, rows in pieces(batch.column(1).to_pylist()):
                packed, own = grams(chars), langs[rows[np.concatenate([[True], rows[1:] != rows[:-1]])]]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                length = np.diff(np.concatenate([first, [len(rows)]]))
                for lang in set(own):
                    codes, counts = np.unique(packed[np.repeat(own == lang, length)], return_counts=True)
                    held.setdefault(lang, []).append((codes, counts))
                    size += len(codes)
            if size > 4_000_000:
                held.update({lang: [merged(lang)] for lang in held})
                size = sum(len(p[0][0]) for p in held.values())
                if size > 2_000_000:  # hand on what doesn't shrink
                    yield from out()
                    held.clear()
                    size = 0
        if held:
            yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(
        F.sum("c").alias("c"))


@dataclass(frozen=True)
class TableModel:
    """The same model as tables: of each order (code, scores) and (context,
    backoffs), maps from a language's place to log2 values."""

    languages: list[str]
    unseen: float
    scores: list[DataFrame | None]
    backoffs: list[DataFrame | None]
    mean: np.ndarray
    spread: np.ndarray
    short: float
    cut: float

    def scores_of(self, codes: DataFrame, order: int = ORDER) -> DataFrame:
        """(code, p): log2 P under every language for each of the distinct ``codes``."""
        places = F.sequence(F.lit(0), F.lit(len(self.languages) - 1))
        if order == 0:
            return codes.withColumn("p", F.transform(places, lambda k: F.lit(self.unseen)))
        suffix = F.col("code").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1))
        lower = self.scores_of(codes.select(suffix.alias("code")).distinct(), order - 1)
        return (
            codes.withColumn("suffix", suffix).withColumn("context", F.shiftright("code", 16))
            .join(self.scores[order], "code", "left").join(self.backoffs[order], "context", "left")
            .join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
            .select("code", F.transform(places, lambda k: F.coalesce(
                F.col("scores")[k], F.element_at("lower", k + 1) + F.coalesce(F.col("backoffs")[k], F.lit(0.0)))).alias("p"))
        )

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(row, entropy, letters) of (row, text): cross-entropy in bits a character
        under every language; no row for texts without characters."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for chars, rows in pieces(batch.column(1).to_pylist()):
                    packed = grams(chars)
                    order = np.lexsort((packed, rows))
                    packed, rows = packed[order], rows[order]
                    first = np.flatnonzero(np.concatenate([[True], (packed[1:] != packed[:-1]) | (rows[1:] != rows[:-1])]))
                    n, code = np.diff(np.append(first, len(rows))), packed[first]
                    own = np.where(is_letter(code & 0xFFFF), n, 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows[first]]), pa.array(code), pa.array(n), pa.array(own)], ["row", "code", "n", "own"])

        spark = texts.sparkSession
        held = stored(texts.mapInArrow(run, "row long, code long, n long, own long"), f"{scratch_dir(spark)}/held")
        known = stored(self.scores_of(held.select("code").distinct()), f"{scratch_dir(spark)}/known")
        bits = [(-F.sum(F.col("n") * F.col("p")[k]) / F.sum("n")) for k in range(len(self.languages))]
        return held.join(known, "code").groupBy("row").agg(F.array(*bits).alias("entropy"), F.sum("own").alias("letters"))


def _tabled(tables: dict[int, DataFrame], discounts: dict[int, dict[str, float]], languages: list[str], unseen: float) -> TableModel:
    """The interpolated model of the counts, without bringing it to one place."""
    base = scratch_dir(tables[1].sparkSession)
    scores, backoffs, lower = [None], [None], None
    for order in range(1, ORDER + 1):
        discount = place = F.lit(None)
        for k, lang in enumerate(languages):
            here = F.col("lang") == lang
            discount = F.when(here, F.lit(discounts[order][lang])).otherwise(discount)
            place = F.when(here, F.lit(k)).otherwise(place)
        t = tables[order].withColumn("context", F.shiftright("code", 16)).withColumn("d", discount).withColumn("place", place)
        totals = t.groupBy("lang", "context", "place").agg(
            F.sum("c").alias("total"), (F.first("d") * F.count("*") / F.sum("c")).alias("weight"))
        totals = stored(totals, f"{base}/totals-{order}")
        t = t.join(totals.select("lang", "context", "total", "weight"), ["lang", "context"])
        if lower is None:
            t = t.withColumn("q", F.lit(2.0 ** unseen))
        else:
            # Every suffix of a counted n-gram is counted itself.
            t = t.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1))).join(
                lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")
        lower = stored(t.select("lang", "place", "code", F.greatest(p, F.lit(1e-30)).alias("p")), f"{base}/p-{order}")

        def by_language(key, value, of):
            return of.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", F.log2(value)))).alias("v"))

        scores.append(stored(by_language("code", "p", lower).withColumnRenamed("v", "scores"), f"{base}/scores-{order}"))
        backoffs.append(stored(by_language("context", "weight", totals).withColumnRenamed("v", "backoffs"), f"{base}/backoffs-{order}"))
    return TableModel(languages, unseen, scores, backoffs, np.zeros(len(languages)), np.ones(len(languages)), 0.0, np.inf)


def fit(docs: DataFrame, how: Training = Training()) -> Model | TableModel:
    """Count, discount and interpolate; a model beyond ``how.entries`` stays in tables.

    The lower orders count in how many different contexts an n-gram occurs
    (Kneser-Ney); each order's discount comes from its own n1 and n2.
    """
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.coalesce("doc_id", F.lit(0))))
    base = scratch_dir(docs.sparkSession)
    tables = {ORDER: stored(_counted(train), f"{base}/grams-{ORDER}")}
    for order in range(ORDER - 1, 0, -1):
        low = (1 << (16 * order)) - 1
        tables[order] = tables[order + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit(low)).alias("code")).agg(
            F.count("*").alias("c"))
        tables[order] = stored(tables[order], f"{base}/grams-{order}")
    languages = sorted(r.lang for r in tables[1].select("lang").distinct().collect())
    codes, scores = [np.zeros(0, np.int64)], [np.zeros(len(languages))]
    contexts, backoffs = [np.zeros(0, np.int64)], [np.zeros((0, len(languages)), np.float32)]
    if not languages:
        none = np.zeros(0)
        return Model([], codes, scores, contexts, backoffs, none, none, 1.0, np.inf)
    alphabet = tables[1].select("code").distinct().count() + 1
    scores[0] = np.full(len(languages), -np.log2(alphabet), np.float32)
    discounts = {}
    for order, t in tables.items():
        ones = {(r.lang, r.c): r.n for r in t.filter("c <= 2").groupBy("lang", "c").agg(F.count("*").alias("n")).collect()}
        discounts[order] = {}
        for lang in languages:
            n1, n2 = ones.get((lang, 1), 0), ones.get((lang, 2), 0)
            discounts[order][lang] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    if sum(t.count() for t in tables.values()) > how.entries:
        return _calibrated(_tabled(tables, discounts, languages, float(-np.log2(alphabet))), train)
    for order in range(1, ORDER + 1):
        t, discount = tables[order], discounts[order]
        context = F.shiftright("code", 16).alias("context")
        totals = t.groupBy("lang", context).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        rows = t.withColumn("context", context).join(totals, ["lang", "context"]).toArrow()
        column = {lang: k for k, lang in enumerate(languages)}
        which = np.array([column[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
        code, ctx, c, total, types = (rows.column(k).to_numpy() for k in ("code", "context", "c", "total", "types"))
        d = np.array([discount[x] for x in languages])[which]
        known = np.unique(ctx)
        weight = np.zeros((len(known), len(languages)), np.float32)
        weight[np.searchsorted(known, ctx), which] = np.log2(d * types / total)
        keys = np.unique(code)
        so_far = Model(languages, codes, scores, contexts, backoffs, None, None, 0.0, 0.0)
        lower = so_far.scores_of(keys & np.int64((1 << (16 * (order - 1))) - 1), order - 1)
        p = np.exp2(lower + weight[np.searchsorted(known, keys >> _BITS)]).astype(np.float64)
        p[np.searchsorted(keys, code), which] += (c - d) / total
        codes.append(keys)
        scores.append(np.log2(np.maximum(p, 1e-30)).astype(np.float32))
        contexts.append(known)
        backoffs.append(weight)
    bare = Model(languages, codes, scores, contexts, backoffs, np.zeros(len(languages)), np.ones(len(languages)), 0.0, np.inf)
    return _calibrated(bare, train)


def _calibrated(model: Model | TableModel, train: DataFrame) -> Model | TableModel:
    """Rejection: a text must look two and a half times as strange as any training row."""
    seen = _measured(train.select("text"), model).select("best", "bits", "letters").filter("letters > 0")
    seen = stored(seen, f"{scratch_dir(train.sparkSession)}/seen")
    mean, spread = np.zeros(len(model.languages)), np.ones(len(model.languages))
    long = F.when(F.col("letters") >= 200, F.col("bits"))
    for r in seen.groupBy("best").agg(
        F.coalesce(F.mean(long), F.mean("bits")).alias("mean"), F.coalesce(F.stddev_pop(long), F.stddev_pop("bits")).alias("spread"),
    ).collect():  # a row for each language
        mean[r.best], spread[r.best] = r.mean, max(r.spread, 0.05)

    def own(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])[F.col("best").cast("int")]

    above = F.col("bits") - own(mean)
    short = seen.filter("letters < 200").agg(F.mean(above**2 * F.col("letters"))).first()[0]
    model = replace(model, mean=mean, spread=spread, short=max(4.0 if short is None else short, 1.0))
    most = seen.agg(F.max(above / F.sqrt(own(spread) ** 2 + model.short / F.col("letters")))).first()[0]
    return replace(model, cut=2.5 * max(most or 0.0, 4.0))


_MEASURES = ["best", "bits", "score", "odd", "letters"]


def _judged(model: Model | TableModel, entropy: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    """The columns ``_MEASURES`` of rows with these cross-entropies."""
    best = entropy.argmin(axis=1)
    bits = entropy[np.arange(len(best)), best]
    gap = np.minimum((entropy - bits[:, None]) * np.minimum(letters, 50)[:, None], 500)
    odd = Model.surprise(model, entropy, best, letters) > model.cut
    return [pa.array(best), pa.array(bits), pa.array(1 / np.exp2(-gap).sum(axis=1)), pa.array(odd), pa.array(letters)]


def _measured(docs: DataFrame, model: Model | TableModel) -> DataFrame:
    """``docs`` with ``_MEASURES``; these names are not among its columns."""
    schema = extended(docs, "best long, bits double, score double, odd boolean, letters long")
    place, names = docs.schema.fieldNames().index("text"), [*docs.columns, *_MEASURES]
    spark = docs.sparkSession
    if isinstance(model, Model):
        shared = spark.sparkContext.broadcast(vars(model))  # bounded by Training.entries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoder()
            model = Model(**shared.value)
            for batch in batches:
                entropy, letters = model.entropies(batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *_judged(model, entropy, letters)], names)

        return docs.mapInArrow(run, schema)
    # Stored, so that the rows' numbers stay.
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), f"{scratch_dir(spark)}/rows")
    found = model.entropies(rows.select("row", "text"))
    full = rows.join(found, "row", "left").select(*docs.columns, "entropy", F.coalesce("letters", F.lit(0)).alias("letters"))
    bare, n = replace(model, scores=[], backoffs=[]), len(model.languages)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy = np.array([e or [0.0] * n for e in batch.column(batch.num_columns - 2).to_pylist()]).reshape(-1, n)
            letters = batch.column(batch.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *_judged(bare, entropy, letters)], names)

    return full.mapInArrow(judge, schema)


def identified(docs: DataFrame, model: Model, prefix: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``lang_bits`` and ``lang_rejected``.

    ``prefix`` stands for ``lang`` in these names; columns of ``docs`` that have one
    of them, in any case, are replaced.  Rows are judged each by itself, repeated
    ones alike, long texts whole; an empty table stays empty.

    ``lang_pred`` is the language of the lowest cross-entropy, the first by name
    in a tie; ``lang_score`` its posterior over the languages for a sample of at
    most 50 characters.  A text that is null or has no letter is ``und``, with
    score 0, and rejected; so is every text if nothing could be learned.
    ``lang_rejected`` also marks texts that fit none of the languages.
    """
    own = [f"{prefix}_{x}" for x in ("pred", "score", "bits", "rejected")]
    docs = docs.drop(*own)
    if not model.languages:
        return docs.select("*", F.lit("und").alias(own[0]), F.lit(0.0).alias(own[1]), F.lit(0.0).alias(own[2]),
                           F.lit(True).alias(own[3]))
    kept = [F.col(c).alias(f"c{k}") if c != "text" else F.col(c) for k, c in enumerate(docs.columns)]
    out, known = _measured(docs.select(*kept), model), F.col("letters") > 0
    names = F.array(*[F.lit(x) for x in model.languages])
    return out.select(
        *[F.col(f"c{k}").alias(c) if c != "text" else F.col(c) for k, c in enumerate(docs.columns)],
        F.when(known, names[F.col("best").cast("int")]).otherwise("und").alias(own[0]),
        F.when(known, F.col("score")).otherwise(0.0).alias(own[1]),
        F.when(known, F.col("bits")).otherwise(0.0).alias(own[2]),
        (F.col("odd") | ~known).alias(own[3]))
