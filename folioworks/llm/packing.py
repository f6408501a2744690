"""Vector best-fit packing of tokenised documents into training sequences."""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import extended, release_memory, scratch_dir, stored

WORD_BPE = "word_bpe_49k.json"


@dataclass(frozen=True)
class Bins:
    """Capacities of a sequence: tokens, documents, and attention cost (the sum of
    squared piece lengths, as a share of the square of the token capacity).

    Pieces are packed in groups of about ``group_rows``; a group leaves at most
    a few bins part empty, so the loss against one packing of all pieces is a
    fraction of a percent.
    """

    tokens: int = 4096
    documents: int = 4096
    cost: float = 1.0
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "product"  # or "residual"
    group_rows: int = 50_000
    end_id: int = 1
    # Words (and as many parts of other texts) whose ids a worker remembers before it starts anew.
    remembered: int = 300_000


#: Letters that need no look at their neighbours: ASCII and the Latin blocks behind it, lowered.
LATIN = "a-zÀ-ÖØ-öø-ɏ"
#: The tokenizer's own split, for texts of ASCII characters and those letters.
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+", re.ASCII)
#: Any other character, or what could start a special token.
OTHER = re.compile(rf"[^\x00-\x7f{LATIN}]|<\|")
BLANK = re.compile("[ \t\r\n]")


class Encoder:
    """Token ids of a text, word by word.

    The tokenizer never joins characters across words, so the ids of a text are
    those of its words in a row; each distinct word is encoded once.  A text in
    which :data:`OTHER` finds something is cut at blanks only, and each part is
    left to the tokenizer whole: it composes, lowers and splits by itself.
    """

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        words = Tokenizer.from_file(path)
        # Lowered and split already.
        words.normalizer = normalizers.Sequence([])
        words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.parts = Memory(words, remembered), Memory(Tokenizer.from_file(path), remembered)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids."""
        texts = [t or "" for t in texts]
        lowered = [t.lower() for t in texts]
        hard = [OTHER.search(t) is not None for t in lowered]
        by_word = self.words.ids([WORD.findall(t) for t, h in zip(lowered, hard) if not h])
        by_part = self.parts.ids([BLANK.split(t) for t, h in zip(texts, hard) if h])
        return [next(by_part if h else by_word) for h in hard]


class Memory:
    """Ids of strings, each encoded once while it is remembered.

    Strings of late stay; those not asked for while half of ``remembered`` others
    were go.  One call's strings are all held until the next.
    """

    def __init__(self, tokenizer, remembered: int):
        self.tokenizer, self.remembered, self.known, self.older = tokenizer, remembered, {}, {}

    def ids(self, rows: list[list[str]]) -> Iterator[bytes]:
        """The ids of each row's strings, one after another."""
        if len(self.known) > self.remembered // 2:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for word in {w for row in rows for w in row if w not in known}:
            ids = older.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        for k in range(0, len(new), 20_000):
            block = new[k : k + 20_000]
            for word, got in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)):
                ids = got.ids
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return (b"".join(map(known.__getitem__, row)) for row in rows)


@lru_cache(maxsize=1)
def encoder_of(path: str, remembered: int) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks that the worker gets."""
    return Encoder(path, remembered)


def tokenizer_path() -> str:
    """The public vocabulary on this machine, the default of :func:`pieces`."""
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def pieces(docs: DataFrame, path: str | None = None, bins: Bins = Bins()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    A document is its ids and then ``end_id``; null and empty texts are the end
    id alone.  Only longer ones are cut, into pieces of ``bins.tokens``.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encoder, end = encoder_of(path, bins.remembered), np.array([bins.end_id], dtype="<u4").tobytes()
        width = 4 * bins.tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    for k in range(0, len(ids), width):
                        own = ids[k : k + width]
                        rows.append((doc_id, k // width, k // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int32() if k == 1 else pa.int64()) for k in range(5)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest first.

    Each goes to the open bin with room in every capacity that has the largest
    weighted dot product of piece and residual ("product": smallest residual
    along the piece, see below) or the smallest weighted residual norm.  With
    "product" the fullest bin is preferred, so the sign of the dot product is
    taken on what would be left.  Ties go to the older bin.

    Bins are filed by the tokens they have left.  They are looked at from the
    fullest that fits on, until the tokens alone cost as much as the best found:
    the other terms are never negative, so none is missed.  With the default
    capacities of documents and cost, which only tokens can exhaust, this is best
    fit by tokens whose ties the other two terms settle.
    """
    room, share = bins.tokens, [1 / bins.tokens, 1 / bins.documents, 1 / (bins.cost * bins.tokens**2)]
    w = bins.weights
    product = bins.rule == "product"
    out, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    filed: dict[int, list[int]] = {}  # tokens left -> bins, older first
    levels: list[int] = []  # the tokens left that some bin has
    documents: list[int] = []
    squares: list[int] = []
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        square = size * size
        need = (size * share[0], share[1], square * share[2])
        best, cost, level = -1, float("inf"), 0
        for at in range(bisect.bisect_left(levels, size), len(levels)):
            left = levels[at]
            rest = (left - size) * share[0]
            tokens = w[0] * need[0] * rest if product else (w[0] * rest) ** 2
            if tokens > cost:
                break
            for number in filed[left]:
                free = 1 - (documents[number] + 1) * share[1], 1 - (squares[number] + square) * share[2]
                if min(free) > -1e-9:
                    now = (tokens + w[1] * need[1] * free[0] + w[2] * need[2] * free[1] if product
                           else tokens + (w[1] * free[0]) ** 2 + (w[2] * free[1]) ** 2)
                    if now < cost or (now == cost and number < best):
                        best, cost, level = number, now, left
        if best < 0:
            best, level = len(documents), room
            documents.append(0)
            squares.append(0)
        else:
            filed[level].remove(best)
            if not filed[level]:
                del filed[level], levels[bisect.bisect_left(levels, level)]
        out[i], offset[i] = best, room - level
        documents[best] += 1
        squares[best] += square
        level -= size
        if level >= smallest:  # others can take no piece any more
            if level not in filed:
                filed[level] = []
                bisect.insort(levels, level)
            bisect.insort(filed[level], best)
    return out, offset


def packed(cut: DataFrame, bins: Bins = Bins()) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own.  The others are dealt by a hash of
    their id into groups of about ``group_rows``, packed independently; equal
    rows may share a group but count as pieces of their own.
    """
    groups = int(-(-cut.count() // bins.group_rows)) or 1
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)))
    own_names = cut.columns
    names = [*own_names, "sequence_id", "offset"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        own, offset = best_fit(table.column("length").to_numpy(), bins)
        number = own * groups + key[0].as_py()
        return pa.table([*(table.column(c) for c in own_names), pa.array(number), pa.array(offset)], names)

    # By number of groups: small rows, much work; adaptive execution would merge them.
    return dealt.repartition(groups, "group").groupBy("group").applyInArrow(run, extended(cut, "sequence_id long, offset long"))


def pack(docs: DataFrame, path: str | None = None, bins: Bins = Bins()) -> DataFrame:
    """Tokenise, cut and pack all documents; tokenising is done once and stored."""
    return packed(stored(pieces(docs, path, bins), f"{scratch_dir(docs.sparkSession)}/pieces"), bins)
