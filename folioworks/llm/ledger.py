"""Quality rules as a ledger: every rule is evaluated once, policies are masks over its bits.

The ledger has a row for each document: its measurements and a bit for each rule
it fails.  A policy is a versioned set of rules; applying it, comparing versions
and asking what a rule alone removes are bitwise operations over the ledger, and
no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import extended

#: What is measured of a text, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_listed", "n_trailing")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_REPEATED = 3  # words of a window


@dataclass(frozen=True)
class Rule:
    """A rule is failed where ``times * measure > limit * per`` (``above``) or is less (not ``above``)."""

    name: str
    measure: str
    times: int
    limit: int
    per: str | None = None
    above: bool = True

    def failed(self) -> Column:
        left = F.col(self.measure) * self.times
        right = F.col(self.per) * self.limit if self.per else F.lit(self.limit)
        return left > right if self.above else left < right


#: Bit k of a ledger is rule k.  New rules go to the end: stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words", 1, 50, above=False),
    Rule("repeated_words", "n_repeat_words", 100, 50, "n_words"),
    Rule("long_words", "word_chars", 1, 15, "n_words"),
    Rule("short_words", "word_chars", 1, 2, "n_words", above=False),
    Rule("symbols", "n_symbols", 10, 1, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", 100, 30, "n_lines"),
    Rule("few_letters", "n_lettered", 100, 70, "n_words", above=False),
    Rule("list_lines", "n_listed", 100, 90, "n_lines"),
    Rule("trailing_lines", "n_trailing", 100, 30, "n_lines"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(rule) for rule in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("prose", 1, (*BASE.rules, "long_words", "short_words", "symbols")),
    Policy("prose", 2, tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _in_rows(starts: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one for each start) by row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[np.searchsorted(starts, offsets)])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all lines; the last one of a row ends with it."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((starts, rows))
    ends = ends[np.lexsort((ends, np.concatenate([row, np.arange(len(offsets) - 1)])))]
    return starts[order], ends, rows[order]


def _seen_before(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Does an earlier place of the same row hold the same key?"""
    order = np.lexsort((key, row))  # stable: places stay in order
    again = np.zeros(len(row), dtype=bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def _in_repeated(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word: does it lie in a window of words that its row has twice or more?"""
    out = np.zeros(len(hashes), dtype=bool)
    n = len(hashes) - _REPEATED + 1
    if n < 1:
        return out
    keys = W.position_keys(_REPEATED)
    window = W.mixed(sum((hashes[k : k + n] * keys[k] for k in range(_REPEATED)), np.zeros(n, np.uint64)))
    row = np.searchsorted(at, np.arange(n), side="right") - 1
    place = np.flatnonzero(np.arange(n) + _REPEATED <= at[row + 1])
    row, window = row[place], window[place]
    order = np.lexsort((window, row))
    same = (window[order[1:]] == window[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    twice = np.zeros(len(place), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for k in range(_REPEATED):
        out[place[twice] + k] = True
    return out


def measured(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``MEASURES`` of each row's whole text."""
    inside = W.NOT_SPACE[data]
    starts, ends = W.spans(data, offsets, inside)
    hashes = W.span_hashes(data, inside, starts, ends)
    at = np.searchsorted(starts, offsets)
    whole = (data & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(whole & inside)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])

    line_start, line_end, line_row = _lines(data, offsets)
    word = np.searchsorted(starts, line_start)  # a line's first word
    last = np.searchsorted(starts, line_end) - 1
    full = np.flatnonzero(last >= word)
    line_start, line_end, line_row, word, last = (x[full] for x in (line_start, line_end, line_row, word, last))
    length = line_end - line_start
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    text = data[place + np.repeat(line_start, length)].astype(np.uint64) + np.uint64(1)
    text *= W.position_keys(int(length.max()) if len(length) else 1)[place]
    key = W.mixed(np.add.reduceat(text, begin)) if len(length) else np.zeros(0, np.uint64)
    head, tail = starts[word], ends[last]
    listed = np.isin(data[head], np.frombuffer(b"-*", np.uint8)) if len(head) else np.zeros(0, bool)
    dots = np.zeros(len(tail), dtype=bool)
    three = np.flatnonzero(tail - starts[last] >= 3) if len(tail) else np.zeros(0, np.int64)
    dots[three] = (data[tail[three] - 1] == 46) & (data[tail[three] - 2] == 46) & (data[tail[three] - 3] == 46)

    def by_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line_row[flags], minlength=len(offsets) - 1)

    return [
        np.diff(at), np.diff(points[offsets]), np.diff(symbols[offsets]), by_row(_seen_before(line_row, key)),
        _in_rows(starts, offsets, _in_repeated(hashes, at)), by_row(np.ones(len(line_row), bool)),
        _in_rows(starts, offsets, letters[ends] > letters[starts]), by_row(listed), by_row(dots)]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, the ``MEASURES`` of that, and ``failures``: bit k is set where rule k is failed.

    A map over the documents.  A null text counts as empty; an empty one, of white
    space too, has no words and measures 0 throughout (so it fails ``few_words``
    alone).  Texts are read whole, a long one in a step of its own; repeated and
    equal rows are measured each by itself; an empty table gives an empty ledger.
    Columns of ``docs`` that are named like one of the ledger's are left out, so
    the ledger's own stand.
    """
    own = {*MEASURES, "failures"}
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in own]
    docs = docs.select(*others, F.col(text).cast("string").alias(text))
    column = len(others)
    schema = extended(docs.drop(text), ", ".join(f"{m} long" for m in MEASURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measured(data, offsets) for _, _, data, offsets in W.groups(batch.column(column))]
            if parts:
                more = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], *MEASURES])

    bits = (F.when(rule.failed(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES))
    return docs.mapInArrow(run, schema).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def failed(policy: Policy) -> Column:
    """Does a ledger's row fail a rule of the policy?"""
    return F.col("failures").bitwiseAND(F.lit(policy.mask()).cast("long")) != 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule of each policy does: one row for each (policy, version, rule).

    ``failed``: rows that fail the rule; ``alone``: rows that only this rule of the
    policy removes, so that many more stay without it; ``kept`` and
    ``kept_without``: rows that stay with and without it; ``with_others``: bits of
    the policy's rules that ever fail together with it.  The ledger is counted by
    its distinct bits first (at most 2 ** number of rules), whatever its size.  An
    empty ledger gives zeros.
    """
    spark = entries.sparkSession
    counts = entries.groupBy("failures").agg(F.count("*").alias("n"))
    names = [r.name for r in RULES]
    asked = spark.createDataFrame(
        [(p.name, p.version, rule, p.mask(), 1 << names.index(rule)) for p in policies for rule in sorted(set(p.rules), key=names.index)],
        "policy string, version int, rule string, mask long, bit long")
    # A set of a few rules of constants for each distinct value of the bits.
    both = counts.withColumn("hit", F.explode(F.array(*(
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"),
                 F.lit(p.mask()).cast("long").alias("mask"), F.lit(1 << names.index(rule)).cast("long").alias("bit"))
        for p in policies for rule in set(p.rules))))).select("failures", "n", "hit.*")
    inside = F.col("failures").bitwiseAND(F.col("mask"))
    has = F.col("failures").bitwiseAND(F.col("bit")) != 0
    done = both.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(has, F.col("n"))).alias("failed"),
        F.sum(F.when(inside == F.col("bit"), F.col("n"))).alias("alone"),
        F.sum(F.when(inside == 0, F.col("n"))).alias("kept"),
        F.sum(F.when(inside.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))).alias("kept_without"),
        F.bit_or(F.when(has, inside.bitwiseAND(F.bitwise_not("bit")))).alias("with_others"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("failed", "alone", "kept", "kept_without", "with_others")}
    return asked.join(F.broadcast(done), ["policy", "version", "rule"], "left").withColumns(zero).drop("mask", "bit")
