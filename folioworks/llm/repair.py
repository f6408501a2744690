"""Conversation structure repair by depth-first branch and bound.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Rows are
kept, given the other role, or deleted, and empty turns inserted; the cheapest
sequence of edits is wanted, of equally cheap ones the ASCII-least.

The search runs over (row, state) nodes, where the state is what the output so far
ends with.  Conversations are streamed: first a code for each row, which the search
needs, then the rows themselves, which take the edits.  So a task holds some tens of
bytes for each row of its longest conversation, and no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import width

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5

_SPACE = " \t\n\x0b\x0c\r"
#: What the output ends with: nothing, a system, user or assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after the next user or assistant turn: user unless a user turn is open.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = 1 << 60


def _kept(state: int, initial: int) -> int:
    """State after a kept row with this initial, -1 if it can't stand there."""
    if initial == _SYSTEM:
        return _SYSTEM if state == _START else -1
    return initial if initial and initial == _NEXT[state] else -1


_KEPT = [[_kept(state, initial) for initial in range(4)] for state in range(4)]


def _moves(state: int, initial: int, must_go: bool, truncated: bool) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) of a row, in ASCII order."""
    out = [(DELETE, COST[DELETE], state)]
    if not must_go:
        more = TRUNCATED_COST if truncated else 0
        if _KEPT[state][initial] >= 0:
            out.append((KEEP, COST[KEEP] + more, _KEPT[state][initial]))
        out.append((REROLE, COST[REROLE] + more, _NEXT[state]))
    return out


#: Rows' codes: initial * 4 + must_go * 2 + truncated.
_MOVES = [[_moves(state, code >> 2, bool(code & 2), bool(code & 1)) for state in range(4)] for code in range(16)]


def suffix_bounds(codes: bytes) -> np.ndarray:
    """Least cost of completing the output from each node (row * 4 + state), by a sweep from the end."""
    out = np.empty((len(codes) + 1) * 4, dtype=np.int64)
    after = [0, _FAR, _FAR, 0]
    for row in range(len(codes), -1, -1):
        if row < len(codes):
            moves = _MOVES[codes[row]]
            after = [min(cost + after[then] for _, cost, then in moves[state]) for state in range(4)]
        for _ in range(2):  # an inserted pair at most
            after = [min(after[state], COST[INSERT] + after[_NEXT[state]]) for state in range(4)]
        out[row * 4 : row * 4 + 4] = after
    return out


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and audit (the edits' initials in order) of the best repair.

    Depth first with an explicit stack.  A node's children are entered by their
    lower bound (cost so far and suffix bound), equal ones in ASCII order.  A child
    is dropped if its bound exceeds the incumbent's cost, or equals it and its
    audit can't be less; if its node has been reached by a prefix no worse
    (dominance table); the search is over when the stack is empty, which proves the
    incumbent.
    """
    bounds = suffix_bounds(codes)
    last = len(codes)
    table = np.full(len(bounds), _FAR, dtype=np.int64)  # node -> cost of the best prefix
    best, audit = _FAR, b""
    path = bytearray()
    stack = [(0, 0, 0, b"")]  # node, cost so far, length of the path before its edit, edit
    while stack:
        node, cost, depth, edit = stack.pop()
        bound = cost + int(bounds[node])
        del path[depth:]
        path += edit
        if bound > best or (bound == best and bytes(path) >= audit[: len(path)]):
            continue
        # Bounds are exact, so prefixes of equal cost reach a node in ASCII order: the first is the least.
        if table[node] <= cost:
            continue
        table[node] = cost
        row, state = divmod(node, 4)
        if row == last and state in (_START, _ASSISTANT):
            best, audit = cost, bytes(path)
            continue
        children = [(cost + COST[INSERT] + int(bounds[row * 4 + _NEXT[state]]), INSERT, row * 4 + _NEXT[state], COST[INSERT])]
        if row < last:
            children += [(cost + price + int(bounds[row * 4 + 4 + then]), name, row * 4 + 4 + then, price)
                         for name, price, then in _MOVES[codes[row]][state]]
        for _, name, then, price in sorted(children, reverse=True):
            if table[then] > cost + price:
                stack.append((then, cost + price, len(path), name.encode()))
    return best, audit.decode()


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in order (``place`` from 0) with ``fault`` and ``illegal``, by conversation.

    ``rows``: conv_id, turn, role, text; null role or text: one space.  Order: turn
    (nulls first), then role and text.  The first fault counts: ``blank``,
    ``duplicate`` (role and text seen earlier), ``truncated``.  ``illegal``: this
    row's role cannot follow the one before it.
    """
    text = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    placed = rows.repartition(width(rows.sparkSession), "conv_id").withColumns({
        "place": F.row_number().over(whole) - 1,
        "illegal": F.coalesce(~F.concat(F.lag(initial).over(whole), initial).isin("su", "ua", "au"), F.lit(False)),
    })
    fault = (F.when(text == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return placed.withColumn("fault", fault)


_EDITS = ("conv_id long, turn long, role string, text string, fault string, illegal boolean, edit string, cost long, "
          "new_role string")


def edited(faults: DataFrame) -> DataFrame:
    """One row for each edit, in the order of the conversation, of rows from :func:`with_faults`.

    ``edit``: K(eep), R(erole), D(elete) or I(nsert); ``cost`` with what an undeleted
    truncated row adds; ``new_role``: the role in the repaired conversation, null for
    deleted rows.  Inserted rows have an empty text and no turn.  Rows of a
    conversation are next to each other and in order within a partition.
    """
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT).otherwise(0) * 4
            + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0))
    names = ("turn", "role", "text", "fault", "illegal")
    # Each row twice: its code among those that come first, then itself.
    coded = faults.withColumn("code", code).select(
        "conv_id", "place", F.explode(F.array(
            F.struct(F.lit(0).alias("phase"), "code", *(F.lit(None).cast(faults.schema[c].dataType).alias(c) for c in names)),
            F.struct(F.lit(1).alias("phase"), "code", *names))).alias("r")).select("conv_id", "place", "r.*")
    sorted_ = coded.sortWithinPartitions("conv_id", "phase", "place")
    return sorted_.select("conv_id", "phase", "code", F.col("turn").cast("long").alias("turn"), *names[1:]).mapInArrow(
        _streamed, _EDITS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows by (conv_id, phase)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[:2])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("fault", pa.string()), ("illegal", pa.bool_()), ("edit", pa.string()), ("cost", pa.int64()),
                        ("new_role", pa.string())])
    out: list[tuple] = []
    size = 0
    audit, state, at = "", _START, 0
    for (conversation, phase), rows in _runs(batches):
        if phase == 0:
            _, audit = cheapest_edits(bytes(r[2] for r in rows))
            state, at = _START, 0
            continue
        for _, _, code, turn, role, text, fault, illegal in _closed(rows):
            while at < len(audit) and audit[at] == INSERT:
                state, at = _NEXT[state], at + 1
                out.append((conversation, None, None, "", None, False, INSERT, COST[INSERT], _ROLES[state]))
            if code is None:
                break
            edit, at = audit[at], at + 1
            _, price, state = next(m for m in _MOVES[code][state] if m[0] == edit)
            new = None if edit == DELETE else role if edit == KEEP else _ROLES[state]
            out.append((conversation, turn, role, text, fault, illegal, edit, price, new))
            size += len(text) + 50
            if size > 4_000_000:
                yield _batch(out, schema)
                out, size = [], 0
    if out:
        yield _batch(out, schema)


def _closed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows and one more, after which only insertions come."""
    yield from rows
    yield (None,) * 8


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Every edit of the cheapest repair of each conversation; see :func:`edited`.

    ``rows``: conv_id, turn, role, text; other columns are ignored, whatever their
    names.  Null role or text count as one space; null ids are a conversation of
    their own, null turns come first.  Equal turns are ordered by role and text, and
    a repeated row is a duplicate.  Texts of any length are moved, not searched.  An
    empty table gives an empty result.

    One shuffle, by conversation.  A conversation is one task's work however long it
    is, since its repair is a sequence; it is streamed, see the module.
    """
    return edited(with_faults(rows))


def summarised(edits: DataFrame) -> DataFrame:
    """Faults, costs, audit and digest of each conversation, from rows that come as :func:`edited` gives them.

    ``gaps``: turns missing between the first and the last.  ``repaired_sha256``:
    hex digest of the repaired ``role:text`` joined by newlines.
    """
    names = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        schema = pa.schema([(n.split()[0], pa.string() if "string" in n else pa.int64()) for n in names.split(", ")])
        for conversation, own in groupby(rows, key=lambda r: r[0]):
            faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            first = turn = None
            distinct = wrong = total = said = 0
            audit, digest = bytearray(), hashlib.sha256()
            for _, now, _, text, fault, illegal, edit, cost, role in own:
                if fault:
                    faults[fault] += 1
                if now is not None and now != turn:
                    first, turn, distinct = now if first is None else first, now, distinct + 1
                wrong, total = wrong + bool(illegal), total + cost
                audit += edit.encode()
                if role is not None:
                    digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                    said += 1
            gaps = 0 if first is None else turn - first + 1 - distinct
            out.append((conversation, gaps, *faults.values(), wrong, total, audit.decode(), digest.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return edits.mapInArrow(run, names)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4
    makes it a user's.  Nulls count as one space, in the checksum too.
    """
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind: Column = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
