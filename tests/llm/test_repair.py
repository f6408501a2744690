"""Repairs against trying every sequence of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from folioworks.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """Cheapest edits by a table of (state, best audits) kept whole, insertions tried up to two at a time."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    found = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for state, (cost, audit, said) in states.items():
            for _ in range(2):
                state = after[state]
                cost, audit, said = cost + 5, audit + "I", (*said, f"{name[state]}:")
                out[state] = min(out.get(state, (cost, audit, said)), (cost, audit, said))
        return out

    for role, text, fault in rows:
        step = {}
        for state, (cost, audit, said) in inserted(found).items():
            new = [(state, (cost + 2, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                first = role[:1]
                if (first == "s" and state == "") or (first in ("u", "a") and first == after[state]):
                    new.append((first, (cost + more, audit + "K", (*said, f"{role}:{text}"))))
                to = after[state]
                new.append((to, (cost + 1 + more, audit + "R", (*said, f"{name[to]}:{text}"))))
            for to, value in new:
                step[to] = min(step.get(to, value), value)
        found = step
    return min(value for state, value in inserted(found).items() if state in ("", "a"))


def judged(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                 "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_search_equals_all_edits_tried():
    codes = "".join
    initial = {1: "system", 2: "user", 3: "assistant", 0: "tool"}
    for n in range(4):  # every conversation of up to three rows
        for case in itertools.product([i * 4 + f for i in range(4) for f in (0, 1, 2)], repeat=n):
            rows = [(initial[c >> 2], "x", {0: None, 1: "truncated", 2: "blank"}[c & 3]) for c in case]
            cost, audit, _ = exhaustive(rows)
            assert repair.cheapest_edits(bytes(case)) == (cost, audit), codes(map(str, case))
            assert repair.suffix_bounds(bytes(case))[0] == cost
    rng = random.Random(1)
    for _ in range(200):
        case = [rng.randrange(4) * 4 + rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(60))]
        rows = [(initial[c >> 2], "x", {0: None, 1: "truncated", 2: "blank"}[c & 3]) for c in case]
        assert repair.cheapest_edits(bytes(case)) == exhaustive(rows)[:2]


def brute(table):
    """The query's rows for (conv_id, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in table:
        kept.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        full = judged([r[1:] for r in rows])
        turns = {r[0] for r in rows} - {None}
        cost, audit, said = exhaustive(full)
        faults = [f for _, _, f in full]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
                     cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_query_on_damaged_conversations(spark, tmp_path):
    rng = random.Random(2)
    table = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!\n", "so", " \t", "", None, "Äh … ja?", "x" * 5000 + "."])
            table.append((conv, rng.choice([turn, turn, turn * 3, None]), role, text))
    table += table[:20]  # repeated rows
    table += [(777, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]  # a long one
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Hello."))
    spark.createDataFrame(table, ROWS).withColumns({"cost": F.lit(1), "audit": F.lit("x"), "place": F.lit(0)}).repartition(
        5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_repair(spark, str(tmp_path))
    assert dict(got.dtypes) == {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
                                "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[n] for n in names) for r in got.collect()}
    assert found == brute(table)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_give_a_legal_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "So?"), (1, 2, "user", "A"), (1, 3, "user", "B."),
                                  (2, 0, "user", "Alone.")], ROWS)
    edits = repair.repaired(rows.coalesce(1)).collect()
    said = [(r.conv_id, r.new_role, r.text) for r in edits if r.new_role is not None]
    assert said == [(1, "user", "Hi."), (1, "assistant", "So?")]
    assert "".join(r.edit for r in edits if r.conv_id == 1) == "RKDD" and [r.edit for r in edits if r.conv_id == 2] == ["D"]
    assert repair.repaired(rows.limit(0)).count() == 0
    assert repair.summarised(repair.repaired(rows.limit(0))).count() == 0
