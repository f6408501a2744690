"""Exact round trips of the chat grammar and of the archives."""

from __future__ import annotations

import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from folioworks.llm import arc, chat

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\", "\\\\", "###", "#\\##", "</turn", "<\\/turn>", "",
        "a\nb\n", "\\n", "🙂 </turn>", ": ", "x" * 50_000 + "</turn>\n"]


def test_turns_come_back(spark):
    rows = [(k, t, r, x) for k, x in enumerate(HARD) for t, r in enumerate(("user", "assistant"))]
    rows += [(100, 2, "assistant", "b"), (100, 1, "user", "a"), (100, 1, "user", "a"), (101, None, None, None),
             (102, 0, "a: b\\", "### x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1))
    chats = chat.with_loss(chat.formatted(df))
    got = {r.conv_id: r for r in chats.join(chat.digest(chats).drop("identical", "escape_level"), F.expr("true"), "left_semi").collect()}
    done = {r.conv_id: r for r in chat.digest(chats).collect()}
    assert len(done) == len(HARD) + 4 and all(r.identical for r in done.values())
    for k, x in enumerate(HARD):
        whole = "".join(f"{r}\n{x}\n" for r in ("user", "assistant"))
        assert done[k].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert done[k].loss_sha256 == hashlib.sha256(x.encode()).hexdigest() and done[k].loss_chars == len(x)
        assert done[k].formatted_chars == len(got[k].formatted)
    assert [(t.role, t.text) for t in got[100].turns] == [("user", "a"), ("user", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[101].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[102].turns] == [("a: b\\", "### x")]
    assert done[8].escape_level == 0 and done[0].escape_level == 1
    assert chat.formatted(df.limit(0)).count() == 0


def test_mask_of_many_turns(spark):
    texts = [HARD[k % 13] + str(k) for k in range(3_000)]
    rows = [(1, k, ("system", "user", "assistant")[k % 3], x) for k, x in enumerate(texts)]
    chats = chat.with_loss(chat.formatted(spark.createDataFrame(rows, TURNS)))
    row, done = chats.first(), chat.digest(chats).first()
    assert [s is not None for s in row.loss_spans] == [k % 3 == 2 for k in range(3_000)]
    cut = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans if s]
    safe = [x.replace("\\", "\\\\").replace("###", "#\\##").replace("</turn>", "<\\/turn>") for x in texts[2::3]]
    assert row.escape_level == 1 and cut == safe
    assert done.loss_sha256 == hashlib.sha256("".join(texts[2::3]).encode()).hexdigest() and done.n_turns == 3_000


def test_pages_come_back(spark):
    rows = [(k, f"http://x.org/{k % 7} a", f"<p>{k % 5} é</p>") for k in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "y" * 300_000), (None, "u", "z"), (60, "u", "same"), (60, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    out = arc.archived(df).collect()
    assert len(out) == len(rows) - 1 and all(r.intact for r in out)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    pages = {i: html or "" for i, _, html in rows if i is not None}
    for r in out:
        payload = pages[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        least = first[pages[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if least == r.page_id else ("revisit", least))
    assert arc.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archive_lines_follow_their_version(version):
    data = arc.arc_header(version, "n") + arc.arc_record(version, "n", 5, "http://a b", b"\r\n\r\nx\n") + arc.arc_record(version, "n", 6, None, b"")
    values, blocks = zip(*arc.read_arc(io.BytesIO(data)))
    assert list(values[0]) == arc.FIELDS[version] and values[0]["URL"] == "http://a%20b"
    assert [arc._http(b)[1:] for b in blocks] == [(5, b"\r\n\r\nx\n"), (6, b"")]
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data.replace(b"URL IP", b"UR IP", 1).replace(b"text/plain ", b"text/plain ", 1))))


def test_version_block_becomes_warcinfo(spark, tmp_path):
    rows = spark.createDataFrame([(k, "u", f"p{k}") for k in range(6)], "page_id long, url string, html string").coalesce(1)
    arcs = arc.write_arcs(rows, f"{tmp_path}/arc").cache()
    made = arc.convert(arc.choose_responses(arc.arc_contents(arcs)), f"{tmp_path}/warc").collect()
    assert [r.records for r in made] == [6]
    with arc._opened(made[0].path) as stream:
        (info, block), *others = arc.read_warc(stream)
    assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == made[0].path.rsplit("/", 1)[-1]
    assert info["WARC-Date"] == "2020-01-01T00:00:00Z" and b"ARC version 1" in block
    assert info["WARC-Block-Digest"] == f"sha1:{arc.sha1(block)}"
    assert {v["WARC-Warcinfo-ID"] for v, _ in others} == {info["WARC-Record-ID"]} and len(others) == 6
