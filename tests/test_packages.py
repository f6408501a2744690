"""Listing, opening and checking packages."""

from __future__ import annotations

import codecs
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.operators.classify import missing_required, only_large
from folioworks.operators.references import jpeg_extension
from folioworks.sources import package_xml as px
from folioworks.sources import packages as pk
from folioworks.sources.listing import list_files

from fixtures import BASE, IMAGE, main_part, rels, types, write_package


@pytest.fixture()
def folder(tmp_path):
    write_package(tmp_path / "plain.docx", BASE)
    write_package(tmp_path / "MIXED2.DOCX", {**BASE, "word/media/": b"", "word/media/a.png": b"x" * 50})
    write_package(tmp_path / "~$lock.docx", BASE)
    write_package(tmp_path / "_hidden.docx", BASE)
    write_package(tmp_path / "other.zip", BASE)
    write_package(tmp_path / "notypes.docx", {"word/document.xml": main_part()})
    (tmp_path / "broken.docx").write_bytes(b"not an archive, but longer than one could be")
    (tmp_path / "tiny.docx").write_bytes(b"x")
    write_package(tmp_path / ".dotted.docx", BASE)
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / "below.docx").mkdir()
    return str(tmp_path)


def test_listing_takes_packages_only(spark, folder):
    found = pk.list_containers(spark, folder)
    rows = {r.container: r for r in found.collect()}
    assert sorted(rows) == [".dotted.docx", "MIXED2.DOCX", "_hidden.docx", "broken.docx", "empty.docx", "notypes.docx",
                            "plain.docx", "tiny.docx"]
    for name, r in rows.items():
        assert (r.path, r.length) == (f"{folder}/{name}", os.path.getsize(f"{folder}/{name}"))
        assert r.modificationTime.timestamp() == pytest.approx(os.path.getmtime(f"{folder}/{name}"), abs=1e-5)


def test_listing_runs_in_tasks_and_filters_by_size(spark, folder, tmp_path):
    large = only_large(pk.list_containers(spark, folder), 100)
    names = {r.container for r in large.collect()}
    assert not {"tiny.docx", "empty.docx"} & names and {"_hidden.docx", ".dotted.docx"} <= names
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "content" not in plan
    (tmp_path / "two").mkdir()
    write_package(tmp_path / "two/_x.docx", BASE)
    both = list_files(spark, folder, f"{tmp_path}/two/")
    assert both.rdd.getNumPartitions() == 2
    assert f"{tmp_path}/two/_x.docx" in {r.path for r in both.collect()}
    assert list_files(spark, f"{tmp_path}/below.docx").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, f"{tmp_path}/nowhere").count()


def test_size_filter_is_strict(spark):
    df = spark.createDataFrame([(99,), (100,), (101,)], "length long")
    assert [r.length for r in only_large(df, 100).collect()] == [101]


def test_parts_follow_the_directory(spark, folder):
    scanned = pk.explode_parts(pk.list_containers(spark, folder))
    bad = {r.container for r in pk.unreadable(scanned).collect()}
    assert bad == {"broken.docx", "empty.docx", "tiny.docx"}
    rows = pk.readable(scanned).filter("container = 'MIXED2.DOCX'").orderBy("ordinal").collect()
    with zipfile.ZipFile(f"{folder}/MIXED2.DOCX") as z:
        expected = [
            (i, m.filename, m.is_dir(), m.file_size, m.compress_size, m.CRC, m.external_attr,
             m.create_system)
            for i, m in enumerate(z.infolist())
        ]
    assert [
        (r.ordinal, r.part_name, r.is_dir, r.file_size, r.compress_size, r.crc, r.external_attr,
         r.create_system) for r in rows
    ] == expected
    assert str(rows[0].date_time) == "2020-05-04 03:02:00"


def test_contents_and_checksums(spark, folder):
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, folder)))
    one = parts.filter("container = 'plain.docx'")
    stored = {r.part_name: bytes(r.content) for r in pk.read_parts(one, pk.Share(members=1)).collect()}
    assert stored == BASE
    heads = pk.read_parts(one, first_bytes=4).collect()
    assert {bytes(r.content) for r in heads} == {v[:4] for v in BASE.values()}
    assert all(r.crc_ok for r in pk.verify_crc(pk.read_parts(one)).collect())
    assert all(r.crc_ok for r in pk.check_parts(one).collect())
    wrong = one.withColumn("crc", F.col("crc") + 1)
    assert not any(r.crc_ok for r in pk.verify_crc(pk.read_parts(wrong)).collect())
    assert not any(r.crc_ok for r in pk.check_parts(wrong).collect())


def test_large_contents_stay_with_their_rows(spark, tmp_path):
    sizes = {f"{k}.txt": 18_000_000 + k for k in range(4)}
    write_package(tmp_path / "big.docx", {k: b"x" * n for k, n in sizes.items()})
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    read = pk.read_parts(parts, pk.Share(tasks=1)).select("part_name", "file_size", F.octet_length("content").alias("n"))
    assert {r.part_name: (r.file_size, r.n) for r in read.collect()} == {k: (n, n) for k, n in sizes.items()}


def test_damaged_member_is_reported_not_raised(spark, tmp_path):
    path = write_package(tmp_path / "d.docx", {"a.raw": b"A" * 200, "b.txt": b"fine"})
    data = bytearray(open(path, "rb").read())
    data[data.index(b"AAAA") + 50] = ord("B")
    open(path, "wb").write(bytes(data))
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    tested = {r.part_name: r.crc_ok for r in pk.check_parts(parts).collect()}
    assert tested == {"a.raw": False, "b.txt": True}
    problems = {r.part_name: r.problem for r in pk.read_parts(parts).collect()}
    assert "CRC" in problems["a.raw"] and problems["b.txt"] is None


def test_required_part(spark, folder):
    containers = pk.list_containers(spark, folder)
    scanned = pk.explode_parts(containers)
    parts = pk.readable(scanned)
    opened = containers.join(pk.unreadable(scanned), "container", "left_anti")
    got = missing_required(opened, parts).collect()
    assert [r.container for r in got] == ["notypes.docx"]


def xml_row(spark, name, content):
    return spark.createDataFrame(
        [("c", 0, name, bytearray(content))],
        "container string, ordinal int, part_name string, content binary",
    )


@pytest.mark.parametrize("prefix", ["", "r"])
def test_relationships_with_and_without_prefix(spark, prefix):
    text = rels(
        ("rId1", IMAGE, "media/a.png"), ("rId2", "t", "https://x/?a&amp;b", "External"), prefix=prefix
    )
    got = px.relationships(xml_row(spark, "word/_rels/document.xml.rels", text)).collect()
    assert [(r.pos, r.rel_id, r.rel_type, r.target, r.target_mode) for r in got] == [
        (0, "rId1", IMAGE, "media/a.png", None), (1, "rId2", "t", "https://x/?a&b", "External"),
    ]


def test_single_and_no_relationship(spark):
    one = px.relationships(xml_row(spark, "x.rels", rels(("rId1", "t", "u"))))
    assert one.count() == 1
    none = xml_row(spark, "x.rels", rels())
    assert px.relationships(none).count() == 0
    assert px.malformed(none).count() == 0


@pytest.mark.parametrize("text", [b"", b"<Relationships>", b"<a></b>", b"\xff\xfe nonsense"])
def test_malformed_xml_is_told(spark, text):
    assert px.malformed(xml_row(spark, "x.rels", text)).count() == 1
    assert px.malformed(xml_row(spark, fv.CONTENT_TYPES_PART, text)).count() == 1


def encodings(text: bytes):
    plain = text.decode()
    head = '<?xml version="1.0" encoding="{}"?>'.format
    return {
        "utf-8-sig": codecs.BOM_UTF8 + text,
        "utf-16": (head("UTF-16") + plain).encode("utf-16"),
        "utf-16-be": codecs.BOM_UTF16_BE + plain.encode("utf-16-be"),
        "latin-1": (head("ISO-8859-1") + plain).encode("latin-1"),
        "cp1252": (head("windows-1252") + plain).encode("cp1252"),
    }


def test_encodings_by_mark_or_declaration(spark, tmp_path):
    """What the parts say is the same in every encoding, at hand or read from packages."""
    refs = rels(("rId1", IMAGE, "media/fünf.png"), ("rId2", "t", "u&amp;v", "External"))
    declared = types({"PNG": "image/png"}, {"/word/dökument.xml": "main"})
    refs = refs.replace(b"</", b'<Relationship xmlns="other" Id="no"/></')  # of another namespace
    for name, text in encodings(refs).items():
        got = px.relationships(xml_row(spark, "word/_rels/a.rels", text)).collect()
        assert [(r.pos, r.rel_id, r.target, r.target_mode) for r in got] == [
            (0, "rId1", "media/fünf.png", None), (1, "rId2", "u&v", "External")], name
        other = encodings(declared)[name]
        write_package(tmp_path / f"{name}.docx", {fv.CONTENT_TYPES_PART: other, "word/_rels/a.rels": text})
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    xml = px.read_xml(parts)
    assert px.malformed(xml).count() == 0 and px.damaged(xml).count() == 0
    found = px.relationships(xml).groupBy("container").agg(F.sort_array(F.collect_list("target")).alias("t")).collect()
    assert {r.container: r.t for r in found} == {f"{n}.docx": ["media/fünf.png", "u&v"] for n in encodings(refs)}
    kinds = px.content_types(xml).filter("kind = 'override'").select("key", "content_type").distinct().collect()
    assert [tuple(r) for r in kinds] == [("/word/dökument.xml", "main")]


def test_content_types(spark):
    text = types({"PNG": "image/png"}, {"/word/document.xml": "main"})
    got = px.content_types(xml_row(spark, fv.CONTENT_TYPES_PART, text)).collect()
    assert [(r.kind, r.key, r.content_type, r.pos) for r in got] == [
        ("default", "png", "image/png", 0), ("override", "/word/document.xml", "main", 0),
    ]
    only = px.content_types(xml_row(spark, fv.CONTENT_TYPES_PART, types({}, {"/a": "b"})))
    assert only.count() == 1


@pytest.mark.parametrize(
    "defaults, expected",
    [({"jpeg": 1, "jpg": 1}, "jpeg"), ({"JPG": 1}, "jpg"), ({"png": 1}, "jpeg"), ({}, "jpeg")],
)
def test_jpeg_extension(spark, defaults, expected):
    ct = px.content_types(xml_row(spark, fv.CONTENT_TYPES_PART, types(defaults)))
    containers = spark.createDataFrame([("c",)], "container string")
    assert jpeg_extension(ct, containers).first().jpeg_extension == expected


def test_structure_counts(spark, tmp_path):
    nested = main_part(3, 2, 1).replace(
        b"<w:tbl/>", b"<w:tbl><w:tr><w:tc><w:p><w:r><w:drawing><wp:inline/></w:drawing></w:r></w:p>"
        b"<w:tbl/></w:tc></w:tr></w:tbl>"
    )
    write_package(tmp_path / "a.docx", {fv.MAIN_PART: nested})
    write_package(tmp_path / "b.docx", {fv.MAIN_PART: b"<w:document><w:body>"})
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    got = {r.container: r for r in px.structure_counts(parts).collect()}
    assert (got["a.docx"].paragraphs, got["a.docx"].tables, got["a.docx"].inline_images) == (3, 2, 3)
    assert got["b.docx"].paragraphs is None and got["b.docx"].problem


def main_refs(target, kind=fv.DOCUMENT_REL_TYPE, mode=None):
    return rels(("rId1", kind, target, *([mode] if mode else [])), ("rId2", "other", "docProps/core.xml"))


def test_main_part_by_the_root_references(spark, tmp_path):
    body = main_part(4, 3, 2)
    packages = {
        "moved": {fv.ROOT_RELS: main_refs("content/story.xml"), "content/story.xml": body, fv.MAIN_PART: main_part()},
        "absolute": {fv.ROOT_RELS: main_refs("/content/./story.xml"), "content/story.xml": body},
        "utf16": {fv.ROOT_RELS: main_refs("content/story.xml").decode().encode("utf-16"), "content/story.xml": body},
        "usual": {fv.MAIN_PART: body},
        "dangling": {fv.ROOT_RELS: main_refs("gone.xml"), fv.MAIN_PART: body},
        "none": {fv.ROOT_RELS: main_refs("word/document.xml", "other"), fv.MAIN_PART: body},
        "outside": {fv.ROOT_RELS: main_refs("https://x/y", mode="External"), fv.MAIN_PART: body},
        "two": {fv.ROOT_RELS: rels(("a", fv.DOCUMENT_REL_TYPE, "x"), ("b", fv.DOCUMENT_REL_TYPE, "y")), "x": body, "y": body},
        "broken": {fv.ROOT_RELS: b"<Relationships", fv.MAIN_PART: body},
        "nothing": {"word/other.xml": body},
    }
    for name, members in packages.items():
        write_package(tmp_path / f"{name}.docx", members)
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    got = {r.container[:-5]: r for r in px.structure_counts(parts).collect()}
    assert {k for k, r in got.items() if r.problem is None} == {"moved", "absolute", "utf16", "usual"}
    for name in ("moved", "absolute", "utf16"):
        r = got[name]
        assert (r.main_part, r.paragraphs, r.tables, r.inline_images) == ("content/story.xml", 4, 3, 2)
    assert got["dangling"].problem == "no part gone.xml" and got["two"].problem.startswith("2 references")
    assert len(got) == len(packages)


def test_one_package_is_shared_by_several_tasks(spark, tmp_path):
    """A package with most of the parts must not end up in one task."""
    members = {f"word/media/{i}.png": bytes([i % 251]) * 20 for i in range(400)}
    write_package(tmp_path / "hot.docx", members)
    write_package(tmp_path / "cold.docx", BASE)
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    read = pk.read_parts(parts, pk.Share(members=16, tasks=4)).filter("container = 'hot.docx'")
    by_task = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by_task) == 4 and sum(r["count"] for r in by_task) == 400
    assert {r.part_name: bytes(r.content) for r in read.collect()} == members


def test_parts_of_a_hot_container_are_spread(spark):
    from folioworks.operators.skew import of_containers

    parts = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("container"),
        F.col("id").alias("ordinal"),
    )
    wanted = spark.createDataFrame([("hot",), ("2500",)], "container string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        kept = of_containers(parts, wanted)
        assert kept.count() == 2001
        assert of_containers(parts, wanted, "left_anti").count() == 999
        tasks = kept.filter("container = 'hot'").select(F.spark_partition_id()).distinct().count()
        assert tasks > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(
    "path, name",
    [("file:/data/a b.docx", "/data/a b.docx"), ("file:///data/x", "/data/x"), ("/data/x", "/data/x")],
)
def test_local_paths_in_all_spellings(path, name):
    from folioworks.sources.files import locate

    assert locate(path)[1] == name
