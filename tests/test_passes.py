"""Whole passes: what is published, what is refused, what is reported."""

from __future__ import annotations

import os
import re
import sys
import timeit
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.operators import recode as rc
from folioworks.plans import publish as pub
from folioworks.plans.first_pass import run_first_pass
from folioworks.plans.report import LINE_ORDER, render_report, write_report
from folioworks.plans.second_pass import redeclare, retarget, run_second_pass
from folioworks.session import scratch_dir, written
from folioworks.settings import Settings
from folioworks.sources import packages as pk
from folioworks.sources.images import head_profile, inspect_images, sampled_colors
from folioworks.sources.slices import stored_contents
from folioworks.standins import collapse_spaces, png_bytes, repack_png, unpack_png
from folioworks.streaming import run_corpus

from fixtures import BASE, IMAGE, exact_colors, main_part, noise, photo, rels, types, write_package

# The codecs below run in workers, which cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL = Settings(min_part_bytes=2000, alert_bytes=20_000)
JPEG = bytes.fromhex("FFD8FFE0")


def members(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return {m.filename: z.read(m) for m in z.infolist()}


def halve(content: bytes, name: str) -> bytes:
    """A codec with a case for every outcome."""
    if "fail" in name:
        raise ValueError("cannot identify image file")
    if "same" in name:
        return content
    if "grow" in name:
        return content + b"x"
    return content[: len(content) // 2]


MIXED = [
    (fv.CONTENT_TYPES_PART, BASE[fv.CONTENT_TYPES_PART]),
    ("word/", b""),
    (fv.MAIN_PART, main_part()),
    ("word/media/", b""),
    ("word/media/big.png", photo()),
    ("word/media/small.png", photo()[:1999]),
    ("word/media/limit.png", (photo() * 2)[:2000]),
    ("word/media/photo.jpg", JPEG + bytes(5000)),
    ("word/media/liar.jpeg", photo()),
    ("word/media/fail.png", photo()),
    ("word/media/same.png", photo()),
    ("word/media/grow.jpeg", JPEG + bytes(5000)),
    ("word/media/art.emf", b"v" * 5000),
    ("word/media/anim.gif", b"GIF89a" + bytes(5000)),
    ("word/media/odd.png", b"?" * 5000),
    ("word/raw/data.raw", b"stored" * 100),
]


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("first")
    source, target = folder / "in", folder / "out"
    source.mkdir()
    write_package(source / "mixed.docx", MIXED)
    write_package(source / "plain.docx", BASE)
    write_package(source / "nomain.docx", {fv.CONTENT_TYPES_PART: b"<Types/>", "word/media/a.png": photo()})
    (source / "broken.docx").write_bytes(b"this is no archive at all, sorry")
    before = {p.name: p.read_bytes() for p in source.iterdir()}
    result = run_first_pass(spark, str(source), str(target), halve, SMALL)
    assert {p.name: p.read_bytes() for p in source.iterdir()} == before
    return result, source, target


def test_first_pass_publishes_proven_packages(first):
    result, source, target = first
    rows = {r.container: r for r in result.outcomes.collect()}
    assert {k: r.version for k, r in rows.items()} == {
        "mixed.docx": "new", "plain.docx": "new", "nomain.docx": "original", "broken.docx": "original",
    }
    mixed = rows["mixed.docx"]
    assert (mixed.processed, mixed.skipped, mixed.published_count) == (3, 8, 3)
    assert mixed.size_after == os.path.getsize(target / "mixed.docx") < mixed.size_before
    assert (mixed.media_count, mixed.paragraphs, mixed.tables, mixed.inline_images) == (12, 2, 1, 1)
    assert rows["broken.docx"].failure.startswith("exceção durante o processamento:")
    assert (rows["nomain.docx"].processed, rows["nomain.docx"].published_count) == (1, 0)
    for name in ("broken.docx", "nomain.docx"):
        assert (target / name).read_bytes() == (source / name).read_bytes()
    assert sorted(p.name for p in target.iterdir() if not p.name.startswith(".")) == sorted(rows)


def test_first_pass_changes_only_the_accepted_parts(first):
    _, source, target = first
    old, new = members(source / "mixed.docx"), members(target / "mixed.docx")
    assert list(old) == list(new)
    changed = [n for n in old if old[n] != new[n]]
    assert changed == ["word/media/big.png", "word/media/limit.png", "word/media/photo.jpg"]
    assert all(new[n] == old[n][: len(old[n]) // 2] for n in changed)
    with zipfile.ZipFile(source / "mixed.docx") as a, zipfile.ZipFile(target / "mixed.docx") as b:
        for m, n in zip(a.infolist(), b.infolist()):
            assert (m.date_time, m.external_attr, m.create_system, m.is_dir()) == (
                n.date_time, n.external_attr, n.create_system, n.is_dir())
            assert n.compress_type == zipfile.ZIP_DEFLATED


def test_first_pass_details(first):
    result, _, _ = first
    got = [r.line for r in result.details.filter("container = 'mixed.docx'").orderBy("ordinal").collect()]
    assert [line.split(": ", 1)[1] for line in got] == [
        "0,0 MB -> 0,0 MB", "1 KB < 1 KB (mantida)", "0,0 MB -> 0,0 MB", "0,0 MB -> 0,0 MB",
        "extensão não confere com o conteúdo (mantida)",
        "erro ao processar (cannot identify image file) — mantida",
        "recompressão ficou maior (original mantida)", "recompressão ficou maior (original mantida)",
        "vetorial (mantida)", "extensão .gif (mantida)", "formato desconhecido (mantida)",
    ]


def report_text(spark, lines, folder):
    write_report(lines, folder)
    files = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return "".join(open(f"{folder}/{p}", encoding="utf-8").read() for p in files)


def test_first_pass_report(spark, first, tmp_path):
    result, source, target = first
    lines = render_report(result, "in", "out", SMALL)
    text = report_text(spark, lines, str(tmp_path / "report"))
    rows = text.split("\n")
    assert rows[:5] == [
        "LOG DE REDUÇÃO DE .DOCX", "Entrada: in", "Saída:   out",
        "Parâmetros: máx. 1600 px | JPEG q=80 | mínimo 1 KB", "=" * 78,
    ]
    at = rows.index("ARQUIVO: plain.docx")
    assert rows[at - 1] == ""
    assert rows[at + 1 : at + 7] == [
        "  Tamanho antes:  0,0 MB",
        "  Validação: imagens: 0 = 0 OK; partes XML intactas (CRC) OK",
        "  Validação: parágrafos: 2 OK; tabelas: 1 OK; imagens inline: 1 OK",
        "  Tamanho depois: 0,0 MB",
        rows[at + 5],
        "  Imagens processadas: 0 | puladas: 0",
    ]
    assert rows[at + 5].startswith("  Redução:        ") and rows[at + 5].endswith(" %")
    names = [r.split(": ")[1] for r in rows if r.startswith("ARQUIVO: ")]
    assert names == ["broken.docx", "mixed.docx", "nomain.docx", "plain.docx"]
    assert sum(r.startswith("  *** FALHA: ") for r in rows) == 2
    assert "  Arquivos processados: 4 | com falha (original mantido): 2" in rows
    large = [n for n in ("mixed.docx", "nomain.docx") if os.path.getsize(target / n) > 20_000]
    assert f"  ATENÇÃO: {len(large)} arquivo(s) ainda acima de 100 MB:" in rows or not large
    assert lines.columns == [*LINE_ORDER, "line"]


def second_members(**more):
    return {
        fv.CONTENT_TYPES_PART: types(
            {"png": "image/png", "rels": "r"},
            {"/word/document.xml": "main", "/word/media/photo.png": "image/png"},
        ),
        fv.MAIN_PART: main_part(),
        "word/_rels/document.xml.rels": rels(
            ("rId1", IMAGE, "media/photo.png"), ("rId2", IMAGE, "https://h/photo.png", "External"),
            ("rId3", IMAGE, "media/logo.png"), prefix="r",
        ),
        "word/_rels/header1.xml.rels": rels(("rId1", IMAGE, "/word/media/photo.png")),
        "word/_rels/footer1.xml.rels": rels(("rId1", "other", "footnotes.xml")),
        **more,
    }


def repack(content: bytes, name: str) -> bytes:
    if "keep" in name:
        return content
    if "torn" in name:
        return JPEG + b"not an image"
    return repack_png(content, name)


@pytest.fixture(scope="module")
def second(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("second")
    source, target = folder / "in", folder / "out"
    source.mkdir()
    big = photo(200)
    write_package(source / "refs.docx", second_members(**{
        "word/media/photo.png": big, "word/media/logo.png": exact_colors(40, side=40),
        "word/media/glass.png": photo(200, alpha=128), "word/media/solid.png": photo(200, alpha=255),
        "word/media/keep.png": big, "word/media/odd.png": b"?" * 5000,
        "word/media/cut.png": big[:3000], "word/media/tiny.png": b"1",
    }))
    write_package(source / "clash.docx", second_members(**{
        "word/media/photo.png": big, "word/media/photo.PNG": photo(201),
        "word/media/photo.jpeg": b"old", "word/media/photo_conv2.png": photo(202),
        "word/media/logo.png": b"1",
    }))
    write_package(source / "torn.docx", second_members(**{
        "word/media/torn.png": big, "word/media/photo.png": b"1", "word/media/logo.png": b"1"}))
    write_package(source / "nothing.docx", second_members(**{
        "word/media/photo.png": b"1", "word/media/logo.png": b"1"}))
    bare = second_members(**{"word/media/photo.png": big})
    del bare[fv.CONTENT_TYPES_PART]
    write_package(source / "notypes.docx", bare)
    write_package(source / "badrels.docx", second_members(**{
        "word/media/photo.png": big, "word/_rels/x.rels": b"<broken"}))
    settings = Settings(min_part_bytes=2000, min_colors=1000)
    result = run_second_pass(spark, str(source), str(target), repack, unpack_png, settings)
    return result, source, target


def test_second_pass_versions(second):
    result, source, target = second
    rows = {r.container: r for r in result.outcomes.collect()}
    assert {k: r.version for k, r in rows.items()} == {
        "refs.docx": "new", "clash.docx": "new", "torn.docx": "original",
        "nothing.docx": "unchanged", "notypes.docx": "original", "badrels.docx": "original",
    }, [r.failure for r in rows.values()]
    assert (rows["refs.docx"].processed, rows["refs.docx"].skipped) == (2, 5)
    assert rows["torn.docx"].failure == "JPEG convertido corrompido: word/media/torn.jpeg"
    assert rows["notypes.docx"].failure.endswith("ausente — não é um .docx válido")
    for name in ("torn.docx", "nothing.docx", "notypes.docx", "badrels.docx"):
        assert (target / name).read_bytes() == (source / name).read_bytes()


def test_second_pass_follows_references(second):
    _, source, target = second
    old, new = members(source / "refs.docx"), members(target / "refs.docx")
    renamed = {"word/media/photo.png": "word/media/photo.jpeg", "word/media/solid.png": "word/media/solid.jpeg"}
    assert list(new) == [renamed.get(n, n) for n in old]
    untouched = [n for n in old if n not in renamed and not n.endswith(".rels") and n != fv.CONTENT_TYPES_PART]
    assert all(old[n] == new[n] for n in untouched)
    document = new["word/_rels/document.xml.rels"].decode()
    assert 'Target="media/photo.jpeg"' in document and 'Target="media/logo.png"' in document
    assert 'Target="https://h/photo.png"' in document
    assert 'Target="/word/media/photo.jpeg"' in new["word/_rels/header1.xml.rels"].decode()
    assert new["word/_rels/footer1.xml.rels"] == old["word/_rels/footer1.xml.rels"]
    declared = new[fv.CONTENT_TYPES_PART].decode()
    assert 'Extension="jpeg"' in declared and "/word/media/photo.png" not in declared
    assert "/word/document.xml" in declared


def test_second_pass_avoids_taken_names(second):
    _, _, target = second
    names = set(members(target / "clash.docx"))
    assert {"word/media/photo.jpeg", "word/media/photo_conv2.jpeg", "word/media/photo_conv3.jpeg",
            "word/media/photo_conv2_conv2.jpeg"} <= names
    assert not any(n.lower().endswith(".png") and "logo" not in n for n in names)


def test_second_pass_details(second):
    result, _, _ = second
    rows = result.details.filter("container = 'refs.docx'").orderBy("ordinal").collect()
    got = {r.line.split(":")[0].strip("- "): r.line.split(": ", 1)[1] for r in rows}
    assert got["word/media/photo.png -> word/media/photo.jpeg"] == "0,1 MB -> 0,1 MB"
    assert got["word/media/logo.png"].startswith("poucas cores")
    assert got["word/media/glass.png"] == "possui transparência real (mantida como PNG)"
    assert got["word/media/keep.png"] == "conversão não reduziu o suficiente (mantida como PNG)"
    assert got["word/media/odd.png"] == "conteúdo não é PNG (desconhecido) — mantida"
    assert got["word/media/cut.png"].startswith("erro ao processar (")


def test_second_pass_report(spark, second, tmp_path):
    result, _, _ = second
    text = report_text(
        spark, render_report(result, "in", "out", second=True), str(tmp_path / "report")
    )
    assert text.startswith("LOG DA 2ª PASSADA — CONVERSÃO PNG -> JPEG\n")
    assert "redução mínima exigida: 5 %\n" in text
    assert "  Nenhum PNG fotográfico elegível — arquivo copiado sem alterações.\n" in text
    assert "  PNGs convertidos: 2 | mantidos como PNG: 5\n" in text
    assert text.endswith("\n  Nenhum arquivo restou acima de 100 MB.\n")


def test_large_only(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_package(source / "a.docx", BASE)
    limit = os.path.getsize(source / "a.docx")
    none = run_second_pass(spark, str(source), str(tmp_path / "o1"), repack, unpack_png,
                           Settings(alert_bytes=limit), large_only=True)
    assert none.outcomes.count() == 0 and none.summary().first().files == 0
    one = run_second_pass(spark, str(source), str(tmp_path / "o2"), repack, unpack_png,
                          Settings(alert_bytes=limit - 1), large_only=True)
    assert one.outcomes.count() == 1


def test_xml_edits_keep_the_rest():
    text = rels(("a", IMAGE, "media/x.png"), ("b", "t", "u", "External"))
    out = retarget(text, [{"pos": 0, "new_target": "media/x&y.jpeg"}]).decode()
    assert out.startswith('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n')
    assert 'Target="media/x&amp;y.jpeg"' in out and 'TargetMode="External"' in out
    declared = redeclare(types({"png": "p"}, {"/a": "x", "/b": "y"}), ["jpg"], ["/a"]).decode()
    assert "/a" not in declared.replace("image/", "") and "/b" in declared and 'Extension="jpg"' in declared


def test_a_spoilt_rewrite_falls_back(spark, tmp_path, monkeypatch):
    """A writer that damages an untouched part is caught by the proof."""
    source = tmp_path / "in"
    source.mkdir()
    write_package(source / "a.docx", MIXED)
    honest = pub.write_packages

    def spoil(containers, replacements, folder, tasks):
        extra = containers.select(
            "container", F.lit(2).alias("ordinal"), F.lit(fv.MAIN_PART).alias("new_part_name"),
            F.lit(bytearray(main_part(5))).alias("new_content"))
        extra = stored_contents(extra, str(tmp_path / "slices"))
        return honest(containers, replacements.unionByName(extra), folder, tasks)

    monkeypatch.setattr("folioworks.plans.first_pass.write_packages", spoil)
    result = run_first_pass(spark, str(source), str(tmp_path / "out"), halve, SMALL)
    row = result.outcomes.first()
    assert (row.version, row.failure) == ("original", "parte não-imagem alterada: word/document.xml")
    assert (tmp_path / "out/a.docx").read_bytes() == (source / "a.docx").read_bytes()
    assert {r.rule_no for r in result.violations.collect()} == {4, 8}


def test_publishing_twice_is_harmless(spark, tmp_path):
    write_package(tmp_path / "a.docx", BASE)
    write_package(tmp_path / "staged.docx", {"x": b"new"})
    judged = spark.createDataFrame(
        [("a.docx", str(tmp_path / "a.docx"), str(tmp_path / "staged.docx"), "new")],
        "container string, path string, staged string, version string",
    )
    (tmp_path / "out").mkdir()
    for _ in range(2):
        row = pub.publish(judged, str(tmp_path / "out")).first()
        assert row.length == os.path.getsize(tmp_path / "out/a.docx")
    assert members(tmp_path / "out/a.docx") == {"x": b"new"}


PICTURES = {
    "two": (exact_colors(2), False, 2),
    "at": (exact_colors(4096), False, 4096),
    "over": (exact_colors(4097), False, 4097),
    "opaque": (png_bytes(np.dstack([noise(8, 8), np.full((8, 8), 255, np.uint8)])), False, 64),
    "mask": (png_bytes(np.dstack([noise(8, 8), np.eye(8, dtype=np.uint8) * 255])), True, 64),
    "half": (png_bytes(np.dstack([noise(8, 8), np.full((8, 8), 128, np.uint8)])), True, 64),
    "gray": (png_bytes(noise(30, 30, 1)), False, len(np.unique(noise(30, 30, 1)))),
    "grayglass": (png_bytes(np.dstack([noise(30, 30, 1), np.full((30, 30), 9, np.uint8)])), True, len(np.unique(noise(30, 30, 1)))),
    "wide": (png_bytes(noise(3, 1024)), False, None),
}


def test_pictures(spark, tmp_path):
    write_package(tmp_path / "p.docx", {
        **{f"word/media/{k}.png": v[0] for k, v in PICTURES.items()}, "word/media/junk.png": b"junk",
        "word/media/none.png": b""})
    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    named = parts.select("container", "ordinal", "part_name")
    flags = inspect_images(parts, unpack_png).join(named, ["container", "ordinal"])
    got = {r.part_name.split("/")[-1][:-4]: r for r in flags.collect()}
    for name in ("junk", "none"):
        assert (got[name].decodable, got[name].photographic, got[name].width) == (False, False, -1)
        assert got[name].decode_error == "cannot identify image file" and got[name].problem is None
    for name, (_, alpha, colors) in PICTURES.items():
        assert (got[name].decodable, got[name].has_alpha) == (True, alpha), name
        assert colors is None or got[name].sample_colors == colors, name
    assert [n for n in got if got[n].photographic] == ["over"]
    wide = noise(3, 1024)[[0, 2]]  # rows under the centres of two sampled lines
    sample = wide[:, 1::2]
    assert got["wide"].sample_colors == len(np.unique(sample.reshape(-1, 3), axis=0))
    assert (got["wide"].width, got["wide"].height, got["wide"].channels) == (1024, 3, 3)
    none = inspect_images(parts.limit(0), unpack_png)
    assert none.count() == 0 and {*none.columns, "part_name"} == set(got["wide"].asDict())
    # Sizes from the first bytes alone.
    heads = head_profile(pk.read_parts(parts, first_bytes=32)).collect()
    for r in heads:
        seen = got[r.part_name.split("/")[-1][:-4]]
        assert (r.head_width, r.head_height, r.head_channels) == (
            (seen.width, seen.height, seen.channels) if seen.decodable else (None, None, None))


def test_heads_of_other_formats(spark):
    heads = {
        "gif": (b"GIF89a" + bytes([64, 1, 200, 0]), ("GIF", 320, 200)),
        "bmp": (b"BM" + bytes(16) + bytes([4, 0, 0, 0, 5, 1, 0, 0]), ("BMP", 4, 261)),
        "jpeg": (JPEG + bytes(28), ("JPEG", None, None)),
        "cut": (bytes.fromhex("89504E470D0A1A0A"), ("PNG", None, None)),
        "huge": (bytes.fromhex("89504E470D0A1A0A") + bytes(8) + b"\xff" * 8, ("PNG", 2**32 - 1, 2**32 - 1)),
        "none": (None, (None, None, None)),
    }
    rows = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in heads.items()], "name string, content binary")
    got = {r.name: (r.head_format, r.head_width, r.head_height) for r in head_profile(rows).collect()}
    assert got == {k: v[1] for k, v in heads.items()}


def test_first_pass_opens_candidates_once(spark, first, tmp_path, monkeypatch):
    """Formats are checked where parts are recoded, checksums once; every core has several tasks."""
    calls, deal = [], pk.by_package_slice

    def spy(parts, share):
        calls.append(share.tasks)
        return deal(parts, share)

    monkeypatch.setattr(rc, "by_package_slice", spy)
    monkeypatch.setattr(pk, "by_package_slice", spy)
    _, source, _ = first
    run_first_pass(spark, str(source), str(tmp_path / "out"), halve, SMALL)
    assert len(calls) == 2 and min(calls) > spark.sparkContext.defaultParallelism


def test_only_fitting_formats_meet_the_codec(spark, tmp_path):
    log, png, jpeg = tmp_path / "log", bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("FFD8FF")
    found = {"a.png": png + b"a" * 90, "b.png": jpeg + b"b" * 90, "c.jpeg": jpeg + b"c" * 90, "d.JPG": jpeg + b"d" * 90,
             "e.jpg": png + b"e" * 90, "f.png": b"", "g.png": png[:5], "h.jpeg": b"GIF89a", "i.gif": png + b"i" * 90}
    write_package(tmp_path / "a.docx", {f"word/media/{k}": v for k, v in found.items()})

    def codec(content, name):
        with open(log, "a") as out:
            out.write(f"{name[11:]}\n")
        return content[:-9]

    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    done = written(rc.recode_fitting(parts, codec, str(tmp_path / "slices")), str(tmp_path / "done")).collect()
    fitting = {r.part_name[11:] for r in done if r.format_reason is None}
    assert sorted(log.read_text().split()) == sorted(fitting) == ["a.png", "c.jpeg", "d.JPG"]
    assert all((r.new_size == r.old_size - 9) == (r.part_name[11:] in fitting) for r in done if r.new_size)
    assert {r.part_name[11:]: r.old_size for r in done} == {k: len(v) for k, v in found.items()}


def test_collapsed_spaces():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 5000):
        content = bytes(rng.choice(np.frombuffer(b"  \t\r\n\v\f\0a\xe9", np.uint8), n))
        assert collapse_spaces(content, "x") == re.sub(rb"[ \t\r\n]+", b" ", content)
    content = b"some plain words \n " * 20_000
    assert min(timeit.repeat(lambda: collapse_spaces(content, "x"), number=3, repeat=3)) < min(
        timeit.repeat(lambda: re.sub(rb"[ \t\r\n]+", b" ", content), number=3, repeat=3)) / 2


def test_a_task_reports_all_its_packages(spark, tmp_path):
    heads = spark.range(600).selectExpr("concat('p', id, '.docx') as container", "cast(null as string) as path")
    bodies = heads.select("container", F.lit(0).alias("ordinal"), F.lit("a.txt").alias("new_part_name"),
                          F.encode("container", "UTF-8").alias("new_content"))
    bodies = written(stored_contents(bodies, str(tmp_path / "slices")), str(tmp_path / "bodies"))
    done = pub.write_packages(heads, bodies, str(tmp_path / "out"), 1).collect()
    assert len({r.container for r in done}) == len(done) == 600
    assert members(tmp_path / "out/p599.docx") == {"a.txt": b"p599.docx"}


def test_a_candidate_is_opened_once(spark, tmp_path):
    """The decoder and the codec meet the same bytes in one task, each part once."""
    log = tmp_path / "log"
    write_package(tmp_path / "a.docx", {f"word/media/{k}.png": photo(100, alpha=None if k else 7) for k in range(6)})

    def told(what, content):
        with open(log, "a") as out:
            out.write(f"{what} {len(content)}\n")

    def decode(content):
        told("decode", content)
        return unpack_png(content)

    def codec(content, name):
        told("codec", content)
        return content[:-9]

    parts = pk.readable(pk.explode_parts(pk.list_containers(spark, str(tmp_path))))
    done = rc.convert(parts, decode, codec, str(tmp_path / "slices"), min_colors=1000)
    done = done.withColumn("why", rc.pixel_reason()).toPandas()
    lines = log.read_text().split("\n")
    assert sum(x.startswith("decode") for x in lines) == 6 and sum(x.startswith("codec") for x in lines) == 5
    assert sorted(done["why"].fillna("")) == [""] * 5 + [fv.KEPT_ALPHA]
    for place, size in zip(done["new_slice"], done["old_size"]):
        if place is not None:
            with open(place["file"], "rb") as file:
                file.seek(place["offset"])
                assert file.read(place["size"])[:4] == b"\x89PNG" and place["size"] == size - 9


def test_sampling_keeps_small_images_whole():
    assert sampled_colors(np.zeros((512, 512, 3), np.uint8)) == 1
    ramp = np.arange(1024, dtype=np.uint32)
    pixels = np.stack([ramp & 255, ramp >> 8, ramp * 0], -1).astype(np.uint8)[None]
    assert sampled_colors(pixels) == 512


def test_main_part_of_another_name_in_both_passes(spark, tmp_path):
    root = rels(("rId1", fv.DOCUMENT_REL_TYPE, "word/story.xml"))
    story = {fv.ROOT_RELS: root, "word/story.xml": main_part(5, 2, 1),
             "word/_rels/story.xml.rels": rels(("rId1", IMAGE, "media/photo.png")), "word/media/photo.png": photo(200)}
    source = tmp_path / "in"
    source.mkdir()
    write_package(source / "story.docx", {fv.CONTENT_TYPES_PART: types({"png": "image/png", "rels": "r"}), **story})
    settings = Settings(min_part_bytes=2000, min_colors=1000)
    for second in (False, True):
        target = str(tmp_path / f"out{second}")
        done = (run_second_pass(spark, str(source), target, repack, unpack_png, settings) if second
                else run_first_pass(spark, str(source), target, halve, settings))
        row = done.outcomes.first()
        assert (row.version, row.failure, row.paragraphs, row.tables, row.inline_images) == ("new", None, 5, 2, 1)


def test_hidden_names_and_empty_files_have_outcomes(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name in ("_a.docx", ".b.docx", "c.docx"):
        write_package(source / name, MIXED)
    (source / "empty.docx").write_bytes(b"")
    done = run_first_pass(spark, str(source), str(target), halve, SMALL)
    rows = {r.container: r for r in done.outcomes.collect()}
    assert {k: r.version for k, r in rows.items()} == {
        "_a.docx": "new", ".b.docx": "new", "c.docx": "new", "empty.docx": "original"}
    assert (rows["empty.docx"].size_before, rows["empty.docx"].size_after) == (0, 0)
    assert (target / "empty.docx").read_bytes() == b""
    assert members(target / "_a.docx") == members(target / ".b.docx") == members(target / "c.docx")
    done.discard()
    assert not os.path.exists(done.scratch)
    # The stream finds and does the same.
    args = (spark, str(source), str(tmp_path / "streamed"), str(tmp_path / "results"), str(tmp_path / "check"), halve, SMALL)
    run_corpus(*args, max_files_per_trigger=3)
    got = spark.read.parquet(str(tmp_path / "results")).collect()
    assert {r.container: r.version for r in got} == {k: r.version for k, r in rows.items()}
    assert sorted(r.chunk for r in got) == [0, 0, 0, 1]
    for name in rows:
        assert (tmp_path / "streamed" / name).read_bytes() == (target / name).read_bytes()


def test_writer_gets_no_bytes(spark, first, tmp_path, monkeypatch):
    """Replacements come as places; no binary column is shuffled."""
    seen = []

    def spy(containers, replacements, folder, tasks):
        seen.append(dict(replacements.dtypes))
        return pub.write_packages(containers, replacements, folder, tasks)

    monkeypatch.setattr("folioworks.plans.first_pass.write_packages", spy)
    monkeypatch.setattr("folioworks.plans.second_pass.write_packages", spy)
    _, source, _ = first
    run_first_pass(spark, str(source), str(tmp_path / "o1"), halve, SMALL)
    run_second_pass(spark, str(source), str(tmp_path / "o2"), repack, unpack_png, SMALL)
    assert len(seen) == 2 and all("binary" not in kind for types_ in seen for kind in types_.values())


def test_corpus_stream_takes_only_new_packages(spark, tmp_path):
    source, target, results = (str(tmp_path / n) for n in ("in", "out", "results"))
    os.mkdir(source)
    write_package(f"{source}/a.docx", MIXED)
    args = (spark, source, target, results, str(tmp_path / "check"), halve, SMALL)
    run_corpus(*args)
    write_package(f"{source}/b.docx", BASE)
    run_corpus(*args)
    rows = {r.container: r.batch_id for r in spark.read.parquet(results).collect()}
    assert rows == {"a.docx": 0, "b.docx": 1}
    assert members(f"{target}/b.docx") == BASE


def test_corpus_stream_leaves_nothing_but_results(spark, tmp_path):
    """Also after a failed batch, which the next run repeats."""
    source, target, results, check = (str(tmp_path / n) for n in ("in", "out", "results", "check"))
    os.mkdir(source)
    write_package(f"{source}/a.docx", MIXED)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    os.mkdir(target)
    os.mkdir(f"{target}/a.docx")  # nothing can be published there
    with pytest.raises(Exception):
        run_corpus(spark, source, target, results, check, halve, SMALL)
    assert set(os.listdir(shared)) == before and os.listdir(target) == ["a.docx"]
    os.rmdir(f"{target}/a.docx")
    run_corpus(spark, source, target, results, check, halve, SMALL)
    assert set(os.listdir(shared)) == before
    assert [n for n in os.listdir(target) if not n.startswith(".")] == ["a.docx"]
    assert [r.container for r in spark.read.parquet(results).collect()] == ["a.docx"]
    run_corpus(spark, source, target, results, check, halve, SMALL)
    assert spark.read.parquet(results).count() == 1


def test_drawn_pictures_go_from_their_task_to_slices(spark, sf_dir, monkeypatch):
    """At size a batch of pictures is too large to be handed from one task's worker to another."""
    from folioworks import standins

    seen = []
    monkeypatch.setattr(standins, "_write_packages", lambda media, listed, folder: seen.append(media))
    monkeypatch.setattr(standins, "_written", {})
    standins.vector_packages(spark, sf_dir)
    assert [f.simpleString() for f in seen[0].schema if f.name.startswith("new_")] == [
        "new_part_name:string", "new_slice:struct<file:string,offset:bigint,size:bigint>"
    ]
    rows = seen[0].collect()
    assert len(rows) == len({(r.new_slice.file, r.new_slice.offset) for r in rows}) > 0
