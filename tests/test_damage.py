"""Damaged members and empty results of a codec, beside healthy packages."""

from __future__ import annotations

import sys
import zipfile

from pyspark import cloudpickle

from folioworks import fixed_values as fv
from folioworks.plans.second_pass import run_second_pass
from folioworks.settings import Settings
from folioworks.standins import repack_png, unpack_png

from fixtures import IMAGE, main_part, photo, rels, types

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PICTURE = "word/media/photo.png"


def package(path, picture, method=zipfile.ZIP_DEFLATED, spoil=False, broken_rels=False):
    members = {
        fv.CONTENT_TYPES_PART: types({"png": "image/png", "rels": "r"}, {"/word/document.xml": "main"}),
        fv.MAIN_PART: main_part(),
        "word/_rels/document.xml.rels": rels(("rId1", IMAGE, "media/photo.png"), prefix="r"),
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content, zipfile.ZIP_DEFLATED)
        if broken_rels:
            z.writestr("word/_rels/spoilt.rels", b"x" * 4000, zipfile.ZIP_DEFLATED)
        z.writestr(PICTURE, picture, method)
    data = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        info = z.getinfo("word/_rels/spoilt.rels" if broken_rels else PICTURE)
    if spoil or broken_rels:
        at = info.header_offset + 30 + len(info.filename)
        for k in range(at + info.compress_size // 2, at + info.compress_size // 2 + 12):
            data[k] ^= 0xA5
        path.write_bytes(data)


def codec(content: bytes, name: str) -> bytes:
    return b"" if len(content) < 60_000 else repack_png(content, name)


def test_damage_fails_its_own_package_only(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    big, small = photo(200), photo(100)
    assert len(small) < 60_000 < len(big)
    package(source / "healthy.docx", big)
    package(source / "empty.docx", small)
    for name, method in (("deflate", 8), ("stored", 0), ("bzip2", 12), ("lzma", 14)):
        package(source / f"{name}.docx", big, method, spoil=True)
    package(source / "rels.docx", b"1", broken_rels=True)
    result = run_second_pass(spark, str(source), str(target), codec, unpack_png, Settings(min_part_bytes=2000, min_colors=1000))
    rows = {r.container: r for r in result.outcomes.collect()}
    versions = {k.removesuffix(".docx"): r.version for k, r in rows.items()}
    assert versions == {
        "healthy": "new", "empty": "unchanged", "rels": "unchanged", "deflate": "original", "stored": "original",
        "bzip2": "original", "lzma": "original",
    }, {k: r.failure for k, r in rows.items()}
    assert (rows["empty.docx"].processed, rows["empty.docx"].skipped) == (0, 1)
    for name in versions:
        if name != "healthy":
            assert (target / f"{name}.docx").read_bytes() == (source / f"{name}.docx").read_bytes(), name
