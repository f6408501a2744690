"""Tables inside the XML parts of a package.

The XML is parsed as it streams from the archive, in the task that opens it: what
travels on are rows, no text.  The parser goes by the byte-order mark or the XML
declaration (UTF-8, UTF-16, ISO-8859-1 and other single-byte encodings) and by
namespaces, whatever their prefixes.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from typing import IO
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .files import opened
from .packages import DAMAGED, Batches, Share, by_package_slice, open_zip

#: One row for each XML part (``element`` is ``part``) and for each of its elements.
XML_ROWS = (
    "container string, path string, ordinal int, part_name string, element string, pos int, "
    "id string, type string, target string, mode string, malformed string, problem string"
)
_XML_COLUMNS = [field.split()[0] for field in XML_ROWS.split(", ")]

RELATIONSHIP, DEFAULT, OVERRIDE = "relationship", "default", "override"
# Element -> row kind and the attributes that go to id, type, target, mode.
_ELEMENTS = {
    f"{fv.NS_RELATIONSHIPS}}}Relationship": (RELATIONSHIP, ("Id", "Type", "Target", "TargetMode")),
    f"{fv.NS_CONTENT_TYPES}}}Default": (DEFAULT, ("Extension", "ContentType", None, None)),
    f"{fv.NS_CONTENT_TYPES}}}Override": (OVERRIDE, ("PartName", "ContentType", None, None)),
}


def is_rels(name: str = "part_name"):
    return F.col(name).endswith(fv.RELS_SUFFIX)


def rels_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(~F.col("is_dir") & is_rels())


def content_types_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("part_name") == fv.CONTENT_TYPES_PART)


def _elements(feed: Callable[[expat.XMLParserType], None]) -> list[tuple]:
    """(kind, pos, four attributes) of the wanted children of the root element."""
    rows: list[tuple] = []
    depth = 0
    count = dict.fromkeys((RELATIONSHIP, DEFAULT, OVERRIDE), 0)

    def start(name: str, attributes: dict) -> None:
        nonlocal depth
        if depth == 1 and name in _ELEMENTS:
            kind, wanted = _ELEMENTS[name]
            rows.append((kind, count[kind], *(attributes.get(a) for a in wanted)))
            count[kind] += 1
        depth += 1

    def end(_name: str) -> None:
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    feed(parser)
    return rows


def _part_rows(part: tuple, feed: Callable[[expat.XMLParserType], None]) -> list[tuple]:
    """The rows of one part, only ``part`` itself where it can't be read or parsed."""
    nothing = (None,) * 5
    try:
        found = _elements(feed)
    except expat.ExpatError as wrong:
        return [(*part, "part", *nothing, str(wrong), None)]
    except DAMAGED as damage:
        return [(*part, "part", *nothing, None, str(damage) or repr(damage))]
    return [(*part, "part", *nothing, None, None), *((*part, *row, None, None) for row in found)]


def read_xml(parts: DataFrame, share: Share = Share()) -> DataFrame:
    """``XML_ROWS`` of ``.rels`` and content-type parts, parsed where they are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(_XML_COLUMNS)
        with opened(open_zip) as package:
            for frame in frames:
                for container, path, ordinal, name in frame.itertuples(index=False, name=None):

                    def feed(parser) -> None:
                        z = package(path)
                        with z.open(z.infolist()[ordinal]) as xml:
                            parser.ParseFile(xml)

                    for row in _part_rows((container, path, ordinal, name), feed):
                        if batch.add(row):
                            yield batch.take()
        if batch.rows:
            yield batch.take()

    rows = parts.select("container", "path", "ordinal", "part_name")
    return by_package_slice(rows, share).mapInPandas(run, XML_ROWS)


def parsed(xml_with_content: DataFrame) -> DataFrame:
    """The same rows of parts whose bytes are at hand; rows pass through as they are."""
    if "element" in xml_with_content.columns:
        return xml_with_content

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                row
                for container, ordinal, name, content in frame.itertuples(index=False, name=None)
                for row in _part_rows(
                    (container, None, ordinal, name),
                    lambda parser, text=content: parser.Parse(text or b"", True),
                )
            ]
            yield pd.DataFrame(rows, columns=_XML_COLUMNS, dtype=object)

    return xml_with_content.select("container", "ordinal", "part_name", "content").mapInPandas(
        run, XML_ROWS
    )


def relationships(xml: DataFrame) -> DataFrame:
    """One row per reference; ``pos`` is its place in the ``.rels`` part."""
    return parsed(xml).filter((F.col("element") == RELATIONSHIP) & is_rels()).select(
        "container",
        F.col("part_name").alias("rels_path"),
        "pos",
        F.col("id").alias("rel_id"),
        F.col("type").alias("rel_type"),
        "target",
        F.col("mode").alias("target_mode"),
    )


def content_types(xml: DataFrame) -> DataFrame:
    """One row per declaration: ``kind`` is ``default`` or ``override``.

    Keys of defaults are lower-cased extensions, keys of overrides part names.
    """
    extension = F.lower(F.coalesce("id", F.lit("")))
    kind = F.col("element")
    declared = content_types_parts(parsed(xml)).filter(kind.isin(DEFAULT, OVERRIDE))
    return declared.select(
        "container",
        kind.alias("kind"),
        F.when(kind == DEFAULT, extension).otherwise(F.col("id")).alias("key"),
        F.col("type").alias("content_type"),
        "pos",
    )


def malformed(xml: DataFrame) -> DataFrame:
    """``.rels`` and content-type parts that do not parse.

    They give no rows above, which must not be taken for "no references".
    """
    return parsed(xml).filter(F.col("malformed").isNotNull()).select(
        "container", "ordinal", "part_name"
    )


def damaged(xml: DataFrame) -> DataFrame:
    """Parts whose bytes could not be read, with the ``problem``."""
    return xml.filter(F.col("problem").isNotNull()).select(
        "container", "ordinal", "part_name", "problem"
    )


def structure_counts(parts: DataFrame, share: Share = Share()) -> DataFrame:
    """Main part, its body paragraphs, body tables and inline images, by package.

    ``parts`` are part rows without content; of each package the first is used.
    The main part is found by walking the package's references from its root
    ``.rels`` part to the one of type office document, whatever its name; a package
    without root references is taken to have the usual one.  All of it happens in
    one opening of the package, and the XML is counted as it streams from the
    archive: main parts can be large and none of their text is needed afterwards.
    ``problem`` tells why a package could not be counted.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(open_zip) as package:
            for frame in frames:
                yield pd.DataFrame(
                    [
                        (row.container, *_count_main(package, row.path))
                        for row in frame.itertuples(index=False)
                    ],
                    columns=_COUNT_COLUMNS,
                    dtype=object,
                )

    wanted = parts.filter(F.col("ordinal") == 0)
    rows = wanted.select("container", "path", "ordinal")
    return by_package_slice(rows, share).mapInPandas(count, _COUNTS)


_COUNTS = (
    "container string, main_part string, paragraphs int, tables int, inline_images int, "
    "problem string"
)
_COUNT_COLUMNS = [field.split()[0] for field in _COUNTS.split(", ")]
_BODY = ["document", "body"]
_INLINE = ["p", "r", "drawing", "inline"]


class NoMainPart(ValueError):
    """A package's references do not lead to one main part."""


def main_part(z) -> str:
    """Name of the part that the package's root references call its document."""
    names = z.NameToInfo  # of names entered twice the last entry
    if fv.ROOT_RELS not in names:
        if fv.MAIN_PART not in names:
            raise NoMainPart(f"no part {fv.MAIN_PART}")
        return fv.MAIN_PART
    with z.open(fv.ROOT_RELS) as xml:
        found = _elements(lambda parser: parser.ParseFile(xml))
    mains = [
        target for kind, _, _, rel_type, target, mode in found
        if kind == RELATIONSHIP and rel_type == fv.DOCUMENT_REL_TYPE and mode != "External"
    ]
    if len(mains) != 1:
        raise NoMainPart(f"{len(mains)} references of type {fv.DOCUMENT_REL_TYPE}")
    name = posixpath.normpath((mains[0] or "").lstrip("/"))
    if name not in names:
        raise NoMainPart(f"no part {name}")
    return name


def _count_main(package, path: str) -> tuple:
    try:
        z = package(path)
        name = main_part(z)
        with z.open(name) as xml:
            return name, *_count_body(xml), None
    except (expat.ExpatError, NoMainPart, *DAMAGED) as problem:
        return None, None, None, None, str(problem) or repr(problem)


def _count_body(xml: IO[bytes]) -> tuple[int, int, int]:
    stack: list[str] = []
    counts = {"p": 0, "tbl": 0, "inline": 0}

    def start(name: str, _attributes: dict) -> None:
        local = name.rpartition("}")[2]
        if stack == _BODY and local in ("p", "tbl"):
            counts[local] += 1
        stack.append(local)
        if local == "inline" and stack[-4:] == _INLINE and stack[:2] == _BODY:
            counts["inline"] += 1

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _name: stack.pop()
    parser.ParseFile(xml)
    return counts["p"], counts["tbl"], counts["inline"]
