"""Parts, references and readings taken from ordinary tables.

The queries of ``queries.py`` run over these: every document is a part, its
source the package; every link of a page a reference; every event a reading.
The last section writes real packages, images and status files from the same
tables, so that the archive and stream jobs have something to read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .functions import resolve_target, stem
from .operators.classify import accept, classify_parts
from .plans.publish import write_packages
from .session import few_tasks, scratch_dir, width, written
from .settings import Settings
from .sources.slices import SLICE, as_struct, slice_writer, stored_contents

# Document texts are smaller than images; so are the limits on them.
SMALL = Settings(min_part_bytes=2000, alert_bytes=100_000, min_colors=500)
EVENT_CODES = ("click", "error", "purchase", "signup", "view")
SPACES = "[ \\t\\r\\n]+"
HYPERLINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
DOCS_PER_PACKAGE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extension_of(lang: str = "lang") -> Column:
    return (
        F.when(F.col(lang) == "en", ".png")
        .when(F.col(lang) == "fr", ".jpeg")
        .when(F.col(lang) == "de", ".emf")
        .otherwise(".gif")
    )


def document_part_name() -> Column:
    return F.concat(
        F.lit(fv.MEDIA_PREFIX + "doc"), F.col("doc_id").cast("string"), extension_of()
    )


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parts; the text digest stands for the stored checksum."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("container"),
        F.col("doc_id").alias("ordinal"),
        document_part_name().alias("part_name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.col("n_chars").alias("compress_size"),
        F.md5(F.encode("text", "UTF-8")).alias("crc"),
        F.octet_length(F.regexp_replace("text", SPACES, " ")).cast("long").alias("new_size"),
    )


def document_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first pass decides when recoding means collapsing white space."""
    classified = classify_parts(document_parts(spark, sf_dir), SMALL)
    candidate = F.col("disposition") == "candidate"
    sized = classified.withColumnRenamed("file_size", "old_size").withColumn(
        "new_size", F.when(candidate, F.col("new_size"))
    )
    kept = F.col("reason").alias("kept")
    judged = accept(sized.select("*", kept), "recompress", SMALL)
    return judged.select(
        "container", "ordinal", "part_name", "old_size", "new_size", "accepted",
        F.coalesce("kept", "reason").alias("reason"),
    )


def altered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``document_parts`` after some damage.

    Toxic documents are gone, those of low quality have their white space
    collapsed, and the benchmark items have been slipped in.
    """
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    text = F.when(F.col("quality") == 0, F.regexp_replace("text", SPACES, " ")).otherwise(
        F.col("text")
    )
    kept = documents.filter(~F.coalesce(F.col("toxic") == 1, F.lit(False))).select(
        F.col("source").alias("container"),
        F.col("doc_id").alias("ordinal"),
        document_part_name().alias("part_name"),
        F.md5(F.encode(text, "UTF-8")).alias("crc"),
        F.octet_length(text).cast("long").alias("file_size"),
    )
    slipped_in = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("container"),
        F.col("item_id").alias("ordinal"),
        F.concat(F.lit("word/item"), F.col("item_id").cast("string"), F.lit(".xml")).alias(
            "part_name"
        ),
        F.md5(F.encode("text", "UTF-8")).alias("crc"),
        F.octet_length("text").cast("long").alias("file_size"),
    )
    return kept.unionByName(slipped_in)


def plain_renames(parts: DataFrame, extension: str = "jpeg") -> DataFrame:
    """Every part under the same stem with another extension."""
    return parts.select(
        "container", "part_name", F.concat(stem("part_name"), F.lit("." + extension)).alias(
            "new_part_name"
        )
    )


# Content types: packages of a few documents each, so that some lack a type.

def small_package(doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("pkg"), F.floor(F.col(doc_id) / 4).cast("string"))


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    key = F.when(F.col("lang") == "es", "jpg").otherwise(F.ltrim(extension_of(), F.lit(".")))
    defaults = documents.select(
        small_package().alias("container"), F.lit("default").alias("kind"), key.alias("key"),
        F.concat(F.lit("image/"), key).alias("content_type"), F.lit(0).alias("pos"),
    ).distinct()
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    overrides = documents.join(labelled, "doc_id").select(
        small_package().alias("container"),
        F.lit("override").alias("kind"),
        F.concat(F.lit("/"), document_part_name()).alias("key"),
        F.concat(F.lit("text/"), F.col("lang")).alias("content_type"),
        F.col("doc_id").cast("int").alias("pos"),
    )
    return defaults.unionByName(overrides)


def package_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents a second pass renames: PNG and large enough."""
    documents = table(spark, sf_dir, "documents").filter(
        (F.col("lang") == "en") & (F.octet_length("text") >= SMALL.min_part_bytes)
    )
    return plain_renames(
        documents.select(small_package().alias("container"), document_part_name().alias("part_name"))
    )


# References: the links of every page.

def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a part of its host, with its own and its links' addresses.

    Links to capitalised paths stay as they are written, the others become
    relative to the page's folder.
    """
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("container"),
        F.concat(
            F.lit("word/"), F.regexp_extract("url", r"^https?://[^/]*/([^/]*)", 1),
            F.lit("/_rels/page"), F.col("page_id").cast("string"), F.lit(".xml.rels"),
        ).alias("rels_path"),
        F.concat(
            F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
        ).alias("links"),
    )
    link = F.col("link")
    target = (
        F.when(~link.startswith("/") | link.rlike("^/[A-Z]"), link)
        .otherwise(F.concat(F.lit("../media"), link))
    )
    rows = pages.select("container", "rels_path", F.posexplode("links").alias("pos", "link"))
    return rows.withColumn("target", target).select(
        "container", "rels_path", "pos",
        F.concat(F.lit("rId"), F.col("pos").cast("string")).alias("rel_id"),
        F.when(link.rlike("^/[A-Z]"), F.lit(HYPERLINK)).otherwise(F.lit(fv.IMAGE_REL_TYPE)).alias(
            "rel_type"
        ),
        "target",
        F.when(link.startswith("http"), F.lit("External")).alias("target_mode"),
    )


def page_renames(references: DataFrame) -> DataFrame:
    """Renames of the linked media parts with an ``e`` in their name."""
    resolved = references.select(
        "container", resolve_target("rels_path", "target").alias("part_name")
    )
    media = resolved.filter(F.col("part_name").rlike("^word/media/.*e")).distinct()
    return media.withColumn("new_part_name", F.concat("part_name", F.lit(".jpeg")))


# Readings: the events, with users as devices and days as polls.

def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("device_id"),
        day.cast("string").alias("poll_id"),
        day.cast("timestamp_ntz").alias("polled_at"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("code"),
        F.col("value").cast("variant").alias("value"),
    )


def as_double(value: str) -> Column:
    return F.try_variant_get(F.col(value), "$", "double")


# Files written from the tables.  A session writes each kind once per input.

_written: dict[tuple, str] = {}


def _once(spark: SparkSession, kind: str, sf_dir: str, write) -> str:
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _written:
        folder = scratch_dir(spark)
        write(folder)
        _written[key] = folder
    return _written[key]


def package_name(number: Column) -> Column:
    return F.concat(F.lit("pack"), number.cast("string"), F.lit(".docx"))


def package_of(doc_id: str) -> Column:
    return package_name(F.floor(F.col(doc_id) / DOCS_PER_PACKAGE))


_PNG_MAGIC = "89504E470D0A1A0A"
_JPEG_MAGIC = "FFD8FF"


def document_content() -> Column:
    """The text behind the magic bytes its name promises.

    Long French texts carry the wrong ones.
    """
    magic = (
        F.when(F.col("lang") == "en", F.unhex(F.lit(_PNG_MAGIC)))
        .when((F.col("lang") == "fr") & (F.col("n_chars") < 5000), F.unhex(F.lit(_JPEG_MAGIC)))
        .when(F.col("lang") == "fr", F.unhex(F.lit(_PNG_MAGIC)))
        .otherwise(F.unhex(F.lit("")))
    )
    return F.concat(magic, F.encode("text", "UTF-8"))


def document_packages(spark: SparkSession, sf_dir: str) -> str:
    """Folder of packages with the documents as media parts.

    A package takes the documents of a fixed run of ids, so packages stay small
    and their number grows with the table.
    """

    def write(folder: str) -> None:
        documents = table(spark, sf_dir, "documents")
        media = documents.select(
            package_of("doc_id").alias("container"),
            (F.col("doc_id") % DOCS_PER_PACKAGE + 10).cast("int").alias("ordinal"),
            document_part_name().alias("new_part_name"),
            document_content().alias("new_content"),
        )
        listed = documents.select(
            package_of("doc_id").alias("container"), "doc_id", "lang",
            F.concat(F.lit("media/doc"), F.col("doc_id").cast("string"), extension_of()).alias(
                "target"
            ),
        )
        _write_packages(stored_contents(media, f"{scratch_dir(spark)}/slices"), listed, folder)

    return _once(spark, "documents", sf_dir, write)


def _write_packages(media: DataFrame, listed: DataFrame, folder: str) -> None:
    """``media``: ``container, ordinal, new_part_name, new_slice``; ``listed``:
    ``container, doc_id, lang, target``, one row per media part.
    """
    paragraph = F.when(
        F.col("lang") == "en",
        F.lit("<w:p><w:r><w:drawing><wp:inline/></w:drawing></w:r></w:p>"),
    ).when(F.col("lang") == "fr", F.lit("<w:tbl><w:tr/></w:tbl>")).otherwise(F.lit("<w:p/>"))
    relation = F.concat(
        F.lit('<Relationship Id="rId'), F.col("doc_id").cast("string"),
        F.lit(f'" Type="{fv.IMAGE_REL_TYPE}" Target="'), F.col("target"), F.lit('"/>'),
    )
    extension = F.substring_index("target", ".", -1)
    declaration = F.concat(
        F.lit('<Default Extension="'), extension, F.lit('" ContentType="image/'), extension,
        F.lit('"/>'),
    )

    def ordered(piece: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("doc_id", piece.alias("xml"))))
        return F.array_join(F.transform(rows, lambda r: r["xml"]), "")

    xml = listed.groupBy("container").agg(
        ordered(paragraph).alias("body"),
        ordered(relation).alias("relations"),
        F.array_join(F.array_sort(F.collect_set(declaration)), "").alias("defaults"),
    )
    main = F.concat(
        F.lit('<w:document xmlns:w="w" xmlns:wp="wp"><w:body>'), "body",
        F.lit("</w:body></w:document>"),
    )
    rels = F.concat(
        F.lit(f'<Relationships xmlns="{fv.NS_RELATIONSHIPS}">'), "relations",
        F.lit("</Relationships>"),
    )
    types = F.concat(
        F.lit(f'<Types xmlns="{fv.NS_CONTENT_TYPES}">'), "defaults",
        F.lit('<Override PartName="/word/document.xml" ContentType="main+xml"/></Types>'),
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(name).alias("new_part_name"),
                F.encode(text, "UTF-8").alias("new_content"),
            )
            for i, (name, text) in enumerate(
                [
                    (fv.CONTENT_TYPES_PART, types),
                    (fv.MAIN_PART, main),
                    ("word/_rels/document.xml.rels", rels),
                ]
            )
        ]
    )
    heads = xml.select("container", F.lit(None).cast("string").alias("path"))
    spark = media.sparkSession
    scratch = scratch_dir(spark)
    rest = stored_contents(xml.select("container", F.inline(entries)), f"{scratch}/slices")
    rows = written(media.unionByName(rest), f"{scratch}/rows")
    tasks = min(width(spark), few_tasks(spark))
    written(write_packages(heads, rows, folder, tasks), scratch_dir(spark))


# PNG colour types by channels.
_COLOR_OF = {1: 0, 2: 4, 3: 2, 4: 6}


def png_bytes(pixels: np.ndarray, level: int = 0) -> bytes:
    """An 8-bit PNG of a (height, width, channels) array, for fixtures."""
    height, width, channels = pixels.shape
    color = _COLOR_OF[channels]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return (
            struct.pack(">I", len(body)) + kind + body
            + struct.pack(">I", zlib.crc32(kind + body))
        )

    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    return (
        bytes.fromhex(_PNG_MAGIC)
        + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(lines, level))
        + chunk(b"IEND", b"")
    )


def _png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    if content[:8] != bytes.fromhex(_PNG_MAGIC):
        raise ValueError("cannot identify image file")
    at = 8
    while at < len(content):
        (size,) = struct.unpack(">I", content[at:at + 4])
        yield content[at + 4:at + 8], content[at + 8:at + 8 + size]
        at += 12 + size


def unpack_png(content: bytes) -> np.ndarray:
    """The pixels of what ``png_bytes`` makes; a decoder that needs no image library."""
    chunks = list(_png_chunks(content))
    width, height, depth, color, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    channels = {c: n for n, c in _COLOR_OF.items()}.get(color)
    if depth != 8 or channels is None or any(rest):
        raise ValueError("a kind of PNG that the fixtures do not draw")
    data = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    lines = np.frombuffer(data, np.uint8).reshape(height, 1 + width * channels)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].reshape(height, width, channels)


def repack_png(content: bytes, _name: str) -> bytes:
    """Compress a PNG's pixel data better; a codec that needs no image library."""
    out = content[:8]
    for kind, body in _png_chunks(content):
        if kind == b"IDAT":
            body = zlib.compress(zlib.decompress(body), 9)
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return out


_BLANKS = bytes.maketrans(b"\t\r\n", b"   ")


def collapse_spaces(content: bytes, _name: str) -> bytes:
    """The codec for document packages: white space runs become one blank."""
    content = content.translate(_BLANKS)
    while b"  " in content:
        content = content.replace(b"  ", b" ")
    return content


def vector_pixels(vector: np.ndarray, see_through: bool) -> np.ndarray:
    """An image whose row and column colours are the vector's rounded values.

    Values are multiples of 1/256 apart after rounding; see-through images have
    an alpha channel that drops below 255 where the vector is negative.
    """
    levels = np.floor((vector.astype(np.float64) + 1.0) * 128.0).astype(np.uint8)
    red, green = np.meshgrid(levels, levels, indexing="ij")
    layers = [red, green, np.zeros_like(red)]
    if see_through:
        layers.append(np.where(np.meshgrid(vector, vector, indexing="ij")[0] < 0, 128, 255))
    return np.stack(layers, axis=-1).astype(np.uint8)


def vector_packages(spark: SparkSession, sf_dir: str) -> str:
    """Folder of packages with one PNG per embedding; label 0 is see-through."""

    slices_folder = f"{scratch_dir(spark)}/slices"

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Each picture goes to its slice when it is drawn: none is held or handed on.
        with slice_writer(slices_folder) as slices:
            for frame in frames:
                frame["new_slice"] = [
                    as_struct(slices.add(png_bytes(vector_pixels(np.asarray(v), label == 0))))
                    for v, label in zip(frame["embedding"], frame["label"])
                ]
                yield frame[["container", "ordinal", "new_part_name", "new_slice"]]

    def write(folder: str) -> None:
        vectors = table(spark, sf_dir, "embeddings")
        container = package_of("vec_id").alias("container")
        name = F.concat(F.lit("vec"), F.col("vec_id").cast("string"), F.lit(".png"))
        media = vectors.select(
            container,
            (F.col("vec_id") % DOCS_PER_PACKAGE + 10).cast("int").alias("ordinal"),
            F.concat(F.lit(fv.MEDIA_PREFIX), name).alias("new_part_name"),
            "embedding", "label",
        ).mapInPandas(
            draw, f"container string, ordinal int, new_part_name string, new_slice {SLICE}"
        )
        listed = vectors.select(
            container, F.col("vec_id").alias("doc_id"), F.lit("en").alias("lang"),
            F.concat(F.lit("media/"), name).alias("target"),
        )
        _write_packages(media, listed, folder)

    return _once(spark, "vectors", sf_dir, write)


def status_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of status responses: one poll per event, two readings each.

    Error events become failed responses.
    """

    def write(folder: str) -> None:
        failed = F.col("event_type") == "error"
        reading = F.struct(F.col("event_type").alias("code"), F.col("value").alias("value"))
        k = F.get_json_object("props", "$.k").cast("double")
        result = F.array(reading, F.struct(F.lit("k").alias("code"), k.alias("value")))
        rows = table(spark, sf_dir, "events").select(
            F.col("event_id").cast("string").alias("poll_id"),
            F.col("user_id").cast("string").alias("device_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("polled_at"),
            (~failed).alias("success"),
            F.when(failed, F.lit(1106)).alias("code"),
            F.when(failed, F.lit("denied")).alias("msg"),
            F.when(~failed, result).alias("result"),
        )
        rows.write.json(folder)

    return _once(spark, "status", sf_dir, write)
