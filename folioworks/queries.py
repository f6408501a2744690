"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from . import standins as st
from .functions import (
    base_name,
    ext,
    fmt_mb,
    is_internal,
    is_media,
    poll_stamp,
    reduction_pct,
    resolve_target,
    stem,
)
from .functions.formats import format_mismatch, sniff_format
from .functions.names import is_container
from .functions.readings import tenth
from .operators import outcomes as out
from .operators import readings as rd
from .operators import reconcile as rec
from .operators import references as ref
from .operators.classify import (
    accept,
    candidates,
    classify_parts,
    missing_required,
    only_large,
    resize_plan,
)
from .operators.naming import assign_names
from .operators.numbering import with_progress
from .operators.recode import decide, recode
from .plans.first_pass import PassResult, run_first_pass
from .plans.report import LINE_ORDER, PART_LINES, render_report
from .plans.second_pass import run_second_pass
from .plans.telemetry import take_in
from .session import scratch_dir, tasks_for, written
from .sources import images as im
from .sources import package_xml as px
from .sources import packages as pk
from .sources.status import read_status
from .streaming import run_corpus, run_telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Names, classes, decisions.

@query
def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, disposition and reason of every part."""
    return classify_parts(st.document_parts(spark, sf_dir), st.SMALL).select(
        "container", "ordinal", "part_name", "extension", "disposition", "reason"
    )


@query
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name, stem, extension and media test of page addresses."""
    return st.table(spark, sf_dir, "pages").select(
        "page_id",
        base_name("url").alias("base"),
        ext("url").alias("extension"),
        stem("url").alias("stem"),
        is_media(F.concat(F.lit("Word\\Media/"), base_name("url"))).alias("media"),
    )


@query
def pass2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = st.document_parts(spark, sf_dir)
    return candidates(parts, fv.PNG_EXTENSIONS, st.SMALL.min_part_bytes).select(
        "container", "ordinal", "part_name", "file_size"
    )


@query
def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = st.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return only_large(documents, 4000, "n_chars")


@query
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address has the wanted suffix, numbered in name order."""
    pages = st.table(spark, sf_dir, "pages").select("page_id", base_name("url").alias("name"))
    found = pages.filter(is_container("name", ".HTML"))
    return with_progress(found, ["name", "page_id"]).select(
        "page_id", "name", "ordinal", "total"
    )


@query
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both acceptance rules on every document."""
    sized = st.document_parts(spark, sf_dir).select(
        "ordinal", F.col("file_size").alias("old_size"), "new_size"
    )
    first = accept(sized, "recompress", st.SMALL).withColumnsRenamed(
        {"accepted": "accepted_1", "reason": "reason_1"}
    )
    return accept(first, "convert", st.SMALL).withColumnsRenamed(
        {"accepted": "accepted_2", "reason": "reason_2"}
    )


@query
def resize_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = st.table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_size") * 100).alias("width"),
        F.floor("p_retailprice").cast("int").alias("height"),
    )
    return resize_plan(images, 1600)


@query
def formatted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money summed per order, shown as sizes."""
    cents = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        st.table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(cents).alias("total"))
        .select("l_orderkey", fmt_mb((F.col("total") * 10000).cast("long")).alias("size_text"))
    )


@query
def reduction_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = st.document_parts(spark, sf_dir)
    return parts.select(
        "ordinal", reduction_pct("file_size", "new_size").alias("reduction_pct")
    )


@query
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the part that labels them."""
    documents = st.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("container"), "source"
    )
    labels = st.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("container"), F.lit("label").alias("part_name")
    )
    return missing_required(documents, labels, "label").withColumnRenamed("container", "doc_id")


@query
def assigned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names for the PNG documents of a package, two documents to a stem."""
    documents = st.table(spark, sf_dir, "documents")
    parts = documents.select(
        st.small_package().alias("container"),
        F.col("doc_id").alias("ordinal"),
        F.concat(
            F.lit(fv.MEDIA_PREFIX + "img"), F.floor(F.col("doc_id") / 2).cast("string"),
            st.extension_of(),
        ).alias("part_name"),
    )
    wanted = parts.filter(ext("part_name") == ".png").withColumn(
        "jpeg_extension", F.lit("jpeg")
    )
    return assign_names(wanted, parts)


# Outcomes.

@query
def outcome_per_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.outcomes(st.document_decisions(spark, sf_dir))


@query
def detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.detail_lines(st.document_decisions(spark, sf_dir))


@query
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = out.outcomes(st.document_decisions(spark, sf_dir))
    failure = F.when(F.col("reduction_pct") < 1, F.lit("hardly smaller"))
    return out.corpus_summary(results.withColumn("failure", failure))


@query
def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = out.outcomes(st.document_decisions(spark, sf_dir))
    return out.over_limit(results, st.document_parts(spark, sf_dir), st.SMALL.alert_bytes)


@query
def media_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.media_weight(st.document_parts(spark, sf_dir))


@query
def media_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.media_counts(st.altered_documents(spark, sf_dir))


# Proofs.

def _replaceable(name: str):
    return ext(name).isin(*fv.JPEG_EXTENSIONS, *fv.PNG_EXTENSIONS)


def _document_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.reconcile(
        st.document_parts(spark, sf_dir), st.altered_documents(spark, sf_dir), _replaceable
    )


@query
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_differences(spark, sf_dir)


@query
def member_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.member_diff(_document_differences(spark, sf_dir)).select(
        "container",
        F.array_join("missing", ",").alias("missing"),
        F.array_join("extra", ",").alias("extra"),
    )


@query
def manifest_diff_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with the PNG parts renamed except where the text is toxic."""
    before = st.document_parts(spark, sf_dir)
    renames = st.plain_renames(before.filter(ext("part_name") == ".png"))
    altered = st.altered_documents(spark, sf_dir)
    after = altered.withColumn(
        "part_name", F.regexp_replace("part_name", r"\.png$", ".jpeg")
    )
    return rec.reconcile_renamed(before, after, renames)


@query
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.manifest_violations(
        st.document_parts(spark, sf_dir), st.altered_documents(spark, sf_dir)
    ).drop("subject")


@query
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rec.manifest_violations(
        st.document_parts(spark, sf_dir), st.altered_documents(spark, sf_dir)
    )
    return rec.first_violation(found)


def _document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that changed, each a package of its own."""
    labels = st.table(spark, sf_dir, "labels").filter(
        (F.col("toxic") == 1) | (F.col("quality") == 0)
    )
    return rec.violation(
        labels.withColumn("container", F.col("doc_id")),
        rec.RULE_PART,
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("poor")),
    )


@query
def selected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = st.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("container"))
    rewritten = candidates(
        st.document_parts(spark, sf_dir), fv.PNG_EXTENSIONS, st.SMALL.min_part_bytes
    ).select(F.col("ordinal").alias("container"))
    return rec.select_version(documents, _document_findings(spark, sf_dir), rewritten)


@query
def count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language counts per source, before and after the damage."""

    def counts(parts: DataFrame) -> DataFrame:
        e = ext("part_name")
        return parts.groupBy("container").agg(
            F.count_if(e == ".png").alias("paragraphs"),
            F.count_if(e == ".jpeg").alias("tables"),
            F.count_if(e == ".gif").alias("inline_images"),
        )

    return rec.diff_counts(
        counts(st.document_parts(spark, sf_dir)), counts(st.altered_documents(spark, sf_dir))
    )


# References and declarations.

@query
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = st.page_references(spark, sf_dir)
    return references.select(
        "rels_path", "pos", "target",
        is_internal("target").alias("internal"),
        resolve_target("rels_path", "target").alias("resolved"),
    )


@query
def rewrite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = st.page_references(spark, sf_dir)
    return ref.rewrite_references(references, st.page_renames(references)).select(
        "container", "rels_path", "pos", "target", "new_target", "changed"
    )


@query
def changed_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = st.page_references(spark, sf_dir)
    return ref.changed_rels(ref.rewrite_references(references, st.page_renames(references)))


@query
def relationship_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References rewritten with mistakes: lost, retyped, pointed elsewhere."""
    before = st.page_references(spark, sf_dir)
    renames = st.page_renames(before)
    target = F.col("target")
    after = (
        ref.rewrite_references(before, renames)
        .filter(~target.endswith(","))
        .withColumn(
            "rel_type",
            F.when(target.endswith("s"), F.lit(st.HYPERLINK)).otherwise(F.col("rel_type")),
        )
        .withColumn(
            "target",
            F.when(target.endswith("r"), F.concat("new_target", F.lit("x"))).otherwise(
                F.col("new_target")
            ),
        )
    )
    return rec.diff_relationships(before, after, renames)


@query
def jpeg_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref.jpeg_extension(st.declared_types(spark, sf_dir))


def _rewritten_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = st.declared_types(spark, sf_dir)
    return ref.rewrite_content_types(
        types, st.package_renames(spark, sf_dir), ref.jpeg_extension(types)
    )


@query
def rewrite_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten_types(spark, sf_dir).drop("pos")


@query
def content_type_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations rewritten with mistakes: lost, added, retyped."""
    key = F.col("key")
    after = (
        _rewritten_types(spark, sf_dir)
        .filter((key != "emf") & ~key.endswith("3.png"))
        .withColumn(
            "content_type",
            F.when(key.endswith("7.png"), F.lit("text/plain")).otherwise(F.col("content_type")),
        )
        .withColumn("key", F.when(key == "gif", F.lit("bmp")).otherwise(key))
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
    )
    return rec.diff_content_types(
        st.declared_types(spark, sf_dir), after, st.package_renames(spark, sf_dir)
    )


# Readings.

@query
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the side of the response gate it falls on."""
    events = st.table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_type") != "error").alias("success")
    )
    good, bad = rd.split_responses(events)
    return good.withColumn("side", F.lit("reading")).unionByName(
        bad.withColumn("side", F.lit("error"))
    )


@query
def explained_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events explained by nations; their codes are the event's ``k``."""
    events = st.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    errors = events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("code"),
        F.date_format("ts", "HH:mm").alias("msg"),
    )
    hints = st.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("hint")
    )
    return rd.explain_errors(errors, hints, "poll").select("event_id", "message")


@query
def stamped_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "events").select(
        "event_id", poll_stamp("ts").alias("stamp")
    )


@query
def rescaled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = st.event_readings(spark, sf_dir)
    return rd.rescale(readings, ("click", "view")).select(
        "pos", "code", st.as_double("value").alias("value")
    )


@query
def rescaled_tenths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounding rule itself, on prices."""
    return st.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tenth("l_extendedprice").alias("tenth")
    )


@query
def latest_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = rd.last_per_code(st.event_readings(spark, sf_dir))
    return latest.select("device_id", "poll_id", "code", "pos", st.as_double("value").alias("value"))


@query
def wide_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rd.stamp(rd.to_wide(st.event_readings(spark, sf_dir), st.EVENT_CODES))
    values = [st.as_double(c).alias(c) for c in st.EVENT_CODES]
    return wide.select("device_id", fv.STAMP_COLUMN, *values)


@query
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rd.derive_headers(st.event_readings(spark, sf_dir))
    return found.select("device_id", F.array_join("codes", ",").alias("codes"))


@query
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = st.event_readings(spark, sf_dir)
    return rd.drift(readings, rd.derive_headers(readings)).select(
        "device_id", "poll_id", F.array_join("new_codes", ",").alias("new_codes")
    )


@query
def locked_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = st.event_readings(spark, sf_dir)
    locked = rd.lock_columns(readings, rd.derive_headers(readings), st.EVENT_CODES)
    values = [st.as_double(c).alias(c) for c in st.EVENT_CODES]
    return locked.select("device_id", fv.STAMP_COLUMN, *values)


@query
def empty_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as polls and their links to capitalised paths as readings."""
    links = F.regexp_extract_all("html", F.lit('href="(/[A-Z][^"]*)"'), 1)
    polls = st.table(spark, sf_dir, "pages").select("page_id", links.alias("result"))
    some, none = rd.non_empty(polls)
    return some.select("page_id", F.size("result").alias("readings")).unionByName(
        none.select("page_id", F.lit(0).alias("readings"))
    )


@query
def status_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses read back: readings, errors and their numbers per device."""
    responses = read_status(spark, st.status_files(spark, sf_dir))
    hints = spark.createDataFrame([(1106, "ask again")], "code long, hint string")
    intake = take_in(responses, hints, "poll", ("k",))
    good = intake.readings.groupBy("device_id").agg(
        F.count("*").alias("readings"),
        F.sum(
            F.when(F.col("code") == "k", st.as_double("value")).cast("decimal(18,1)")
        ).cast("double").alias("k_total"),
    )
    bad = intake.errors.groupBy("device_id").agg(
        F.count("*").alias("errors"), F.max("message").alias("message")
    )
    return good.join(bad, "device_id", "full_outer")


@query
def streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same responses through the stream, with columns locked per device."""
    run = scratch_dir(spark)
    tables = run_telemetry(
        spark, st.status_files(spark, sf_dir), f"{run}/tables", f"{run}/checkpoint",
        codes=("click", "k", "purchase", "signup", "view"), tenths=("k",),
    )
    rows = tables.rows(spark)
    values = [
        st.as_double(c).alias(c) for c in ("click", "k", "purchase", "signup", "view")
    ]
    return rows.select("device_id", "poll_id", fv.STAMP_COLUMN, *values)


# Packages written from the documents.

def _parts_on_disk(spark: SparkSession, folder: str) -> tuple[DataFrame, pk.Share]:
    """The parts of all packages in a folder, and how to deal them out."""
    containers = pk.list_containers(spark, folder)
    share = pk.Share(tasks=tasks_for(containers))
    return pk.readable(pk.explode_parts(containers, share.tasks)), share


def _document_parts_on_disk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pk.Share]:
    return _parts_on_disk(spark, st.document_packages(spark, sf_dir))


def _xml_rows(spark: SparkSession, sf_dir: str, keep) -> DataFrame:
    parts, share = _document_parts_on_disk(spark, sf_dir)
    return px.read_xml(keep(parts), share)


@query
def package_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every package, as its directory tells."""
    parts, _ = _document_parts_on_disk(spark, sf_dir)
    return parts.select("container", "ordinal", "part_name", "is_dir")


@query
def package_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media parts read back, their checksum and their digest."""
    parts, share = _document_parts_on_disk(spark, sf_dir)
    media = pk.read_parts(parts.filter(is_media("part_name")), share)
    digested = media.withColumn("digest", F.md5("content"))
    return pk.verify_crc(digested).select("container", "part_name", "file_size", "digest", "crc_ok")


@query
def package_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = pk.check_parts(*_document_parts_on_disk(spark, sf_dir))
    return tested.groupBy("container").agg(
        F.count("*").alias("parts"), F.bool_and("crc_ok").alias("crc_ok")
    )


@query
def package_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = px.relationships(_xml_rows(spark, sf_dir, px.rels_parts))
    return rels.select(
        "container", "rel_id", "target", resolve_target("rels_path", "target").alias("resolved")
    )


@query
def package_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = px.content_types(_xml_rows(spark, sf_dir, px.content_types_parts))
    return types.select("container", "kind", "key", "content_type")


@query
def package_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.structure_counts(*_document_parts_on_disk(spark, sf_dir)).drop("problem", "main_part")


@query
def package_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of the documents without a GIF part called after its number."""
    folder = st.document_packages(spark, sf_dir)
    containers = pk.list_containers(spark, folder).select("container")
    parts, _ = _document_parts_on_disk(spark, sf_dir)
    pictures = parts.filter(ext("part_name") == ".gif")
    return missing_required(
        containers, pictures.withColumn("part_name", F.lit("gif")), "gif"
    )


@query
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real format of the media parts and whether their names tell it."""
    parts, share = _document_parts_on_disk(spark, sf_dir)
    heads = pk.read_parts(parts.filter(is_media("part_name")), share, first_bytes=32)
    return heads.select(
        "container", "part_name",
        F.coalesce(sniff_format("content"), F.lit("?")).alias("format"),
        format_mismatch("content", ext("part_name")).alias("reason"),
    )


@query
def recoded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed inside the candidate parts of every package."""
    parts, share = _document_parts_on_disk(spark, sf_dir)
    wanted = classify_parts(parts, st.SMALL).filter("disposition = 'candidate'")
    recoded = recode(wanted, st.collapse_spaces, f"{scratch_dir(spark)}/slices", share)
    return decide(recoded, "recompress", st.SMALL).select(
        "container", "part_name", "old_size", "new_size", "accepted", "reason"
    )


_passes: dict[tuple, PassResult] = {}


def _first_pass(spark: SparkSession, sf_dir: str) -> PassResult:
    key = (spark.sparkContext.applicationId, 1, sf_dir)
    if key not in _passes:
        source, target = st.document_packages(spark, sf_dir), scratch_dir(spark)
        _passes[key] = run_first_pass(spark, source, target, st.collapse_spaces, st.SMALL)
    return _passes[key]


def _second_pass(spark: SparkSession, sf_dir: str) -> PassResult:
    key = (spark.sparkContext.applicationId, 2, sf_dir)
    if key not in _passes:
        source, target = st.vector_packages(spark, sf_dir), scratch_dir(spark)
        _passes[key] = run_second_pass(
            spark, source, target, st.repack_png, st.unpack_png, st.SMALL
        )
    return _passes[key]


@query
def first_pass_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole first pass over the document packages."""
    return _first_pass(spark, sf_dir).outcomes.select(
        "container", "version", "processed", "skipped", "published_count",
        F.col("failure").isNull().alias("proven"),
        "media_count", "paragraphs", "tables", "inline_images",
    )


@query
def first_pass_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published packages contain."""
    done = _first_pass(spark, sf_dir)
    parts = done.published_parts.filter(is_media("part_name"))
    return pk.read_parts(parts, done.share).select(
        "container", "part_name", F.octet_length("content").alias("size"),
        F.md5("content").alias("digest"),
    )


def _whole_report(result: PassResult, second: bool = False) -> DataFrame:
    """Every line of a report, over-limit list included (nothing is small enough).

    Sizes in an archive depend on the compressor: ``#`` stands for them.  Sizes of
    the first pass's parts are known and stay.
    """
    settings = replace(st.SMALL, alert_bytes=0)
    lines = render_report(result, "in", "out", settings, second)
    masked = F.regexp_replace("line", r"[0-9.]+,[0-9] MB", "# MB")
    masked = F.regexp_replace(masked, r"-?[0-9]+([.][0-9]+)? %", "# %")
    known = F.lit(not second) & (F.col("section") == PART_LINES)
    return lines.select(*LINE_ORDER, F.when(known, F.col("line")).otherwise(masked).alias("line"))


@query
def first_pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of the first pass."""
    return _whole_report(_first_pass(spark, sf_dir))


@query
def second_pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of the second pass."""
    return _whole_report(_second_pass(spark, sf_dir), second=True)


@query
def second_pass_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and declarations in the packages that the second pass published."""
    done = _second_pass(spark, sf_dir)
    parts = done.published_parts
    xml = px.rels_parts(parts).unionByName(px.content_types_parts(parts))
    rows = written(px.read_xml(xml, done.share), scratch_dir(spark))
    rels = px.relationships(rows).select(
        "container", F.lit("reference").alias("kind"), F.col("rel_id").alias("key"),
        F.concat_ws(" ", "rel_type", "target", "target_mode").alias("value"),
    )
    types = px.content_types(rows).select("container", "kind", "key", F.col("content_type").alias("value"))
    return rels.unionByName(types)


@query
def picture_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and size of every picture, read from the first bytes of its member."""
    parts, share = _parts_on_disk(spark, st.vector_packages(spark, sf_dir))
    heads = pk.read_parts(parts.filter(is_media("part_name")), share, first_bytes=32)
    return im.head_profile(heads).select(
        "container", "part_name", "head_format", "head_width", "head_height", "head_channels"
    )


@query
def image_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the embeddings decoded: size, transparency, colours."""
    parts, share = _parts_on_disk(spark, st.vector_packages(spark, sf_dir))
    pictures = parts.filter(is_media("part_name"))
    flags = im.inspect_images(pictures, st.unpack_png, share, st.SMALL.min_colors)
    names = pictures.select("container", "ordinal", "part_name")
    return flags.join(names, ["container", "ordinal"]).select(
        "part_name", "width", "height", "channels", "decodable", "has_alpha",
        "sample_colors", "photographic",
    )


@query
def second_pass_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole second pass over the picture packages."""
    return _second_pass(spark, sf_dir).outcomes.select(
        "container", "version", "processed", "skipped", "published_count",
        F.col("failure").isNull().alias("proven"), "media_count", "members",
    )


@query
def second_pass_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_pass(spark, sf_dir).published_parts.select("container", "ordinal", "part_name")


@query
def streamed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass fed by a stream of arriving packages."""
    run = scratch_dir(spark)
    run_corpus(
        spark, st.document_packages(spark, sf_dir), f"{run}/out", f"{run}/results",
        f"{run}/checkpoint", st.collapse_spaces, st.SMALL,
    )
    return spark.read.parquet(f"{run}/results").select(
        "container", "version", "processed", "skipped"
    )
