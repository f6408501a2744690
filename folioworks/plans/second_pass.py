"""Convert photographic PNG parts to JPEG and follow their new names everywhere."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import outcomes as out
from ..operators import reconcile as rec
from ..operators.classify import candidates, missing_required, only_large
from ..operators.naming import assign_names
from ..operators.recode import DECISION_COLUMNS, Codec, convert, decide, pixel_reason
from ..operators.references import jpeg_extension, missing_defaults, rewrite_references
from ..operators.skew import of_containers, spread_join
from ..session import registered, scratch_dir, tasks_for, written
from ..settings import DEFAULTS, Settings
from ..sources.files import opened, remove_folder
from ..sources.images import Decoder, inspect_images
from ..sources.package_xml import (
    content_types,
    content_types_parts,
    damaged,
    is_rels,
    malformed,
    read_xml,
    relationships,
    rels_parts,
)
from ..sources.packages import (
    Batches,
    Share,
    by_package_slice,
    check_parts,
    explode_parts,
    list_containers,
    open_zip,
    readable,
    unreadable,
)
from ..sources.slices import SLICE, as_struct, slice_writer
from .first_pass import PassResult, structure_violations, undecided, unprocessable
from .publish import publish, write_packages

def run_second_pass(
    spark: SparkSession,
    source: str,
    target: str,
    codec: Codec,
    decode: Decoder,
    settings: Settings = DEFAULTS,
    large_only: bool = False,
    containers: DataFrame | None = None,
) -> PassResult:
    """Convert the packages of ``source`` into ``target``.

    ``codec(content, part_name)`` turns PNG bytes into JPEG bytes, and
    ``decode(content)`` gives the pixels of either (see ``sources.images``).  With
    ``large_only`` packages up to ``settings.alert_bytes`` are left out.
    """
    run = scratch_dir(spark)
    staging = registered(f"{target.rstrip('/')}/_staging-{run.rpartition('-')[2]}")
    if containers is None:
        containers = list_containers(spark, source, settings.suffix)
    if large_only:
        containers = only_large(containers, settings.alert_bytes)
    containers = written(containers, f"{run}/containers")
    tasks = tasks_for(containers)
    share = Share(settings.members_per_task, tasks)

    scanned = written(explode_parts(containers, tasks), f"{run}/scanned")
    parts = readable(scanned)
    xml = rels_parts(parts).unionByName(content_types_parts(parts))
    xml = written(read_xml(xml, share), f"{run}/xml")
    rels = relationships(xml)
    types = content_types(xml)
    whole = containers.join(unreadable(scanned), "container", "left_anti")
    bad_xml = malformed(xml)
    unread_xml = damaged(xml)
    stopped = written(
        rec.all_violations(
            unprocessable(unreadable(scanned), "error"),
            unprocessable(content_types_parts(unread_xml), "problem"),
            unprocessable(
                missing_required(whole, parts).withColumn(
                    "problem", F.lit(fv.MISSING_CONTENT_TYPES)
                ),
                "problem",
            ),
            unprocessable(
                bad_xml.filter(F.col("part_name") == fv.CONTENT_TYPES_PART), "part_name"
            ),
        ),
        f"{run}/stopped",
    )
    workable = whole.join(stopped.select("container").distinct(), "container", "left_anti")

    # Which candidates to convert.
    wanted = of_containers(
        candidates(parts, fv.PNG_EXTENSIONS, settings.min_part_bytes), workable
    )
    slices = f"{run}/slices"
    seen = convert(wanted, decode, codec, slices, share, settings.min_colors)
    seen = written(seen.withColumn("kept_reason", pixel_reason()), f"{run}/seen")
    recoded = seen.filter(F.col("kept_reason").isNull() & F.col("problem").isNull())
    decided = written(decide(recoded, "convert", settings), f"{run}/decided")

    # New names, and everything that must follow them.
    extensions = jpeg_extension(types, workable)
    converted = decided.filter("accepted").select("container", "ordinal", "part_name")
    extended = spread_join(converted, extensions, ["container"], "inner", ["ordinal"])
    named = assign_names(extended, parts)
    by_ordinal = written(named, f"{run}/renames")
    # References know parts by name; a name entered twice means its last entry.
    last_entries = by_ordinal.groupBy("container", "part_name").agg(
        F.max_by("new_part_name", "ordinal").alias("new_part_name"),
        F.max("ordinal").alias("ordinal"),
    )
    renames = written(last_entries, f"{run}/renames_by_name")
    touched = renames.select("container").distinct()
    broken_rels = bad_xml.filter(F.col("part_name") != fv.CONTENT_TYPES_PART).join(
        touched, "container", "left_semi"
    )
    # References matter only where something was renamed; a picture that can't
    # be read stops its package in any case.
    unread_rels = unread_xml.filter(is_rels()).join(touched, "container", "left_semi")
    stopped_late = (
        unprocessable(broken_rels, "part_name")
        .unionByName(unprocessable(unread_rels, "problem"))
        .unionByName(unprocessable(seen, "problem"))
    )
    to_write = whole.join(touched, "container", "left_semi").join(
        stopped_late.select("container").distinct(), "container", "left_anti"
    )
    images = decided.filter("accepted").select(
        "container", "ordinal", F.lit(None).cast("string").alias("new_part_name"), "new_slice"
    )
    new_names = by_ordinal.select(
        "container",
        F.col("ordinal").cast("int").alias("ordinal"),
        "new_part_name",
        F.lit(None).cast(SLICE).alias("new_slice"),
    )
    edited = edited_xml(xml, rels, types, renames, extensions, slices, share)
    replacements = images.unionByName(new_names).unionByName(written(edited, f"{run}/edited"))
    staged = written(write_packages(to_write, replacements, staging, tasks), f"{run}/staged")

    # Proof.
    complete = staged.filter(F.col("problem").isNull())
    rescanned = written(explode_parts(complete, tasks), f"{run}/rescanned")
    after = readable(rescanned)
    after_xml = rels_parts(after).unionByName(content_types_parts(after))
    after_xml = written(read_xml(after_xml, share), f"{run}/after_xml")
    before = written(of_containers(parts, complete), f"{run}/before")
    moved = written(of_containers(renames, complete), f"{run}/moved")
    counts, structure = structure_violations(complete, before, after, share)
    counts = written(counts, f"{run}/counts")
    new_images = after.join(
        moved.select("container", F.col("new_part_name").alias("part_name")),
        ["container", "part_name"],
        "left_semi",
    )
    reopened = written(inspect_images(new_images, decode, share), f"{run}/reopened")
    undecodable = reopened.filter(~F.coalesce("decodable", F.lit(False))).join(
        after.select("container", "ordinal", "part_name"), ["container", "ordinal"]
    )
    violations = written(
        rec.all_violations(
            stopped,
            stopped_late,
            unprocessable(staged, "problem"),
            rec.violation(unreadable(rescanned), rec.RULE_CHECKSUM, F.lit(fv.BAD_CHECKSUM)),
            rec.checksum_violations(check_parts(after, share)),
            rec.manifest_violations_renamed(before, after, moved),
            rec.violation(
                undecodable,
                rec.RULE_NEW_IMAGE,
                F.format_string(fv.BAD_NEW_IMAGE, "part_name"),
                F.col("ordinal"),
                F.col("part_name"),
            ),
            unprocessable(malformed(after_xml), "part_name"),
            rec.diff_relationships(
                of_containers(rels.withColumnRenamed("pos", "ordinal"), complete).withColumnRenamed(
                    "ordinal", "pos"
                ),
                relationships(after_xml),
                moved,
            ),
            rec.diff_content_types(
                of_containers(types.withColumnRenamed("pos", "ordinal"), complete).withColumnRenamed(
                    "ordinal", "pos"
                ),
                content_types(after_xml),
                moved,
            ),
            structure,
        ),
        f"{run}/violations",
    )

    judged = rec.select_version(containers, violations, staged).join(
        staged.select("container", F.col("path").alias("staged")), "container", "left"
    )
    judged = written(judged, f"{run}/judged")
    published = written(publish(judged, target, tasks), f"{run}/published")
    remove_folder(staging)

    halted = violations.filter(F.col("rule_no") == rec.RULE_READABLE).select("container")
    decisions = undecided(
        seen.filter(F.col("kept_reason").isNotNull()), "kept_reason"
    ).unionByName(decided.select(*DECISION_COLUMNS))
    decisions = (
        of_containers(decisions, halted, "left_anti")
        .join(
            by_ordinal.select("container", "ordinal", "new_part_name"),
            ["container", "ordinal"],
            "left",
        )
    )
    decisions = written(decisions, f"{run}/decisions")
    remove_folder(slices)
    results = out.with_package_sizes(
        containers,
        out.outcomes(decisions),
        judged.select("container", "version", "failure").join(
            published.select("container", F.col("length").alias("size_after")), "container"
        ),
    )
    members = parts.groupBy("container").agg(
        F.count_distinct("part_name").alias("members")
    )
    facts = (
        rec.media_counts(parts)
        .join(members, "container", "left")
        .join(counts.drop("problem", "main_part"), "container", "left")
    )
    results = written(results.join(facts, "container", "left"), f"{run}/outcomes")
    published_parts = readable(written(explode_parts(published, tasks), f"{run}/published_parts"))
    return PassResult(results, out.detail_lines(decisions), violations, published_parts, share, run)


def edited_xml(
    xml: DataFrame,
    rels: DataFrame,
    types: DataFrame,
    renames: DataFrame,
    extensions: DataFrame,
    folder: str,
    share: Share = Share(),
) -> DataFrame:
    """New bytes of the XML parts that mention renamed parts, in slices below ``folder``.

    The edits of one XML part are gathered beside its place; the part itself
    bounds their number.  Its text is read again where it is edited.
    """
    changed = rewrite_references(rels, renames).filter("changed")
    targets = changed.groupBy("container", F.col("rels_path").alias("part_name")).agg(
        F.collect_list(F.struct("pos", "new_target")).alias("targets")
    )
    edit = F.struct(F.col("key").alias("add"), F.lit(None).cast("string").alias("remove"))
    added = missing_defaults(types, renames, extensions).select("container", edit.alias("edit"))
    gone = renames.select("container", F.concat(F.lit("/"), "part_name").alias("key")).distinct()
    removed = (
        types.filter(F.col("kind") == "override")
        .join(gone, ["container", "key"], "left_semi")
        .select(
            "container",
            F.struct(F.lit(None).cast("string").alias("add"), F.col("key").alias("remove")).alias(
                "edit"
            ),
        )
    )
    declarations = (
        added.unionByName(removed)
        .groupBy("container")
        .agg(
            F.collect_list("edit.add").alias("add"),
            F.collect_list("edit.remove").alias("remove"),
        )
        .withColumn("part_name", F.lit(fv.CONTENT_TYPES_PART))
    )
    keys = ["container", "part_name"]
    edits = targets.join(declarations, keys, "full_outer")
    source = xml.filter(F.col("element") == "part").select(*keys, "path", "ordinal")
    wanted = source.join(edits, keys).select(
        "container", "path", "ordinal", "part_name", "targets", "add", "remove"
    )
    columns = ["container", "ordinal", "new_part_name", "new_slice"]

    def edit_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batches(columns)
        with opened(open_zip) as package, slice_writer(folder) as slices:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    z = package(row.path)
                    content = z.read(z.infolist()[row.ordinal])
                    if row.part_name == fv.CONTENT_TYPES_PART:
                        content = redeclare(content, row.add, row.remove)
                    else:
                        content = retarget(content, row.targets)
                    place = as_struct(slices.add(content))
                    if batch.add((row.container, row.ordinal, row.part_name, place)):
                        yield batch.take()
        if batch.rows:
            yield batch.take()

    return by_package_slice(wanted, share).mapInPandas(
        edit_all, f"container string, ordinal int, new_part_name string, new_slice {SLICE}"
    )


# Fixed value: declaration line of package XML.
_XML_HEAD = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'


def retarget(content: bytes, targets: list[dict]) -> bytes:
    """A ``.rels`` text with the references at ``pos`` pointing elsewhere."""
    ET.register_namespace("", fv.NS_RELATIONSHIPS)
    root = ET.fromstring(content)
    references = root.findall(f"{{{fv.NS_RELATIONSHIPS}}}Relationship")
    for edit in targets:
        references[edit["pos"]].set("Target", edit["new_target"])
    return _XML_HEAD + ET.tostring(root, "utf-8")


def redeclare(content: bytes, add: list[str], remove: list[str]) -> bytes:
    """A content-types text with JPEG defaults added and overrides removed."""
    ET.register_namespace("", fv.NS_CONTENT_TYPES)
    root = ET.fromstring(content)
    for extension in add:
        ET.SubElement(
            root,
            f"{{{fv.NS_CONTENT_TYPES}}}Default",
            {"Extension": extension, "ContentType": "image/jpeg"},
        )
    gone = set(remove)
    for override in root.findall(f"{{{fv.NS_CONTENT_TYPES}}}Override"):
        if override.get("PartName") in gone:
            root.remove(override)
    return _XML_HEAD + ET.tostring(root, "utf-8")
