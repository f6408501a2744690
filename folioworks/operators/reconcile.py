"""Proofs that a rewritten package differs from its original only as allowed.

Each proof returns ``violations``: one row per finding, none when all is well.
Both sides of a comparison are stacked and grouped by their key, so a proof
takes one shuffle of the two manifests and no join; the key includes the part
or reference name, so one huge package spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import fixed_values as fv
from ..functions import is_media, resolve_target, rewrite_target
from ..functions.columns import py_list

VIOLATION_COLUMNS = ("container", "rule_no", "ordinal", "subject", "message")

# Rule numbers: the order in which a proof would stop at its first finding.
RULE_READABLE = 0
RULE_CHECKSUM = 1
RULE_MEMBERS = 2
RULE_MEDIA_COUNT = 3
RULE_PART = 4
# The second pass looks at the untouched parts before counting the media.
RULE_PART_RENAMED = 3
RULE_MEDIA_COUNT_RENAMED = 4
RULE_NEW_IMAGE = 5
RULE_RELATIONSHIPS = 6
RULE_CONTENT_TYPES = 7
RULE_COUNTS = 8


def violation(
    df: DataFrame,
    rule_no: int,
    message: Column,
    ordinal: Column | None = None,
    subject: Column | None = None,
) -> DataFrame:
    return df.select(
        "container",
        F.lit(rule_no).alias("rule_no"),
        (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
        message.alias("message"),
    )


def all_violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def side_by_side(
    before: DataFrame, after: DataFrame, keys: Sequence[str], rank: str, values: Sequence[str]
) -> DataFrame:
    """One row per key with structs ``before`` and ``after`` (null when absent).

    Each struct holds ``values`` of the row with the highest ``rank``: a name
    written twice counts as its last entry.
    """
    entry = F.struct(F.col(rank).alias("rank"), *values)
    stacked = before.select(*keys, entry.alias("b"), F.lit(None).cast("void").alias("a"))
    other = after.select(*keys, F.lit(None).cast("void").alias("b"), entry.alias("a"))
    return (
        stacked.unionByName(other)
        .groupBy(*keys)
        .agg(F.max("b").alias("before"), F.max("a").alias("after"))
    )


def _judged(pairs: DataFrame, exempt: Column, rank: Sequence[str]) -> DataFrame:
    """Add ``status`` (null where all is well) and ``ordinal`` to pairs of manifests."""
    same = (F.col("before.crc") == F.col("after.crc")) & (
        F.col("before.file_size") == F.col("after.file_size")
    )
    status = (
        F.when(F.col("after").isNull(), F.lit("missing"))
        .when(F.col("before").isNull(), F.lit("extra"))
        .when(~exempt & ~same, F.lit("changed"))
    )
    ordinal = F.coalesce(*(f"{side}.rank" for side in rank)).cast("long")
    return pairs.withColumns({"status": status, "ordinal": ordinal})


def _differences(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("status").isNotNull()).select(
        "container", "part_name", "status", "ordinal"
    )


def _manifests(
    before: DataFrame, after: DataFrame, exempt: Callable[[str], Column] = is_media
) -> DataFrame:
    pairs = side_by_side(
        before, after, ["container", "part_name"], "ordinal", ["crc", "file_size"]
    )
    return _judged(pairs, exempt("part_name"), ("before", "after"))


def reconcile(
    before: DataFrame,
    after: DataFrame,
    exempt: Callable[[str], Column] = is_media,
) -> DataFrame:
    """Differences between two manifests: ``missing``, ``extra``, ``changed``.

    Manifests have ``container, part_name, ordinal, crc, file_size``.  Members
    for which ``exempt`` holds may change, but not come or go.
    """
    return _differences(_manifests(before, after, exempt))


def expected_manifest(before: DataFrame, renames: DataFrame) -> DataFrame:
    """``before`` as it should look once ``renames`` are applied."""
    known = renames.select("container", "part_name", "new_part_name")
    named = before.join(known, ["container", "part_name"], "left")
    return named.withColumn("renamed", F.col("new_part_name").isNotNull()).withColumn(
        "part_name", F.coalesce("new_part_name", "part_name")
    ).drop("new_part_name")


def may_change_when_renaming(part_name: str) -> Column:
    name = F.col(part_name)
    return (name == fv.CONTENT_TYPES_PART) | name.endswith(fv.RELS_SUFFIX)


def _manifests_renamed(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    expected = expected_manifest(before, renames)
    entry = F.struct(F.col("ordinal").alias("rank"), "crc", "file_size")
    none = F.lit(None).cast("void")
    keys = ["container", "part_name"]
    stacked = expected.select(*keys, "renamed", entry.alias("b"), none.alias("a")).unionByName(
        after.select(*keys, F.lit(False).alias("renamed"), none.alias("b"), entry.alias("a"))
    )
    pairs = stacked.groupBy(*keys).agg(
        F.max("b").alias("before"), F.max("a").alias("after"), F.max("renamed").alias("renamed")
    )
    exempt = F.col("renamed") | may_change_when_renaming("part_name")
    return _judged(pairs, exempt, ("after", "before"))


def reconcile_renamed(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """As ``reconcile``, with the renamed parts expected under their new names."""
    return _differences(_manifests_renamed(before, after, renames))


def member_diff(differences: DataFrame, shown: int = 5) -> DataFrame:
    """First ``shown`` missing and extra names per container, sorted.

    The ranking keeps ``shown`` names per group in every task before the
    shuffle, so a package with millions of differences stays cheap.
    """
    one_sided = differences.filter(F.col("status").isin("missing", "extra"))
    order = Window.partitionBy("container", "status").orderBy("part_name")
    top = one_sided.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shown)

    def names(status: str) -> Column:
        picked = F.collect_list(F.when(F.col("status") == status, F.col("part_name")))
        return F.array_sort(picked)

    return top.groupBy("container").agg(
        names("missing").alias("missing"), names("extra").alias("extra")
    )


def media_counts(parts: DataFrame) -> DataFrame:
    """Distinct media names per container."""
    named = parts.groupBy("container", "part_name").agg(F.lit(1).alias("_one"))
    return named.groupBy("container").agg(
        F.count_if(is_media("part_name")).alias("media_count")
    )


def manifest_totals(judged: DataFrame) -> DataFrame:
    """What the pairs of two manifests say by container, in one further aggregation.

    ``members_differ``; ``media_count`` and ``media_after`` (distinct names), with
    ``compared`` where both sides know the container; ``changed_parts`` and the
    first of them, ``first_changed``.
    """
    old, new = F.col("before").isNotNull(), F.col("after").isNotNull()
    media, changed = is_media("part_name"), F.col("status") == "changed"
    return judged.groupBy("container").agg(
        F.bool_or(~(old & new)).alias("members_differ"),
        F.count_if(old & media).alias("media_count"),
        F.count_if(new & media).alias("media_after"),
        (F.bool_or(old) & F.bool_or(new)).alias("compared"),
        F.count_if(changed).alias("changed_parts"),
        F.min(F.when(changed, F.struct("ordinal", "part_name"))).alias("first_changed"),
    )


def _media_violations(totals: DataFrame, rule_no: int, message: str) -> DataFrame:
    differing = totals.filter(
        F.col("compared") & (F.col("media_count") != F.col("media_after"))
    )
    return violation(
        differing, rule_no, F.format_string(message, "media_count", "media_after")
    )


def _part_violations(judged: DataFrame, rule_no: int, message: str) -> DataFrame:
    return violation(
        judged.filter(F.col("status") == "changed"),
        rule_no,
        F.format_string(message, "part_name"),
        F.col("ordinal"),
        F.col("part_name"),
    )


def manifest_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """First pass: same members, untouched parts identical, as many media.

    The manifests are shuffled once, into pairs, and the pairs once more, into one
    row for each container; what the pairs themselves add reuses their shuffle.
    """
    judged = _manifests(before, after)
    totals = manifest_totals(judged)
    message = F.format_string(fv.BAD_MEDIA_COUNT, "media_count", "media_after")

    def finding(when: Column, rule_no: int, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule_no).alias("rule_no"), text.alias("message")))

    found = F.array_compact(
        F.array(
            finding(F.col("members_differ"), RULE_MEMBERS, F.lit(fv.BAD_MEMBERS)),
            finding(
                F.col("compared") & (F.col("media_count") != F.col("media_after")),
                RULE_MEDIA_COUNT,
                message,
            ),
        )
    )
    whole = totals.select("container", F.inline(found)).select(
        "container",
        "rule_no",
        F.lit(0).cast("long").alias("ordinal"),
        F.lit(None).cast("string").alias("subject"),
        "message",
    )
    return all_violations(whole, _part_violations(judged, RULE_PART, fv.BAD_PART))


def manifest_violations_renamed(
    before: DataFrame, after: DataFrame, renames: DataFrame
) -> DataFrame:
    """Second pass: members as expected, the others identical, as many media."""
    judged = _manifests_renamed(before, after, renames)
    members = member_diff(_differences(judged))
    return all_violations(
        violation(
            members,
            RULE_MEMBERS,
            F.format_string(
                fv.BAD_MEMBERS_RENAMED, py_list(F.col("missing")), py_list(F.col("extra"))
            ),
        ),
        _part_violations(judged, RULE_PART_RENAMED, fv.BAD_PART_RENAMED),
        _media_violations(
            manifest_totals(judged), RULE_MEDIA_COUNT_RENAMED, fv.BAD_MEDIA_COUNT_RENAMED
        ),
    )


def diff_relationships(
    before: DataFrame,
    after: DataFrame,
    renames: DataFrame,
    image_type: str = fv.IMAGE_REL_TYPE,
) -> DataFrame:
    """References that changed in any other way than following a rename."""
    keys = ["container", "rels_path", "rel_id"]
    pairs = side_by_side(before, after, keys, "pos", ["rel_type", "target_mode", "target"])
    paired = pairs.withColumn(
        "part_name", resolve_target("rels_path", F.col("before.target"))
    )
    known = renames.select("container", "part_name", "new_part_name")
    looked_up = paired.join(known, ["container", "part_name"], "left")
    b, a = F.col("before"), F.col("after")
    expected = rewrite_target(b["target"], "new_part_name")
    rid = F.col("rel_id")
    finding = (
        F.when(b.isNull() | a.isNull(), F.lit(fv.BAD_REL_IDS))
        .when(
            ~b["rel_type"].eqNullSafe(a["rel_type"])
            | ~b["target_mode"].eqNullSafe(a["target_mode"]),
            F.format_string(fv.BAD_REL_TYPE, rid),
        )
        .when(b["target"].eqNullSafe(a["target"]), F.lit(None))
        .when(
            ~b["rel_type"].eqNullSafe(F.lit(image_type)),
            F.format_string(fv.BAD_REL_NOT_IMAGE, rid),
        )
        .when(F.col("new_part_name").isNull(), F.format_string(fv.BAD_REL_NOT_RENAMED, rid))
        .when(
            ~a["target"].eqNullSafe(expected),
            F.format_string(fv.BAD_REL_TARGET, rid, a["target"]),
        )
    )
    found = looked_up.withColumn("finding", finding).filter(F.col("finding").isNotNull())
    # A lost or added Id is reported before anything else in the same file.
    position = F.when(b.isNull() | a.isNull(), F.lit(-1)).otherwise(b["rank"])
    return violation(
        found,
        RULE_RELATIONSHIPS,
        F.concat("rels_path", F.lit(": "), "finding"),
        position,
        F.concat("rels_path", F.lit("#"), F.coalesce(rid, F.lit(""))),
    )


def diff_content_types(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """Declarations that were lost, added or altered without a rename behind it."""
    pairs = side_by_side(before, after, ["container", "kind", "key"], "pos", ["content_type"])
    dropped = renames.select(
        "container",
        F.lit("override").alias("kind"),
        F.concat(F.lit("/"), "part_name").alias("key"),
        F.lit(True).alias("renamed"),
    ).distinct()
    joined = pairs.join(dropped, ["container", "kind", "key"], "left")
    b, a, key = F.col("before"), F.col("after"), F.col("key")
    default = F.col("kind") == "default"
    lost, added = a.isNull(), b.isNull()
    quoted = F.concat(F.lit("{'"), key, F.lit("'}"))
    order = (
        F.when(default & lost, 0)
        .when(default & added & ~key.isin("jpeg", "jpg"), 1)
        .when(~default & lost & F.col("renamed").isNull(), 2)
        .when(~default & added, 3)
        .when(~default & ~b["content_type"].eqNullSafe(a["content_type"]) & ~lost, 4)
    )
    message = (
        F.when(F.col("_order") == 0, F.lit(fv.BAD_DEFAULT_LOST))
        .when(F.col("_order") == 1, F.format_string(fv.BAD_DEFAULT_ADDED, quoted))
        .when(F.col("_order") == 2, F.format_string(fv.BAD_OVERRIDE_LOST, quoted))
        .when(F.col("_order") == 3, F.lit(fv.BAD_OVERRIDE_ADDED))
        .otherwise(F.format_string(fv.BAD_OVERRIDE_TYPE, key))
    )
    found = joined.withColumn("_order", order).filter(F.col("_order").isNotNull())
    return violation(
        found,
        RULE_CONTENT_TYPES,
        F.concat(F.lit(fv.CONTENT_TYPES_PART + ": "), message),
        F.col("_order"),
        F.concat("kind", F.lit(":"), key),
    )


COUNTED = ("paragraphs", "tables", "inline_images")


def diff_counts(
    before: DataFrame, after: DataFrame, counted: Sequence[str] = COUNTED
) -> DataFrame:
    """Containers whose structure counts changed."""
    b = before.select("container", *[F.col(c).alias(f"{c}_before") for c in counted])
    a = after.select("container", *[F.col(c).alias(f"{c}_after") for c in counted])
    pairs = [(f"{c}_before", f"{c}_after") for c in counted]
    differs = reduce(
        Column.__or__, [~F.col(x).eqNullSafe(F.col(y)) for x, y in pairs]
    )
    return b.join(a, "container").filter(differs)


def count_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    differing = diff_counts(before, after)
    values = [F.col(f"{c}_{side}") for c in COUNTED for side in ("before", "after")]
    return violation(differing, RULE_COUNTS, F.format_string(fv.BAD_COUNTS, *values))


def checksum_violations(tested: DataFrame) -> DataFrame:
    """``tested`` has ``container, ordinal, part_name, crc_ok``."""
    return violation(
        tested.filter(~F.col("crc_ok")),
        RULE_CHECKSUM,
        F.lit(fv.BAD_CHECKSUM),
        F.col("ordinal"),
        F.col("part_name"),
    )


def first_violation(violations: DataFrame) -> DataFrame:
    """The finding a step-by-step proof would have stopped at."""
    order = F.struct("rule_no", "ordinal", "subject", "message")
    return (
        violations.groupBy("container")
        .agg(F.min(order).alias("first"), F.count("*").alias("findings"))
        .select("container", "first.rule_no", "first.message", "findings")
    )


def select_version(
    containers: DataFrame, violations: DataFrame, rewritten: DataFrame | None = None
) -> DataFrame:
    """Add ``version`` and ``failure``.

    ``new`` when the proof found nothing, ``original`` when it did, and
    ``unchanged`` for containers not in ``rewritten`` (nothing to publish).
    """
    first = first_violation(violations).select(
        "container", F.col("message").alias("failure")
    )
    judged = containers.join(first, "container", "left")
    version = F.when(F.col("failure").isNotNull(), F.lit("original"))
    if rewritten is not None:
        done = rewritten.select("container", F.lit(True).alias("_done")).distinct()
        judged = judged.join(done, "container", "left")
        version = version.when(F.col("_done").isNull(), F.lit("unchanged"))
    return judged.withColumn("version", version.otherwise(F.lit("new"))).drop("_done")
