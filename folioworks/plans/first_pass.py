"""Recompress the images of every package, prove the result and publish it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import outcomes as out
from ..operators import reconcile as rec
from ..operators.classify import classify_parts
from ..operators.recode import DECISION_COLUMNS, Codec, decide, recode_fitting
from ..operators.skew import of_containers
from ..session import registered, scratch_dir, tasks_for, written
from ..settings import DEFAULTS, Settings
from ..sources.files import remove_folder
from ..sources.package_xml import structure_counts
from ..sources.packages import (
    Share,
    check_parts,
    explode_parts,
    list_containers,
    readable,
    unreadable,
)
from .publish import publish, write_packages

EXCEPTION = "exceção durante o processamento:\n"


@dataclass(frozen=True)
class PassResult:
    """Tables a pass leaves behind; all of them are stored, none is recomputed."""

    outcomes: DataFrame
    details: DataFrame
    violations: DataFrame
    published_parts: DataFrame
    share: Share  # how to deal out ``published_parts`` for reading
    scratch: str  # where these tables lie

    def discard(self) -> None:
        """Remove the tables; nothing of this result can be read afterwards."""
        remove_folder(self.scratch)

    def summary(self) -> DataFrame:
        return out.corpus_summary(self.outcomes)

    def over_limit(self, limit: int) -> DataFrame:
        return out.over_limit(self.outcomes, self.published_parts, limit)


def undecided(parts: DataFrame, reason: str) -> DataFrame:
    """Decisions for parts that stay without having been recoded."""
    return parts.select(
        "container",
        "ordinal",
        "part_name",
        F.col(reason).alias("reason"),
        F.col("file_size").alias("old_size"),
        F.lit(None).cast("long").alias("new_size"),
        F.lit(False).alias("accepted"),
    )


def structure_violations(
    containers: DataFrame, parts: DataFrame, after: DataFrame, share: Share
) -> tuple[DataFrame, DataFrame]:
    """The counts of the originals, and what differs or cannot be counted."""
    before_counts, after_counts = structure_counts(parts, share), structure_counts(after, share)
    uncountable = before_counts.unionByName(after_counts).filter(F.col("problem").isNotNull())
    empty = containers.join(before_counts.select("container"), "container", "left_anti")
    found = rec.all_violations(
        rec.count_violations(before_counts, after_counts),
        rec.violation(
            uncountable, rec.RULE_COUNTS, F.concat(F.lit(EXCEPTION), "problem"), F.lit(-1)
        ),
        rec.violation(empty, rec.RULE_COUNTS, F.lit(EXCEPTION + "no parts"), F.lit(-1)),
    )
    return before_counts, found


def unprocessable(problems: DataFrame, column: str) -> DataFrame:
    """Findings that stop a package before any proof."""
    return rec.violation(
        problems.filter(F.col(column).isNotNull()),
        rec.RULE_READABLE,
        F.concat(F.lit(EXCEPTION), column),
    )


def run_first_pass(
    spark: SparkSession,
    source: str,
    target: str,
    codec: Codec,
    settings: Settings = DEFAULTS,
    containers: DataFrame | None = None,
) -> PassResult:
    """Reduce every package of ``source`` into ``target``.

    ``codec(content, part_name)`` returns recompressed bytes of the same format
    (at most ``settings.max_dimension`` pixels, see ``resize_plan``).  Steps
    that run Python or touch files are written once; the rest stays lazy.
    """
    run = scratch_dir(spark)
    staging = registered(f"{target.rstrip('/')}/_staging-{run.rpartition('-')[2]}")
    if containers is None:
        containers = list_containers(spark, source, settings.suffix)
    containers = written(containers, f"{run}/containers")
    tasks = tasks_for(containers)
    share = Share(settings.members_per_task, tasks)

    scanned = written(explode_parts(containers, tasks), f"{run}/scanned")
    parts = readable(scanned)
    classified = classify_parts(parts, settings)
    wanted = classified.filter(F.col("disposition") == "candidate")
    recoded = written(recode_fitting(wanted, codec, f"{run}/slices", share), f"{run}/recoded")
    decided = decide(recoded.filter(F.col("format_reason").isNull()), "recompress", settings)
    misnamed = recoded.filter(F.col("format_reason").isNotNull())

    whole = containers.join(unreadable(scanned), "container", "left_anti")
    replacements = decided.filter("accepted").select(
        "container", "ordinal", F.col("part_name").alias("new_part_name"), "new_slice"
    )
    staged = written(write_packages(whole, replacements, staging, tasks), f"{run}/staged")
    complete = staged.filter(F.col("problem").isNull())
    rescanned = written(explode_parts(complete, tasks), f"{run}/rescanned")
    after = readable(rescanned)
    before = written(of_containers(parts, complete), f"{run}/before")

    counts, structure = structure_violations(complete, before, after, share)
    counts = written(counts, f"{run}/counts")
    violations = written(
        rec.all_violations(
            unprocessable(unreadable(scanned), "error"),
            unprocessable(staged, "problem"),
            unprocessable(decided, "problem"),
            rec.violation(unreadable(rescanned), rec.RULE_CHECKSUM, F.lit(fv.BAD_CHECKSUM)),
            rec.checksum_violations(check_parts(after, share)),
            rec.manifest_violations(before, after),
            structure,
        ),
        f"{run}/violations",
    )

    judged = rec.select_version(containers, violations).join(
        staged.select("container", F.col("path").alias("staged")), "container", "left"
    )
    judged = written(judged, f"{run}/judged")
    published = written(publish(judged, target, tasks), f"{run}/published")
    remove_folder(staging)

    stopped = violations.filter(F.col("rule_no") == rec.RULE_READABLE).select("container")
    decisions = (
        undecided(classified.filter(F.col("disposition") == "kept"), "reason")
        .unionByName(
            undecided(misnamed.withColumnRenamed("old_size", "file_size"), "format_reason")
        )
        .unionByName(decided.select(*DECISION_COLUMNS))
    )
    decisions = written(of_containers(decisions, stopped, "left_anti"), f"{run}/decisions")
    remove_folder(f"{run}/slices")
    results = out.with_package_sizes(
        containers,
        out.outcomes(decisions),
        judged.select("container", "version", "failure").join(
            published.select("container", F.col("length").alias("size_after")), "container"
        ),
    )
    facts = rec.media_counts(parts).join(counts.drop("problem", "main_part"), "container", "left")
    results = written(results.join(facts, "container", "left"), f"{run}/outcomes")
    published_parts = readable(written(explode_parts(published, tasks), f"{run}/published_parts"))
    return PassResult(results, out.detail_lines(decisions), violations, published_parts, share, run)
