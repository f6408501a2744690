"""The text report of a pass, as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import fmt_mb, fmt_percent
from ..settings import DEFAULTS, Settings
from .first_pass import PassResult

LINE_ORDER = ("block", "container", "section", "ordinal")
_HEADER, _CONTAINERS, _SUMMARY, _OVER, _CLOSING = range(5)
#: Section of the lines about parts.
PART_LINES = 50


def _lines(df: DataFrame, block: int, lines: Sequence[Column], container: Column) -> DataFrame:
    """One row per non-null line, in the given order."""
    numbered = F.array(
        *[F.struct(F.lit(i).alias("section"), line.alias("line")) for i, line in enumerate(lines)]
    )
    return (
        df.select(F.lit(block).alias("block"), container.alias("container"), F.inline(numbered))
        .filter(F.col("line").isNotNull())
        .withColumn("ordinal", F.lit(0).cast("long"))
        .select(*LINE_ORDER, "line")
    )


def render_report(
    result: PassResult,
    source: str,
    target: str,
    settings: Settings = DEFAULTS,
    second: bool = False,
    started: datetime | None = None,
) -> DataFrame:
    """Lines with their sort keys: header, one block per package, summary.

    Nothing is gathered: a package's detail lines stay rows of their own.
    """
    kilobytes = settings.min_part_bytes // 1024
    if second:
        title = fv.REPORT_TITLE_2
        parameters = fv.REPORT_PARAMETERS_2 % (
            settings.jpeg_quality, kilobytes, settings.min_colors, settings.min_saving * 100,
        )
    else:
        title = fv.REPORT_TITLE
        parameters = fv.REPORT_PARAMETERS % (
            settings.max_dimension, settings.jpeg_quality, kilobytes,
        )
    if started is not None:
        title = f"{title} — {started:%d/%m/%Y %H:%M:%S}"
    head = [title, f"Entrada: {source}", f"Saída:   {target}", parameters, fv.RULE_LINE]

    summary = result.summary()
    over = result.over_limit(settings.alert_bytes)
    no_container = F.lit("")
    details = result.details.select(
        F.lit(_CONTAINERS).alias("block"),
        "container",
        F.lit(PART_LINES).alias("section"),
        "ordinal",
        "line",
    )
    return (
        _lines(summary, _HEADER, [F.lit(text) for text in head], no_container)
        .unionByName(
            _lines(result.outcomes, _CONTAINERS, _container_lines(second), F.col("container"))
        )
        .unionByName(details)
        .unionByName(_lines(summary, _SUMMARY, _summary_lines(second), no_container))
        .unionByName(_over_lines(over, second))
    )


def _container_lines(second: bool) -> list[Column]:
    published = F.col("version") == "new"
    counts = F.format_string(fv.VALID_COUNTS, "paragraphs", "tables", "inline_images")
    media = F.col("media_count")
    if second:
        unchanged = F.when(F.col("version") == "unchanged", F.lit(fv.LINE_UNCHANGED))
        proofs = [
            F.format_string(fv.VALID_PARTS_2, F.col("members") - F.col("processed")),
            F.format_string(fv.VALID_IMAGES_2, media, media, "processed"),
            F.lit(fv.VALID_RELS_2),
            F.lit(fv.VALID_TYPES_2),
            counts,
        ]
        before, action, images = fv.LINE_BEFORE_2, fv.LINE_ACTION_2, fv.LINE_IMAGES_2
    else:
        unchanged = F.lit(None).cast("string")
        proofs = [F.format_string(fv.VALID_IMAGES, media, media), counts]
        before, action, images = fv.LINE_BEFORE, fv.LINE_ACTION, fv.LINE_IMAGES
    failed = F.col("failure").isNotNull()
    return [
        F.lit(""),
        F.format_string(fv.LINE_FILE, "container"),
        F.format_string(before, fmt_mb("size_before")),
        unchanged,
        *[F.when(published, F.format_string(fv.LINE_VALID, proof)) for proof in proofs],
        F.when(failed, F.format_string(fv.LINE_FAILURE, "failure")),
        F.when(failed, F.lit(action)),
        F.format_string(fv.LINE_AFTER, fmt_mb("size_after")),
        F.format_string(fv.LINE_REDUCTION, fmt_percent("reduction_pct")),
        F.format_string(images, "processed", "skipped"),
    ]


def _summary_lines(second: bool) -> list[Column]:
    return [
        F.lit(""),
        F.lit(fv.RULE_LINE),
        F.lit(fv.SUMMARY_TITLE_2 if second else fv.SUMMARY_TITLE),
        F.format_string(fv.SUMMARY_FILES_2 if second else fv.SUMMARY_FILES, "files", "failures"),
        F.format_string(fv.SUMMARY_BEFORE, "before_text"),
        F.format_string(fv.SUMMARY_AFTER, "after_text"),
        F.format_string(fv.SUMMARY_REDUCTION, fmt_percent("reduction_pct")),
        F.lit(""),
    ]


def _over_lines(over: DataFrame, second: bool) -> DataFrame:
    counted = over.agg(F.count("*").alias("n"))
    some = F.col("n") > 0
    title = F.when(
        some, F.format_string(fv.OVER_TITLE_2 if second else fv.OVER_TITLE, "n")
    ).otherwise(F.lit(fv.OVER_NONE))
    if second:
        entry = F.format_string(fv.OVER_LINE_2, "container", fmt_mb("size_after"))
        hints: list[Column] = []
    else:
        entry = F.format_string(
            fv.OVER_LINE, "container", fmt_mb("size_after"), "parts", fmt_mb("weight"),
            fmt_percent("weight_pct", 0),
        )
        hints = [F.when(some, F.lit(text)) for text in fv.OVER_HINT]
    lines = _lines(counted, _OVER, [title], F.lit("")).unionByName(
        _lines(over, _OVER, [entry], F.col("container"))
    )
    return lines.unionByName(_lines(counted, _CLOSING, hints, F.lit(""))) if hints else lines


def write_report(lines: DataFrame, folder: str) -> None:
    """UTF-8 text files that read in name order give the report.

    The sort is by ranges over (block, package, section, part), so no task gets
    the whole report, nor all the details of one package.
    """
    lines.orderBy(*LINE_ORDER).select("line").write.mode("overwrite").text(folder)
