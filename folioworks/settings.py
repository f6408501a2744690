"""Job parameters, passed by value; every limit has its documented default."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    max_dimension: int = fv.MAX_DIMENSION
    jpeg_quality: int = fv.JPEG_QUALITY
    min_part_bytes: int = fv.MIN_PART_BYTES
    alert_bytes: int = fv.ALERT_BYTES
    min_colors: int = fv.MIN_COLORS
    min_saving: float = fv.MIN_SAVING
    suffix: str = ".docx"
    # How many members of one package a task handles before the next task
    # takes over; splits a package that holds most of the collection's parts.
    members_per_task: int = 64


DEFAULTS = Settings()
