"""Recognising image formats by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .columns import ColumnOrName, col

# First bytes (hexadecimal) of image formats.
# In WEBP four bytes of length stand between the two marks.
MAGIC = (
    ("PNG", "89504E470D0A1A0A"),
    ("JPEG", "FFD8FF"),
    ("GIF", "47494638"),
    ("BMP", "424D"),
    ("TIFF", "49492A00"),
    ("TIFF", "4D4D002A"),
    ("WEBP", "52494646________57454250"),
)


def sniff_format(content: ColumnOrName) -> Column:
    """Format name of image bytes, null when unknown."""
    head = F.hex(F.substring(col(content), 1, 12))
    found = F.lit(None).cast("string")
    for name, magic in MAGIC:
        found = F.when(head.like(f"{magic}%"), F.lit(name)).otherwise(found)
    return found


def format_mismatch(content: ColumnOrName, extension: ColumnOrName) -> Column:
    """Why a part must not be recompressed, null when content and name agree."""
    real = sniff_format(content)
    e = col(extension)
    shown = F.coalesce(real, F.lit(fv.UNKNOWN_FORMAT))
    clash = ((real == "JPEG") & ~e.isin(*fv.JPEG_EXTENSIONS)) | (
        (real == "PNG") & ~e.isin(*fv.PNG_EXTENSIONS)
    )
    return (
        F.when(real.isNull() | ~real.isin("JPEG", "PNG"), F.format_string(fv.KEPT_FORMAT, shown))
        .when(clash, F.lit(fv.KEPT_MISMATCH))
    )


def not_png(content: ColumnOrName) -> Column:
    """Why a part must not be converted, null for PNG content."""
    real = sniff_format(content)
    shown = F.coalesce(real, F.lit(fv.UNKNOWN_FORMAT))
    return F.when(~real.eqNullSafe(F.lit("PNG")), F.format_string(fv.KEPT_NOT_PNG, shown))
