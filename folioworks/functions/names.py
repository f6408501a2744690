"""Names of parts inside a package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .columns import ColumnOrName, col

# Leading dots belong to the name; the extension starts at the last dot after
# at least one other character.
_EXTENSION = r"(?s)^\.*[^.].*?(\.[^.]*)\z"


def base_name(name: ColumnOrName) -> Column:
    return F.substring_index(col(name), "/", -1)


def lower_path(name: ColumnOrName) -> Column:
    return F.lower(F.translate(col(name), "\\", "/"))


def is_media(name: ColumnOrName) -> Column:
    return lower_path(name).startswith(fv.MEDIA_PREFIX)


def _raw_ext(name: ColumnOrName) -> Column:
    return F.regexp_extract(base_name(name), _EXTENSION, 1)


def ext(name: ColumnOrName) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(_raw_ext(name))


def stem(name: ColumnOrName) -> Column:
    """The name without its extension."""
    return F.left(col(name), F.length(col(name)) - F.length(_raw_ext(name)))


def is_container(name: ColumnOrName, suffix: str) -> Column:
    """Has the package suffix in any case and is not an editor's lock file."""
    return F.lower(col(name)).endswith(suffix.lower()) & ~col(name).startswith("~$")
