"""An equi-join that splits the keys holding too large a share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import width


def of_containers(rows: DataFrame, containers: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the given containers (or, with ``left_anti``, of the others).

    ``rows`` are parts or the like, numbered by ``ordinal`` within a container;
    one container may own a third of them.
    """
    return spread_join(
        rows, containers.select("container").distinct(), ["container"], how, ["ordinal"]
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    ways: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` where one key may hold a third of ``left``.

    A key with more than ``1/ways`` of all left rows is hot.  There are fewer
    than ``ways`` hot keys whatever the data, so their list can be broadcast.
    Rows of a hot key are spread by ``spread_by`` over as many groups as the
    key's share asks for, and the few matching right rows are repeated once per
    group: all groups together add at most ``2 * ways`` copies of a key's rows.
    Other keys join as they are.  Finding the hot keys reads ``left`` once more,
    so use it where ``left`` is stored, and where adaptive execution cannot
    split the key because a later grouping builds on the join's distribution.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    ways = ways or width(left.sparkSession)
    on = list(on)
    sizes = left.groupBy(*on).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    hot = sizes.filter(F.col("_n") * F.lit(ways) > total).select(
        *on, F.ceil(F.col("_n") * F.lit(ways) / total).cast("int").alias("_ways")
    )
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_ways", F.lit(1)))
    spread = left.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_ways")
    copies = F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)
    repeated = (
        right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_ways")
    )
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
