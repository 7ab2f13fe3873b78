"""Best representative of each duplicate group (problem 1).

``survive`` makes one row per group by a single aggregation: for every attribute the maximum of a
composite struct (value there, source priority, time, tie-break, value). It combines before the shuffle,
so a group may hold any share of the rows.

Defined results: an attribute without any usable value gives an empty string; null times count as the
oldest, ties go to the smallest id; rows with a null group are ignored; a group of one row survives as it
is; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survive(rows: DataFrame, attributes: dict[str, Column], group: str = "group_id", key: str = "id", time: str = "date_modified", priority: Column | None = None) -> DataFrame:
    """attributes: name and cleaned value (null where unusable); priority: larger is more trusted."""
    rank = F.lit(0) if priority is None else priority
    cols = [
        F.max(F.struct(v.isNotNull(), rank, F.coalesce(F.col(time).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), -F.col(key), v.alias("value"))).alias(name)
        for name, v in attributes.items()
    ]
    best = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*cols)
    return best.select(F.col(group).alias(key), *[F.coalesce(F.col(name)["value"], F.lit("")).alias(name) for name in attributes])
