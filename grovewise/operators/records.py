"""Doubled and superseded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``order``, nulls least; ties fall to the greatest row as a whole.

    A partial maximum runs before the shuffle, so many repeats of one key cost one row per task. Map columns take no part in ties.
    """
    comparable = [c for c, kind in df.dtypes if not kind.startswith("map")]
    rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("value")) for c in order], *[F.col(c) for c in comparable if c not in order])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")
