"""A query and the SQL it is held against, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The points, each record once (arrivals apart), as SQL and as a table.
P = "(SELECT DISTINCT point_id, cloud_id, x, y, z, tree_id, cls, intensity FROM points)"
#: Of these the ones with all coordinates.
G = "(SELECT DISTINCT point_id, cloud_id, x, y, z, tree_id, cls, intensity FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"


class Queries:
    """Collects queries by name; SQL is optional."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            if name in self.QUERIES:
                raise ValueError(f"{name} is there already")
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "points").drop("scan_day", "load_day").dropDuplicates(["point_id"])


def given_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "points").drop("scan_day", "load_day").filter("x is not null and y is not null and z is not null").dropDuplicates(["point_id"])


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles and floats rounded, so that the order of sums doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), places).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])
