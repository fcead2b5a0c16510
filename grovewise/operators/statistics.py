"""Counts, records and bounds of labelled points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.functions.labels import is_tree, next_free_id
from grovewise.plans.bounded import broadcast_bounded

AXES = ("x", "y", "z")


def label_counts(points: DataFrame, label: str = "tree_id") -> DataFrame:
    return points.groupBy(label).agg(F.count("*").alias("n"))


def tree_records(points: DataFrame, keys: Sequence[str] = ("tree_id",), label: str = "tree_id") -> DataFrame:
    """Count, box and the box's middle (not the mean) for each tree; 0 and -1 are no trees, null coordinates don't count for the box."""
    ends = [f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]
    out = points.filter(is_tree(F.col(label))).groupBy(*keys).agg(F.count("*").alias("count"), *ends)
    middle = lambda a: (F.col(f"lo_{a}").cast("double") + F.col(f"hi_{a}")) / 2
    return out.withColumn("centre_x", middle("x")).withColumn("centre_y", middle("y"))


def updated_records(records: DataFrame, points: DataFrame, touched: DataFrame, key: str = "tree_id") -> DataFrame:
    """Records after an edit: those of touched labels computed anew, all others kept. Only the touched trees' points are read."""
    touched = broadcast_bounded(touched.select(key).distinct())
    anew = tree_records(points.join(touched, key, "left_semi"), [key], key)
    return records.join(touched, key, "left_anti").unionByName(anew)


def bounds(points: DataFrame) -> DataFrame:
    """One row: lowest and highest coordinate of each axis in double precision."""
    return points.agg(*[f(F.col(a).cast("double")).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES])


def needs_shift(limits: DataFrame, far: float = 10_000.0) -> DataFrame:
    """Whether any coordinate lies farther than ``far`` from the origin, and the whole-number shift that brings the lowest corner to it."""
    most = F.greatest(*[F.abs(c) for c in limits.columns])
    return limits.select(F.coalesce(most > far, F.lit(False)).alias("needed"), *[(-F.floor(f"lo_{a}")).alias(f"shift_{a}") for a in AXES])


def shifted(c: Column, by: Column) -> Column:
    """A coordinate after a shift, as stored."""
    return (c.cast("double") + by).cast("float")


def free_id(points: DataFrame, label: str = "tree_id") -> DataFrame:
    """One row: the id for a new tree."""
    return points.agg(next_free_id(F.max(label)).alias("next_id"))


def height_by_box(records: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Tree statistics from boxes: the middle, and the box's height unless ``heights`` (tree_id, height) says otherwise."""
    out = records.select("tree_id", F.col("centre_x").alias("x"), F.col("centre_y").alias("y"), (F.col("hi_z").cast("double") - F.col("lo_z")).alias("_h"))
    if heights is None:
        return out.withColumnRenamed("_h", "height")
    return out.join(heights.select("tree_id", F.col("height").alias("_o")), "tree_id", "left").withColumn("height", F.coalesce("_o", "_h")).drop("_o", "_h")


def done_progress(trees: DataFrame, done: DataFrame) -> DataFrame:
    """How many trees are done, of how many, and the percentage rounded half to even."""
    marked = trees.select("tree_id").distinct().join(done.select("tree_id").distinct().withColumn("_d", F.lit(1)), "tree_id", "left")
    out = marked.agg(F.count("_d").alias("done"), F.count("*").alias("total"))
    return out.withColumn("percent", F.coalesce(F.bround(F.try_divide(100 * F.col("done"), F.col("total")), 0), F.lit(0.0)).cast("int"))


def selection_summary(points: DataFrame, selected: Column) -> DataFrame:
    return points.filter(selected).agg(F.count("*").alias("points"), F.count_distinct(F.when(is_tree(F.col("tree_id")), F.col("tree_id"))).alias("trees"))
