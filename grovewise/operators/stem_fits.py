"""Ground level, diameter at breast height and position of each tree from its points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.plans.ranking import percentile_by_sort

# Fixed values (metres; shares of the radius): height and half thickness of the slab, and what counts as a stem.
BREAST_HEIGHT, HALF_SLAB = 1.3, 0.15
LEAST_POINTS, THINNEST, THICKEST, WORST_FIT, GOOD_FIT = 8, 0.02, 3.0, 0.45, 0.2


def ground_levels(points: DataFrame, keys: Sequence[str] = ("tree_id",)) -> DataFrame:
    """(keys, base_z): the first percentile of height, interpolated between neighbours, by one sort over all tasks, so that a label of any size may be among them."""
    return percentile_by_sort(points, list(keys), "z", 0.01, "base_z")


def stem_diameters(points: DataFrame, keys: Sequence[str] = ("tree_id",), base: DataFrame | None = None) -> DataFrame:
    """(keys, dbh, dbh_quality, x, y, n): the least-squares circle through the slab at breast height, in closed form from two passes of sums.

    dbh is null for fewer than eight points, in the tree or the slab, a diameter outside 0.02 to 3, a scatter above 0.45 of the radius, or points on a line. x and y are the mean of the slab where there is a
    diameter, else of all points. Trees without any height have no row.
    """
    keys = list(keys)
    given = points.filter("x is not null and y is not null and z is not null").select(*keys, *[F.col(a).cast("double").alias(a) for a in ("x", "y", "z")])
    base = base if base is not None else ground_levels(given, keys)
    level = given.join(base, keys)
    in_slab = F.abs(F.col("z") - F.col("base_z") - BREAST_HEIGHT) <= HALF_SLAB
    means = level.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("_ax"), F.avg("y").alias("_ay"), F.count(F.when(in_slab, 1)).alias("_m"), F.avg(F.when(in_slab, F.col("x"))).alias("_mx"), F.avg(F.when(in_slab, F.col("y"))).alias("_my"))
    slab = level.filter(in_slab).join(means, keys)
    u, v = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    w = u * u + v * v
    sums = slab.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in (("_uu", u * u), ("_uv", u * v), ("_vv", v * v), ("_uw", u * w), ("_vw", v * w))], F.avg(w).alias("_c"))
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    solid = F.abs(det) > 1e-12 * (F.col("_uu") + F.col("_vv")) * (F.col("_uu") + F.col("_vv"))
    a = F.when(solid, F.try_divide(F.col("_uw") * F.col("_vv") - F.col("_vw") * F.col("_uv"), det) / 2)
    b = F.when(solid, F.try_divide(F.col("_vw") * F.col("_uu") - F.col("_uw") * F.col("_uv"), det) / 2)
    circle = sums.withColumn("_a", a).withColumn("_b", b).withColumn("_r", F.sqrt(F.col("_c") + F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))).select(*keys, "_a", "_b", "_r")
    off = F.sqrt((u - F.col("_a")) * (u - F.col("_a")) + (v - F.col("_b")) * (v - F.col("_b"))) - F.col("_r")
    scatter = slab.join(circle, keys).groupBy(*keys).agg((F.try_divide(F.sqrt(F.avg(off * off)), F.max("_r"))).alias("_q"), F.max("_r").alias("_r"))
    out = means.join(scatter, keys, "left")
    fits = (F.col("n") >= LEAST_POINTS) & (F.col("_m") >= LEAST_POINTS) & (2 * F.col("_r")).between(THINNEST, THICKEST) & (F.col("_q") <= WORST_FIT)
    out = out.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    pick = lambda good, other: F.when(F.col("_fits"), good).otherwise(other)
    return out.select(*keys, pick(2 * F.col("_r"), None).alias("dbh"), pick(F.col("_q"), None).alias("dbh_quality"), pick(F.col("_mx"), F.col("_ax")).alias("x"), pick(F.col("_my"), F.col("_ay")).alias("y"), "n")


def tree_statistics(points: DataFrame, keys: Sequence[str] = ("tree_id",)) -> DataFrame:
    """(keys, x, y, height, dbh, dbh_quality) of each tree from its points; the height is from the ground level to the top."""
    keys = list(keys)
    base = ground_levels(points, keys)
    tops = points.filter("z is not null").groupBy(*keys).agg(F.max(F.col("z").cast("double")).alias("_top"))
    fits = stem_diameters(points, keys, base)
    return fits.join(tops.join(base, keys), keys).select(*keys, "x", "y", (F.col("_top") - F.col("base_z")).alias("height"), "dbh", "dbh_quality")
