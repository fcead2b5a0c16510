"""Thinning by voxels, point spacing, and the decision whether to thin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.functions.geometry import voxel
from grovewise.operators.neighbours import nearest
from grovewise.plans.ranking import percentile_by_sort

AXES = ("x", "y", "z")
# A cloud is dense below this spacing, and the voxel offered then (metres).
DENSE, USUAL_VOXEL = 0.02, 0.03
#: Spacing that is taken where none can be measured.
NO_SPACING = 0.01


def _given() -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()


def with_voxel(points: DataFrame, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points with voxel numbers _i, _j, _k from their cloud's lowest corner (of equal keys) and the squared distance _off to the voxel's centre; null coordinates are left out."""
    if size <= 0:
        raise ValueError("the voxel size must be positive")
    low = points.filter(_given()).groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(*[F.min(a).alias(f"_l{a}") for a in AXES])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    # One row for each cloud: counted nowhere larger than the clouds themselves, so the optimiser may broadcast it by its size.
    out = points.filter(_given()).join(low if keys else F.broadcast(low), on)
    cells, off = voxel(*[F.col(a) for a in AXES], size, [F.col(f"_l{a}") for a in AXES])
    return out.select(*points.columns, *[c.alias(n) for n, c in zip(("_i", "_j", "_k"), cells)], off.alias("_off"))


def thinned(points: DataFrame, size: float, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """(keys, ident): for each voxel the point nearest to its centre, of equally near ones the smallest id. A partial minimum runs before the shuffle."""
    cells = with_voxel(points, size, keys)
    best = cells.groupBy(*keys, "_i", "_j", "_k").agg(F.min(F.struct("_off", ident)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{ident}").alias(ident))


def first_of_cubes(points: DataFrame, size: float, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """(keys, ident): the first point of each cube of a grid through the origin."""
    cube = [F.floor(F.col(a).cast("double") / size).alias(f"_{a}") for a in AXES]
    return points.filter(_given()).groupBy(*keys, *cube).agg(F.min(ident).alias(ident)).select(*keys, ident)


def nearest_distances(points: DataFrame, start: float, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """(ident, distance) to the nearest other point of equal keys; repeated positions are at distance 0. A point that is alone has no row."""
    other = points.select(*keys, F.col(ident).alias("_other"), *AXES).withColumnRenamed("_other", "other_id")
    return nearest(points.select(*keys, ident, *AXES), other, start, ident, "other_id", keys, exclude_same=True)


def spacing(points: DataFrame, start: float = 0.05, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """(keys, spacing): the median distance to the nearest other point, exactly; 0.01 where it is 0 or a cloud has fewer than two points."""
    near = nearest_distances(points, start, keys, ident).join(points.select(*keys, ident), ident) if keys else nearest_distances(points, start, keys, ident)
    got = percentile_by_sort(near, list(keys), "distance", 0.5, "_m")
    if not keys:
        return got.agg(F.max("_m").alias("_m")).select(F.when(F.coalesce("_m", F.lit(0.0)) == 0, NO_SPACING).otherwise(F.col("_m")).alias("spacing"))
    all_keys = points.select(*keys).distinct()
    return all_keys.join(got, list(keys), "left").select(*keys, F.when(F.coalesce("_m", F.lit(0.0)) == 0, NO_SPACING).otherwise(F.col("_m")).alias("spacing"))


def block_spacing(points: DataFrame, edge: float, start: float = 0.05, least: int = 50, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """One row: the median over blocks (cubes of ``edge``) of at least ``least`` points of each block's median spacing, measured within the block; 0 where there is no such block."""
    block = [F.floor(F.col(a).cast("double") / edge).alias(f"_b{a}") for a in AXES]
    names = [*keys, *[f"_b{a}" for a in AXES]]
    blocks = points.filter(_given()).select(*keys, ident, *AXES, *block)
    big = blocks.groupBy(*names).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    blocks = blocks.join(big, names, "left_semi")
    near = nearest_distances(blocks, start, names, ident).join(blocks.select(*names, ident), ident)
    each = near.groupBy(*names).agg(F.median("distance").alias("_m"))
    return each.agg(F.coalesce(F.median("_m"), F.lit(0.0)).alias("spacing"))


def kept_share(points: DataFrame, edge: float, size: float, least: int = 50, inner_least: int = 20, keys: Sequence[str] = (), ident: str = "point_id") -> DataFrame:
    """One row: the share of points that thinning keeps, the median over blocks of their inner shares; null where no block can tell.

    A block's inside leaves out a voxel's width along each axis on which the block is at least three voxels wide.
    """
    block = [F.floor(F.col(a).cast("double") / edge).alias(f"_b{a}") for a in AXES]
    names = [*keys, *[f"_b{a}" for a in AXES]]
    blocks = points.filter(_given()).select(*keys, ident, *AXES, *block)
    ends = blocks.groupBy(*names).agg(F.count("*").alias("_n"), *[f(F.col(a).cast("double")).alias(f"_{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in AXES]).filter(F.col("_n") >= least)
    kept = thinned(blocks, size, names, ident).withColumn("_kept", F.lit(1))
    inside = F.lit(True)
    for a in AXES:
        roomy = F.col(f"_h{a}") - F.col(f"_l{a}") >= 3 * size
        inside = inside & F.when(roomy, F.col(a).cast("double").between(F.col(f"_l{a}") + size, F.col(f"_h{a}") - size)).otherwise(True)
    inner = blocks.join(ends, names).filter(inside).join(kept.select(ident, "_kept"), ident, "left")
    each = inner.groupBy(*names).agg(F.count("*").alias("_t"), F.count("_kept").alias("_k")).filter(F.col("_t") >= inner_least)
    return each.agg(F.median(F.col("_k") / F.col("_t")).alias("kept"))


@dataclass(frozen=True)
class Thinning:
    """What to do with a cloud on opening: its spacing, the voxel to offer, and the voxel decided on (None: full resolution)."""

    spacing: float
    offered: float | None
    voxel: float | None


def offered_voxel(measured: float) -> float:
    return USUAL_VOXEL if measured < USUAL_VOXEL else measured


def decide_thinning(points: DataFrame, decided: dict | None = None, ask=None, far: bool = False, edge: float = 2.0) -> Thinning:
    """The decision flow on opening: a remembered decision (also for none) holds; coordinates far from the origin that weren't shifted skip the question; a cloud of
    spacing 0, or of 0.02 or more, isn't thinned; else ``ask(spacing, offered voxel, kept share)`` decides, and None means never ask."""
    decided = decided or {}
    if "voxel_size" in decided:
        return Thinning(decided.get("spacing", 0.0), None, decided["voxel_size"])
    if far:
        return Thinning(0.0, None, None)
    measured = decided["spacing"] if "spacing" in decided else block_spacing(points, edge).first()["spacing"]
    if not 0 < measured < DENSE:
        return Thinning(measured, None, None)
    offer = offered_voxel(measured)
    return Thinning(measured, offer, ask(measured, offer, kept_share(points, edge, offer).first()["kept"]) if ask else None)
