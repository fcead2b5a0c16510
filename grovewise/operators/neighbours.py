"""Distances between points: pairs, nearest neighbours, neighbouring trees. All by cells, never by comparing everything with everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.functions.labels import is_tree
from grovewise.plans.grid import cell_names, with_cells, with_cells_around
from grovewise.session import materialize

AXES = ("x", "y", "z")
#: Searches in cells before the boxes are asked, and how much wider each is than the one before.
WIDENINGS, WIDER = 3, 4.0


def _apart(a: str, b: str, axes: Sequence[str] = AXES) -> Column:
    total = None
    for c in axes:
        d = F.col(f"{a}{c}").cast("double") - F.col(f"{b}{c}").cast("double")
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def _renamed(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in keep])


def pairs_within(points: DataFrame, eps: float, keys: Sequence[str] = (), ident: str = "point_id", axes: Sequence[str] = AXES) -> DataFrame:
    """(keys, a_id, b_id, distance): pairs of different points at most ``eps`` apart with equal keys, each once, a_id < b_id.

    Both sides meet in cells of edge ``eps``. Points with null coordinates have no pairs; eps 0 pairs points of one position. This lists every pair; where groups of many points share a place,
    take components instead (``components_of``), which pairs one point for each cell of a finer grid.
    """
    size = eps if eps > 0 else 1.0
    keep = [*keys, ident, *axes]
    given = points.filter(_all_given(axes)).select(*keep)
    left = with_cells(_renamed(given, "a_", keep), [f"a_{c}" for c in axes], size)
    right = with_cells_around(_renamed(given, "b_", keep), [f"b_{c}" for c in axes], size)
    on = [left[c] == right[c] for c in cell_names(len(axes))] + [left[f"a_{k}"].eqNullSafe(right[f"b_{k}"]) for k in keys] + [F.col(f"a_{ident}") < F.col(f"b_{ident}")]
    out = left.join(right, on).withColumn("distance", _apart("a_", "b_", axes)).filter(F.col("distance") <= eps)
    return out.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{ident}").alias("a_id"), F.col(f"b_{ident}").alias("b_id"), "distance")


def _all_given(axes: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in axes:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return out


def nearest(queries: DataFrame, others: DataFrame, start: float, query_id: str, other_id: str, keys: Sequence[str] = (), axes: Sequence[str] = AXES, most: float | None = None, exclude_same: bool = False) -> DataFrame:
    """(query_id, other_id, distance): the nearest other point with equal keys; ties go to the smallest other_id.

    Others within ``start`` are searched for in cells of that edge, what has none there in wider cells, for a few rounds. What is left, points far from everything, goes down a pyramid of boxes around the others
    (``_nearest_by_boxes``), so no step compares it with all others. With ``most`` one search with cells of that edge decides, and a hit is strictly nearer than it. ``exclude_same`` leaves out the other with
    the query's own id; it takes both sides for points of one table. Queries without any other of their keys have no row; null, NaN and infinite coordinates are left out. Ids must be unique within keys.
    """
    ok = _all_given(axes)
    left = _renamed(queries.filter(ok), "q_", [*keys, query_id, *axes])
    right = _renamed(others.filter(ok), "o_", [*keys, other_id, *axes])

    def within(left: DataFrame, edge: float) -> DataFrame:
        a, b = with_cells(left, [f"q_{c}" for c in axes], edge), with_cells_around(right, [f"o_{c}" for c in axes], edge)
        on = [a[c] == b[c] for c in cell_names(len(axes))] + [a[f"q_{k}"].eqNullSafe(b[f"o_{k}"]) for k in keys]
        if exclude_same:
            on.append(F.col(f"q_{query_id}") != F.col(f"o_{other_id}"))
        hit = a.join(b, on).withColumn("distance", _apart("q_", "o_", axes))
        return _best_of(hit.filter(F.col("distance") < most if most is not None else F.col("distance") <= edge), query_id, other_id)

    if most is not None:
        return within(left, most)
    found = None
    for widening in range(WIDENINGS):
        best = materialize(within(left, start * WIDER**widening), "nearest")
        found = best if found is None else found.unionByName(best)
        left = materialize(left.join(best.select(F.col(query_id).alias(f"q_{query_id}")), f"q_{query_id}", "left_anti"), "far")
        if left.isEmpty():
            return found
    return found.unionByName(_nearest_by_boxes(left, right, start * WIDER, query_id, other_id, keys, axes, exclude_same))


def _best_of(hit: DataFrame, query_id: str, other_id: str) -> DataFrame:
    best = hit.groupBy(F.col(f"q_{query_id}").alias(query_id)).agg(F.min(F.struct("distance", F.col(f"o_{other_id}").alias("o"))).alias("b"))
    return best.select(query_id, F.col("b.o").alias(other_id), F.col("b.distance").alias("distance"))


#: Edges of a level's cells, in edges of the level below.
_FANOUT = 2.0


def _nearest_by_boxes(left: DataFrame, right: DataFrame, start: float, query_id: str, other_id: str, keys: Sequence[str], axes: Sequence[str], exclude_same: bool) -> DataFrame:
    """``nearest`` without a bound on the distance.

    The others are summed up as boxes of occupied cells, level upon level, until a few cells span them. Each query starts with the cells of the top level and goes down: of the cells it has, only those stay whose box
    is no farther than the farthest corner of some box that surely holds another point. So it meets a bounded number of boxes on each level, and at last the points of a few cells.
    """
    ends = right.agg(*[f(F.col(f"o_{c}").cast("double")) for f in (F.min, F.max) for c in axes]).first()
    n = len(axes)
    if ends[0] is None:
        return right.select(F.col(f"o_{other_id}").alias(query_id), F.col(f"o_{other_id}").alias(other_id), F.lit(0.0).alias("distance")).limit(0).join(left.select(F.col(f"q_{query_id}").alias("_q")), F.lit(False)).select(F.col("_q").alias(query_id), other_id, "distance")
    wide = max(ends[n + k] - ends[k] for k in range(n))
    levels = 1
    while start * _FANOUT**levels < wide:
        levels += 1
    cell = lambda c, level: F.floor(F.col(c).cast("double") / (start * _FANOUT**level))
    okeys = [f"o_{k}" for k in keys]
    spot = lambda level: [f"_{level}_{c}" for c in axes]
    lows, highs = [f"_l{c}" for c in axes], [f"_h{c}" for c in axes]
    placed = right.select("*", *[cell(f"o_{c}", 0).alias(name) for c, name in zip(axes, spot(0))])
    boxes = {0: materialize(placed.groupBy(*okeys, *spot(0)).agg(*[F.min(F.col(f"o_{c}").cast("double")).alias(m) for c, m in zip(axes, lows)], *[F.max(F.col(f"o_{c}").cast("double")).alias(m) for c, m in zip(axes, highs)], F.count("*").alias("_n")), "boxes")}
    for level in range(1, levels + 1):
        up = boxes[level - 1].select("*", *[cell(m, level).alias(name) for m, name in zip(lows, spot(level))])
        boxes[level] = up.groupBy(*okeys, *spot(level)).agg(*[F.min(m).alias(m) for m in lows], *[F.max(m).alias(m) for m in highs], F.sum("_n").alias("_n"))
    top = boxes[levels].select(*okeys, *spot(levels), *lows, *highs, "_n")
    # The top level has at most two cells along each axis for each set of keys, so without keys they are a handful of literals.
    if keys:
        asked = left.join(top, [left[f"q_{k}"].eqNullSafe(top[f"o_{k}"]) for k in keys])
    else:
        few = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in top.collect()])
        asked = left.select("*", F.explode(few).alias("_top")).select(*left.columns, "_top.*")
    for level in range(levels, -1, -1):
        squares = lambda far: F.sqrt(sum((far(F.col(f"q_{c}").cast("double"), F.col(lo), F.col(hi)) ** 2 for c, lo, hi in zip(axes, lows, highs)), F.lit(0.0)))
        least = squares(lambda q, lo, hi: F.greatest(lo - q, q - hi, F.lit(0.0)))
        most = squares(lambda q, lo, hi: F.greatest(F.abs(q - lo), F.abs(q - hi)))
        at_home = F.lit(True)
        for c, name in zip(axes, spot(level)):
            at_home = at_home & (cell(f"q_{c}", level) == F.col(name))
        others = F.col("_n") - F.when(at_home, 1).otherwise(0) if exclude_same else F.col("_n")
        bound = F.min(F.when(others > 0, most)).over(Window.partitionBy(f"q_{query_id}"))
        kept = asked.select("*", least.alias("_least"), bound.alias("_bound")).filter(F.col("_least") <= F.coalesce("_bound", F.lit(float("inf"))) * (1 + 1e-12))
        kept = kept.select(*[c for c in left.columns], *okeys, *spot(level))
        if level == 0:
            below = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(okeys)], *[F.col(s).alias(f"_p{s}") for s in spot(0)], *[c for c in right.columns if c not in okeys])
        else:
            lower = boxes[level - 1]
            below = lower.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(okeys)], *[cell(m, level).alias(f"_p{s}") for m, s in zip(lows, spot(level))], *spot(level - 1), *lows, *highs, "_n")
        on = [F.col(s) == F.col(f"_p{s}") for s in spot(level)] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(okeys)]
        asked = kept.join(below, on).drop(*[f"_p{s}" for s in spot(level)], *[f"_k{i}" for i in range(len(okeys))], *spot(level))
    hit = asked.withColumn("distance", _apart("q_", "o_", axes))
    if exclude_same:
        hit = hit.filter(F.col(f"q_{query_id}") != F.col(f"o_{other_id}"))
    return _best_of(hit, query_id, other_id)


def neighbour_trees(points: DataFrame, tree: int, reach: float, box: Sequence[float] | None = None) -> DataFrame:
    """(tree_id, distance): other trees with a point less than ``reach`` from a point of ``tree``, by the exact least distance.

    The tree's box, widened by reach, is a literal filter, so that files and row groups without points there aren't read.
    """
    mine = points.filter((F.col("tree_id") == tree) & _all_given(AXES))
    if box is None:
        ends = mine.agg(*[f(a).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in AXES]).first()
        if ends["lx"] is None:
            return points.select("tree_id", F.lit(0.0).alias("distance")).limit(0)
        box = [float(ends[f"l{a}"]) for a in AXES] + [float(ends[f"h{a}"]) for a in AXES]
    near = F.lit(True)
    for k, a in enumerate(AXES):
        near = near & F.col(a).between(box[k] - reach, box[k + 3] + reach)
    others = points.filter(near & is_tree(F.col("tree_id")) & (F.col("tree_id") != tree))
    a = with_cells(_renamed(others, "o_", ["tree_id", *AXES]), [f"o_{c}" for c in AXES], reach)
    b = with_cells_around(_renamed(mine, "m_", AXES), [f"m_{c}" for c in AXES], reach)
    out = a.join(b, cell_names(3)).withColumn("distance", _apart("o_", "m_")).filter(F.col("distance") < reach)
    return out.groupBy(F.col("o_tree_id").alias("tree_id")).agg(F.min("distance").alias("distance"))


def all_neighbour_trees(points: DataFrame, reach: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tree_id, other_id, distance) for all trees at once: pairs of trees with points less than ``reach`` apart, both ways."""
    given = points.filter(is_tree(F.col("tree_id")) & _all_given(AXES)).select(*keys, "tree_id", *AXES)
    # Points of one tree and one fine cell are first reduced to distinct positions: repeats can't come nearer.
    given = given.distinct()
    names = [*keys, "tree_id", *AXES]
    a = with_cells(_renamed(given, "a_", names), [f"a_{c}" for c in AXES], reach)
    b = with_cells_around(_renamed(given, "b_", names), [f"b_{c}" for c in AXES], reach)
    on = [a[c] == b[c] for c in cell_names(3)] + [a[f"a_{k}"].eqNullSafe(b[f"b_{k}"]) for k in keys] + [F.col("a_tree_id") < F.col("b_tree_id")]
    half = a.join(b, on).withColumn("distance", _apart("a_", "b_")).filter(F.col("distance") < reach)
    half = half.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a_tree_id").alias("tree_id"), F.col("b_tree_id").alias("other_id")).agg(F.min("distance").alias("distance"))
    turned = half.select(*keys, F.col("other_id").alias("tree_id"), F.col("tree_id").alias("other_id"), "distance")
    return half.unionByName(turned)


def boxes_overlapping(records: DataFrame, reach: float, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tree_id, other_id): trees whose boxes, widened by ``reach``, overlap. Boxes meet in plan cells of edge ``cell``; a pair is kept in the cell of its reference corner only."""
    box = [f"{n}_{a}" for n in ("lo", "hi") for a in AXES]
    names = [*keys, "tree_id", *box]
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))

    def spread(df: DataFrame, p: str, wide: float) -> DataFrame:
        out = df.withColumn("_cx", span(F.col(f"{p}lo_x").cast("double") - wide, F.col(f"{p}hi_x").cast("double") + wide))
        return out.withColumn("_cy", span(F.col(f"{p}lo_y").cast("double") - wide, F.col(f"{p}hi_y").cast("double") + wide))

    given = records.filter(F.col("lo_x").isNotNull() & F.col("lo_y").isNotNull() & F.col("lo_z").isNotNull())
    a, b = spread(_renamed(given, "a_", names), "a_", reach), spread(_renamed(given, "b_", names), "b_", 0.0)
    on = [a["_cx"] == b["_cx"], a["_cy"] == b["_cy"], F.col("a_tree_id") != F.col("b_tree_id")] + [a[f"a_{k}"].eqNullSafe(b[f"b_{k}"]) for k in keys]
    for c in AXES:
        on += [F.col(f"b_lo_{c}") <= F.col(f"a_hi_{c}").cast("double") + reach, F.col(f"b_hi_{c}") >= F.col(f"a_lo_{c}").cast("double") - reach]
    corner = lambda c: F.floor(F.greatest(F.col(f"a_lo_{c}").cast("double") - reach, F.col(f"b_lo_{c}").cast("double")) / cell)
    out = a.join(b, on).filter((corner("x") == a["_cx"]) & (corner("y") == a["_cy"]))
    return out.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a_tree_id").alias("tree_id"), F.col("b_tree_id").alias("other_id"))


def picked(points: DataFrame, x: Column, y: Column, depth: Column, valid: Column, click: tuple[float, float], radius: float = 9.0) -> DataFrame:
    """One row or none: the point under a click (canvas units): the frontmost within the radius, else the nearest within three times that; ties to the smallest id."""
    d2 = (x - click[0]) * (x - click[0]) + (y - click[1]) * (y - click[1])
    seen = points.filter(valid).select("point_id", d2.alias("_d"), depth.alias("_z")).filter(F.col("_d") <= 9 * radius * radius)
    close = F.col("_d") <= radius * radius
    best = seen.agg(F.min(F.when(close, F.struct("_z", "point_id"))).alias("a"), F.min(F.struct("_d", "point_id")).alias("b"))
    return best.select(F.coalesce("a.point_id", "b.point_id").alias("point_id")).filter("point_id is not null")
