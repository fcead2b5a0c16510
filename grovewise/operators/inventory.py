"""A field inventory against the cloud's trees: alignment, ranking, one-to-one matching, the match table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.plans.grid import cell_names, with_cells, with_cells_around
from grovewise.plans.ranking import percentile_by_sort
from grovewise.session import discard, materialize


@dataclass(frozen=True)
class Tolerances:
    """Metres by which each measurement usually differs, and limits."""

    position: float = 2.0
    height: float = 3.0
    dbh: float = 0.04
    max_distance: float = 15.0
    max_score: float = 2.0
    dbh_quality: float = 0.2


def _nearest_trees(stems: DataFrame, trees: DataFrame, reach: float) -> DataFrame:
    """Stems (keys, candidate, sx, sy) with the nearest tree at most ``reach`` away: tx, ty, distance; ties to the tree of smaller id."""
    a = with_cells(stems, ["sx", "sy"], reach)
    b = with_cells_around(trees.select(F.col("cloud").alias("_cl"), F.col("tree_id").alias("_t"), F.col("x").alias("tx"), F.col("y").alias("ty")), ["tx", "ty"], reach)
    on = [a[c] == b[c] for c in cell_names(2)] + [a["cloud"].eqNullSafe(b["_cl"])]
    d = F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))
    hit = a.join(b, on).withColumn("distance", d).filter(F.col("distance") <= reach)
    return hit.groupBy("cloud", "candidate", "stem_id", "sx", "sy").agg(F.min(F.struct("distance", "_t", "tx", "ty")).alias("b")).select("cloud", "candidate", "stem_id", "sx", "sy", "b.distance", "b.tx", "b.ty")


def _closeness(close: DataFrame) -> DataFrame:
    """(_cl, _ca, m, r): for each cloud and candidate how many stems have a tree, and their median distance, by a sort over all tasks."""
    close = materialize(close.select(F.col("cloud").alias("_cl"), F.col("candidate").alias("_ca"), "distance"), "close")
    middle = percentile_by_sort(close, ["_cl", "_ca"], "distance", 0.5, "r").select(F.col("_cl").alias("_mc"), F.col("_ca").alias("_ma"), "r")
    many = close.groupBy("_cl", "_ca").agg(F.count("*").alias("m"))
    return many.join(middle, F.col("_cl").eqNullSafe(F.col("_mc")) & (F.col("_ca") == F.col("_ma"))).select("_cl", "_ca", "m", "r")


def fit_shifts(stems: DataFrame, trees: DataFrame, tolerance: float = 2.0, bin_size: float | None = None, tried: int = 5, reach: float | None = None) -> DataFrame:
    """(cloud, dx, dy, matched, residual): for each cloud the shift that brings most stems within ``tolerance`` of a tree.

    ``stems`` (cloud, stem_id, x, y) and ``trees`` (cloud, tree_id, x, y). All offsets of a cloud's pairs vote in a histogram of ``bin_size``; the ``tried`` fullest bins (then the
    larger bin numbers) start from their mean offset, are refined three times by the mean of what is left between stems and their nearest tree, and the one that matches most, then most tightly, wins. ``reach``
    limits the offsets that vote, which keeps the vote a cell join where plots are large; without it all pairs of a cloud vote, as small plots need when the frames differ altogether. A
    cloud without stems or trees has no row; where nothing matches, matched is 0 and the residual null.
    """
    size = bin_size or tolerance
    s = stems.filter("x is not null and y is not null").select("cloud", "stem_id", F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    t = trees.filter("x is not null and y is not null").select(F.col("cloud").alias("_cl"), "tree_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    if reach is None:
        pairs = s.join(t, s["cloud"].eqNullSafe(t["_cl"]))
    else:
        a, b = with_cells(s, ["_sx", "_sy"], reach), with_cells_around(t, ["_tx", "_ty"], reach)
        pairs = a.join(b, [a[c] == b[c] for c in cell_names(2)] + [a["cloud"].eqNullSafe(b["_cl"])])
    pairs = pairs.select("cloud", (F.col("_tx") - F.col("_sx")).alias("ox"), (F.col("_ty") - F.col("_sy")).alias("oy"))
    if reach is not None:
        pairs = pairs.filter((F.abs("ox") <= reach) & (F.abs("oy") <= reach))
    bins = pairs.groupBy("cloud", F.rint(F.col("ox") / size).alias("i"), F.rint(F.col("oy") / size).alias("j")).agg(F.count("*").alias("n"), F.avg("ox").alias("dx"), F.avg("oy").alias("dy"))
    rank = F.row_number().over(Window.partitionBy("cloud").orderBy(F.desc("n"), F.desc("i"), F.desc("j")))
    shifts = materialize(bins.withColumn("candidate", rank).filter(F.col("candidate") <= tried).select("cloud", "candidate", "dx", "dy"), "shifts")
    plain = trees.filter("x is not null and y is not null").select("cloud", "tree_id", "x", "y")

    def moved(shifts: DataFrame) -> DataFrame:
        own = shifts.select(F.col("cloud").alias("_cl"), "candidate", "dx", "dy")
        return s.join(own, s["cloud"].eqNullSafe(own["_cl"])).select("cloud", "candidate", "stem_id", (F.col("_sx") + F.col("dx")).alias("sx"), (F.col("_sy") + F.col("dy")).alias("sy"))

    for _ in range(3):
        close = _nearest_trees(moved(shifts), plain, tolerance)
        step = close.groupBy(F.col("cloud").alias("_cl"), F.col("candidate").alias("_ca")).agg(F.avg(F.col("tx") - F.col("sx")).alias("ex"), F.avg(F.col("ty") - F.col("sy")).alias("ey"))
        shifts = shifts.join(step, shifts["cloud"].eqNullSafe(step["_cl"]) & (F.col("candidate") == F.col("_ca")), "left")
        shifts = materialize(shifts.select("cloud", "candidate", (F.col("dx") + F.coalesce("ex", F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce("ey", F.lit(0.0))).alias("dy")), "shifts")
    quality = _closeness(_nearest_trees(moved(shifts), plain, tolerance))
    scored = shifts.join(quality, shifts["cloud"].eqNullSafe(quality["_cl"]) & (F.col("candidate") == F.col("_ca")), "left").withColumn("m", F.coalesce("m", F.lit(0)))
    best = F.min_by(F.struct("dx", "dy", "m", "r"), F.struct(-F.col("m"), F.coalesce("r", F.lit(float("inf"))), "candidate"))
    return scored.groupBy("cloud").agg(best.alias("b")).select("cloud", "b.dx", "b.dy", F.col("b.m").alias("matched"), F.col("b.r").alias("residual"))


def alignment_quality(stems: DataFrame, trees: DataFrame, shifts: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``shifts`` (cloud, dx, dy) with matched and residual counted anew."""
    own = shifts.select(F.col("cloud").alias("_cl"), "dx", "dy")
    moved = stems.filter("x is not null and y is not null").join(own, F.col("cloud").eqNullSafe(F.col("_cl"))).select("cloud", F.lit(1).alias("candidate"), "stem_id", (F.col("x") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("sy"))
    got = _closeness(_nearest_trees(moved, trees.filter("x is not null and y is not null"), tolerance))
    return shifts.select("cloud", "dx", "dy").join(got, F.col("cloud").eqNullSafe(F.col("_cl")), "left").select("cloud", "dx", "dy", F.coalesce("m", F.lit(0)).alias("matched"), F.col("r").alias("residual"))


def scored(pairs: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Pairs (x, y, height, dbh, dbh_quality of the tree; sx, sy, stem_height, stem_dbh) with distance, height_diff, dbh_diff, score and used: the root mean square of the differences in tolerances that both sides have."""
    d = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    h = F.col("height") - F.col("stem_height")
    good = F.coalesce(F.col("dbh_quality") <= t.dbh_quality, F.lit(True))
    b = F.when(good, F.col("dbh") - F.col("stem_dbh"))
    out = pairs.withColumn("distance", d).withColumn("height_diff", h).withColumn("dbh_diff", b)
    terms = F.array_compact(F.array((F.col("distance") / t.position) ** 2, (F.col("height_diff") / t.height) ** 2, (F.col("dbh_diff") / t.dbh) ** 2))
    score = F.sqrt(F.try_divide(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.size(terms)))
    used = F.array_compact(F.array(F.lit("position"), F.when(F.col("height_diff").isNotNull(), "height"), F.when(F.col("dbh_diff").isNotNull(), "dbh")))
    return out.withColumn("score", score).withColumn("used", used)


def candidate_pairs(trees: DataFrame, stems: DataFrame, t: Tolerances = Tolerances(), exclude: DataFrame | None = None) -> DataFrame:
    """Scored pairs at most ``max_distance`` apart in the same cloud. ``stems`` (cloud, stem_id, ordinal, x, y, height, dbh, species) lie in the trees' frame; ``exclude`` lists stem ids taken already."""
    s = stems.filter("x is not null and y is not null").select(F.col("cloud").alias("_cl"), "stem_id", "ordinal", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("height").alias("stem_height"), F.col("dbh").alias("stem_dbh"), "species")
    if exclude is not None:
        s = s.join(exclude.select("stem_id").distinct(), "stem_id", "left_anti")
    a, b = with_cells(trees.filter("x is not null and y is not null"), ["x", "y"], t.max_distance), with_cells_around(s, ["sx", "sy"], t.max_distance)
    pairs = a.join(b, [a[c] == b[c] for c in cell_names(2)] + [a["cloud"].eqNullSafe(b["_cl"])]).drop(*cell_names(2), "_cl")
    return scored(pairs, t).filter(F.col("distance") <= t.max_distance)


def best_candidates(pairs: DataFrame, most: int = 8) -> DataFrame:
    """The best ``most`` stems of each tree by score, then the stems' order, with their rank."""
    rank = F.row_number().over(Window.partitionBy("cloud", "tree_id").orderBy("score", "ordinal"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= most)


def greedy_matches(pairs: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """One-to-one matches of score at most ``max_score``, taken from the best on; ties by tree id, then the stems' order. Stems that share an id are taken together.

    By rounds of pairs that are best for both sides, which gives the same as going through the sorted pairs one by one.
    """
    left = materialize(pairs.filter(F.col("score") <= t.max_score).withColumn("_o", F.struct("score", "tree_id", "ordinal", "cloud")), "pairs")
    taken = None
    while not left.isEmpty():
        by_tree = left.groupBy("cloud", "tree_id").agg(F.min("_o").alias("_o"))
        by_stem = left.groupBy("cloud", "stem_id").agg(F.min("_o").alias("_o"))
        both = materialize(left.join(by_tree, ["cloud", "tree_id", "_o"], "left_semi").join(by_stem, ["cloud", "stem_id", "_o"], "left_semi"), "both")
        taken = both if taken is None else taken.unionByName(both)
        before, left = left, materialize(left.join(both.select("cloud", "tree_id"), ["cloud", "tree_id"], "left_anti").join(both.select("cloud", "stem_id"), ["cloud", "stem_id"], "left_anti"), "pairs")
        discard(before)
    return (left if taken is None else taken).drop("_o")


def linked_matches(links: DataFrame, trees: DataFrame, stems: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Scored pairs for links made by hand (cloud, tree_id, stem_id), whatever the distance; links to what doesn't exist or has no position are left out."""
    placed = "x is not null and y is not null"
    s = stems.filter(placed).select("cloud", "stem_id", "ordinal", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("height").alias("stem_height"), F.col("dbh").alias("stem_dbh"), "species")
    return scored(links.select("cloud", "tree_id", "stem_id").distinct().join(trees.filter(placed), ["cloud", "tree_id"]).join(s, ["cloud", "stem_id"]), t)


def all_matches(trees: DataFrame, stems: DataFrame, links: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Links made by hand, and greedy matches of all trees and stems that those leave over, with ``matched_by``."""
    by_hand = linked_matches(links, trees, stems, t)
    rest_t = trees.join(links.select("cloud", "tree_id"), ["cloud", "tree_id"], "left_anti")
    rest_s = stems.join(links.select("cloud", "stem_id"), ["cloud", "stem_id"], "left_anti")
    auto = greedy_matches(candidate_pairs(rest_t, rest_s, t), t)
    names = by_hand.columns
    return by_hand.withColumn("matched_by", F.lit("manual")).unionByName(auto.select(*names).withColumn("matched_by", F.lit("auto")))


#: Columns of the match table, in order.
MATCH_COLUMNS = ["tree_id", "stem_id", "species", "matched_by", "distance_m", "height_diff_m", "dbh_diff_m", "score", "tree_height_m", "tree_dbh_m", "stem_height_m", "stem_dbh_m", "stem_x", "stem_y"]


def match_table(matches: DataFrame) -> DataFrame:
    """Matches as texts with fixed decimals and blanks for null, in the columns of the match file."""
    text = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.when(F.col(c).isNotNull(), F.col(c).cast("double"))), F.lit(""))
    fixed = lambda c, n: F.when(F.col(c).isNull(), "").otherwise(text(c, n))
    return matches.select(
        "tree_id", "stem_id", F.coalesce("species", F.lit("")).alias("species"), "matched_by", fixed("distance", 3).alias("distance_m"), fixed("height_diff", 2).alias("height_diff_m"), fixed("dbh_diff", 3).alias("dbh_diff_m"),
        fixed("score", 3).alias("score"), fixed("height", 2).alias("tree_height_m"), fixed("dbh", 3).alias("tree_dbh_m"), fixed("stem_height", 2).alias("stem_height_m"), fixed("stem_dbh", 3).alias("stem_dbh_m"), fixed("sx", 3).alias("stem_x"), fixed("sy", 3).alias("stem_y"),
    )


def scorecard(matches: DataFrame, truth: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row: trees with a fitted diameter and its mean absolute error, matches, and how many of them are right. ``truth`` (tree_id, stem_id, dbh_m), ``fitted`` (tree_id, dbh)."""
    fits = fitted.filter("dbh is not null").join(truth.select("tree_id", "dbh_m"), "tree_id").agg(F.count("*").alias("fitted"), F.avg(F.abs(F.col("dbh") - F.col("dbh_m"))).alias("dbh_error"))
    right = matches.select("tree_id", "stem_id").join(truth.select("tree_id", F.col("stem_id").alias("_true")), "tree_id", "left").agg(F.count("*").alias("matched"), F.coalesce(F.sum((F.col("stem_id") == F.col("_true")).cast("int")), F.lit(0)).alias("correct"))
    return fits.crossJoin(F.broadcast(right))


def offsets(stems: DataFrame, trees: DataFrame, reach: float) -> DataFrame:
    """All columns of ``stems``, tree_id, and the offset (ox, oy) from stem to tree, of pairs of one cloud at most ``reach`` apart along each axis; without positions there are none."""
    placed = "x is not null and y is not null"
    a = with_cells(stems.filter(placed), ["x", "y"], reach)
    b = with_cells_around(trees.filter(placed).select(F.col("cloud").alias("_cl"), "tree_id", F.col("x").alias("_tx"), F.col("y").alias("_ty")), ["_tx", "_ty"], reach)
    pairs = a.join(b, [a[c] == b[c] for c in cell_names(2)] + [a["cloud"].eqNullSafe(b["_cl"])])
    pairs = pairs.select(*[a[c] for c in stems.columns], "tree_id", (F.col("_tx") - F.col("x")).alias("ox"), (F.col("_ty") - F.col("y")).alias("oy"))
    return pairs.filter((F.abs("ox") <= reach) & (F.abs("oy") <= reach))


def offset_histogram(stems: DataFrame, trees: DataFrame, size: float, reach: float) -> DataFrame:
    """(cloud, i, j, n, dx, dy): offsets of pairs at most ``reach`` apart along each axis, by bins rounded half to even."""
    pairs = offsets(stems.select("cloud", "x", "y"), trees, reach)
    return pairs.groupBy("cloud", F.rint(F.col("ox") / size).alias("i"), F.rint(F.col("oy") / size).alias("j")).agg(F.count("*").alias("n"), F.avg("ox").alias("dx"), F.avg("oy").alias("dy"))


def left_over(trees: DataFrame, stems: DataFrame, matches: DataFrame) -> DataFrame:
    """(kind, cloud, ident): the rest of the plot: trees without a match and stems that no tree is linked with. A null id is never matched."""
    rest = lambda df, c, kind: df.join(matches.select("cloud", c), ["cloud", c], "left_anti").select(F.lit(kind).alias("kind"), "cloud", F.col(c).cast("string").alias("ident"))
    return rest(trees, "tree_id", "tree").unionByName(rest(stems, "stem_id", "stem"))


def inferred_scale(dbh: Column, threshold: float = 5.0) -> Column:
    """An aggregate: 0.01 if the median of the given, non-zero diameters lies above the threshold, else 1."""
    return F.when(F.median(F.when(dbh != 0, dbh)) > threshold, 0.01).otherwise(1.0)
