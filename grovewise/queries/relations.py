"""Queries of aggregates, joins, ranking, sets, components, inventory and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grovewise.functions import labels, texts
from grovewise.functions.colours import labels_from_colours, saved_colour
from grovewise.operators import components, edits, inventory, merging, neighbours, statistics, stem_fits, voxels
from grovewise.operators.records import latest
from grovewise.operators.units import stem_diameters
from grovewise.plans.bounded import broadcast_bounded
from grovewise.plans.ranking import Sorted
from grovewise.queries.problems import records_in_force
from grovewise.queries.registry import G, P, Queries, given_points, points, rounded, table
from grovewise.session import materialize

query = Queries()
QUERIES, SQL = query.QUERIES, query.SQL

_REC = f"SELECT tree_id, count(*) AS count, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z, round((min(x)::DOUBLE + max(x)) / 2, 4) AS centre_x, round((min(y)::DOUBLE + max(y)) / 2, 4) AS centre_y FROM {P} WHERE tree_id NOT IN (0, -1) GROUP BY tree_id"
_IN_FORCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, tree_id ORDER BY saved_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn FROM tree_records) WHERE rn = 1)"
_TREES = "(SELECT DISTINCT tree_id, cloud_id, x, y, height, dbh, dbh_quality FROM tree_stats)"
_STEMS = "(SELECT DISTINCT stem_uid, cloud_id, x, y, height, species FROM stems)"
#: Cells of a size, as SQL.
_CELL = "CAST(floor({0}::DOUBLE / {1}) AS BIGINT)"


def _dist(a: str, b: str, axes: str = "xyz") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c}::DOUBLE - {b}.{c}::DOUBLE) * ({a}.{c}::DOUBLE - {b}.{c}::DOUBLE)" for c in axes) + ")"


def _near_sql(cell: float, on: str, axes: str = "xyz", left: str = G, right: str = G) -> str:
    """Pairs of points (a, b) in touching cells, as SQL."""
    key = [f"CAST(floor({c}::DOUBLE / {cell}) AS BIGINT)" for c in axes]
    off = ", ".join(f"(SELECT unnest([-1, 0, 1]) AS o{c}) t{c}" for c in axes)
    names = [f"c{c}" for c in axes]
    a = f"(SELECT *, {', '.join(f'{k} AS {n}' for k, n in zip(key, names))} FROM {left})"
    b = f"(SELECT *, {', '.join(f'{k} + o{c} AS c{c}' for k, c in zip(key, axes))} FROM {right}, {off})"
    return f"{a} a JOIN {b} b ON {' AND '.join(f'a.{n} = b.{n}' for n in names)} AND {on}"


def _trees(spark, sf):
    return table(spark, sf, "tree_stats").dropDuplicates(["tree_id"]).withColumnRenamed("cloud_id", "cloud")


def _stems(spark, sf):
    got = stem_diameters(latest(table(spark, sf, "stems"), ["stem_uid"], ["received_at"]), table(spark, sf, "clouds"))
    return got.select(F.col("cloud_id").alias("cloud"), F.col("stem_uid").cast("string").alias("stem_id"), F.col("stem_uid").alias("ordinal"), "x", "y", "height", F.col("metres").alias("dbh"), "species")


# -- aggregates ----------------------------------------------------------------


@query("agg01_label_counts", f"SELECT tree_id, count(*) AS n FROM {P} GROUP BY tree_id")
def _(spark, sf):
    return statistics.label_counts(table(spark, sf, "points").select("point_id", "tree_id").distinct())


@query("agg02_tree_records", _REC)
def _(spark, sf):
    return statistics.tree_records(table(spark, sf, "points").select("point_id", "tree_id", "x", "y", "z").distinct()).withColumn("centre_x", F.round("centre_x", 4)).withColumn("centre_y", F.round("centre_y", 4))


@query("agg03_bounds", "SELECT min(x::DOUBLE) AS lo_x, min(y::DOUBLE) AS lo_y, min(z::DOUBLE) AS lo_z, max(x::DOUBLE) AS hi_x, max(y::DOUBLE) AS hi_y, max(z::DOUBLE) AS hi_z FROM points")
def _(spark, sf):
    return statistics.bounds(table(spark, sf, "points"))


@query("agg04_tree_ids", "SELECT DISTINCT tree_id FROM points WHERE tree_id NOT IN (0, -1)")
def _(spark, sf):
    return table(spark, sf, "points").filter(labels.is_tree(F.col("tree_id"))).select("tree_id").distinct()


@query("agg05_class_values", "SELECT DISTINCT cls FROM points WHERE cls IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "points").select("cls").filter("cls is not null").distinct()


@query("agg06_rows_by_tree", f"SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY point_id) - 1 AS place, point_id FROM {P} WHERE tree_id > 0")
def _(spark, sf):
    p = table(spark, sf, "points").filter("tree_id > 0").select("tree_id", "point_id")
    return Sorted(p, ["tree_id"], ["point_id"], distinct=True).ranked("place")


_VOX = f"""(SELECT point_id, cloud_id, floor(rx) AS i, floor(ry) AS j, floor(rz) AS k, ((rx - floor(rx) - 0.5::FLOAT) * (rx - floor(rx) - 0.5::FLOAT) + (ry - floor(ry) - 0.5::FLOAT) * (ry - floor(ry) - 0.5::FLOAT)) + (rz - floor(rz) - 0.5::FLOAT) * (rz - floor(rz) - 0.5::FLOAT) AS off FROM
 (SELECT point_id, cloud_id, (x - lx) / 0.5::FLOAT AS rx, (y - ly) / 0.5::FLOAT AS ry, (z - lz) / 0.5::FLOAT AS rz FROM {G} JOIN (SELECT cloud_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM {G} GROUP BY cloud_id) USING (cloud_id)))"""


@query("agg07_voxel_thinning", f"SELECT cloud_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, i, j, k ORDER BY off, point_id) AS rn FROM {_VOX}) WHERE rn = 1")
def _(spark, sf):
    return voxels.thinned(given_points(spark, sf), 0.5, ["cloud_id"])


@query("agg08_first_of_cube", f"SELECT cloud_id, min(point_id) AS point_id FROM {G} GROUP BY cloud_id, {_CELL.format('x', 0.25)}, {_CELL.format('y', 0.25)}, {_CELL.format('z', 0.25)}")
def _(spark, sf):
    return voxels.first_of_cubes(table(spark, sf, "points"), 0.25, ["cloud_id"])


_NEAREST = f"(SELECT cloud_id, point_id, m.d AS d, m.o AS o FROM (SELECT a.cloud_id, a.point_id, min({{'d': {_dist('a', 'b')}, 'o': b.point_id}}) AS m FROM {G} a JOIN {G} b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id GROUP BY ALL))"


@query("agg09_point_spacing", f"SELECT cloud_id, round(CASE WHEN coalesce(m, 0) = 0 THEN 0.01::DOUBLE ELSE m END, 4) AS spacing FROM (SELECT DISTINCT cloud_id FROM {G}) LEFT JOIN (SELECT cloud_id, quantile_cont(d, 0.5) AS m FROM {_NEAREST} GROUP BY cloud_id) USING (cloud_id)")
def _(spark, sf):
    return rounded(voxels.spacing(given_points(spark, sf).select("cloud_id", "point_id", "x", "y", "z"), 0.4, ["cloud_id"]))


@query("agg10_block_spacing")
def _(spark, sf):
    return rounded(voxels.block_spacing(given_points(spark, sf), 6.0, 0.4, keys=["cloud_id"]))


@query("agg11_block_counts", f"SELECT cloud_id, {_CELL.format('x', 6.0)} AS bx, {_CELL.format('y', 6.0)} AS by, {_CELL.format('z', 6.0)} AS bz, count(*) AS n FROM {G} GROUP BY ALL HAVING count(*) >= 50")
def _(spark, sf):
    block = [F.floor(F.col(a).cast("double") / 6.0).alias(f"b{a}") for a in "xyz"]
    return given_points(spark, sf).groupBy("cloud_id", *block).agg(F.count("*").alias("n")).filter("n >= 50")


@query("agg12_kept_share")
def _(spark, sf):
    return rounded(voxels.kept_share(given_points(spark, sf), 6.0, 0.5, keys=["cloud_id"]))


@query("agg13_tree_distances", f"""WITH h AS (SELECT a.cloud_id, a.tree_id AS t, b.tree_id AS o, min({_dist('a', 'b')}) AS d FROM {_near_sql(0.15, 'a.cloud_id = b.cloud_id AND a.tree_id < b.tree_id AND a.tree_id NOT IN (0, -1) AND b.tree_id NOT IN (0, -1)')} WHERE {_dist('a', 'b')} < 0.15 GROUP BY ALL)
 SELECT cloud_id, t AS tree_id, o AS other_id, round(d, 5) AS distance FROM h UNION ALL SELECT cloud_id, o, t, round(d, 5) FROM h""")
def _(spark, sf):
    return rounded(neighbours.all_neighbour_trees(table(spark, sf, "points").select("cloud_id", "tree_id", "x", "y", "z"), 0.15, ["cloud_id"]), 5)


@query("agg14_ground_levels", f"SELECT tree_id, round(quantile_cont(z::DOUBLE, 0.01), 5) AS base_z FROM {P} WHERE z IS NOT NULL AND tree_id > 0 GROUP BY tree_id")
def _(spark, sf):
    p = table(spark, sf, "points").filter("z is not null and tree_id > 0").select("point_id", "tree_id", "z").distinct()
    return stem_fits.ground_levels(p).withColumn("base_z", F.round("base_z", 5))


_SLAB = f"""(SELECT tree_id, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT tree_id, x, y, z::DOUBLE AS z, quantile_cont(z::DOUBLE, 0.01) OVER (PARTITION BY tree_id) AS b FROM {G} WHERE tree_id > 0) WHERE abs(z - b - 1.3::DOUBLE) <= 0.15::DOUBLE)"""
_CIRCLE = f"""(SELECT *, (uw * vv - vw * uv) / (uu * vv - uv * uv) / 2 AS a, (vw * uu - uw * uv) / (uu * vv - uv * uv) / 2 AS b FROM
 (SELECT tree_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS m, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS uw, sum(v * (u * u + v * v)) AS vw, avg(u * u + v * v) AS c
 FROM (SELECT tree_id, x - mx AS u, y - my AS v, mx, my FROM {_SLAB} JOIN (SELECT tree_id, avg(x) AS mx, avg(y) AS my FROM {_SLAB} GROUP BY tree_id) USING (tree_id)) GROUP BY tree_id)
 WHERE abs(uu * vv - uv * uv) > 1e-12 * (uu + vv) * (uu + vv) AND m >= 8)"""


@query("agg15_stem_circle", f"""SELECT tree_id, round(2 * r, 3) AS dbh, round(q, 3) AS quality FROM (SELECT s.tree_id, any_value(r) AS r, sqrt(avg((sqrt((x - mx - a) * (x - mx - a) + (y - my - b) * (y - my - b)) - r) ^ 2)) / any_value(r) AS q
 FROM {_SLAB} s JOIN (SELECT *, sqrt(c + a * a + b * b) AS r FROM {_CIRCLE}) USING (tree_id) GROUP BY s.tree_id) WHERE 2 * r BETWEEN 0.02 AND 3 AND q <= 0.45""")
def _(spark, sf):
    got = stem_fits.stem_diameters(given_points(spark, sf).filter("tree_id > 0"))
    return got.filter("dbh is not null").select("tree_id", F.round("dbh", 3).alias("dbh"), F.round("dbh_quality", 3).alias("quality"))


@query("agg16_stats_from_points", f"SELECT tree_id, round(max(z::DOUBLE) - quantile_cont(z::DOUBLE, 0.01), 4) AS height FROM {G} WHERE tree_id > 0 GROUP BY tree_id")
def _(spark, sf):
    return stem_fits.tree_statistics(given_points(spark, sf).filter("tree_id > 0")).select("tree_id", F.round("height", 4).alias("height"))


@query("agg17_stats_from_boxes", f"SELECT tree_id, round((min(x)::DOUBLE + max(x)) / 2, 4) AS x, round((min(y)::DOUBLE + max(y)) / 2, 4) AS y, round(coalesce(any_value(o.height), max(z)::DOUBLE - min(z)), 4) AS height FROM {P} p LEFT JOIN (SELECT DISTINCT tree_id, height FROM tree_stats WHERE height > 20) o USING (tree_id) WHERE tree_id NOT IN (0, -1) GROUP BY tree_id")
def _(spark, sf):
    measured = table(spark, sf, "tree_stats").filter("height > 20").select("tree_id", "height").distinct()
    return rounded(statistics.height_by_box(statistics.tree_records(points(spark, sf)), measured))


@query("agg18_unit_by_median", "SELECT cloud_id, CASE WHEN median(dbh) FILTER (WHERE dbh <> 0) > 5 THEN 0.01 ELSE 1.0 END::DOUBLE AS scale FROM (SELECT DISTINCT stem_uid, cloud_id, dbh FROM stems) GROUP BY cloud_id")
def _(spark, sf):
    return table(spark, sf, "stems").select("stem_uid", "cloud_id", "dbh").distinct().groupBy("cloud_id").agg(inventory.inferred_scale(F.col("dbh")).alias("scale"))


@query("agg19_offset_histogram", f"""SELECT cloud_id AS cloud, CAST(round_even((t.x - s.x) / 2, 0) AS DOUBLE) AS i, CAST(round_even((t.y - s.y) / 2, 0) AS DOUBLE) AS j, count(*) AS n, round(avg(t.x - s.x), 4) AS dx, round(avg(t.y - s.y), 4) AS dy
 FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE abs(t.x - s.x) <= 8 AND abs(t.y - s.y) <= 8 GROUP BY ALL""")
def _(spark, sf):
    return rounded(inventory.offset_histogram(_stems(spark, sf), _trees(spark, sf), 2.0, 8.0))


@query("agg20_shift_refine", f"""SELECT cloud_id AS cloud, round(avg(ex), 4) AS dx, round(avg(ey), 4) AS dy, count(*) AS n FROM (SELECT s.cloud_id, t.x - s.x AS ex, t.y - s.y AS ey, row_number() OVER (PARTITION BY s.stem_uid ORDER BY {_dist('s', 't', 'xy')}, t.tree_id) AS rn
 FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE {_dist('s', 't', 'xy')} < 2) WHERE rn = 1 GROUP BY cloud_id""")
def _(spark, sf):
    s = _stems(spark, sf).select("cloud", "ordinal", "x", "y")
    t = _trees(spark, sf).select("cloud", "tree_id", "x", "y")
    near = neighbours.nearest(s, t, 2.0, "ordinal", "tree_id", ["cloud"], axes=("x", "y"), most=2.0)
    both = near.join(s.select("ordinal", "cloud", F.col("x").alias("sx"), F.col("y").alias("sy")), "ordinal").join(t.drop("cloud"), "tree_id")
    return rounded(both.groupBy("cloud").agg(F.avg(F.col("x") - F.col("sx")).alias("dx"), F.avg(F.col("y") - F.col("sy")).alias("dy"), F.count("*").alias("n")))


@query("agg21_alignment_quality", f"""SELECT cloud_id AS cloud, count(d) AS matched, round(median(d), 4) AS residual FROM (SELECT s.cloud_id, s.stem_uid, min(sqrt((t.x - s.x - 1.5::DOUBLE) * (t.x - s.x - 1.5::DOUBLE) + (t.y - s.y) * (t.y - s.y))) FILTER (WHERE sqrt((t.x - s.x - 1.5::DOUBLE) * (t.x - s.x - 1.5::DOUBLE) + (t.y - s.y) * (t.y - s.y)) <= 2) AS d
 FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE s.x IS NOT NULL AND s.y IS NOT NULL GROUP BY s.cloud_id, s.stem_uid) GROUP BY cloud_id""")
def _(spark, sf):
    shifts = table(spark, sf, "clouds").select(F.col("cloud_id").alias("cloud"), F.lit(1.5).alias("dx"), F.lit(0.0).alias("dy"))
    got = inventory.alignment_quality(_stems(spark, sf), _trees(spark, sf), shifts)
    there = table(spark, sf, "stems").select(F.col("cloud_id").alias("cloud")).distinct()
    return got.join(there, "cloud", "left_semi").select("cloud", "matched", F.round("residual", 4).alias("residual"))


@query("agg22_whole_moves", f"""SELECT tree_id AS code, min(n) AS new FROM (SELECT tree_id, CASE WHEN tree_id % 5 = 0 THEN tree_id + 1 WHEN tree_id % 7 = 0 THEN CASE WHEN z > 2 THEN 1 ELSE 2 END ELSE tree_id END AS n FROM {G}) GROUP BY tree_id HAVING bool_and(n <> tree_id) AND min(n) = max(n) AND tree_id > 0""")
def _(spark, sf):
    t = F.col("tree_id")
    new = F.when(t % 5 == 0, t + 1).when(t % 7 == 0, F.when(F.col("z") > 2, 1).otherwise(2)).otherwise(t)
    return edits.whole_moves(given_points(spark, sf).filter(t > -2).withColumn("after", new), "tree_id", "after")


@query("agg23_done_progress", "SELECT count(*) FILTER (WHERE tree_id % 3 = 0) AS done, count(*) AS total, CAST(round_even(100.0 * count(*) FILTER (WHERE tree_id % 3 = 0) / count(*), 0) AS INTEGER) AS percent FROM (SELECT DISTINCT tree_id FROM tree_stats)")
def _(spark, sf):
    t = table(spark, sf, "tree_stats")
    return statistics.done_progress(t, t.filter("tree_id % 3 = 0"))


@query("agg24_selection_summary", f"SELECT count(*) AS points, count(DISTINCT CASE WHEN tree_id NOT IN (0, -1) THEN tree_id END) AS trees FROM {P} WHERE z > 15")
def _(spark, sf):
    return statistics.selection_summary(points(spark, sf), F.col("z") > 15)


@query("agg25_next_id", "SELECT greatest(max(tree_id) + 1, 1) AS next_id FROM points")
def _(spark, sf):
    return statistics.free_id(table(spark, sf, "points"))


@query("agg26_unsaved_edits", f"SELECT bool_or(CASE WHEN z > 30 THEN 0 ELSE tree_id END <> tree_id) AS unsaved FROM {P}")
def _(spark, sf):
    return table(spark, sf, "points").agg(F.bool_or(F.when(F.col("z") > 30, 0).otherwise(F.col("tree_id")) != F.col("tree_id")).alias("unsaved"))


@query("agg27_progress_shares", "SELECT source_id, round((sum(n) OVER (ORDER BY source_id) - n) / sum(n) OVER (), 6) AS from_share, round(sum(n) OVER (ORDER BY source_id) / sum(n) OVER (), 6) AS to_share FROM (SELECT source_id, count(*)::DOUBLE AS n FROM source_rows GROUP BY source_id)")
def _(spark, sf):
    n = table(spark, sf, "source_rows").groupBy("source_id").agg(F.count("*").alias("points")).withColumnRenamed("source_id", "ordinal")
    return merging.progress_shares(n).select(F.col("ordinal").alias("source_id"), F.round("from_share", 6).alias("from_share"), F.round("to_share", 6).alias("to_share"))


@query("agg28_match_scorecard")
def _(spark, sf):
    pairs = materialize(inventory.candidate_pairs(_trees(spark, sf), _stems(spark, sf)), "scored")
    truth = pairs.groupBy("tree_id").agg(F.min_by("stem_id", "distance").alias("stem_id"), F.min_by("stem_dbh", "distance").alias("dbh_m"))
    return rounded(inventory.scorecard(inventory.greedy_matches(pairs), truth, _trees(spark, sf)))


@query("agg29_latest_release", "SELECT '0.10.2' AS version")
def _(spark, sf):
    rows = [("0.9.9", False), ("0.10.2", False), ("0.11.0", True), ("1.0.dev1", False), ("0.10", None)]
    return merging.latest_release(spark.createDataFrame(rows, "version string, yanked boolean"))


@query("agg30_least_offsets", "SELECT min(shift_x) AS x, min(shift_y) AS y FROM clouds")
def _(spark, sf):
    return table(spark, sf, "clouds").agg(F.min("shift_x").alias("x"), F.min("shift_y").alias("y"))


# -- joins ---------------------------------------------------------------------


@query("jn01_neighbour_trees", f"SELECT b.tree_id, round(min({_dist('a', 'b')}), 5) AS distance FROM {_near_sql(1.0, 'a.tree_id = 17 AND b.tree_id NOT IN (0, -1, 17)')} WHERE {_dist('a', 'b')} < 1.0 GROUP BY b.tree_id")
def _(spark, sf):
    p = table(spark, sf, "points").select("tree_id", "x", "y", "z")
    return rounded(neighbours.neighbour_trees(p, 17, 1.0), 5)


@query("jn02_overlapping_boxes", f"""WITH r AS (SELECT cloud_id, tree_id, min(x)::DOUBLE AS lx, min(y)::DOUBLE AS ly, min(z)::DOUBLE AS lz, max(x)::DOUBLE AS hx, max(y)::DOUBLE AS hy, max(z)::DOUBLE AS hz FROM {P} WHERE tree_id NOT IN (0, -1) GROUP BY cloud_id, tree_id)
 SELECT a.cloud_id, a.tree_id, b.tree_id AS other_id FROM r a JOIN r b ON a.cloud_id = b.cloud_id AND a.tree_id <> b.tree_id AND b.lx <= a.hx + 0.5 AND b.hx >= a.lx - 0.5 AND b.ly <= a.hy + 0.5 AND b.hy >= a.ly - 0.5 AND b.lz <= a.hz + 0.5 AND b.hz >= a.lz - 0.5""")
def _(spark, sf):
    p = table(spark, sf, "points").select("point_id", "cloud_id", "tree_id", "x", "y", "z").distinct()
    return neighbours.boxes_overlapping(statistics.tree_records(p, ["cloud_id", "tree_id"]), 0.5, 10.0, ["cloud_id"])


@query("jn03_eps_pairs", f"SELECT a.cloud_id, a.point_id AS a_id, b.point_id AS b_id, round({_dist('a', 'b')}, 6) AS distance FROM {_near_sql(0.1, 'a.cloud_id = b.cloud_id AND a.point_id < b.point_id')} WHERE {_dist('a', 'b')} <= 0.1")
def _(spark, sf):
    return neighbours.pairs_within(given_points(spark, sf), 0.1, ["cloud_id"]).withColumn("distance", F.round("distance", 6))


@query("jn04_nearest_other", f"SELECT point_id, o AS other_id, round(d, 6) AS distance FROM {_NEAREST}")
def _(spark, sf):
    near = voxels.nearest_distances(given_points(spark, sf), 0.4, ["cloud_id"])
    return near.withColumn("distance", F.round("distance", 6))


_KEPT = f"(SELECT * FROM {G} WHERE point_id IN (SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY cloud_id, i, j, k ORDER BY off, point_id) AS rn FROM {_VOX}) WHERE rn = 1))"


@query("jn05_nearest_kept", f"""SELECT point_id, kept_id, round(d, 6) AS distance FROM (SELECT a.point_id, b.point_id AS kept_id, {_dist('a', 'b')} AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY {_dist('a', 'b')}, b.point_id) AS rn
 FROM {_near_sql(1.0, 'a.tree_id = b.tree_id AND a.cloud_id = b.cloud_id', right=_KEPT)} WHERE {_dist('a', 'b')} < 1.0) WHERE rn = 1""")
def _(spark, sf):
    g = given_points(spark, sf).select("cloud_id", "tree_id", "point_id", "x", "y", "z")
    kept = g.join(voxels.thinned(g, 0.5, ["cloud_id"]).select("point_id"), "point_id", "left_semi").withColumnRenamed("point_id", "kept_id")
    got = neighbours.nearest(g, kept, 1.0, "point_id", "kept_id", ["cloud_id", "tree_id"], most=1.0)
    return got.select("point_id", "kept_id", F.round("distance", 6).alias("distance"))


@query("jn06_whole_lookup", f"SELECT point_id, tree_id + 100000 AS new FROM {P} WHERE tree_id > 0 AND tree_id % 10 = 0")
def _(spark, sf):
    moves = table(spark, sf, "points").filter("tree_id > 0 and tree_id % 10 = 0").select("tree_id").distinct().withColumn("new", F.col("tree_id") + 100000)
    return points(spark, sf).join(broadcast_bounded(moves), "tree_id").select("point_id", "new")


@query("jn07_label_colours", f"SELECT point_id, tree_id * 31 % 256 AS red FROM {P} WHERE tree_id > 0 UNION ALL SELECT point_id, 0 FROM {P} WHERE tree_id <= 0")
def _(spark, sf):
    p = points(spark, sf)
    colour = p.filter("tree_id > 0").select("tree_id").distinct().withColumn("red", F.col("tree_id") * 31 % 256)
    return p.join(broadcast_bounded(colour), "tree_id", "left").select("point_id", F.coalesce("red", F.lit(0)).alias("red"))


@query("jn08_only_done", "SELECT DISTINCT point_id FROM points WHERE tree_id IN (SELECT tree_id FROM tree_stats WHERE height > 12)")
def _(spark, sf):
    done = table(spark, sf, "tree_stats").filter("height > 12").select("tree_id").distinct()
    return table(spark, sf, "points").select("point_id", "tree_id").join(broadcast_bounded(done), "tree_id", "left_semi").select("point_id").distinct()


@query("jn10_nearest_tree", f"""SELECT stem_uid, tree_id, round(d, 4) AS distance FROM (SELECT s.stem_uid, t.tree_id, {_dist('s', 't', 'xy')} AS d, row_number() OVER (PARTITION BY s.stem_uid ORDER BY {_dist('s', 't', 'xy')}, t.tree_id) AS rn
 FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE s.x IS NOT NULL AND s.y IS NOT NULL AND t.x IS NOT NULL AND t.y IS NOT NULL) WHERE rn = 1""")
def _(spark, sf):
    s = _stems(spark, sf).select("cloud", F.col("ordinal").alias("stem_uid"), "x", "y")
    t = _trees(spark, sf).select("cloud", "tree_id", "x", "y")
    got = neighbours.nearest(s, t, 3.0, "stem_uid", "tree_id", ["cloud"], axes=("x", "y"))
    return got.select("stem_uid", "tree_id", F.round("distance", 4).alias("distance"))


_PAIRS = f"""(SELECT t.tree_id, s.stem_uid, {_dist('s', 't', 'xy')} AS d, t.height - s.height AS h FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE {_dist('s', 't', 'xy')} <= 15)"""
_SCORED = f"(SELECT *, sqrt((d * d / 4 + coalesce(h * h / 9, 0)) / (CASE WHEN h IS NULL THEN 1 ELSE 2 END)) AS score FROM {_PAIRS})"


def _scored_pairs(spark, sf):
    return inventory.candidate_pairs(_trees(spark, sf).withColumn("dbh", F.lit(None).cast("double")), _stems(spark, sf))


@query("jn11_candidate_pairs", f"SELECT tree_id, stem_uid, round(d, 4) AS distance, round(score, 4) AS score FROM {_SCORED}")
def _(spark, sf):
    return _scored_pairs(spark, sf).select("tree_id", F.col("ordinal").alias("stem_uid"), F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"))


@query("jn13_manual_links", f"SELECT t.tree_id, s.stem_uid, round({_dist('s', 't', 'xy')}, 4) AS distance FROM (SELECT DISTINCT tree_id, tree_id % 500 AS stem_uid FROM tree_stats) l JOIN {_TREES} t USING (tree_id) JOIN {_STEMS} s ON s.stem_uid = l.stem_uid AND s.cloud_id = t.cloud_id WHERE s.x IS NOT NULL AND s.y IS NOT NULL")
def _(spark, sf):
    links = _trees(spark, sf).select("cloud", "tree_id", (F.col("tree_id") % 500).cast("string").alias("stem_id"))
    return inventory.linked_matches(links, _trees(spark, sf), _stems(spark, sf)).select("tree_id", F.col("ordinal").alias("stem_uid"), F.round("distance", 4).alias("distance"))


@query("jn09_stem_tree_offsets", f"SELECT s.stem_uid, t.tree_id, round(t.x - s.x, 4) AS ox, round(t.y - s.y, 4) AS oy FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE abs(t.x - s.x) <= 8 AND abs(t.y - s.y) <= 8")
def _(spark, sf):
    return inventory.offsets(_stems(spark, sf), _trees(spark, sf), 8.0).select(F.col("ordinal").alias("stem_uid"), "tree_id", F.round("ox", 4).alias("ox"), F.round("oy", 4).alias("oy"))


@query("jn14_left_over", f"""WITH l AS (SELECT t.cloud_id, t.tree_id, s.stem_uid FROM {_TREES} t JOIN {_STEMS} s ON s.stem_uid = t.tree_id % 500 AND s.cloud_id = t.cloud_id WHERE s.x IS NOT NULL AND s.y IS NOT NULL AND t.x IS NOT NULL AND t.y IS NOT NULL)
 SELECT 'tree' AS kind, cloud_id AS cloud, CAST(tree_id AS VARCHAR) AS ident FROM {_TREES} t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree_id = t.tree_id AND l.cloud_id = t.cloud_id)
 UNION ALL SELECT 'stem', cloud_id, CAST(stem_uid AS VARCHAR) FROM {_STEMS} s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.stem_uid = s.stem_uid AND l.cloud_id = s.cloud_id)""")
def _(spark, sf):
    trees, stems = _trees(spark, sf), _stems(spark, sf)
    links = trees.select("cloud", "tree_id", (F.col("tree_id") % 500).cast("string").alias("stem_id"))
    return inventory.left_over(trees, stems, inventory.linked_matches(links, trees, stems))


@query("jn15_measured_tree", f"SELECT cloud_id, tree_id, round(coalesce(s.height, hi_z - lo_z), 4) AS height FROM {_IN_FORCE} r LEFT JOIN (SELECT DISTINCT tree_id, cloud_id, height FROM tree_stats) s USING (cloud_id, tree_id)")
def _(spark, sf):
    s = table(spark, sf, "tree_stats").select("cloud_id", "tree_id", "height").distinct()
    return records_in_force(spark, sf).join(s, ["cloud_id", "tree_id"], "left").select("cloud_id", "tree_id", F.round(F.coalesce("height", F.col("hi_z") - F.col("lo_z")), 4).alias("height"))


@query("jn16_stats_lookup", f"SELECT cloud_id, tree_id, count, dbh FROM {_IN_FORCE} r LEFT JOIN (SELECT DISTINCT tree_id, cloud_id, dbh FROM tree_stats) s USING (cloud_id, tree_id)")
def _(spark, sf):
    s = table(spark, sf, "tree_stats").select("cloud_id", "tree_id", "dbh").distinct()
    return records_in_force(spark, sf).join(s, ["cloud_id", "tree_id"], "left").select("cloud_id", "tree_id", "count", "dbh")


@query("jn19_changed_rows", f"SELECT point_id, tree_id AS old, 0 AS new FROM {P} WHERE z > 25 AND tree_id <> 0")
def _(spark, sf):
    base = points(spark, sf).select("point_id", "tree_id", "z")
    now = base.withColumn("tree_id", F.when(F.col("z") > 25, 0).otherwise(F.col("tree_id")))
    return edits.changed_rows(now, base)


# -- ranking -------------------------------------------------------------------


@query("win01_colour_ranks", f"""WITH c AS (SELECT point_id, (((intensity % 64) * 4) << 16) | (((cls * 37) % 256) << 8) AS rgb FROM {P} WHERE intensity IS NOT NULL AND cls IS NOT NULL)
 SELECT point_id, CASE WHEN rgb = 0 THEN 0 ELSE CAST(rn AS INTEGER) END AS label FROM c JOIN (SELECT rgb, row_number() OVER (ORDER BY rgb) AS rn FROM (SELECT DISTINCT rgb FROM c)) USING (rgb)""")
def _(spark, sf):
    p = points(spark, sf).filter("intensity is not null and cls is not null").select("point_id", (F.col("intensity") % 64 * 4).alias("r"), (F.col("cls") * 37 % 256).alias("g"), F.lit(0).alias("b"))
    return labels_from_colours(p, "r", "g", "b", "label").select("point_id", F.col("label").cast("int").alias("label"))


@query("win02_label_order", f"SELECT row_number() OVER (ORDER BY tree_id, point_id) - 1 AS place, point_id FROM {P}")
def _(spark, sf):
    p = table(spark, sf, "points").select("tree_id", "point_id").distinct().withColumn("_all", F.lit(0))
    return Sorted(p, ["_all"], ["tree_id", "point_id"]).ranked("place").select("place", "point_id")


@query("win03_run_starts", f"SELECT tree_id, min(place) AS start, count(*) AS n FROM (SELECT tree_id, row_number() OVER (ORDER BY tree_id, point_id) - 1 AS place FROM {P}) GROUP BY tree_id")
def _(spark, sf):
    n = statistics.label_counts(points(spark, sf).select("tree_id"))
    before = Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each label, not for each point
    return n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("win04_best_stems", f"SELECT tree_id, stem_uid, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score, stem_uid) AS rn FROM {_SCORED}) WHERE rn <= 8")
def _(spark, sf):
    return inventory.best_candidates(_scored_pairs(spark, sf)).select("tree_id", F.col("ordinal").alias("stem_uid"), "rank")


@query("win05_fullest_bins", f"""SELECT cloud_id AS cloud, i, j, n FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY n DESC, i DESC, j DESC) AS rn FROM (SELECT cloud_id, CAST(round_even((t.x - s.x) / 2, 0) AS DOUBLE) AS i, CAST(round_even((t.y - s.y) / 2, 0) AS DOUBLE) AS j, count(*) AS n
 FROM {_STEMS} s JOIN {_TREES} t USING (cloud_id) WHERE abs(t.x - s.x) <= 8 AND abs(t.y - s.y) <= 8 GROUP BY ALL)) WHERE rn <= 5""")
def _(spark, sf):
    h = inventory.offset_histogram(_stems(spark, sf), _trees(spark, sf), 2.0, 8.0)
    rank = F.row_number().over(Window.partitionBy("cloud").orderBy(F.desc("n"), F.desc("i"), F.desc("j")))
    return h.withColumn("rn", rank).filter("rn <= 5").select("cloud", "i", "j", "n")


@query("win07_nearest_keys", f"""SELECT tree_id, CAST(rn AS INTEGER) AS key FROM (SELECT *, row_number() OVER (ORDER BY d, tree_id) AS rn FROM (SELECT b.tree_id, min({_dist('a', 'b')}) AS d FROM {_near_sql(1.0, 'a.tree_id = 17 AND b.tree_id NOT IN (0, -1, 17)')} WHERE {_dist('a', 'b')} < 1.0 GROUP BY b.tree_id)) WHERE rn <= 5""")
def _(spark, sf):
    near = neighbours.neighbour_trees(table(spark, sf, "points").select("tree_id", "x", "y", "z"), 17, 1.0)
    top = near.orderBy("distance", "tree_id").limit(5)
    return top.withColumn("key", F.row_number().over(Window.orderBy("distance", "tree_id"))).select("tree_id", "key")


@query("win08_review_order", """SELECT coalesce(min(tree_id) FILTER (WHERE tree_id > 10500), min(tree_id)) AS next, coalesce(max(tree_id) FILTER (WHERE tree_id < 10500), max(tree_id)) AS previous,
 coalesce(min(tree_id) FILTER (WHERE tree_id > 10500 AND tree_id % 4 <> 1), min(tree_id) FILTER (WHERE tree_id % 4 <> 1 AND tree_id <> 10500)) AS next_open FROM (SELECT DISTINCT tree_id FROM tree_stats)""")
def _(spark, sf):
    t = table(spark, sf, "tree_stats")
    return merging.review_order(t, t.filter("tree_id % 4 = 1"), 10500)


@query("win09_tree_in_name", r"SELECT DISTINCT path, TRY_CAST(regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '(\d+)\D*$', 1) AS INTEGER) AS tree FROM source_files")
def _(spark, sf):
    return table(spark, sf, "source_files").select("path", texts.tree_in_name(F.col("path")).alias("tree")).distinct()


@query("win10_last_mapping", r"""WITH k AS (SELECT source_id, path AS key, tree_id FROM source_files WHERE tree_id IS NOT NULL UNION ALL SELECT source_id, regexp_extract(path, '([^/]*)$', 1), tree_id FROM source_files WHERE tree_id IS NOT NULL)
 SELECT key, tree_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_id DESC) AS rn FROM k) WHERE rn = 1""")
def _(spark, sf):
    lines = table(spark, sf, "source_files").select(F.col("source_id").alias("line_no"), "path", F.col("tree_id").cast("string").alias("value"))
    return merging.mapping_entries(lines)


@query("win11_recent_entries", "SELECT path, 'file' AS type, CAST(max(written_at) AS VARCHAR) AS last_opened FROM source_files GROUP BY path ORDER BY max(written_at) DESC, path LIMIT 20")
def _(spark, sf):
    from grovewise.sources.tables import recent_entries

    e = table(spark, sf, "source_files").select("path", F.lit("file").alias("type"), F.date_format("written_at", "yyyy-MM-dd HH:mm:ss").alias("last_opened"))
    return recent_entries(e)


@query("win12_greedy_order", f"SELECT row_number() OVER (ORDER BY round(score, 6), tree_id, stem_uid) - 1 AS place, tree_id, stem_uid FROM {_SCORED} WHERE round(score, 6) <= 2")
def _(spark, sf):
    pairs = _scored_pairs(spark, sf).select(F.lit(0).alias("_all"), F.round("score", 6).alias("score"), "tree_id", F.col("ordinal").alias("stem_uid")).filter("score <= 2")
    return Sorted(pairs, ["_all"], ["score", "tree_id", "stem_uid"]).ranked("place").select("place", "tree_id", "stem_uid")


@query("win13_kept_rows", f"SELECT point_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, i, j, k ORDER BY off, point_id) AS rn FROM {_VOX}) WHERE rn = 1")
def _(spark, sf):
    return voxels.thinned(given_points(spark, sf), 0.5, ["cloud_id"]).select("point_id").orderBy("point_id")


_CLICKS = "(SELECT event_id AS click_id, user_id, ts, CAST(event_id % 40 AS DOUBLE) AS x, CAST(coalesce(value, 0) AS DOUBLE) AS y FROM events)"


@query("win14_click_chains", f"""SELECT user_id, click_id, sum(CASE WHEN gap <= 86400 AND far <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, click_id) AS chain FROM
 (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS gap, (x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2 AS far FROM {_CLICKS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, click_id))""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 40).cast("double").alias("x"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("y"))
    return edits.click_chains(e, 86400.0, 30.0, ("user_id",)).select("user_id", "click_id", "chain")


@query("flt13_table_filter", "SELECT DISTINCT tree_id FROM tree_stats WHERE tree_id::VARCHAR LIKE '107%' AND tree_id % 3 <> 0")
def _(spark, sf):
    t = table(spark, sf, "tree_stats").select("tree_id").distinct()
    return merging.table_filter(t, "107", t.filter("tree_id % 3 = 0"))


@query("flt17_believable_fits", "SELECT DISTINCT tree_id, CASE WHEN dbh BETWEEN 0.02 AND 3 AND dbh_quality <= 0.2 THEN dbh END AS dbh FROM tree_stats")
def _(spark, sf):
    good = F.col("dbh").between(stem_fits.THINNEST, stem_fits.THICKEST) & (F.col("dbh_quality") <= stem_fits.GOOD_FIT)
    return table(spark, sf, "tree_stats").select("tree_id", F.when(good, F.col("dbh")).alias("dbh")).distinct()


@query("flt19_source_problems", r"""WITH s AS (SELECT DISTINCT source_id, path, TRY_CAST(regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '(\d+)\D*$', 1) AS INTEGER) AS tree FROM source_files)
 SELECT 'missing' AS problem, CAST(NULL AS INTEGER) AS tree_id, count(*) AS n FROM s WHERE tree IS NULL HAVING count(*) > 0 UNION ALL SELECT 'clash', tree, count(*) FROM s WHERE tree <> 0 GROUP BY tree HAVING count(*) > 1
 UNION ALL SELECT 'unreadable', NULL, count(*) FROM s WHERE NOT regexp_matches(lower(path), '\.(ply|las|laz)$') HAVING count(*) > 0
 UNION ALL SELECT 'mixed', NULL, k FROM (SELECT count(DISTINCT CASE WHEN regexp_matches(lower(path), '\.ply$') THEN 1 ELSE 2 END) AS k, bool_and(regexp_matches(lower(path), '\.(ply|las|laz)$')) AS fine FROM s) WHERE fine AND k > 1""")
def _(spark, sf):
    s = table(spark, sf, "source_files").select("source_id", "path").distinct()
    return merging.source_problems(merging.planned_sources(s))


@query("jn12_planned_sources", r"""WITH s AS (SELECT DISTINCT source_id, path FROM source_files), m AS (SELECT path AS key, any_value(tree_id) AS id FROM source_files WHERE source_id % 3 = 0 GROUP BY path)
 SELECT source_id, coalesce(CASE WHEN s.path LIKE '%ground%' THEN 0 END, m.id, TRY_CAST(regexp_extract(regexp_replace(regexp_extract(s.path, '([^/]*)$', 1), '\.[^.]*$', ''), '(\d+)\D*$', 1) AS INTEGER)) AS tree_id FROM s LEFT JOIN m ON m.key = s.path""")
def _(spark, sf):
    f = table(spark, sf, "source_files")
    s = f.select("source_id", "path").distinct()
    mapping = f.filter("source_id % 3 = 0").select(F.col("path").alias("key"), "tree_id").distinct()
    return merging.planned_sources(s, mapping, s.filter(F.col("path").contains("ground"))).select("source_id", "tree_id")


# -- sets ----------------------------------------------------------------------


@query("uni01_merged_set", "SELECT cloud_id AS \"treeID\", point_id, x, y, z FROM (SELECT DISTINCT point_id, cloud_id, x, y, z FROM points)")
def _(spark, sf):
    p = table(spark, sf, "points").select("point_id", "cloud_id", "x", "y", "z", "intensity").dropDuplicates(["point_id"])
    clouds = [r[0] for r in table(spark, sf, "clouds").select("cloud_id").distinct().orderBy("cloud_id").collect()]  # one table for each file of the set
    parts = [(p.filter(F.col("cloud_id") == c).select("point_id", "x", "y", "z", *(["intensity"] if k else [])), c) for k, c in enumerate(clouds[:2])]
    rest = p.filter(~F.col("cloud_id").isin(clouds[:2])).select("point_id", "x", "y", "z", F.col("cloud_id").cast("int").alias("treeID"))
    return merging.merged(parts).unionByName(rest)


@query("uni02_scene_points", f"""SELECT point_id FROM {P}, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM points WHERE tree_id IN (10003, 10007)) b
 WHERE tree_id IN (10003, 10007) OR (tree_id = 0 AND x BETWEEN lx - 1::FLOAT AND hx + 1::FLOAT AND y BETWEEN ly - 1::FLOAT AND hy + 1::FLOAT AND z BETWEEN lz - 1::FLOAT AND hz + 1::FLOAT)""")
def _(spark, sf):
    return edits.scene_points(table(spark, sf, "points"), [10003, 10007]).select("point_id").distinct()


@query("uni03_distinct_union", "SELECT DISTINCT cls AS v FROM points UNION SELECT DISTINCT tree_id FROM tree_records")
def _(spark, sf):
    return table(spark, sf, "points").select(F.col("cls").alias("v")).distinct().union(table(spark, sf, "tree_records").select("tree_id")).distinct()


@query("uni04_touched_labels", f"SELECT DISTINCT tree_id FROM (SELECT tree_id FROM {P} WHERE z > 25 AND tree_id <> 0 UNION ALL SELECT 0 FROM {P} WHERE z > 25 AND tree_id <> 0)")
def _(spark, sf):
    p = points(spark, sf)
    return edits.touched_labels(edits.edit_of(p, p.filter("z > 25"), 0))


@query("uni05_shared_columns", "SELECT * FROM (VALUES (0, 'cloud_id')) t(place, name)")
def _(spark, sf):
    names = merging.shared_columns([table(spark, sf, t) for t in ("tree_stats", "stems", "tree_records")])
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")


@query("uni06_intersect_done", "SELECT tree_id FROM tree_stats INTERSECT SELECT tree_id FROM tree_records")
def _(spark, sf):
    return table(spark, sf, "tree_stats").select("tree_id").intersect(table(spark, sf, "tree_records").select("tree_id"))


@query("uni07_except_current", "SELECT tree_id FROM tree_records EXCEPT SELECT tree_id FROM tree_stats WHERE height > 10")
def _(spark, sf):
    return table(spark, sf, "tree_records").select("tree_id").subtract(table(spark, sf, "tree_stats").filter("height > 10").select("tree_id"))


@query("uni08_manual_over_auto")
def _(spark, sf):
    trees, stems = _trees(spark, sf), _stems(spark, sf)
    links = trees.select("cloud", "tree_id", (F.col("tree_id") % 500).cast("string").alias("stem_id")).join(stems.select("cloud", "stem_id"), ["cloud", "stem_id"], "left_semi")
    links = links.groupBy("cloud", "stem_id").agg(F.min("tree_id").alias("tree_id"))
    return inventory.all_matches(trees, stems, links).select("tree_id", "stem_id", "matched_by", F.round("score", 4).alias("score"))


# -- components, inventory, edits ----------------------------------------------

_EPS = 0.25


@query("grf01_components", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.point_id AS u, b.point_id AS v FROM {_near_sql(_EPS, 'a.cloud_id = b.cloud_id AND a.tree_id = b.tree_id AND a.tree_id > 0 AND a.point_id <> b.point_id')} WHERE {_dist('a', 'b')} <= {_EPS}),
 c(id, least) USING KEY (id) AS (SELECT point_id, point_id FROM {G} WHERE tree_id > 0 UNION SELECT e.v, min(c.least) FROM c JOIN e ON e.u = c.id JOIN recurring.c AS r ON r.id = e.v WHERE c.least < r.least GROUP BY e.v)
 SELECT cloud_id, tree_id, point_id, least AS component FROM c JOIN {G} ON point_id = id""")
def _(spark, sf):
    g = given_points(spark, sf).filter("tree_id > 0").select("cloud_id", "tree_id", "point_id", "x", "y", "z")
    return components.components_of(g, _EPS, ("cloud_id", "tree_id"))


@query("grf02_voxel_components")
def _(spark, sf):
    g = given_points(spark, sf).filter("tree_id > 0").select("cloud_id", "tree_id", "point_id", "x", "y", "z")
    return components.components_of(g, _EPS, ("cloud_id", "tree_id"), exact=False)


@query("grf03_connected_patch", f"""WITH RECURSIVE g AS (SELECT point_id, x, y, z FROM {G} WHERE tree_id = 10003),
 e AS (SELECT a.point_id AS u, b.point_id AS v FROM g a JOIN g b ON a.point_id <> b.point_id AND {_dist('a', 'b')} <= 0.8), r AS (SELECT min(point_id) AS point_id FROM g UNION SELECT e.v FROM r JOIN e ON e.u = r.point_id) SELECT point_id FROM r WHERE point_id IS NOT NULL""")
def _(spark, sf):
    g = given_points(spark, sf).filter("tree_id = 10003").select("tree_id", "point_id", "x", "y", "z")
    seed = g.agg(F.min("point_id")).first()[0]
    return components.patch_of(g, seed if seed is not None else -1, 0.8)


@query("grf04_gap_ladder")
def _(spark, sf):
    g = given_points(spark, sf).filter("tree_id = 10003").select("tree_id", "point_id", "x", "y", "z")
    spacing = 0.15
    links = materialize(neighbours.pairs_within(g, spacing * components.GAPS[-1], ["tree_id"]), "ladder")
    total = g.count()
    rows = []
    for gap in components.GAPS:
        found = components.label_components(links.filter(F.col("distance") <= gap * spacing))
        rows.append(found.agg(F.count("*").alias("linked"), F.count_distinct("component").alias("pieces")).select(F.lit(gap).alias("gap"), (F.lit(total) - F.col("linked") + F.col("pieces")).alias("components")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("itr01_fit_shift")
def _(spark, sf):
    got = inventory.fit_shifts(_stems(spark, sf).select("cloud", "stem_id", "x", "y"), _trees(spark, sf).select("cloud", "tree_id", "x", "y"), reach=10.0)
    return rounded(got, 3)


@query("itr02_scores", f"SELECT tree_id, round(min(score), 4) AS best, count(*) AS n FROM {_SCORED} GROUP BY tree_id")
def _(spark, sf):
    return _scored_pairs(spark, sf).groupBy("tree_id").agg(F.round(F.min("score"), 4).alias("best"), F.count("*").alias("n"))


@query("itr03_greedy_matches")
def _(spark, sf):
    return inventory.greedy_matches(_scored_pairs(spark, sf)).select("tree_id", "stem_id", F.round("score", 4).alias("score"))


@query("itr04_expanded_edits")
def _(spark, sf):
    g = given_points(spark, sf).select("cloud_id", "tree_id", "point_id", "x", "y", "z")
    kept = voxels.thinned(g, 0.5, ["cloud_id"]).select("point_id")
    code = F.col("tree_id").alias("code")
    working = materialize(g.join(kept, "point_id", "left_semi").select("point_id", "x", "y", "z", code, F.col("tree_id").alias("before"), F.when((F.col("tree_id") == 17) & (F.col("x") < 20), 0).when(F.col("tree_id") == 10003, 17).otherwise(F.col("tree_id")).alias("after")), "working")
    return edits.expanded(g.select("point_id", "x", "y", "z", code), working, 0.5)


@query("itr06_updated_records", _REC)
def _(spark, sf):
    p = points(spark, sf).select("point_id", "tree_id", "x", "y", "z")
    stale = statistics.tree_records(p.filter("tree_id not in (3, 10003) or z < 5"))
    touched = p.filter("tree_id in (3, 10003)").select("tree_id").distinct()
    return statistics.updated_records(stale, p, touched).withColumn("centre_x", F.round("centre_x", 4)).withColumn("centre_y", F.round("centre_y", 4))


#: Edits made from the events, spread over all points.
_EVENT_LOG = "SELECT event_id AS seq, point_id, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE user_id END AS new FROM events JOIN (SELECT DISTINCT point_id FROM points) ON point_id = 1 + event_id * 611953 % (SELECT max(point_id) FROM points)"


def _log(spark, sf):
    e = F.col("event_id")
    new = F.when(e % 3 == 0, 0).when(e % 3 == 1, -1).otherwise(F.col("user_id"))
    last = table(spark, sf, "points").agg(F.max("point_id")).first()[0] or 1
    return table(spark, sf, "events").select(e.cast("long").alias("seq"), F.lit("tree_id").alias("target"), (1 + e.cast("long") * 611953 % last).alias("point_id"), F.lit(None).cast("int").alias("old"), new.cast("int").alias("new"))


@query("dml01_edits_applied", f"SELECT point_id, CAST(coalesce(n.new, tree_id) AS INTEGER) AS tree_id FROM {P} LEFT JOIN (SELECT point_id, arg_max(new, seq) AS new FROM ({_EVENT_LOG}) GROUP BY point_id) n USING (point_id)")
def _(spark, sf):
    return edits.applied(points(spark, sf).select("point_id", "tree_id"), _log(spark, sf))


@query("dml02_undo_redo", f"SELECT point_id, CASE WHEN z > 20 THEN -1 WHEN z > 15 THEN 0 ELSE tree_id END AS tree_id FROM {P}")
def _(spark, sf):
    p = points(spark, sf).select("point_id", "tree_id", "z")
    scene = edits.Scene(p)
    scene.unassign(p.filter("z > 15"))
    scene.mark_noise(p.filter("z > 20"))
    scene.reassign(p.filter("z > 10"), 5)
    scene.undo()
    scene.undo()
    scene.redo()
    return scene.current().select("point_id", "tree_id")


@query("dml03_reassign", f"SELECT point_id, tree_id AS old, 42 AS new FROM {P} WHERE z > 22 AND tree_id <> 42")
def _(spark, sf):
    p = points(spark, sf)
    return edits.edit_of(p, p.filter("z > 22"), 42).select("point_id", "old", "new")


@query("dml04_split_new", f"SELECT point_id, (SELECT greatest(max(tree_id) + 1, 1) FROM points) AS new FROM {P} WHERE tree_id = 3 AND z > 5")
def _(spark, sf):
    p = points(spark, sf)
    new = statistics.free_id(table(spark, sf, "points")).first()[0]
    return edits.edit_of(p, p.filter("tree_id = 3 and z > 5"), new).select("point_id", "new")


@query("dml05_mark_noise", f"SELECT point_id FROM {P} WHERE z > 30 AND tree_id <> -1")
def _(spark, sf):
    p = points(spark, sf)
    return edits.edit_of(p, p.filter("z > 30"), -1).select("point_id")


@query("dml06_unassign", f"SELECT point_id FROM {P} WHERE tree_id = 17")
def _(spark, sf):
    p = points(spark, sf)
    return edits.edit_of(p, p.filter("tree_id = 17"), 0).select("point_id")


@query("dml07_set_class", f"SELECT point_id, cls AS old, 5 AS new FROM {P} WHERE z > 10 AND cls IS DISTINCT FROM 5")
def _(spark, sf):
    p = points(spark, sf)
    return edits.edit_of(p, p.filter("z > 10"), 5, "cls").select("point_id", "old", "new")


@query("dml08_default_target", "SELECT DISTINCT point_id FROM points WHERE tree_id = 42")
def _(spark, sf):
    p = points(spark, sf)
    return edits.Scene(p.select("point_id", "tree_id")).target_of(p.filter("false"), 42)


@query("dml09_apply_scene", f"SELECT tree_id, count(*) AS n FROM (SELECT CASE WHEN tree_id = 108 AND z > 3 THEN 256 ELSE tree_id END AS tree_id FROM {P}) GROUP BY tree_id")
def _(spark, sf):
    p = points(spark, sf).select("point_id", "tree_id", "z")
    log = edits.edit_of(p, p.filter("tree_id = 108 and z > 3"), 256)
    return statistics.label_counts(edits.applied(p, log))


@query("dml11_switch_class", f"SELECT cls, count(*) AS n FROM (SELECT intensity % 8 AS cls FROM {P}) GROUP BY cls")
def _(spark, sf):
    scene = edits.Scene(points(spark, sf).withColumn("other", F.col("intensity") % 8))
    scene.switch_class_column("other")
    return scene.current().groupBy("cls").agg(F.count("*").alias("n"))


@query("dml12_links", "SELECT * FROM (VALUES (7, 'b'), (9, 'c')) t(tree_id, stem_id)")
def _(spark, sf):
    links = spark.createDataFrame([(7, "a"), (8, "b")], "tree_id int, stem_id string")
    return edits.linked(edits.linked(links, 9, "c"), 7, "b")


@query("dml14_negative_meaning", f"SELECT cloud_id, CASE WHEN tree_id = -1 AND coalesce(negative_means, 'noise') = 'unassigned' THEN 0 ELSE tree_id END AS label, count(*) AS n FROM {P} JOIN clouds USING (cloud_id) GROUP BY ALL")
def _(spark, sf):
    c = broadcast_bounded(table(spark, sf, "clouds").select("cloud_id", "negative_means"))
    return points(spark, sf).join(c, "cloud_id").groupBy("cloud_id", labels.resolve_negative(F.col("tree_id"), F.col("negative_means")).alias("label")).agg(F.count("*").alias("n"))


@query("snk05_saved_difference", f"SELECT tree_id, count(*) AS n FROM (SELECT CASE WHEN z > 18 THEN 0 ELSE tree_id END AS tree_id FROM {P}) GROUP BY tree_id")
def _(spark, sf):
    import uuid

    from grovewise.session import shared_folder

    base = materialize(points(spark, sf).select("point_id", "tree_id", "z"), "base")
    store = edits.Snapshots(base, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    store.save(base.withColumn("tree_id", F.when(F.col("z") > 18, 0).otherwise(F.col("tree_id"))))
    return statistics.label_counts(store.at())


@query("snk12_match_table")
def _(spark, sf):
    got = inventory.greedy_matches(_scored_pairs(spark, sf)).withColumn("matched_by", F.lit("auto"))
    return inventory.match_table(got)


@query("snk06_label_write", f"SELECT point_id, CASE WHEN tree_id IN (0, -1) THEN -1 ELSE tree_id END AS unassigned, CASE WHEN tree_id = -1 THEN 0 ELSE tree_id END AS plain FROM {P}")
def _(spark, sf):
    t = F.col("tree_id")
    return points(spark, sf).select("point_id", labels.label_to_file(t, "unassigned").alias("unassigned"), labels.label_to_file(t, unsigned=True).alias("plain"))


@query("snk11_export_names", r"SELECT DISTINCT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') || '_tree_' || tree_id || lower(regexp_extract(path, '(\.[^.]*)$', 1)) AS name FROM source_files")
def _(spark, sf):
    return table(spark, sf, "source_files").select("path", texts.tree_file(F.col("path"), F.col("tree_id")).alias("name")).distinct()


@query("gen04_class_by_stem", "SELECT DISTINCT point_id, CASE WHEN p.tree_id = -1 THEN 7 WHEN p.tree_id <= 0 THEN 2 WHEN sqrt((p.x + c.shift_x - t.x) ^ 2 + (p.y + c.shift_y - t.y) ^ 2) <= 0.35 THEN 4 ELSE 5 END AS class FROM points p JOIN clouds c USING (cloud_id) LEFT JOIN (SELECT DISTINCT tree_id, x, y FROM tree_stats) t ON t.tree_id = p.tree_id")
def _(spark, sf):
    clouds = broadcast_bounded(table(spark, sf, "clouds").select("cloud_id", "shift_x", "shift_y"))
    trees = table(spark, sf, "tree_stats").select("tree_id", F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    p = points(spark, sf).join(clouds, "cloud_id").join(broadcast_bounded(trees), "tree_id", "left")
    far = F.hypot(F.col("x") + F.col("shift_x") - F.col("tx"), F.col("y") + F.col("shift_y") - F.col("ty"))
    return p.select("point_id", F.when(F.col("tree_id") == -1, 7).when(F.col("tree_id") <= 0, 2).when(far <= 0.35, 4).otherwise(5).alias("class"))


@query("gen05_facing_band", f"SELECT point_id FROM {G} WHERE sqrt((x - 30) ^ 2 + (y - 30) ^ 2) > 0.3 AND (x - 30) / sqrt((x - 30) ^ 2 + (y - 30) ^ 2) > cos(radians(50)) AND z BETWEEN 2 AND 8")
def _(spark, sf):
    r = F.hypot(F.col("x").cast("double") - 30, F.col("y").cast("double") - 30)
    return given_points(spark, sf).filter((r > 0.3) & ((F.col("x").cast("double") - 30) / r > F.cos(F.radians(F.lit(50.0)))) & F.col("z").between(2, 8)).select("point_id")


@query("gen07_tree_table", f"SELECT tree_id, cloud_id, round(centroid.x + shift_x, 4) AS x, round(hi_z - lo_z, 4) AS height, s.dbh FROM {_IN_FORCE} r JOIN clouds USING (cloud_id) LEFT JOIN (SELECT DISTINCT tree_id, cloud_id, dbh FROM tree_stats WHERE dbh_quality <= 0.2) s USING (cloud_id, tree_id)")
def _(spark, sf):
    clouds = broadcast_bounded(table(spark, sf, "clouds").select("cloud_id", "shift_x"))
    s = table(spark, sf, "tree_stats").filter("dbh_quality <= 0.2").select("cloud_id", "tree_id", "dbh").distinct()
    r = records_in_force(spark, sf).join(clouds, "cloud_id").join(s, ["cloud_id", "tree_id"], "left")
    return r.select("tree_id", "cloud_id", F.round(F.col("centroid.x") + F.col("shift_x"), 4).alias("x"), F.round(F.col("hi_z") - F.col("lo_z"), 4).alias("height"), "dbh")


@query("jn09_colour_of_saved", f"SELECT point_id, tree_id <= 0 AND tree_id >= -1 AS black FROM {P}")
def _(spark, sf):
    rgb = saved_colour(F.col("tree_id"))
    return points(spark, sf).select("point_id", ((F.get(rgb, 0) + F.get(rgb, 1) + F.get(rgb, 2)) == 0).alias("black"))


@query("itr05_thinning_decision")
def _(spark, sf):
    got = voxels.decide_thinning(given_points(spark, sf).select("point_id", "x", "y", "z"), ask=lambda spacing, voxel, kept: voxel, edge=6.0)
    return spark.createDataFrame([(round(got.spacing, 4), got.offered, got.voxel)], "spacing double, offered double, voxel double")


@query("dml10_load_scene", f"""WITH b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM points WHERE tree_id = 10003)
 SELECT tree_id, count(*) AS n FROM {P}, b WHERE tree_id = 10003 OR (tree_id = 0 AND x BETWEEN lx - 0.5::FLOAT AND hx + 0.5::FLOAT AND y BETWEEN ly - 0.5::FLOAT AND hy + 0.5::FLOAT AND z BETWEEN lz - 0.5::FLOAT AND hz + 0.5::FLOAT) GROUP BY tree_id""")
def _(spark, sf):
    return statistics.label_counts(edits.scene_points(points(spark, sf), [10003], 0.5))


@query("dml13_mark_done", "SELECT tree_id FROM tree_records WHERE tree_id % 3 = 0 UNION SELECT tree_id FROM tree_stats WHERE height > 20")
def _(spark, sf):
    done = table(spark, sf, "tree_records").filter("tree_id % 3 = 0").select("tree_id")
    return done.union(table(spark, sf, "tree_stats").filter("height > 20").select("tree_id")).distinct()


@query("gen03_thin_to_spacing", f"SELECT min(point_id) AS point_id FROM {G} GROUP BY cloud_id, {_CELL.format('x', 0.5)}, {_CELL.format('y', 0.5)}, {_CELL.format('z', 0.5)}")
def _(spark, sf):
    return voxels.first_of_cubes(table(spark, sf, "points"), 0.5, ["cloud_id"]).select("point_id")


@query("snk16_sidecar_upsert", "SELECT cloud_id, list_sort(list(DISTINCT tree_id)) AS done FROM tree_records WHERE tree_id % 10 = 0 GROUP BY cloud_id")
def _(spark, sf):
    return table(spark, sf, "tree_records").filter("tree_id % 10 = 0").groupBy("cloud_id").agg(F.array_sort(F.collect_set("tree_id")).alias("done"))
