"""Queries of derived columns and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovewise.functions import classes, colours, geometry, labels, texts
from grovewise.operators import edits, statistics
from grovewise.operators.bad_rows import bare_line, opens_well, whole_fields_of
from grovewise.operators.neighbours import picked
from grovewise.plans.bounded import broadcast_bounded
from grovewise.queries.registry import G, P, Queries, given_points, points, rounded, table

query = Queries()
QUERIES, SQL = query.QUERIES, query.SQL

MATRIX = [[12.0, 1.0, 0.2, 0.002], [-1.0, 11.0, 0.3, 0.001], [0.5, -9.0, 1.0, 0.003], [40.0, 300.0, 5.0, 0.9]]
LASSO = [(100.0, 150.0), (700.0, 180.0), (650.0, 650.0), (400.0, 320.0), (150.0, 700.0), (60.0, 400.0)]
STAR = [(30.0, 5.0), (38.0, 24.0), (58.0, 26.0), (42.0, 38.0), (48.0, 57.0), (30.0, 46.0), (12.0, 57.0), (18.0, 38.0), (2.0, 26.0), (22.0, 24.0)]


def _ring_sql(ring, x: str, y: str) -> str:
    """The even-odd test as SQL, edge by edge."""
    edges = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    parts = [f"(CASE WHEN {y} >= {min(a[1], b[1])}::DOUBLE AND {y} < {max(a[1], b[1])}::DOUBLE AND {x} < ({y} - {a[1]}::DOUBLE) * ({b[0]}::DOUBLE - {a[0]}::DOUBLE) / ({b[1]}::DOUBLE - {a[1]}::DOUBLE) + {a[0]}::DOUBLE THEN 1 ELSE 0 END)" for a, b in edges]
    return "((" + " + ".join(parts) + ") % 2 = 1)"


def _canvas_sql() -> str:
    m = MATRIX
    col = lambda k: f"(x::DOUBLE * {m[0][k]}::DOUBLE + y::DOUBLE * {m[1][k]}::DOUBLE + z::DOUBLE * {m[2][k]}::DOUBLE + {m[3][k]}::DOUBLE)"
    return f"SELECT point_id, tree_id, {col(0)} / (CASE WHEN {col(3)} > 0 THEN {col(3)} ELSE 1 END) AS cx, {col(1)} / (CASE WHEN {col(3)} > 0 THEN {col(3)} ELSE 1 END) AS cy, {col(2)} / (CASE WHEN {col(3)} > 0 THEN {col(3)} ELSE 1 END) AS depth, {col(3)} > 0 AS ok FROM {G}"


def _canvas(spark, sf):
    g = given_points(spark, sf)
    cx, cy, depth, ok = geometry.projected(F.col("x"), F.col("y"), F.col("z"), MATRIX)
    return g.select("point_id", "tree_id", cx.alias("cx"), cy.alias("cy"), depth.alias("depth"), ok.alias("ok"))


@query("prj01_las_decode", "SELECT point_id, round(intensity * 0.001::DOUBLE + 412000.0::DOUBLE, 6) AS x FROM (SELECT DISTINCT point_id, intensity FROM points)")
def _(spark, sf):
    return table(spark, sf, "points").select("point_id", "intensity").distinct().select("point_id", F.round(F.col("intensity") * 0.001 + 412000.0, 6).alias("x"))


@query("prj02_label_normalise", f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN tree_id < 0 AND tree_id <> -1 THEN 0 ELSE tree_id END AS label FROM {P}) GROUP BY label")
def _(spark, sf):
    return points(spark, sf).groupBy(labels.normal_label(F.col("tree_id")).alias("label")).agg(F.count("*").alias("n"))


@query("prj03_world_shift", f"SELECT point_id, CAST(x::DOUBLE - 30.25::DOUBLE AS FLOAT) AS x, CAST(y::DOUBLE + 1000.5::DOUBLE AS FLOAT) AS y FROM {P}")
def _(spark, sf):
    return points(spark, sf).select("point_id", statistics.shifted(F.col("x"), F.lit(-30.25)).alias("x"), statistics.shifted(F.col("y"), F.lit(1000.5)).alias("y"))


@query("prj04_suggested_shift", "SELECT cloud_id, CAST(-floor(min(x::DOUBLE + shift_x)) AS BIGINT) AS dx, CAST(-floor(min(y::DOUBLE + shift_y)) AS BIGINT) AS dy FROM points JOIN clouds USING (cloud_id) GROUP BY cloud_id")
def _(spark, sf):
    clouds = broadcast_bounded(table(spark, sf, "clouds").select("cloud_id", "shift_x", "shift_y"))
    lows = table(spark, sf, "points").groupBy("cloud_id").agg(F.min(F.col("x").cast("double")).alias("x"), F.min(F.col("y").cast("double")).alias("y"))
    return lows.join(clouds, "cloud_id").select("cloud_id", (-F.floor(F.col("x") + F.col("shift_x"))).alias("dx"), (-F.floor(F.col("y") + F.col("shift_y"))).alias("dy"))


@query("prj05_class_decode", f"SELECT point_id, CAST(least(31, greatest(0, round_even(coalesce(intensity, 0) / 100.0::DOUBLE, 0))) AS INTEGER) AS clipped, intensity & 31 AS packed FROM {P}")
def _(spark, sf):
    return points(spark, sf).select("point_id", classes.class_value(F.coalesce("intensity", F.lit(0)) / 100.0, 0, 31).alias("clipped"), classes.class_value(F.col("intensity"), 0, 31, packed=True).alias("packed"))


@query("prj06_class_bits", f"SELECT point_id, (intensity & ~31) | (cls & 31) AS bits FROM {P}")
def _(spark, sf):
    return points(spark, sf).select("point_id", classes.class_bits(F.col("intensity"), F.col("cls")).alias("bits"))


@query("prj07_class_bounds", "SELECT * FROM (VALUES ('char', -128, 127), ('uchar', 0, 255), ('short', -32768, 32767), ('ushort', 0, 65535), ('int', -2147483648, 2147483647), ('uint', 0, 2147483647), ('float', -16777216, 16777216), ('packed', 0, 31)) t(kind, low, high)")
def _(spark, sf):
    kinds = ["char", "uchar", "short", "ushort", "int", "uint", "float"]
    return spark.createDataFrame([(k, *classes.class_bounds(k)) for k in kinds] + [("packed", *classes.class_bounds("uchar", True))], "kind string, low int, high int")


@query("prj08_pack_rgb", f"SELECT point_id, ((intensity % 256) << 16) | ((cls * 37 % 256) << 8) | (abs(tree_id::BIGINT) % 256)::INTEGER AS rgb FROM {P}")
def _(spark, sf):
    return points(spark, sf).select("point_id", colours.pack_rgb(F.col("intensity") % 256, F.col("cls") * 37 % 256, F.abs(F.col("tree_id").cast("long")) % 256).alias("rgb"))


@query("prj09_unpack_rgb", f"SELECT point_id, (intensity * 4099 >> 16) & 255 AS r, (intensity * 4099 >> 8) & 255 AS g, intensity * 4099 & 255 AS b FROM {P}")
def _(spark, sf):
    rgb = colours.unpack_rgb((F.col("intensity") * 4099).cast("int"))
    return points(spark, sf).select("point_id", *[F.get(rgb, i).alias(n) for i, n in enumerate("rgb")])


@query("prj10_tree_class_key", f"SELECT tree_id, cls, count(*) AS n FROM {P} GROUP BY tree_id, cls")
def _(spark, sf):
    return points(spark, sf).groupBy("tree_id", "cls").agg(F.count("*").alias("n"))


@query("prj11_voxel_cell", f"""SELECT point_id, CAST(floor(rx) AS BIGINT) AS i, CAST(floor(ry) AS BIGINT) AS j, CAST(floor(rz) AS BIGINT) AS k FROM (SELECT point_id, (x - lx) / 0.25::FLOAT AS rx, (y - ly) / 0.25::FLOAT AS ry, (z - lz) / 0.25::FLOAT AS rz FROM {G} JOIN
 (SELECT cloud_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM {G} GROUP BY cloud_id) USING (cloud_id))""")
def _(spark, sf):
    from grovewise.operators.voxels import with_voxel

    return with_voxel(given_points(spark, sf), 0.25, ["cloud_id"]).select("point_id", F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("_k").alias("k"))


@query("prj12_gap_cells", f"SELECT tree_id, count(DISTINCT (CAST(floor(x::DOUBLE / 0.1) AS BIGINT), CAST(floor(y::DOUBLE / 0.1) AS BIGINT), CAST(floor(z::DOUBLE / 0.1) AS BIGINT))) AS cells FROM {G} GROUP BY tree_id")
def _(spark, sf):
    cell = [F.floor(F.col(a).cast("double") / 0.1).alias(f"c{a}") for a in "xyz"]
    return given_points(spark, sf).select("tree_id", *cell).distinct().groupBy("tree_id").agg(F.count("*").alias("cells"))


@query("prj13_projection", f"SELECT point_id, round(cx, 4) AS cx, round(cy, 4) AS cy, ok FROM ({_canvas_sql()})")
def _(spark, sf):
    return _canvas(spark, sf).select("point_id", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "ok")


_HSV = """CASE CAST(floor(h * 6) AS INTEGER) % 6 WHEN 0 THEN [v, t, p] WHEN 1 THEN [q, v, p] WHEN 2 THEN [p, v, t] WHEN 3 THEN [p, q, v] WHEN 4 THEN [t, p, v] ELSE [v, p, q] END"""
_IDS = "(SELECT DISTINCT tree_id, tree_id::DOUBLE * 0.61803398875::DOUBLE - floor(tree_id::DOUBLE * 0.61803398875::DOUBLE) AS h, tree_id::DOUBLE * 0.41421356237::DOUBLE - floor(tree_id::DOUBLE * 0.41421356237::DOUBLE) AS fs, tree_id::DOUBLE * 0.73205080757::DOUBLE - floor(tree_id::DOUBLE * 0.73205080757::DOUBLE) AS fv FROM points WHERE tree_id > 0)"


@query("prj14_saved_colour", f"""SELECT tree_id, CAST(round_even(rgb[1] * 255, 0) AS INTEGER) AS r, CAST(round_even(rgb[2] * 255, 0) AS INTEGER) AS g, CAST(round_even(rgb[3] * 255, 0) AS INTEGER) AS b FROM
 (SELECT tree_id, {_HSV} AS rgb FROM (SELECT *, 0.95::DOUBLE AS v, 0.33::DOUBLE AS p, 0.95::DOUBLE * (1 - f * 0.65::DOUBLE) AS q, 0.95::DOUBLE * (1 - (1 - f) * 0.65::DOUBLE) AS t FROM (SELECT *, h * 6 - floor(h * 6) AS f FROM {_IDS})))""")
def _(spark, sf):
    rgb = colours.saved_colour(F.col("tree_id"))
    return table(spark, sf, "points").select("tree_id").filter("tree_id > 0").distinct().select("tree_id", *[F.get(rgb, i).alias(n) for i, n in enumerate("rgb")])


@query("prj15_display_colour", f"""SELECT tree_id, round(rgb[1], 6) AS r, round(rgb[2], 6) AS g, round(rgb[3], 6) AS b FROM (SELECT tree_id, {_HSV} AS rgb FROM (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM
 (SELECT *, h * 6 - floor(h * 6) AS f, 0.70::DOUBLE + 0.28::DOUBLE * fs AS s, 0.80::DOUBLE + 0.20::DOUBLE * fv AS v FROM {_IDS})))""")
def _(spark, sf):
    rgb = colours.display_colour(F.col("tree_id"))
    return table(spark, sf, "points").select("tree_id").filter("tree_id > 0").distinct().select("tree_id", *[F.round(F.get(rgb, i), 6).alias(n) for i, n in enumerate("rgb")])


@query("prj16_class_palette", "SELECT * FROM (VALUES (0, 0.6, 0.61, 0.63), (2, 0.78, 0.66, 0.45), (3, 0.62, 0.82, 0.25), (4, 0.2, 0.7, 0.25), (5, 0.55, 0.33, 0.16), (7, 0.9, 0.62, 0.0)) t(code, r, g, b)")
def _(spark, sf):
    names = {0: "Never classified", 2: "Ground", 3: "Low vegetation", 4: "Leaves", 5: "Wood", 7: "Low point (noise)"}
    return colours.class_palette(spark.createDataFrame(list(names.items()), "code int, name string"))


@query("prj17_scalar_ramp", f"""SELECT point_id, round(stops[k + 1][1] * (1 - (t - k)) + stops[k + 2][1] * (t - k), 5) AS r, round(stops[k + 1][3] * (1 - (t - k)) + stops[k + 2][3] * (t - k), 5) AS b FROM
 (SELECT *, CAST(least(floor(t), 9) AS INTEGER) AS k, {[list(s) for s in colours.RAMP]} AS stops FROM (SELECT point_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (intensity - 500)::DOUBLE / 3500)) * 10 AS t FROM {P} WHERE intensity IS NOT NULL))""")
def _(spark, sf):
    rgb = colours.ramp_colour(F.col("intensity"), F.lit(500.0), F.lit(4000.0))
    return points(spark, sf).filter("intensity is not null").select("point_id", F.round(F.get(rgb, 0), 5).alias("r"), F.round(F.get(rgb, 2), 5).alias("b"))


@query("prj18_class_colour", f"SELECT point_id, CASE cls WHEN 1 THEN 0.55 WHEN 2 THEN 0.78 ELSE 0.4 END::DOUBLE AS r, CASE WHEN tree_id IN (3, 17) THEN 0.32 ELSE 1.0 END::DOUBLE AS alpha FROM {P}")
def _(spark, sf):
    rgba = colours.class_colour(F.col("cls"), {1: (0.55, 0.33, 0.16), 2: (0.78, 0.66, 0.45)}, faded=F.col("tree_id").isin(3, 17))
    return points(spark, sf).select("point_id", F.get(rgba, 0).alias("r"), F.get(rgba, 3).alias("alpha"))


@query("prj19_alignment_apply", "SELECT DISTINCT stem_uid, round(x + 1.25::DOUBLE, 6) AS x, round(y - 0.75::DOUBLE, 6) AS y FROM stems")
def _(spark, sf):
    return table(spark, sf, "stems").select("stem_uid", F.round(F.col("x") + 1.25, 6).alias("x"), F.round(F.col("y") - 0.75, 6).alias("y")).distinct()


@query("prj20_stem_label", "SELECT DISTINCT stem_uid, CASE WHEN coalesce(species, '') = '' THEN stem_id ELSE stem_id || ' (' || species || ')' END AS label FROM stems")
def _(spark, sf):
    return table(spark, sf, "stems").select("stem_uid", texts.stem_label(F.col("stem_id"), F.col("species")).alias("label")).distinct()


@query("prj21_stem_cylinders", """SELECT stem_uid, CAST(seq AS INTEGER) AS seq, round(x + r * cos(a), 4) AS x0, round(y + r * sin(a), 4) AS y0, round(z0, 4) AS z0, round(x + r * cos(b), 4) AS x1, round(y + r * sin(b), 4) AS y1, round(z1, 4) AS z1 FROM (
 SELECT *, CASE WHEN seq < 48 THEN (seq % 16) * (2 * pi() / 16) ELSE (seq - 48) * (pi() / 2) END AS a, CASE WHEN seq < 48 THEN ((seq + 1) % 16) * (2 * pi() / 16) ELSE (seq - 48) * (pi() / 2) END AS b,
 CASE WHEN seq < 16 THEN 0 WHEN seq < 32 THEN least(1.3::DOUBLE, h * 0.5::DOUBLE) WHEN seq < 48 THEN h ELSE 0 END AS z0, CASE WHEN seq < 16 THEN 0 WHEN seq < 32 THEN least(1.3::DOUBLE, h * 0.5::DOUBLE) ELSE h END AS z1
 FROM (SELECT DISTINCT stem_uid, x, y, 0.125::DOUBLE AS r, coalesce(height, 8.0::DOUBLE) AS h FROM stems WHERE x IS NOT NULL AND y IS NOT NULL), (SELECT unnest(range(52)) AS seq))""")
def _(spark, sf):
    s = table(spark, sf, "stems").filter("x is not null and y is not null").select(F.col("stem_uid").alias("stem_id"), "x", "y", F.lit(0.0).alias("base_z"), F.lit(0.0).alias("dbh"), "height").distinct()
    return rounded(geometry.cylinder_segments(s)).withColumnRenamed("stem_id", "stem_uid")


@query("prj22_box_edges", f"""SELECT tree_id, count(*) AS edges, round(sum(sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2 + (z1 - z0) ^ 2)), 3) AS length FROM (
 SELECT tree_id, CASE WHEN i & 1 > 0 THEN hx ELSE lx END AS x0, CASE WHEN j & 1 > 0 THEN hx ELSE lx END AS x1, CASE WHEN i & 2 > 0 THEN hy ELSE ly END AS y0, CASE WHEN j & 2 > 0 THEN hy ELSE ly END AS y1, CASE WHEN i & 4 > 0 THEN hz ELSE lz END AS z0, CASE WHEN j & 4 > 0 THEN hz ELSE lz END AS z1
 FROM (SELECT tree_id, min(x)::DOUBLE AS lx, max(x)::DOUBLE AS hx, min(y)::DOUBLE AS ly, max(y)::DOUBLE AS hy, min(z)::DOUBLE AS lz, max(z)::DOUBLE AS hz FROM {P} WHERE tree_id NOT IN (0, -1) GROUP BY tree_id),
 (SELECT a.i, a.i | b.bit AS j FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest([1, 2, 4]) AS bit) b WHERE a.i & b.bit = 0)) GROUP BY tree_id""")
def _(spark, sf):
    e = geometry.box_edges(statistics.tree_records(points(spark, sf)))
    d = lambda a: (F.col(f"{a}1").cast("double") - F.col(f"{a}0").cast("double"))
    return e.groupBy("tree_id").agg(F.count("*").alias("edges"), F.round(F.sum(F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z"))), 3).alias("length"))


@query("prj23_camera_frame", f"SELECT tree_id, round(avg(x::DOUBLE), 4) AS cx, round(avg(y::DOUBLE), 4) AS cy, round(avg(z::DOUBLE), 4) AS cz, round(greatest(0.5::DOUBLE, 1.6::DOUBLE * greatest(max(x::DOUBLE) - min(x), max(y::DOUBLE) - min(y), max(z::DOUBLE) - min(z))), 4) AS distance FROM {G} GROUP BY tree_id")
def _(spark, sf):
    wide = [F.max(F.col(a).cast("double")) - F.min(F.col(a).cast("double")) for a in "xyz"]
    return given_points(spark, sf).groupBy("tree_id").agg(*[F.round(F.avg(F.col(a).cast("double")), 4).alias(f"c{a}") for a in "xyz"], F.round(F.greatest(F.lit(0.5), 1.6 * F.greatest(*wide)), 4).alias("distance"))


@query("prj24_class_names", f"SELECT DISTINCT cls, CASE cls WHEN 0 THEN 'Never classified' WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 3 THEN 'Low vegetation' WHEN 4 THEN 'Medium vegetation' WHEN 5 THEN 'High vegetation' WHEN 6 THEN 'Building' WHEN 7 THEN 'Low point (noise)' WHEN 9 THEN 'Water' ELSE 'Class ' || cls END AS name FROM {P} WHERE cls IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "points").filter("cls is not null").select("cls").distinct().select("cls", classes.class_name(F.col("cls")).alias("name"))


@query("prj25_column_pruning", f"SELECT point_id, intensity FROM {P}")
def _(spark, sf):
    return table(spark, sf, "points").select("point_id", "intensity").dropDuplicates(["point_id"])


@query("flt01_box", f"SELECT point_id FROM {P} WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 45 AND z BETWEEN 1 AND 15")
def _(spark, sf):
    p = table(spark, sf, "points")
    return p.filter(geometry.in_box([F.col(a) for a in "xyz"], (10.0, 20.0, 1.0), (30.0, 45.0, 15.0))).select("point_id").distinct()


@query("flt02_polygon", f"SELECT point_id FROM {P} WHERE {_ring_sql(STAR, 'x::DOUBLE', 'y::DOUBLE')}")
def _(spark, sf):
    p = table(spark, sf, "points")
    return p.filter(geometry.in_polygon(F.col("x"), F.col("y"), STAR)).select("point_id").distinct()


@query("flt03_lasso_select", f"SELECT point_id FROM ({_canvas_sql()}) WHERE ok AND tree_id NOT IN (0, -1) AND {_ring_sql(LASSO, 'cx', 'cy')}")
def _(spark, sf):
    c = _canvas(spark, sf)
    return c.filter(edits.shown(hide_unassigned=True) & F.col("ok") & geometry.in_polygon(F.col("cx"), F.col("cy"), LASSO)).select("point_id")


@query("flt04_path_thinning", "SELECT 41 AS drawn, 11 AS kept, 0.0::DOUBLE AS first, 40.0::DOUBLE AS last")
def _(spark, sf):
    drawn = spark.createDataFrame([([(float(k), float(k % 2)) for k in range(41)],)], "p array<struct<x double, y double>>")
    kept = geometry.thinned_path(F.col("p"), 3.9)
    return drawn.select(F.size("p").alias("drawn"), F.size(kept).alias("kept"), F.get(kept, 0)["x"].alias("first"), F.element_at(kept, -1)["x"].alias("last"))


@query("flt05_visibility", f"SELECT point_id FROM {P} WHERE tree_id NOT IN (0, -1) AND tree_id NOT IN (3, 42) AND z BETWEEN 0.5 AND 20")
def _(spark, sf):
    p = table(spark, sf, "points")
    return p.filter(edits.shown(True, [3, 42], geometry.slab(F.col("z"), 0.5, 20.0))).select("point_id").distinct()


@query("flt06_slab", f"SELECT cloud_id, count(*) AS n FROM {P} WHERE z BETWEEN 1.15 AND 1.45 GROUP BY cloud_id")
def _(spark, sf):
    p = table(spark, sf, "points")
    return p.filter(geometry.slab(F.col("z").cast("double"), 1.15, 1.45)).select("point_id", "cloud_id").distinct().groupBy("cloud_id").agg(F.count("*").alias("n"))


@query("flt07_slab_moves", "SELECT * FROM (VALUES ('start', 2.0, 4.0), ('up', 2.5, 4.5), ('thick', 1.5, 4.5), ('ended', 8.0, 10.0), ('thin', 2.99, 3.01)) t(step, low, high)")
def _(spark, sf):
    m = geometry.moved_slab
    rows = [("start", *m(2.0, 4.0, 0.0, 10.0)), ("up", *m(2.0, 4.0, 0.0, 10.0, by=1)), ("thick", *m(2.0, 4.0, 0.0, 10.0, grow=1)), ("ended", *m(2.0, 4.0, 0.0, 10.0, by=99)), ("thin", *m(2.0, 4.0, 0.0, 10.0, grow=-9))]
    return spark.createDataFrame([(s, round(a, 6), round(b, 6)) for s, a, b in rows], "step string, low double, high double")


@query("flt08_frozen_section", f"SELECT tree_id, count(*) AS n FROM {P} WHERE {_ring_sql(STAR, 'x::DOUBLE', 'y::DOUBLE')} GROUP BY tree_id")
def _(spark, sf):
    p = points(spark, sf)
    frozen = table(spark, sf, "points").filter(geometry.in_polygon(F.col("x"), F.col("y"), STAR)).select("point_id")
    return p.join(frozen, "point_id", "left_semi").groupBy("tree_id").agg(F.count("*").alias("n"))


@query("flt09_current_tree", f"SELECT point_id FROM {P} WHERE tree_id = 17 AND {_ring_sql(STAR, 'x::DOUBLE', 'y::DOUBLE')}")
def _(spark, sf):
    return table(spark, sf, "points").filter((F.col("tree_id") == 17) & geometry.in_polygon(F.col("x"), F.col("y"), STAR)).select("point_id").distinct()


@query("flt10_invert_selection", f"SELECT point_id FROM {P} WHERE tree_id NOT IN (0, -1) AND NOT coalesce(z BETWEEN 2 AND 6, false)")
def _(spark, sf):
    selected = F.coalesce(F.col("z").between(2, 6), F.lit(False))
    return table(spark, sf, "points").filter(edits.shown(True) & ~selected).select("point_id").distinct()


@query("flt11_add_selection", f"SELECT point_id FROM {P} WHERE tree_id = 3 OR z > 18")
def _(spark, sf):
    p = table(spark, sf, "points").select("point_id", "tree_id", "z")
    return p.filter("tree_id = 3").select("point_id").union(p.filter("z > 18").select("point_id")).distinct()


@query("flt12_fade_others", "SELECT DISTINCT tree_id FROM points WHERE tree_id NOT IN (0, -1, 3)")
def _(spark, sf):
    loaded = table(spark, sf, "points").filter(labels.is_tree(F.col("tree_id"))).select("tree_id").distinct()
    current = spark.createDataFrame([(3,)], "tree_id int")
    return loaded.join(F.broadcast(current), "tree_id", "left_anti")


@query("flt14_needs_shift", "SELECT cloud_id, max(greatest(abs(x::DOUBLE + shift_x), abs(y::DOUBLE + shift_y))) > 10000 AS needed FROM points JOIN clouds USING (cloud_id) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY cloud_id")
def _(spark, sf):
    clouds = broadcast_bounded(table(spark, sf, "clouds").select("cloud_id", "shift_x", "shift_y"))
    ends = table(spark, sf, "points").filter("x is not null and y is not null").groupBy("cloud_id").agg(*[f(F.col(a).cast("double")).alias(n + a) for n, f in (("l", F.min), ("h", F.max)) for a in "xy"]).join(clouds, "cloud_id")
    far = F.greatest(*[F.abs(F.col(n + a) + F.col(f"shift_{a}")) for n in "lh" for a in "xy"])
    return ends.select("cloud_id", (far > 10_000).alias("needed"))


@query("flt16_breast_height", f"SELECT tree_id, count(*) AS n FROM (SELECT tree_id, z::DOUBLE AS z, quantile_cont(z::DOUBLE, 0.01) OVER (PARTITION BY tree_id) AS b FROM {G} WHERE tree_id > 0) WHERE abs(z - b - 1.3::DOUBLE) <= 0.15::DOUBLE GROUP BY tree_id")
def _(spark, sf):
    from grovewise.operators.stem_fits import ground_levels

    g = given_points(spark, sf).filter("tree_id > 0").select("tree_id", F.col("z").cast("double").alias("z"))
    return g.join(ground_levels(g), "tree_id").filter(F.abs(F.col("z") - F.col("base_z") - 1.3) <= 0.15).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("flt18_usable_rows", """SELECT line_id, CAST(trim(f[2]) AS DOUBLE) AS x, CAST(trim(f[3]) AS DOUBLE) AS y FROM (SELECT line_id, string_split(rtrim(raw_line, chr(13)), ',') AS f FROM stem_csv_lines WHERE NOT contains(raw_line, chr(34)))
 WHERE coalesce(isfinite(TRY_CAST(trim(f[2]) AS DOUBLE)), false) AND coalesce(isfinite(TRY_CAST(trim(f[3]) AS DOUBLE)), false)""")
def _(spark, sf):
    return usable_rows(table(spark, sf, "stem_csv_lines"))


_DIGITS = "[0-9]++(?:_[0-9]++)*+"
#: A decimal number with blanks around it. A plain cast would take 1d, 0x1p3 and control characters too, and neither 1_000 nor blanks that aren't ASCII.
_COORDINATE = rf"^[\s\p{{Zs}}]*+([-+]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][-+]?{_DIGITS})?)[\s\p{{Zs}}]*+\z"


def usable_rows(lines):
    """(line_id, x, y): the lines with coordinates, whatever stands after them; fields may be quoted. A quote that breaks the fields up to y leaves none, one further on doesn't matter."""
    line = bare_line(F.col("raw_line"))
    f = F.when(opens_well(line, 3), whole_fields_of(line))
    number = lambda i: F.replace(F.regexp_extract(F.get(f, i), _COORDINATE, 1), F.lit("_"), F.lit("")).try_cast("double")
    got = lines.select("line_id", number(1).alias("x"), number(2).alias("y"))
    return got.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


@query("flt20_class_setup", "SELECT * FROM (VALUES (0, '''x'' is no whole number'), (1, '40 lies outside 0 to 31'), (2, '2 is given twice'), (3, 'the name ''Wood'' is given twice')) t(n, problem)")
def _(spark, sf):
    got = classes.setup_problems([("2", "wood"), ("x", "a"), ("40", "b"), ("2", "Wood")], 0, 31)
    return spark.createDataFrame(list(enumerate(got)), "n int, problem string")


@query("flt21_ramp_or_classes", f"SELECT count(DISTINCT cls) > 64 AS cls_ramp, count(DISTINCT intensity) > 64 AS intensity_ramp FROM {P}")
def _(spark, sf):
    return table(spark, sf, "points").agg((F.count_distinct("cls") > classes.MOST_CLASSES).alias("cls_ramp"), (F.count_distinct("intensity") > classes.MOST_CLASSES).alias("intensity_ramp"))


@query("jn18_pick_point", f"""SELECT coalesce((SELECT point_id FROM ({_canvas_sql()}) WHERE ok AND (cx - 420.0::DOUBLE) * (cx - 420.0::DOUBLE) + (cy - 360.0::DOUBLE) * (cy - 360.0::DOUBLE) <= 81 ORDER BY depth, point_id LIMIT 1),
 (SELECT point_id FROM ({_canvas_sql()}) WHERE ok AND (cx - 420.0::DOUBLE) * (cx - 420.0::DOUBLE) + (cy - 360.0::DOUBLE) * (cy - 360.0::DOUBLE) <= 729 ORDER BY (cx - 420.0::DOUBLE) * (cx - 420.0::DOUBLE) + (cy - 360.0::DOUBLE) * (cy - 360.0::DOUBLE), point_id LIMIT 1)) AS point_id""")
def _(spark, sf):
    c = _canvas(spark, sf)
    return picked(c, F.col("cx"), F.col("cy"), F.col("depth"), F.col("ok"), (420.0, 360.0))


@query("fn_age_phrase", """SELECT stem_uid, received_at, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hr ago' WHEN s // 86400 = 1 THEN 'yesterday' WHEN s // 86400 < 7 THEN (s // 86400) || ' days ago' ELSE strftime(received_at, '%Y-%m-%d') END AS age
 FROM (SELECT DISTINCT stem_uid, received_at, CAST(floor(epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(date_trunc('second', received_at))) AS BIGINT) AS s FROM stems)""")
def _(spark, sf):
    s = table(spark, sf, "stems").select("stem_uid", "received_at").distinct()
    return s.select("stem_uid", "received_at", texts.age(F.col("received_at").cast("timestamp"), F.lit("2024-02-01 12:00:00").cast("timestamp")).alias("age"))


@query("fn_scale_length", "SELECT * FROM (VALUES (0.004, 0.005, '5 mm'), (0.16, 0.2, '20 cm'), (7.4, 5.0, '5 m'), (8.0, 10.0, '10 m'), (1600.0, 2000.0, '2 km')) t(raw, nice, label)")
def _(spark, sf):
    raw = spark.createDataFrame([(0.004,), (0.16,), (7.4,), (8.0,), (1600.0,)], "raw double")
    nice = geometry.nice_length(F.col("raw"))
    return raw.select("raw", F.round(nice, 6).alias("nice"), geometry.length_text(F.round(nice, 6)).alias("label"))


@query("fn_plain_names", "SELECT DISTINCT path, regexp_replace(lower(path), '[^a-z0-9]', '', 'g') AS plain FROM clouds")
def _(spark, sf):
    return table(spark, sf, "clouds").select("path", texts.plain_name(F.col("path")).alias("plain")).distinct()
