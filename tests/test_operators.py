"""Operators on small cases with known answers, and fast ways against plain ones."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovewise.functions import classes, colours, geometry, labels, texts
from grovewise.operators import components, edits, inventory, merging, neighbours, statistics, stem_fits, voxels
from grovewise.sources.synthetic import PLOTS, field_map, placed, points_of

POINTS = "point_id bigint, x float, y float, z float, tree_id int"


def cloud(spark, xyz, tree, first=0):
    n = len(xyz)
    tree = np.broadcast_to(tree, n)
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(first, first + n), "x": np.asarray(xyz)[:, 0].astype("f4"), "y": np.asarray(xyz)[:, 1].astype("f4"), "z": np.asarray(xyz)[:, 2].astype("f4"), "tree_id": tree.astype("i4")}), POINTS)


def line(*starts):
    return [(s + k / 10, 0.0, 0.0) for s in starts for k in range(5)]


@pytest.fixture(scope="module")
def three(spark):
    xyz = [*line(0.0, 1.0, 10.0), (0.6, 0, 0), (0.7, 0, 0), (0.8, 0, 0)]
    return cloud(spark, xyz, [1] * 5 + [2] * 5 + [3] * 5 + [0] * 3)


def ids(df, c="point_id"):
    return sorted(r[c] for r in df.collect())


# -- labels and records ----------------------------------------------------------


def test_sentinels(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, -(2**31), -7, -1, 0, 2**32 - 1, 2**31 - 1, None)], "v bigint")
    assert [r[0] for r in df.select(labels.normal_label(F.col("v"))).collect()] == [1, 2, 0, 0, -1, 0, 0, 2**31 - 1, None]
    assert [r[0] for r in df.filter("v in (-1, 0, 1)").select(labels.label_to_file(F.col("v"), "unassigned")).collect()] == [1, -1, -1]
    assert labels.label_column(["x", "treeid", "label"]) == "treeid" and labels.label_column(["x"], "tree") is None and labels.label_column(["label", "ID"]) == "label"


def test_records_neighbours_and_scene(spark, three):
    got = {r["tree_id"]: (r["count"], round(r["centre_x"], 5)) for r in statistics.tree_records(three).collect()}
    assert got == {1: (5, 0.2), 2: (5, 1.2), 3: (5, 10.2)}
    assert ids(neighbours.neighbour_trees(three, 1, 1.0), "tree_id") == [2] and neighbours.neighbour_trees(three, 77, 1.0).count() == 0
    both = {(r["tree_id"], r["other_id"]) for r in neighbours.all_neighbour_trees(three, 1.0).collect()}
    assert both == {(1, 2), (2, 1)}
    assert {(r["tree_id"], r["other_id"]) for r in neighbours.boxes_overlapping(statistics.tree_records(three), 1.0, 3.0).collect()} == {(1, 2), (2, 1)}
    assert edits.scene_points(three, [1, 2], 1.0).count() == 13
    with pytest.raises(ValueError):
        edits.scene_points(three, [99])


def test_counts_bounds_shift_and_free_id(spark, three):
    assert {r["tree_id"]: r["n"] for r in statistics.label_counts(three).collect()} == {0: 3, 1: 5, 2: 5, 3: 5}
    b = statistics.bounds(three)
    assert statistics.needs_shift(b).first()["needed"] is False
    far = statistics.bounds(cloud(spark, [(204277.4, 7223248.0, 1.0)], 1))
    assert statistics.needs_shift(far).first()["needed"] is True and statistics.needs_shift(far).first()["shift_x"] == -204277
    edge = spark.createDataFrame([(-1e4, 0.0, 0.0, 1e4, 0.0, 0.0)], "lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    assert statistics.needs_shift(edge).first()["needed"] is False
    assert statistics.needs_shift(statistics.bounds(three.limit(0))).first()["needed"] is False
    assert statistics.free_id(three).first()[0] == 4 and statistics.free_id(three.limit(0)).first()[0] == 1
    assert statistics.free_id(cloud(spark, [(0, 0, 0)], -1)).first()[0] == 1


def test_incremental_records_equal_a_rebuild(spark, three):
    before = statistics.tree_records(three)
    now = three.withColumn("tree_id", F.when(F.col("x") > 1.15, 1).otherwise(F.col("tree_id")))
    touched = spark.createDataFrame([(1,), (2,), (3,)], "tree_id int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(statistics.updated_records(before, now, touched)) == rows(statistics.tree_records(now))


def test_progress_and_order(spark):
    trees = spark.createDataFrame([(t,) for t in (2, 5, 7, 9)], "tree_id int")
    done = spark.createDataFrame([(7,), (7,), (99,)], "tree_id int")
    assert tuple(statistics.done_progress(trees, done).first()) == (1, 4, 25)
    assert tuple(statistics.done_progress(trees.limit(0), done).first()) == (0, 0, 0)
    assert tuple(merging.review_order(trees, done, 5).first()) == (7, 2, 9)
    assert tuple(merging.review_order(trees, done, 9).first()) == (2, 7, 2)


# -- geometry ------------------------------------------------------------------


def _inside(px, py, ring):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
        if y0 != y1 and min(y0, y1) <= py < max(y0, y1) and px < (py - y0) * (x1 - x0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def test_polygon_equals_the_loop(spark):
    star = [(50 + (40 if k % 2 else 12) * math.cos(k * math.pi / 7.5), 50 + (40 if k % 2 else 12) * math.sin(k * math.pi / 7.5)) for k in range(15)]
    rng = np.random.default_rng(11)
    p = pd.DataFrame(rng.uniform(-20, 120, (2000, 2)), columns=["x", "y"])
    p.loc[:20, "y"] = 50.0
    df = spark.createDataFrame(p)
    for ring in (star, [(0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (50.0, 20.0), (0.0, 60.0), (0.0, 60.0)], star[:2]):
        want = sum(len(ring) >= 3 and _inside(r.x, r.y, ring) for r in p.itertuples())
        assert df.filter(geometry.in_polygon(F.col("x"), F.col("y"), ring)).count() == want
        lit = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
        assert df.filter(geometry.in_ring(F.col("x"), F.col("y"), lit)).count() == want


def test_paths_boxes_and_cylinders(spark):
    path = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (3.0, 0.0), (4.0, 4.0), (4.0, 5.0)],), ([],)], "p array<struct<x double, y double>>")
    got = [[tuple(v) for v in r[0]] for r in path.select(geometry.thinned_path(F.col("p"))).collect()]
    assert got == [[(0.0, 0.0), (3.0, 0.0), (4.0, 4.0)], []]
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "tree_id int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    edges = geometry.box_edges(box).toPandas()
    assert len(edges) == 12 and (np.abs(edges.x1 - edges.x0) + np.abs(edges.y1 - edges.y0) + np.abs(edges.z1 - edges.z0)).sum() == 4 * (1 + 2 + 3)
    stem = spark.createDataFrame([("a", 1.0, 2.0, 5.0, 0.5, 10.0), ("b", 0.0, 0.0, None, 0.0, None)], "stem_id string, x double, y double, base_z double, dbh double, height double")
    seg = geometry.cylinder_segments(stem).toPandas()
    a = seg[seg.stem_id == "a"].sort_values("seq")
    assert len(a) == 52 and sorted(set(a.z0.round(3))) == [5.0, 6.3, 15.0] and np.allclose(np.hypot(a.x0 - 1, a.y0 - 2), 0.25)
    assert np.allclose(np.hypot(seg[seg.stem_id == "b"].x0, seg[seg.stem_id == "b"].y0), 0.125)


def test_projection_and_pick(spark, three):
    m = [[10.0, 0, 0, 0], [0, 10.0, 0, 0], [0, 0, 1.0, 0], [5.0, 5.0, 0, 1.0]]
    cx, cy, depth, ok = geometry.projected(F.col("x"), F.col("y"), F.col("z"), m)
    c = three.select("point_id", cx.alias("cx"), cy.alias("cy"), depth.alias("d"), ok.alias("ok"))
    assert c.filter("ok").count() == 18 and c.filter("point_id = 10").first()["cx"] == pytest.approx(105.0)
    at = lambda x: neighbours.picked(c, F.col("cx"), F.col("cy"), F.col("d"), F.col("ok"), (x, 5.0)).collect()
    assert at(128.0)[0][0] == 14 and at(200.0) == [] and at(5.0)[0][0] == 0


# -- voxels, neighbours, components ----------------------------------------------


def test_voxels_keep_the_middle_point_or_the_first(spark):
    g = np.array([(i, j, k) for i in range(20) for j in range(20) for k in range(4)]) * 0.005
    assert voxels.thinned(cloud(spark, g, 1), 0.02).count() == 25
    tie = cloud(spark, [(0.0, 0, 0), (1.0, 1.0, 1.0), (0.2, 0.5, 0.5), (0.8, 0.5, 0.5)], 1)
    assert ids(voxels.thinned(tie, 1.0)) == [1, 2]
    with pytest.raises(ValueError):
        voxels.thinned(tie, 0.0)
    assert voxels.thinned(tie.limit(0), 1.0).count() == 0
    nulls = spark.createDataFrame([(1, None, 1.0, 1.0, 1), (2, 1.0, 1.0, 1.0, 1)], POINTS)
    assert ids(voxels.thinned(nulls, 1.0)) == [2] and ids(voxels.first_of_cubes(nulls, 1.0)) == [2]


def test_spacing_and_thinning_decision(spark):
    grid = np.array([(i, j, k) for i in range(10) for j in range(10) for k in range(3)]) * 0.5
    assert voxels.spacing(cloud(spark, grid, 1), 0.1).first()[0] == pytest.approx(0.5)
    assert voxels.spacing(cloud(spark, [(0, 0, 0)] * 3, 1), 0.1).first()[0] == voxels.NO_SPACING
    dense = cloud(spark, np.array([(i, j, k) for i in range(12) for j in range(12) for k in range(3)]) * 0.005, 1)
    assert voxels.block_spacing(dense, 1.0, 0.01).first()[0] == pytest.approx(0.005, rel=0.05)
    assert voxels.decide_thinning(dense, ask=lambda s, v, k: v, edge=1.0).voxel == voxels.USUAL_VOXEL
    assert voxels.decide_thinning(dense, {"voxel_size": None}).voxel is None and voxels.decide_thinning(dense, far=True).offered is None
    assert voxels.decide_thinning(cloud(spark, grid, 1), edge=10.0).offered is None
    assert voxels.kept_share(dense.limit(0), 1.0, 0.02).first()[0] is None


def test_pairs_and_nearest_equal_comparing_all(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(0, 0.3, (120, 3)), rng.uniform(-3, 3, (60, 3)), [[50.0, 50, 50]], np.zeros((3, 3))]).astype("f4")
    df = cloud(spark, xyz, 1)
    d = np.sqrt(((xyz[:, None].astype("f8") - xyz[None].astype("f8")) ** 2).sum(axis=2))
    got = {(r["a_id"], r["b_id"]) for r in neighbours.pairs_within(df, 0.25).collect()}
    assert got == {(i, j) for i in range(len(xyz)) for j in range(i + 1, len(xyz)) if d[i, j] <= 0.25}
    np.fill_diagonal(d, np.inf)
    near = {r["point_id"]: r["distance"] for r in voxels.nearest_distances(df, 0.05).collect()}
    assert len(near) == len(xyz) and all(near[i] == pytest.approx(d[i].min(), abs=1e-9) for i in near)
    assert voxels.nearest_distances(df.limit(1), 0.05).count() == 0


def _components(xyz, eps):
    parent = list(range(len(xyz)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    for i, j in zip(*np.nonzero(d <= eps)):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(xyz))]


@pytest.mark.parametrize("exact", [True, False])
def test_components_equal_union_find(spark, exact):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 0.2, (80, 3)), rng.normal(3, 0.2, (80, 3)), [[9.0, 9, 9]], np.full((30, 3), 5.0), np.column_stack([np.arange(60) * 0.15, np.full(60, -8.0), np.zeros(60)])]).astype("f4").astype("f8")
    order = rng.permutation(len(xyz))
    xyz = xyz[order]
    want = _components(xyz, 0.2)
    got = {r["point_id"]: r["component"] for r in components.components_of(cloud(spark, xyz, 7), 0.2, exact=exact).collect()}
    if exact:
        assert [got[i] for i in range(len(xyz))] == want
    else:  # split at most, never merged
        assert all(want[i] == want[got[i]] for i in got) and len(got) == len(xyz)
    assert components.components_of(cloud(spark, xyz, 7).limit(0), 0.2, exact=exact).count() == 0


@pytest.mark.parametrize("block_rows", [10, 50_000])
def test_components_across_blocks_layers_and_keys(spark, block_rows):
    rng = np.random.default_rng(15)
    walk = np.cumsum(rng.normal(0, 0.09, (400, 3)), axis=0)
    xyz = np.concatenate([walk, rng.uniform(-4, 4, (300, 3)), np.column_stack([rng.normal(0, 0.02, (150, 2)), np.arange(150) * 0.3]), np.full((40, 3), 1.0)]).astype("f4").astype("f8")
    tree = rng.integers(1, 3, len(xyz))
    df = cloud(spark, xyz, tree, first=1000)
    df = df.withColumn("tree_id", F.when(F.col("tree_id") == 2, F.col("tree_id"))).unionByName(spark.createDataFrame([(1, None, 1.0, 1.0, 1), (2, float("nan"), 1.0, 1.0, 1), (3, float("inf"), 1.0, 1.0, 1)], POINTS))
    got = {r["point_id"]: r["component"] for r in components.components_of(df, 0.31, block_rows=block_rows).collect()}
    want = {}
    for t in (1, 2):
        at = np.flatnonzero(tree == t)
        own = _components(xyz[at], 0.31)
        want |= {1000 + int(at[i]): 1000 + int(at[r]) for i, r in enumerate(own)}
    assert got == want
    split = {r["point_id"]: r["component"] for r in components.components_of(df, 0.31, exact=False, block_rows=block_rows).collect()}
    assert set(split) == set(want) and all(want[i] == want[split[i]] for i in split)
    alike = {r["point_id"]: r["component"] for r in components.components_of(df, 0.0, block_rows=block_rows).collect()}
    assert len(alike) == len(want) and len(set(alike.values())) == len(np.unique(np.column_stack([xyz, tree]), axis=0))


def test_patch_and_gap_ladder(spark):
    blob = [(k % 5 * 0.01, k // 5 * 0.01, 0.0) for k in range(20)]
    xyz = blob + [(x + 0.09, y, z) for x, y, z in blob] + [(5.0, 5, 5)]
    df = cloud(spark, xyz, [7] * 20 + [7] * 20 + [9])
    assert components.patch_of(df, 0, 0.04).count() == 20 and components.patch_of(df, 0, 0.06).count() == 40
    assert components.patch_of(df, 999, 0.04).count() == 0
    assert components.patch_of(df, 0, 0.06, F.col("x") > 0.05).count() == 20
    cache = components.ComponentCache(2)
    made = [cache.get(t, 1.0, 0, lambda t=t: t) for t in (1, 2, 3, 3)]
    assert made == [1, 2, 3, 3] and list(cache.kept) == [(2, 1.0, 0), (3, 1.0, 0)]


# -- stems and inventory -----------------------------------------------------------


def _cylinder(rng, d=0.42, n=1200, arc=2 * math.pi, noise=0.0, base=100.0):
    a, z = rng.uniform(0, arc, n), rng.uniform(0, 3, n)
    return np.column_stack([5 + d / 2 * np.cos(a) + rng.normal(0, noise, n) if noise else 5 + d / 2 * np.cos(a), 7 + d / 2 * np.sin(a), base + z])


def test_stem_fits(spark):
    rng = np.random.default_rng(6)
    sets = {1: _cylinder(rng), 2: _cylinder(rng, arc=math.pi / 3, noise=0.02), 3: rng.uniform(0, 3, (7, 3)), 4: np.column_stack([np.arange(600) / 100, np.zeros(600), rng.uniform(0, 3, 600)]), 5: rng.normal(0, 2, (2000, 3)) + [0, 0, 10]}
    df = cloud(spark, np.concatenate(list(sets.values())), np.concatenate([np.full(len(v), k) for k, v in sets.items()]))
    got = {r["tree_id"]: r for r in stem_fits.stem_diameters(df).collect()}
    assert got[1]["dbh"] == pytest.approx(0.42, abs=0.01) and got[1]["dbh_quality"] < 0.05 and got[1]["x"] == pytest.approx(5, abs=0.06)
    assert all(got[k]["dbh"] is None for k in (3, 4)) and (got[2]["dbh"] is None or got[2]["dbh_quality"] > 0.1)
    assert stem_fits.stem_diameters(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["open", "far"])
def test_plot_with_truth_has_no_wrong_match(spark, name):
    rng = np.random.default_rng(7)
    plot = PLOTS[name]
    trees = placed(plot, rng)
    pts = points_of(trees, plot, rng)
    local = pts.assign(x=pts.x - plot.origin[0], y=pts.y - plot.origin[1], z=pts.z - plot.origin[2])
    stats = stem_fits.tree_statistics(spark.createDataFrame(local, "point_id bigint, x double, y double, z double, tree_id int").filter("tree_id > 0")).withColumn("cloud", F.lit(1))
    stems = field_map(trees, rng)
    s = spark.createDataFrame(stems.assign(cloud=1, ordinal=range(len(stems))))
    shift = inventory.fit_shifts(s.select("cloud", "stem_id", "x", "y"), stats.select("cloud", "tree_id", "x", "y")).first()
    assert abs(shift["dx"] + plot.origin[0]) < 0.6 and abs(shift["dy"] + plot.origin[1]) < 0.6 and shift["matched"] >= len(trees) - 4
    moved = s.withColumn("x", F.col("x") + shift["dx"]).withColumn("y", F.col("y") + shift["dy"])
    got = inventory.greedy_matches(inventory.candidate_pairs(stats, moved)).collect()
    assert len(got) >= len(trees) - 4 and all(r["stem_id"] == f"F{r['tree_id']}" for r in got)


def test_scores_and_greedy(spark):
    trees = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.3, 0.05), (1, 2, 5.0, 0.0, 12.0, 0.3, 0.3), (1, 3, 90.0, 0.0, None, None, None)], "cloud int, tree_id int, x double, y double, height double, dbh double, dbh_quality double")
    stems = spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 10.0, 0.3, "oak"), (1, "b", 2, 5.0, 1.0, 12.0, 0.9, None), (1, "c", 3, 200.0, 0.0, 9.0, 0.1, "x"), (1, "d", 4, None, 0.0, 9.0, 0.1, "x")], "cloud int, stem_id string, ordinal int, x double, y double, height double, dbh double, species string")
    pairs = inventory.candidate_pairs(trees, stems)
    got = {(r["tree_id"], r["stem_id"]): r for r in pairs.collect()}
    assert got[1, "a"]["score"] == 0 and got[1, "a"]["used"] == ["position", "height", "dbh"] and got[2, "b"]["used"] == ["position", "height"]
    assert got[2, "b"]["score"] == pytest.approx(math.sqrt(0.25 / 2)) and not any(k[0] == 3 or k[1] in "cd" for k in got)
    assert {(r["tree_id"], r["stem_id"]) for r in inventory.greedy_matches(pairs).collect()} == {(1, "a"), (2, "b")}
    assert inventory.candidate_pairs(trees, stems, exclude=spark.createDataFrame([("a",)], "stem_id string")).filter("stem_id = 'a'").count() == 0
    assert [r["stem_id"] for r in inventory.best_candidates(pairs, 1).filter("tree_id = 1").collect()] == ["a"]
    links = spark.createDataFrame([(1, 3, "c"), (1, 9, "a"), (1, 3, "zz")], "cloud int, tree_id int, stem_id string")
    both = {(r["tree_id"], r["stem_id"], r["matched_by"]) for r in inventory.all_matches(trees, stems, links.limit(1)).collect()}
    assert both == {(3, "c", "manual"), (1, "a", "auto"), (2, "b", "auto")} and inventory.linked_matches(links, trees, stems).count() == 1
    table = inventory.match_table(inventory.linked_matches(links, trees, stems).withColumn("matched_by", F.lit("manual"))).first()
    assert table["distance_m"] == "110.000" and table["dbh_diff_m"] == "" and table["stem_x"] == "200.000"
    assert inventory.fit_shifts(stems.limit(0).select("cloud", "stem_id", "x", "y"), trees).count() == 0


# -- edits -----------------------------------------------------------------------


def test_edits_undo_redo_and_difference(spark, tmp_path):
    p = cloud(spark, np.zeros((12, 3)), [1] * 4 + [2] * 4 + [3] * 4).withColumn("cls", F.lit(1))
    s = edits.Scene(p)
    pick = lambda *i: spark.createDataFrame([(k,) for k in i], "point_id bigint")
    count = lambda: {r["tree_id"]: r["n"] for r in statistics.label_counts(s.current()).collect()}
    assert s.reassign(pick(0, 1, 1, 4), 2) == 2 and count() == {1: 2, 2: 6, 3: 4}
    assert s.reassign(pick(0), 2) == 0 and s.reassign(pick(99), 5) == 0 and len(s.done) == 1
    assert s.set_class(pick(8, 9), 4) == 2 and s.create_new(pick(8)) == 4 and s.create_new(pick(9)) == 5
    with pytest.raises(ValueError):
        s.switch_class_column("cls")
    assert s.undo() and s.undo() and count() == {1: 2, 2: 6, 3: 4} and s.redo() and count()[4] == 1
    assert s.mark_noise(pick(11)) == 1 and not s.redo() and count()[-1] == 1
    assert ids(s.last_changed()) == [11] and ids(s.target_of(pick(), 2)) == [0, 1, 4, 5, 6, 7] and s.target_of(pick(), None).count() == 0
    store = edits.Snapshots(p, str(tmp_path / "versions"))
    assert store.save(s.current()) == 4 and store.save(s.current()) == 0 and store.version == 1
    assert store.save_as(s.current(), str(tmp_path / "other")) == 0
    assert sorted(r["tree_id"] for r in store.at().collect()) == sorted(r["tree_id"] for r in s.current().collect())
    assert store.at(0).filter("tree_id = 4").count() == 0


def test_history_equals_plain_stacks():
    rng = random.Random(8)
    for _ in range(200):
        ops = [rng.choice(["do", "do", "undo", "redo"]) for _ in range(rng.randrange(20))]
        done, undone, n = [], [], 0
        for op in ops:
            if op == "do":
                n += 1
                done, undone = [*done, n], []
            elif op == "undo" and done:
                undone.append(done.pop())
            elif op == "redo" and undone:
                done.append(undone.pop())
        assert edits.active_edits(ops) == done


def test_whole_moves_and_expansion(spark):
    codes = spark.createDataFrame([(7, -1)] * 3 + [(8, 3), (8, 8)] + [(0, 5)] * 2, "before int, after int")
    assert {r["code"]: r["new"] for r in edits.whole_moves(codes, "before", "after").collect()} == {7: -1}
    assert {r["code"]: r["new"] for r in edits.whole_moves(codes, "before", "after", trees_only=False).collect()} == {7: -1, 0: 5}
    ground = [(i + 0.5, j + 0.5, 0.5) for i in range(6) for j in range(6)]
    strays = [(i + 0.3, 2.4, 0.5) for i in range(4)]
    block = [(2 + i * 0.25, 2 + j * 0.25, 5 + k * 0.25) for i in range(4) for j in range(4) for k in range(4)]
    full = cloud(spark, ground + strays + block, [0] * 36 + [1] * 68).withColumnRenamed("tree_id", "code")
    kept = voxels.thinned(full.withColumn("tree_id", F.lit(1)), 1.0)
    work = full.join(kept, "point_id", "left_semi").withColumn("before", F.col("code"))
    whole = edits.expanded(full, work.withColumn("after", F.when(F.col("code") == 1, 0).otherwise(F.col("before"))), 1.0)
    assert ids(whole) == list(range(36, 104)) and {r["new"] for r in whole.collect()} == {0}
    part = edits.expanded(full, work.withColumn("after", F.when((F.col("code") == 1) & (F.col("x") > 2.6), 9).otherwise(F.col("before"))), 1.0)
    changed = set(ids(part))
    assert not changed & set(range(36)) and changed <= set(range(36, 104))
    assert edits.expanded(full, work.withColumn("after", F.col("before")), 1.0).count() == 0


def test_click_chains_and_links(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 2.0, 20.0, 0.0), (3, 4.4, 45.0, 0.0), (4, 5.0, 90.0, 0.0), (5, 8.0, 90.0, 0.0)]
    clicks = spark.createDataFrame(rows, "click_id int, t double, x double, y double").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r["click_id"], r["chain"], r["step"]) for r in edits.click_chains(clicks).orderBy("click_id").collect()] == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 0), (5, 3, 0)]
    links = spark.createDataFrame([(1, "a"), (2, "b")], "tree_id int, stem_id string")
    assert sorted(map(tuple, edits.linked(links, 1, "b").collect())) == [(1, "b")] and edits.unlinked(links, 2).count() == 1


# -- sets of files, texts, colours, classes ------------------------------------------


def test_names_mappings_and_problems(spark):
    one = lambda f, rows: [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(f(F.col("t"))).collect()]
    names = ["tree_7.ply", "a/tree_007.las", "plot12_tree_7.ply", "cloud.ply", "x_99999999999.ply", ".ply"]
    assert one(texts.tree_in_name, names) == [7, 7, 7, None, None, None]
    assert one(lambda c: texts.tree_in_name(c, r"t(\d+)"), ["plot_t12.ply"]) == [12] and one(lambda c: texts.tree_in_name(c, "("), ["t1"]) == [None]
    lines = spark.createDataFrame([(1, "path", "tree_id"), (2, "a/x.ply", "4.0"), (3, "# c", "5"), (4, "b/x.ply", "6"), (5, "", "7"), (6, "y.ply", "nan")], "line_no int, path string, value string")
    assert {r["key"]: r["tree_id"] for r in merging.mapping_entries(lines).collect()} == {"a/x.ply": 4, "x.ply": 6, "b/x.ply": 6}
    src = spark.createDataFrame([("a/x.ply",), ("c/x.ply",), ("tree_9.ply",), ("ground_3.ply",), ("none.ply",)], "path string")
    plan = merging.planned_sources(src, merging.mapping_entries(lines), spark.createDataFrame([("ground_3.ply",)], "path string"))
    assert {r["path"]: r["tree_id"] for r in plan.collect()} == {"a/x.ply": 4, "c/x.ply": 6, "tree_9.ply": 9, "ground_3.ply": 0, "none.ply": None}
    bad = spark.createDataFrame([("a.ply", 1), ("b.las", 1), ("g.ply", 0), ("h.ply", 0), ("c.ply", None)], "path string, tree_id int")
    assert sorted((r["problem"], r["tree_id"], r["n"]) for r in merging.source_problems(bad).collect()) == [("clash", 1, 2), ("missing", None, 1), ("mixed", None, 2)]
    assert [r["problem"] for r in merging.source_problems(bad.limit(0)).collect()] == ["empty"]
    assert [r["problem"] for r in merging.source_problems(spark.createDataFrame([("a.txt", 1)], "path string, tree_id int")).collect()] == ["unreadable"]


def test_ages_versions_and_lengths(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    rows = ["2024-03-10 11:59:30", "2024-03-10 11:55:00", "2024-03-10 09:00:00", "2024-03-09 10:00:00", "2024-03-06 12:00:00", "2024-01-01 00:00:00", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(texts.age(F.col("t").cast("timestamp"), now)).collect()] == ["just now", "5 min ago", "3 hr ago", "yesterday", "4 days ago", "2024-01-01", ""]
    rel = spark.createDataFrame([("0.6", False), ("0.6.1", True), ("0.5.9", False), ("0.6.0.dev1", False)], "version string, yanked boolean")
    assert merging.latest_release(rel).first()[0] == "0.6"


def test_colours(spark):
    df = spark.createDataFrame([(200, 0, 0), (0, 200, 0), (0, 0, 0), (0, 0, 0)], "r int, g int, b int")
    got = sorted((r["r"], r["g"], r["tree_id"]) for r in colours.labels_from_colours(df, "r", "g", "b").collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 200, 2), (200, 0, 3)]
    one = spark.createDataFrame([(5,), (0,), (-1,)], "t int")
    rows = one.select(colours.saved_colour(F.col("t")).alias("s"), colours.display_colour(F.col("t"), faded=F.col("t") == 5).alias("d")).collect()
    assert rows[1]["s"] == [0, 0, 0] == rows[2]["s"] and rows[0]["d"][3] == colours.FADED and rows[1]["d"][:3] == [0.4, 0.41, 0.43]
    source = one.select(colours.display_colour(F.col("t"), F.array(F.lit(255), F.lit(0), F.lit(0))).alias("d")).first()["d"]
    assert source[0] > 0.7 and source[1] < 0.4 and source[2] < 0.4
    flat = one.select(colours.ramp_colour(F.col("t"), F.lit(3.0), F.lit(3.0)).alias("c")).first()["c"]
    assert [round(v, 3) for v in flat] == list(colours.RAMP[5])


def test_palette_of_classes(spark):
    names = {1: " Trunk", 2: "Leaf-off", 3: "x", 4: None, 200: "Wall"} | {k: "x" for k in range(20, 33)}
    df = spark.createDataFrame([*names.items(), (3, "x"), (None, "wood")], "code int, name string")
    got = {r["code"]: (r["r"], r["g"], r["b"]) for r in colours.class_palette(df).collect()}
    assert set(got) == set(names) and got[1] == (0.55, 0.33, 0.16) and got[2] == (0.2, 0.7, 0.25) and got[200] == (0.8, 0.3, 0.3)
    others = [got[k] for k in sorted(set(names) - {1, 2, 200})]
    assert others[:12] == colours.PALETTE and len(set(others)) == 15
    assert colours.class_palette(df.limit(0)).count() == 0



def test_classes():
    assert classes.class_bounds("ubyte") == (-(2**24), 2**24) and classes.class_bounds("uchar", packed=True) == (0, 31)
    assert classes.setup_problems([("1", "a"), ("2", "b")], 0, 31) == []
