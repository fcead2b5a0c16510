"""The general problems on small cases: nulls, empty tables, ties, repeats, clashing names."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovewise.operators.bad_rows import split_lines
from grovewise.operators.heavy_keys import distinct_counts, heavy_keys, join_counts
from grovewise.operators.proximity import near, plan_quadtree, regions_of
from grovewise.plans.quadtree import RTree
from grovewise.operators.records import latest
from grovewise.operators.schema_drift import consistent_table, file_changes, schema_changes, versions
from grovewise.operators.units import infer_units, number_in, tile_diameters, unit_in_header, unit_in_remark, unit_in_value, unit_of_word


def test_latest_takes_the_newest_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (None, 1, "e")], "k int, t int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in latest(df, ["k"], ["t"]).collect()) == [(0, "e"), (1, "c"), (2, "d")]
    assert latest(df.limit(0), ["k"], ["t"]).count() == 0


# -- a few keys holding most records -------------------------------------------


def test_counts_with_heavy_null_and_rare_keys(spark):
    rows = [(7, i) for i in range(900)] * 2 + [(None, i) for i in range(300)] + [(k, k) for k in range(100, 150)] + [(200, None)]
    df = spark.createDataFrame(rows, "label int, item int").withColumn("_n", F.lit("clash"))
    assert {r[0] for r in heavy_keys(df, "label", 0.1).collect()} == {7, None}
    got = {r["label"]: r["n"] for r in distinct_counts(df, "label", "item", share=0.1).collect()}
    assert got == {7: 900, None: 300, 200: 0} | {k: 1 for k in range(100, 150)}
    assert distinct_counts(df.limit(0), "label", "item").count() == 0
    left = spark.createDataFrame([(7,), (999,)], "label int")
    assert {r["label"]: r["n"] for r in join_counts(left, distinct_counts(df, "label", "item"), "label", "n").collect()} == {7: 900, 999: 0}


# -- points near other points or regions ---------------------------------------


@pytest.mark.parametrize("leaf_rows", [100_000, 20])
def test_near_equals_comparing_all(spark, leaf_rows):
    rng = np.random.default_rng(1)
    others = np.concatenate([rng.normal(0, 0.5, (200, 2)), rng.uniform(-10, 10, (200, 2)), np.full((60, 2), 3.0)])
    queries = np.concatenate([rng.uniform(-10, 10, (80, 2)), [[3.0, 3.0], [3.0, 3.0]]])
    o = spark.createDataFrame(pd.DataFrame(others, columns=["x", "y"]).assign(id=range(len(others)), leaf=1))
    q = spark.createDataFrame(pd.DataFrame(queries, columns=["x", "y"]).assign(id=[*range(80), 80, 80], distance="clash"))
    got = sorted((r["query_id"], r["other_id"]) for r in near(q, "id", o, "id", 1.0, leaf_rows=leaf_rows).collect())
    want = sorted((min(i, 80), j) for i, a in enumerate(queries) for j, b in enumerate(others) if math.hypot(*(a - b)) <= 1.0)
    assert got == want
    if leaf_rows == 20:
        assert plan_quadtree(o, "x", "y", 20).shards.max() > 1


def test_many_queries_of_one_place_are_spread(spark):
    rng = np.random.default_rng(7)
    others = np.concatenate([rng.uniform(-10, 10, (400, 2)), np.full((90, 2), 2.0)])
    queries = np.concatenate([np.full((300, 2), 2.0), rng.uniform(-10, 10, (20, 2))])
    o = spark.createDataFrame(pd.DataFrame(others, columns=["x", "y"]).assign(id=range(len(others))))
    q = spark.createDataFrame(pd.DataFrame(queries, columns=["x", "y"]).assign(id=range(len(queries))))
    tree = plan_quadtree(o, "x", "y", 40, queries=q, radius=0.5)
    hot = tree.leaf_of(np.array([2.0]), np.array([2.0]))[0]
    assert tree.asked[hot] >= 7 and tree.shards[hot] >= 3
    got = sorted((r["query_id"], r["other_id"]) for r in near(q, "id", o, "id", 0.5, tree=tree).collect())
    assert got == sorted((i, j) for i, a in enumerate(queries) for j, b in enumerate(others) if math.hypot(*(a - b)) <= 0.5)


def test_lots_of_probes_give_all_overlaps():
    rng = np.random.default_rng(8)
    xy, lo = rng.uniform(0, 1, (500, 2)), rng.uniform(0, 1, (200, 2))
    tree = RTree(xy[:, 0], xy[:, 1], xy[:, 0], xy[:, 1])
    boxes = lo[:, 0], lo[:, 1], lo[:, 0] + 0.4, lo[:, 1] + 0.4
    lots = list(tree.probe_lots(*boxes, most=300))
    whole = tree.probe(*boxes)
    assert len(lots) > 20 and sorted(zip(*(np.concatenate(v) for v in zip(*lots)))) == sorted(zip(*whole))


def test_near_with_nulls_and_empty_sides(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "id int, x double, y double")
    q = spark.createDataFrame([(9, 0.0, 0.5), (8, None, None)], "id int, x double, y double")
    assert [(r["query_id"], r["other_id"], r["distance"]) for r in near(q, "id", o, "id", 0.5).collect()] == [(9, 1, 0.5)]
    assert near(q.limit(0), "id", o, "id", 1.0).count() == 0 and near(q, "id", o.limit(0), "id", 1.0).count() == 0


def test_regions_hold_their_points(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 10, (300, 2)), columns=["x", "y"]).assign(id=range(300)))
    ring = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (5.0, 4.0), (1.0, 9.0)]
    r = spark.createDataFrame([("w", ring), ("thin", ring[:2]), ("bad", [(None, 1.0), *ring[1:]])], "id string, ring array<struct<x double, y double>>")
    from grovewise.functions.geometry import in_polygon

    want = sorted(x["id"] for x in p.filter(in_polygon(F.col("x"), F.col("y"), ring)).collect())
    got = regions_of(p, "id", r, "id", "ring", leaf_rows=40).collect()
    assert {x["region_id"] for x in got} == {"w"} and sorted(x["point_id"] for x in got) == want


# -- units ---------------------------------------------------------------------


def test_units_in_words_values_remarks_and_headers(spark):
    one = lambda f, texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]
    assert one(unit_of_word, ["m", "M", "metre", "cms", "mm", '"', "inch", "foot", None]) == ["m", "m", "m", "cm", "mm", "in", "in", None, None]
    assert one(unit_in_value, ["9.5\"", "m 0.094", "10.3cm.", "ca. in 4.3", "~mm 621", "1.22e-01M", "0.2", "9.9''"]) == ["in", "m", "cm", "in", "mm", "m", None, "in"]
    assert one(number_in, ["1,5 cm", ".041", "1.2e-01", "dead", "", None, "-"]) == [1.5, 0.041, 0.12, None, None, None, None]
    assert one(unit_in_remark, ["read off as cm", "metres this time", 'diam. in "', "imperial tape, inches", "calliper, mm", "leaning", "fork at 1.1 m", "dbh in m", None]) == ["cm", "m", "in", "in", "mm", None, None, "m", None]
    assert one(unit_in_header, ["Tag,x,y,DBH (in),H", "id,x,Diameter_mm", "Tag,East,DBH_metres", "stem;x;y;d;h", "id,diameter inches", "x,y"]) == ["in", "mm", "m", None, "in", None]


def test_unit_of_group_size_and_ambiguity(spark):
    rows = [(i, "a", 20.0 + i % 7, None) for i in range(20)] + [(50, "a", 0.31, None), (51, "a", 240.0, None), (52, "a", 9.0, "in"), (53, "a", None, None), (54, "b", 0.2, None), (55, None, 250.0, None)]
    df = spark.createDataFrame(rows, "id int, g string, v double, s string")
    got = {r["id"]: r for r in infer_units(df, "g", "v", "s").collect()}
    assert {got[i]["unit"] for i in range(20)} == {"cm"} and got[50]["unit"] == "m" and got[51]["unit"] == "mm" and got[52]["unit"] == "in"
    assert got[53]["unit"] is None and got[54]["unit"] == "m" and got[55]["unit"] == "mm"
    assert got[52]["metres"] == pytest.approx(0.2286) and got[3]["unit_unique"] is True
    assert infer_units(df.limit(0), "g", "v", "s").count() == 0


def test_tile_values_as_typed(spark):
    rows = [(i, "f", f"0.{150 + i}") for i in range(12)] + [(20, "f", "29.1"), (21, "f", "374 mm"), (22, "f", "n/a"), (23, "f", None), (24, "f", "9.5\"")]
    got = {r["row_id"]: r["unit"] for r in tile_diameters(spark.createDataFrame(rows, "row_id int, path string, dbh_m string")).collect()}
    assert [got[k] for k in (0, 20, 21, 22, 23, 24)] == ["m", "cm", "mm", None, None, "in"]


# -- schema drift --------------------------------------------------------------

ATTR = "array<struct<name string, type string>>"


def _files(spark, *lists, series=1):
    rows = [(i + 1, series, a, f"2024-01-0{i + 1} 00:00:00", f"2024-02-0{9 - i} 00:00:00") for i, a in enumerate(lists)]
    df = spark.createDataFrame(rows, f"source_id int, series_id int, attributes {ATTR}, written_at string, received_at string")
    return df.withColumn("written_at", F.to_timestamp("written_at")).withColumn("received_at", F.to_timestamp("received_at"))


def test_every_kind_of_change(spark):
    f = _files(
        spark,
        [("x", "float"), ("treeID", "int"), ("intensity", "ushort")],
        [("treeID", "int32"), ("x", "float32"), ("intensity", "uint16")],  # order and names of types only
        [("TreeID", "float"), ("x", "float"), ("intensity", "uint16"), ("hag", "float")],
        [("TreeID", "float"), ("x", "double"), ("intensity", "uint16"), ("gps_time", "float")],
        [("TreeID", "float"), ("x", "double")],
        None,
    )
    got = sorted((r["source_id"], r["change_kind"], r["field"]) for r in schema_changes(f.union(f)).collect())
    assert got == [(3, "added", "hag"), (3, "renamed", "TreeID"), (3, "retyped", "TreeID"), (4, "added", "gps_time"), (4, "removed", "hag"), (4, "retyped", "x"), (5, "removed", "gps_time"), (5, "removed", "intensity"), (6, "removed", "TreeID"), (6, "removed", "x")]
    assert [r["n"] for r in versions(f.union(f)).groupBy("source_id").agg(F.count("*").alias("n")).collect()] == [1] * 6
    assert schema_changes(f.limit(0)).count() == 0


def test_values_tell_renamed_from_replaced(spark):
    f = _files(spark, [("x", "float"), ("zeta", "int")], [("x", "float"), ("eta", "int")], [("x", "float"), ("theta", "int")])
    rows = [(1, i, f'{{"x": {i}, "zeta": {i * 3}}}') for i in range(5)] + [(2, i, f'{{"x": {i}, "eta": "{i * 3}"}}') for i in range(5)] + [(3, i, f'{{"x": {i}, "theta": {i + 50}}}') for i in range(4)] + [(3, 4, "broken"), (3, 5, None)]
    r = spark.createDataFrame(rows, "source_id int, row_no int, record string")
    got = sorted((x["source_id"], x["change_kind"], x["field"]) for x in schema_changes(f, r).collect())
    assert got == [(2, "renamed", "eta"), (3, "added", "theta"), (3, "removed", "eta")]


def test_one_table_of_all_files(spark):
    f = _files(spark, [("x", "float"), ("treeID", "int")], [("x", "float"), ("label", "float"), ("odd", "int")])
    r = spark.createDataFrame([(1, 1, '{"x": "1.5", "treeID": 7}'), (2, 1, '{"x": null, "label": 7.0, "odd": 3}'), (9, 1, '{"x": 2}'), (1, 2, "[]")], "source_id int, row_no int, record string")
    got = {(x["source_id"], x["row_no"]): x for x in consistent_table(f, r).collect()}
    assert (got[1, 1]["x"], got[1, 1]["tree_id"], got[1, 1]["version"]) == (1.5, 7, 0)
    assert got[2, 1]["x"] is None and got[2, 1]["tree_id"] == 7 and got[2, 1]["others"] == {"odd": "3"} and got[2, 1]["version"] == 1
    assert got[9, 1]["series_id"] is None and got[1, 2]["x"] is None and len(got) == 4


def _named(spark, *names, extra=()):
    """Files whose second field goes by these names, version by version, with three rows of the same values each."""
    files = _files(spark, *[[("x", "float"), (n, "int"), *extra] for n in names])
    rows = [(i + 1, k, f'{{"x": {k}, "{n}": {k * 7}}}') for i, n in enumerate(names) for k in (1, 2, 3)]
    return files, spark.createDataFrame(rows, "source_id int, row_no int, record string")


@pytest.mark.parametrize("names", [("tree_id", "a", "b"), ("a", "tree_id"), ("a", "b", "c", "treeID", "d")])
def test_renamings_compose_both_ways(spark, names):
    f, r = _named(spark, *names)
    got = consistent_table(f, r, schema_changes(f, r)).collect()
    assert sorted((x["source_id"], x["tree_id"]) for x in got) == sorted((i + 1, k * 7) for i in range(len(names)) for k in (1, 2, 3))
    assert all(x["others"] == {} for x in got)


def test_chains_without_a_known_name_reused_names_and_defaults(spark):
    f, r = _named(spark, "zeta", "eta", "theta")
    got = consistent_table(f, r, schema_changes(f, r), {"tree_id": 0}).collect()
    assert all(x["others"] == {"theta": str(x["row_no"] * 7)} and x["tree_id"] == 0 and x["hag"] is None for x in got)
    # The name that one field had is later that of another field; a file has the chain's newest name for another field already.
    f = _files(spark, [("tree_id", "int"), ("x", "float")], [("a", "int"), ("x", "float")], [("x", "float")], [("x", "float"), ("a", "int")], [("x", "float"), ("a", "int"), ("p", "int")], [("x", "float"), ("q", "int")], [("x", "float"), ("p", "int")])
    rows = [(s, k, rec % k) for s, rec in [(1, '{"tree_id": %d}'), (2, '{"a": %d}'), (4, '{"a": 5%d}'), (5, '{"a": 5%d, "p": 1}'), (6, '{"q": 5%d}'), (7, '{"p": 5%d}')] for k in (1, 2, 3)]
    r = spark.createDataFrame(rows, "source_id int, row_no int, record string")
    got = {x["source_id"]: (x["tree_id"], x["others"]) for x in consistent_table(f, r, schema_changes(f, r)).filter("row_no = 1").collect()}
    assert got == {1: (1, {}), 2: (1, {}), 4: (None, {"p": "51"}), 5: (None, {"a": "51", "p": "1"}), 6: (None, {"p": "51"}), 7: (None, {"p": "51"})}


def test_repeated_keys_of_a_record_count_once(spark):
    f = _files(spark, [("x", "float"), ("foo", "float")])
    r = spark.createDataFrame([(1, 1, '{"x": 1, "foo": 2, "zz": 5, "x": 3, "foo": 4, "zz": 6}')], "source_id int, row_no int, record string")
    got = consistent_table(f, r).first()
    assert got["x"] == 3.0 and got["others"] == {"foo": "4", "zz": "6"}


def test_two_fields_of_one_quantity_lose_nothing(spark):
    f = _files(spark, [("label", "int"), ("treeID", "int"), ("cls", "int"), ("classification", "int")])
    r = spark.createDataFrame([(1, 1, '{"label": 5, "treeID": 7, "cls": 2, "classification": 3}'), (9, 1, '{"id": 4, "tree_id": 6}')], "source_id int, row_no int, record string")
    for changes in (None, schema_changes(f, r)):
        got = {x["source_id"]: (x["tree_id"], x["classification"], x["others"]) for x in consistent_table(f, r, changes).collect()}
        assert got == {1: (7, 3, {"label": "5", "cls": "2"}), 9: (6, None, {"id": "4"})}


def test_label_fields_and_paths_are_reported_and_resolved(spark):
    f, r = _named(spark, "a", "b", "c", "d", extra=(("treeID", "int"),))
    said = spark.createDataFrame([(1, "a", "p/1"), (2, None, "p/1"), (3, "a", "q/1"), (4, "C", "q/1")], "source_id int, label_field string, path string")
    f = f.join(said, "source_id")
    got = sorted((x["source_id"], x["before_id"], x["change_kind"], x["field"], x["was"]) for x in file_changes(f.union(f)).collect())
    assert got == [(2, 1, "relabelled", None, "a"), (3, 2, "moved", "q/1", "p/1"), (3, 2, "relabelled", "a", None), (4, 3, "relabelled", "C", "a")]
    rows = consistent_table(f, r, schema_changes(f, r)).collect()
    assert {(x["source_id"], x["label_field"]) for x in rows} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")} and all(x["tree_id"] == x["row_no"] * 7 for x in rows)


# -- rows that fail to parse ---------------------------------------------------

LINES = [
    ("﻿tree_id,x,y,dbh_m,species", None), ('"tree_id","x","y","dbh_m","species"\r', None), ("Tree_ID, X,Y,DBH_m,Species", None), ("# note, with, commas", None), ("", None), ("  \r", None), (None, None),
    ("7,1.5,-2e1,0.2,oak\r", "ok"), ("007,+1.,.5,,", "ok"), (' 7 , 1 , 2 , 0.2 , "oak, ""old"", big" ', "ok"), ('"7","1","2","0","a"', "ok"),
    ('7,1,2,0.2,"oak', "broken_quoting"), ('7,1,2,0.2,"oak" old', "broken_quoting"), ('7,1,2,0.2,oak 12" girth', "broken_quoting"), ('7,1,"2', "broken_quoting"),
    ("7,1,2,0.2", "wrong_columns"), ("7,1,2,0,2,oak", "wrong_columns"), ("7;1;2;0.2;oak", "wrong_columns"), ("x", "wrong_columns"),
    ("0,1,2,0.2,oak", "invalid_value"), ("-7,1,2,0.2,oak", "invalid_value"), ("7,nan,2,0.2,oak", "invalid_value"), ("7,1,inf,0.2,oak", "invalid_value"), ("7,1,2,-0.2,oak", "invalid_value"), ("7,1,2,0.2 m,oak", "invalid_value"), ("7,1e999,2,0.2,oak", "invalid_value"), (",1,2,0.2,oak", "invalid_value"), ("7,−1,2,0.2,oak", "invalid_value"), ("٧,1,2,0.2,oak", "invalid_value"),
]


def test_lines_valid_and_failed(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(LINES)], "line_id int, raw_line string, reason string")
    valid, failed = split_lines(df)
    got = {r["line_id"]: "ok" for r in valid.collect()} | {r["line_id"]: r["reason"] for r in failed.collect()}
    assert got == {i: want for i, (_, want) in enumerate(LINES) if want}
    quoted = next(r for r in valid.collect() if r["line_id"] == 9)
    assert (quoted["tree_id"], quoted["x"], quoted["dbh_m"], quoted["species"]) == (7, 1.0, 0.2, 'oak, "old", big')
    blank = next(r for r in valid.collect() if r["line_id"] == 8)
    assert blank["dbh_m"] is None and blank["species"] is None and blank["y"] == 0.5


def test_very_long_lines_and_no_lines(spark):
    long = [(1, '7,1,2,0.2,"' + "a" * 500_000 + '"'), (2, "7,1,2,0.2," + "b" * 500_000), (3, "9" * 300_000), (4, '7,1,2,0.2,"' + "c" * 500_000)]
    valid, failed = split_lines(spark.createDataFrame(long, "line_id int, raw_line string"))
    assert sorted(r["line_id"] for r in valid.select("line_id").collect()) == [1, 2]
    assert {r["line_id"]: r["reason"] for r in failed.collect()} == {3: "wrong_columns", 4: "broken_quoting"}
    none = split_lines(spark.createDataFrame([], "line_id int, raw_line string"))
    assert none[0].count() == none[1].count() == 0


def test_lines_with_coordinates_may_hold_quotes(spark):
    from grovewise.queries.expressions import usable_rows

    lines = ['7,1,2,0.2,oak\r', '"7","1.5"," -2e1 ","0","a, b"', '7,1,2,0.2,"oak, ""old"""', '7,1,2,0.2,"oak', '7,1,2,0.2,oak 12" girth', '"7,1,2,0.2,oak', '7,"1,2",3', '7,1,"2', '7,,2,0.2,"oak"', '7,nan,2,,', "7,1", None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string")
    assert {r["line_id"]: (r["x"], r["y"]) for r in usable_rows(df).collect()} == {0: (1.0, 2.0), 1: (1.5, -20.0), 2: (1.0, 2.0), 3: (1.0, 2.0), 4: (1.0, 2.0)}


def test_coordinates_are_decimal_numbers_as_in_the_sql(spark, tmp_path):
    from grovewise.queries.expressions import SQL, usable_rows

    taken = ["1", "+1.", ".5", "1e5", "-2E-01", "1_000", "1_0.2_5e0_1", "\xa01", "1\u2003", "\t1\r", "1e-400", "9007199254740993", "0" * 400 + "1", "1" + "_1" * 9]
    left = ["1d", "2.5F", "0x1p3", "1__0", "1_", "_1", "1e", ".", "", "1e999", "inf", "nan", "\x001", "1\x08", "1\x1f", "1\x85", "1\u2028", "\ufeff1", "1\ufeff", "\uff11", "\u22121", "1 0", "9" * 100_000, "_".join("1" * 100_000), '1""2']
    lines = [f"7,{v},2,0.2,oak" for v in taken + left] + [f"7,2,{v}" for v in taken + left]
    n = len(taken + left)
    want = {k for i in range(len(taken)) for k in (i, i + n)}
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    got = {r["line_id"]: (r["x"], r["y"]) for r in usable_rows(df).collect()}
    assert set(got) == want and got[5] == (1000.0, 2.0) and got[5 + n] == (2.0, 1000.0)
    df.coalesce(1).write.parquet(f"{tmp_path}/lines")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW stem_csv_lines AS SELECT * FROM '{tmp_path}/lines/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(SQL["flt18_usable_rows"]).fetchall()} == got
    quoted = spark.createDataFrame([(i, f'"7","{v}","2","0.2","o""k"') for i, v in enumerate(taken + left[:-1])] + [(n, '"7,' + '""' * 100_000 + '",1_0, "2" ')], "line_id long, raw_line string")
    assert {r["line_id"]: r["x"] for r in usable_rows(quoted).collect()} == {i: got[i][0] for i in range(len(taken))} | {n: 10.0}
