"""Round trips through files, byte for byte where the format fixes them."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovewise.sources import las, ply, tables
from grovewise.sources.merge_files import merge_files
from grovewise.streaming.edits import arriving_counts, newest_values, publish


def raw_ply(path, rows, kinds, order="<", more=""):
    header = f"ply\nformat binary_{'little' if order == '<' else 'big'}_endian 1.0\nelement vertex {len(rows)}\n" + "".join(f"property {t} {n}\n" for n, t in kinds) + more + "end_header\n"
    dtype = np.dtype([(n, order + ply.NUMPY[t]) for n, t in kinds])
    data = np.zeros(len(rows), dtype)
    for n, _ in kinds:
        data[n] = rows[n]
    with open(path, "wb") as f:
        f.write(header.encode() + data.tobytes())


@pytest.fixture
def rows():
    rng = np.random.default_rng(0)
    return pd.DataFrame({"x": rng.uniform(0, 5, 90), "y": rng.uniform(0, 5, 90), "z": rng.uniform(0, 5, 90), "treeID": np.repeat([4, 9, -1], 30), "intensity": rng.integers(0, 60000, 90)})


KINDS = [("x", "float"), ("y", "float"), ("z", "float"), ("treeID", "int"), ("intensity", "ushort")]


@pytest.mark.parametrize("order", ["<", ">"])
def test_ply_in_ranges_of_rows(spark, tmp_path, rows, order):
    path = str(tmp_path / "a.ply")
    raw_ply(path, rows, KINDS, order)
    ply.register(spark)
    df = spark.read.format("ply").option("rowsPerPartition", 25).load(path)
    assert df.rdd.getNumPartitions() == 4 and dict(df.dtypes)["intensity"] == "int"
    got = df.orderBy("point_id").toPandas()
    assert got.point_id.tolist() == list(range(90)) and got.treeID.tolist() == rows.treeID.tolist() and got.intensity.tolist() == rows.intensity.tolist() and np.allclose(got.x, rows.x)
    assert ply.load_points(spark, path).filter("tree_id = -1").count() == 30
    assert ply.point_count(path) == 90 and ply.sniff(path) == "ply" and ply.sniff(str(tmp_path / "none")) is None


def test_ply_that_is_refused(spark, tmp_path, rows):
    path = str(tmp_path / "a.ply")
    raw_ply(path, rows, KINDS, more="element face 2\nproperty list uchar int vertex_indices\n")
    with pytest.raises(ValueError, match="face"):
        ply.refuse_others(ply.ply_layout(path))
    for text, match in ((b"ply\nformat ascii 1.0\nelement vertex 1\nend_header\n", "binary"), (b"plx\n", "no PLY"), (b"ply\nformat binary_little_endian 1.0\n", "end of header")):
        (tmp_path / "bad.ply").write_bytes(text)
        with pytest.raises(ValueError, match=match):
            ply.ply_layout(str(tmp_path / "bad.ply"))
    (tmp_path / "short.ply").write_bytes(open(path, "rb").read()[:-400])
    ply.register(spark)
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("ply").load(str(tmp_path / "short.ply")).count()
    os.rename(path, tmp_path / "a.las")
    with pytest.raises(ValueError):
        ply.load_points(spark, str(tmp_path / "a.las"))


def test_patch_changes_only_the_given_rows(spark, tmp_path, rows):
    path = str(tmp_path / "a.ply")
    raw_ply(path, rows, KINDS)
    before = np.fromfile(path, np.uint8)
    assert ply.patch_column(path, "treeID", spark.createDataFrame([(3, 77), (89, 0)], "point_id bigint, new int")) == 2
    after = np.fromfile(path, np.uint8)
    layout = ply.ply_layout(path)
    touched = {(i - layout.offset) // layout.dtype.itemsize for i in np.nonzero(before != after)[0]}
    assert touched == {3, 89} and len(before) == len(after)
    got = ply.load_points(spark, path).orderBy("point_id").toPandas().tree_id
    assert got[3] == 77 and got[89] == 0 and got[4] == 4


def test_export_gives_whole_trees(spark, tmp_path, rows):
    path = str(tmp_path / "plot.ply")
    raw_ply(path, rows, KINDS)
    ply.register(spark)
    df = spark.read.format("ply").load(path).withColumn("tree_id", F.col("treeID"))
    files = ply.export_trees(df, path, str(tmp_path / "out"))
    assert [os.path.basename(f) for f in files] == ["plot_tree_4.ply", "plot_tree_9.ply"]
    one = spark.read.format("ply").load(files[1]).orderBy("point_id").toPandas()
    assert one.intensity.tolist() == rows.intensity[30:60].tolist() and ply.ply_layout(files[1]).fields == ply.ply_layout(path).fields
    assert len(ply.export_trees(df, path, str(tmp_path / "some"), only=[9, 99])) == 1


@pytest.mark.parametrize("kind", ["i4", "u4"])
def test_las_round_trip_patch_and_export(spark, tmp_path, rows, kind):
    path = str(tmp_path / "a.las")
    label = rows.treeID.to_numpy() if kind == "i4" else np.where(rows.treeID < 0, 2**32 - 1, rows.treeID)
    las.new_las(path, {"x": rows.x + 400000, "y": rows.y + 6e6, "z": rows.z, "treeID": label, "intensity": rows.intensity, "classification": np.arange(90) % 5}, {"treeID": kind}, shift=(400000.0, 6000000.0, 0.0))
    got = ply.load_points(spark, path).orderBy("point_id").toPandas()
    assert np.allclose(got.x, rows.x + 400000, atol=6e-4) and got.intensity.tolist() == rows.intensity.tolist()
    assert sorted(got.tree_id.unique()) == ([-1, 4, 9] if kind == "i4" else [0, 4, 9])
    assert las.patch_labels(path, "treeID", spark.createDataFrame([(0, -1), (1, 12)], "point_id bigint, new int")) == 2
    again = ply.load_points(spark, path).orderBy("point_id").toPandas()
    assert again.tree_id[0] == (-1 if kind == "i4" else 0) and again.tree_id[1] == 12 and again.classification.tolist() == got.classification.tolist()
    copy = str(tmp_path / "copy.las")
    assert las.save_labels_as(path, copy, "treeID", ply.load_points(spark, path).select("point_id", F.lit(5).alias("new"))) == 90
    with pytest.raises(ValueError):
        las.save_labels_as(path, copy, "treeID", ply.load_points(spark, path).limit(3).select("point_id", F.lit(5).alias("new")))
    files = las.export_trees(ply.load_points(spark, path), path, str(tmp_path / "out"))
    assert [las.las_layout(f).count for f in files] == [28, 30, 1]
    (tmp_path / "cut.las").write_bytes(open(path, "rb").read()[:-100])
    with pytest.raises(ValueError, match="shorter"):
        las.las_layout(str(tmp_path / "cut.las"))
    with pytest.raises(ValueError, match="LAZ"):
        las.decompress("a.laz")


def test_packed_class_bits(spark, tmp_path):
    path = str(tmp_path / "old.las")
    las.new_las(path, {"x": np.arange(4), "y": np.arange(4), "z": np.arange(4), "raw_classification": np.array([0x42, 0x82, 2, 31])}, point_format=3)
    las.patch_labels(path, "raw_classification", spark.createDataFrame([(0, 5), (1, 6)], "point_id bigint, new int"))
    ply.register(spark)
    got = [r[0] for r in spark.read.format("las").load(path).orderBy("point_id").select("raw_classification").collect()]
    assert got == [0x45, 0x86, 2, 31]


def test_merging_sets_of_files(spark, tmp_path, rows):
    folder = tmp_path / "set"
    folder.mkdir()
    for name, part, kinds in (("tree_4.ply", rows[:30], KINDS[:3] + KINDS[4:]), ("tree_9.ply", rows[30:50], KINDS[:3]), ("ground.ply", rows[50:], KINDS)):
        raw_ply(str(folder / name), part.reset_index(drop=True), kinds)
    out = str(tmp_path / "merged.ply")
    assert ply.files_of(str(folder)) == sorted(str(folder / n) for n in ("tree_4.ply", "tree_9.ply", "ground.ply"))
    assert merge_files(spark, [(str(folder / "tree_4.ply"), 4), (str(folder / "tree_9.ply"), 9), (str(folder / "ground.ply"), 0)], out) == 90
    assert ply.ply_layout(out).names == ["x", "y", "z", "treeID"]
    got = ply.load_points(spark, out).orderBy("point_id").toPandas()
    assert got.tree_id.tolist() == [4] * 30 + [9] * 20 + [0] * 40 and np.allclose(got.z, rows.z)
    with pytest.raises(ValueError, match="clash 4; |missing"):
        merge_files(spark, [(str(folder / "tree_4.ply"), 4), (str(folder / "tree_9.ply"), None)], out)
    with pytest.raises(ValueError, match="empty"):
        merge_files(spark, [], out)
    a, b = str(tmp_path / "a.las"), str(tmp_path / "b.las")
    las.new_las(a, {"x": np.array([600.5, 601.0]), "y": np.zeros(2), "z": np.zeros(2), "intensity": np.array([7, 8])}, shift=(600.0, 0.0, 0.0))
    las.new_las(b, {"x": np.array([1.25]), "y": np.zeros(1), "z": np.zeros(1)}, {"treeID": "i4"})
    assert merge_files(spark, [(a, 3), (b, 5)], str(tmp_path / "m.las")) == 3
    m = ply.load_points(spark, str(tmp_path / "m.las")).orderBy("point_id").toPandas()
    assert m.x.round(3).tolist() == [600.5, 601.0, 1.25] and m.tree_id.tolist() == [3, 3, 5] and m.intensity.tolist() == [7, 8, 0] and las.las_layout(str(tmp_path / "m.las")).shift[0] == 0.0


def test_stem_maps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tree ID,Easting,Northing,DBH (cm),Height,Species\n1,10,20,31.2,14,oak\n,,,,,\ntotal,,,,,\n3,11.5,21,,x,\n,1,2,40,3,elm\n")
    got = tables.read_stem_map(spark, str(tmp_path / "a.csv"), {"dbh": "DBH (cm)"}).orderBy("ordinal").collect()
    assert [(r["stem_id"], r["x"], r["species"]) for r in got] == [("1", 10.0, "oak"), ("3", 11.5, ""), ("3", 1.0, "elm")] or [r["stem_id"] for r in got] == ["1", "3", "3"]
    assert got[0]["dbh"] == pytest.approx(0.312) and got[1]["dbh"] is None and got[1]["height"] is None
    (tmp_path / "b.csv").write_text("id,x,y,dbh\n7,1,2,0.31\n")
    assert tables.read_stem_map(spark, str(tmp_path / "b.csv")).first()["dbh"] == 0.31
    assert tables.read_stem_map(spark, str(tmp_path / "b.csv"), units="cm").first()["dbh"] == pytest.approx(0.0031)
    (tmp_path / "c.csv").write_text("id,east side\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_stem_map(spark, str(tmp_path / "c.csv"))


def test_match_file(spark, tmp_path):
    m = spark.createDataFrame([(2, "b", 'oak, "old"', "auto", 0.5, None, 0.01, 0.3, 10.0, None, None, 0.2, 1.0, 2.0), (1, "a", None, "manual", 1.0, 1.5, None, 0.3, 10.0, 0.3, 9.0, 0.2, 1.0, 2.0)], "tree_id int, stem_id string, species string, matched_by string, distance double, height_diff double, dbh_diff double, score double, height double, dbh double, stem_height double, stem_dbh double, sx double, sy double")
    lines = open(tables.write_match_file(m, str(tmp_path / "m.csv"), 1.0, -2.5), encoding="utf-8", newline="").read().split("\n")
    assert lines[0].startswith("# ") and "+1.000, -2.500" in lines[0] and lines[1].startswith("tree_id,stem_id,species,matched_by")
    assert lines[2].startswith("1,a,,manual,1.000,1.50,,0.300,10.00,0.300,9.00,0.200,1.000,2.000") and lines[3].startswith('2,b,"oak, ""old""",auto,0.500,,0.010')


def test_projects_sidecars_and_registry(tmp_path):
    p = tables.Project.create(str(tmp_path / "p"), "a.laz", [{"path": "t", "tree_id": 1}], "a.las")
    with pytest.raises(ValueError):
        tables.Project.create(str(tmp_path / "p"), "a.laz")
    p.remember(voxel_size=None, spacing=0.02)
    p.name_classes("semantic", {1: "wood"})
    assert p.settings()["voxel_size"] is None and "shift" not in p.settings() and p.class_names("semantic") == {1: "wood"} and p.class_names("other") == {}
    p.remember(class_field="old", class_names={"2": "leaf"})
    assert p.class_names("old") == {2: "leaf"} and p.data_file().endswith("a.las")
    cloud = str(tmp_path / "c.ply")
    open(cloud, "w").write("x")
    p.cache(cloud, "kept", np.arange(5))
    assert p.cached(cloud, "kept").tolist() == [0, 1, 2, 3, 4]
    open(cloud, "w").write("xyz")
    assert p.cached(cloud, "kept") is None and p.cached(cloud, "none") is None
    assert tables.read_progress(cloud) == (set(), {})
    tables.progress_path(cloud).write_text(json.dumps({"other": 1, "done": [3]}))
    tables.write_progress(cloud, links={7: "a"})
    assert tables.read_progress(cloud) == ({3}, {7: "a"}) and tables.read_json(tables.progress_path(cloud))["other"] == 1
    tables.progress_path(cloud).write_text("{broken")
    assert tables.read_progress(cloud) == (set(), {})
    r = tables.Registry(str(tmp_path / "r.json"))
    r.add(cloud, "file")
    with pytest.raises(ValueError):
        r.add(cloud, "folder")
    os.remove(cloud)
    assert r.load() == [] and tables.read_json(r.path) == {"entries": []}


def test_edit_streams(spark, tmp_path):
    schema = "seq long, target string, point_id long, new int"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "tree_id", 5, 7), (2, "tree_id", 5, 8), (3, "cls", 5, 1), (4, "tree_id", 6, 0)], schema).write.json(src)
    stream = spark.readStream.schema(schema).json(src)
    q = newest_values(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["point_id"], r["new"]) for r in spark.table("newest").collect()} == {(5, 8), (6, 0)}
    publish(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    publish(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    pts = str(tmp_path / "pts")
    spark.createDataFrame([(1, 7, "2024-01-01 10:00:00"), (1, 7, "2024-01-01 10:10:00"), (2, 7, "2024-01-01 11:00:00"), (3, 8, "2024-01-02 11:00:00")], "point_id long, tree_id int, ts string").write.json(pts)
    arriving = spark.readStream.schema("point_id long, tree_id int, ts timestamp").json(pts)
    q = arriving_counts(arriving).writeStream.format("memory").queryName("arrived").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["tree_id"], r["n"]) for r in spark.table("arrived").collect()} == {(7, 2), (8, 1)}
