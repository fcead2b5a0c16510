"""Queries that go through files: each writes whole tables in a format and reads them back."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from grovewise.functions.colours import saved_colour
from grovewise.functions.labels import label_column
from grovewise.functions.texts import stem_columns
from grovewise.operators import merging
from grovewise.queries.registry import G, P, Queries, given_points, points, table
from grovewise.session import mounted_folder
from grovewise.sources import las, ply, tables

query = Queries()
QUERIES, SQL = query.QUERIES, query.SQL

_TRIP = f"SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_id, x, y, z, CASE WHEN tree_id < -1 THEN 0 ELSE tree_id END AS tree_id FROM {G}"


def _folder(spark) -> str:
    return tempfile.mkdtemp(prefix="files-", dir=_made(mounted_folder(spark)))


def _made(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def _cloud(spark, sf):
    return given_points(spark, sf).select("point_id", "x", "y", "z", "tree_id", "cloud_id")


@query("src03_ply_round_trip", _TRIP)
def _(spark, sf):
    path = f"{_folder(spark)}/cloud.ply"
    ply.save_ply(_cloud(spark, sf), path)
    return ply.load_points(spark, path).select("point_id", "x", "y", "z", "tree_id")


@query("src05_coloured_ply", f"SELECT count(*) AS n, count(DISTINCT tree_id) FILTER (WHERE tree_id > 0) > 0 AS trees FROM {G}")
def _(spark, sf):
    rgb = saved_colour(F.col("tree_id"))
    p = _cloud(spark, sf).select("*", *[F.get(rgb, i).alias(n) for i, n in enumerate(("red", "green", "blue"))])
    path = f"{_folder(spark)}/colour.ply"
    ply.save_coloured_ply(p.drop("cloud_id"), path)
    got = ply.load_points(spark, path)
    return got.agg(F.count("*").alias("n"), (F.count_distinct(F.when(F.col("tree_id") > 0, F.col("tree_id"))) > 0).alias("trees"))


@query("src01_format_sniff", "SELECT * FROM (VALUES ('a.ply', 'ply'), ('b.txt', NULL), ('c', NULL)) t(name, kind)")
def _(spark, sf):
    folder = _folder(spark)
    open(f"{folder}/a.ply", "wb").write(b"ply\nformat binary_little_endian 1.0\nend_header\n")
    open(f"{folder}/b.txt", "wb").write(b"tree")
    return spark.createDataFrame([(n, ply.sniff(f"{folder}/{n}")) for n in ("a.ply", "b.txt", "c")], "name string, kind string")


@query("src02_ply_header", f"SELECT 'x' AS first, 5 AS fields, count(*) AS count FROM {G}")
def _(spark, sf):
    path = f"{_folder(spark)}/cloud.ply"
    ply.save_ply(_cloud(spark, sf), path)
    layout = ply.ply_layout(path)
    return spark.createDataFrame([(layout.names[0], len(layout.fields), layout.count)], "first string, fields int, count bigint")


@query("src06_las_round_trip", "SELECT tree_id, count(*) AS n, round(sum(x), 2) AS x FROM (SELECT DISTINCT tree_id, x, y, height FROM tree_stats) GROUP BY tree_id")
def _(spark, sf):
    t = table(spark, sf, "tree_stats").dropDuplicates(["tree_id"]).select("tree_id", "x", "y").orderBy("tree_id").toPandas()  # one row for each tree; the file's header is made on the driver
    path = f"{_folder(spark)}/trees.las"
    las.new_las(path, {"x": t.x.to_numpy(), "y": t.y.to_numpy(), "z": np.zeros(len(t)), "treeID": t.tree_id.to_numpy()}, {"treeID": "i4"}, shift=(412000.0, 6120000.0, 0.0))
    return ply.load_points(spark, path).groupBy("tree_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"))


@query("src10_scan_bounds", f"SELECT min(x) AS lo, max(x) AS hi FROM {G}")
def _(spark, sf):
    path = f"{_folder(spark)}/cloud.ply"
    ply.save_ply(_cloud(spark, sf), path)
    ply.register(spark)
    return spark.read.format("ply").load(path).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("src13_stem_map", "SELECT CAST(stem_uid AS VARCHAR) AS stem_id, round(x, 3) AS x, round(y, 3) AS y, round(height, 3) AS height FROM (SELECT DISTINCT stem_uid, x, y, height FROM stems) WHERE x IS NOT NULL AND y IS NOT NULL")
def _(spark, sf):
    path = f"{_folder(spark)}/stems"
    s = table(spark, sf, "stems").select(F.col("stem_uid").alias("Tree ID"), F.col("x").alias("Easting"), F.col("y").alias("Northing"), F.col("height").alias("Ht")).distinct()
    s.write.csv(path, header=True)
    return tables.read_stem_map(spark, path).select("stem_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("height", 3).alias("height"))


@query("src14_column_roles", "SELECT * FROM (VALUES ('Tag,East,North,DBH_metres,Ht,Sp', 'Tag', 'East', 'Ht'), ('Tree ID,Easting,Northing,DBH (cm),Height,Species', 'Tree ID', 'Easting', 'Height'), ('stem,x,y,d,h,species', 'stem', 'x', 'h')) t(header, stem_id, x, height)")
def _(spark, sf):
    headers = ["Tag,East,North,DBH_metres,Ht,Sp", "Tree ID,Easting,Northing,DBH (cm),Height,Species", "stem,x,y,d,h,species"]
    return spark.createDataFrame([(h, c.get("stem_id"), c.get("x"), c.get("height")) for h in headers for c in [stem_columns(h.split(","))]], "header string, stem_id string, x string, height string")


@query("src15_mapping_file", r"WITH k AS (SELECT source_id, path AS key, tree_id FROM source_files WHERE tree_id IS NOT NULL UNION ALL SELECT source_id, regexp_extract(path, '([^/]*)$', 1), tree_id FROM source_files WHERE tree_id IS NOT NULL) SELECT key, tree_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_id DESC) AS rn FROM k) WHERE rn = 1")
def _(spark, sf):
    path = f"{_folder(spark)}/mapping"
    rows = table(spark, sf, "source_files").select("source_id", "path", "tree_id").distinct().repartitionByRange(1, "source_id").sortWithinPartitions("source_id")
    rows.select("path", "tree_id").write.csv(path)
    return merging.mapping_entries(tables.read_mapping_lines(spark, path))


@query("src18_header_counts", f"SELECT count(*) AS n FROM {G}")
def _(spark, sf):
    path = f"{_folder(spark)}/cloud.ply"
    ply.save_ply(_cloud(spark, sf), path)
    return spark.createDataFrame([(ply.point_count(path),)], "n bigint")


@query("src19_sidecar", "SELECT doc_id, len(t) AS done FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [1, 2, 3] ELSE []::INTEGER[] END AS t FROM documents)")
def _(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, '{"done": [1, 2, 3], "inventory": {"7": "a"}, "other": 1}').otherwise("{broken")
    return tables.progress_of(table(spark, sf, "documents").select("doc_id", text.alias("text"))).select("doc_id", F.size("done").alias("done"))


@query("src20_settings", "SELECT * FROM (VALUES ('spacing', true, '0.02'), ('voxel_size', true, 'null'), ('global_shift', false, 'null')) t(key, asked, value)")
def _(spark, sf):
    p = tables.Project.create(f"{_folder(spark)}/project", "cloud.ply")
    p.remember(spacing=0.02, voxel_size=None)
    s = p.settings()
    return spark.createDataFrame([(k, k in s, json.dumps(s.get(k))) for k in ("spacing", "voxel_size", "global_shift")], "key string, asked boolean, value string")


@query("snk08_partitioned_export", f"SELECT tree_id, count(*) AS n FROM {P} WHERE tree_id > 0 GROUP BY tree_id")
def _(spark, sf):
    path = f"{_folder(spark)}/export"
    p = points(spark, sf).filter("tree_id > 0")
    p.repartitionByRange("tree_id", "point_id").sortWithinPartitions("tree_id", "point_id").write.partitionBy("tree_id").parquet(path)
    return spark.read.parquet(path).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("snk09_tree_files", f"SELECT tree_id, count(*) AS n FROM {G} WHERE tree_id IN (3, 17, 10003) GROUP BY tree_id")
def _(spark, sf):
    folder = _folder(spark)
    p = _cloud(spark, sf)
    ply.save_ply(p, f"{folder}/cloud.ply")
    cloud = ply.load_points(spark, f"{folder}/cloud.ply")
    files = ply.export_trees(cloud.withColumn("treeID", F.col("tree_id")), f"{folder}/cloud.ply", f"{folder}/trees", only=[3, 17, 10003])
    rows = [(int(f.rsplit("_", 1)[1].split(".")[0]), ply.point_count(f)) for f in files]
    return spark.createDataFrame(rows, "tree_id int, n bigint")


@query("snk05_patched_file", f"SELECT CASE WHEN z > 18 THEN 0 WHEN tree_id < -1 THEN 0 ELSE tree_id END AS tree_id, count(*) AS n FROM {G} GROUP BY 1")
def _(spark, sf):
    path = f"{_folder(spark)}/cloud.ply"
    ply.save_ply(_cloud(spark, sf), path)
    cloud = ply.load_points(spark, path)
    ply.patch_column(path, "treeID", cloud.filter("z > 18 and tree_id <> 0").select("point_id", F.lit(0).alias("new")))
    return ply.load_points(spark, path).groupBy("tree_id").agg(F.count("*").alias("n"))


@query("src04_label_roles", "SELECT * FROM (VALUES ('x,treeid,label', 'treeid'), ('ID,segment_id', 'segment_id'), ('x,y', NULL)) t(header, label)")
def _(spark, sf):
    headers = ["x,treeid,label", "ID,segment_id", "x,y"]
    return spark.createDataFrame([(h, label_column(h.split(","))) for h in headers], "header string, label string")


@query("snk19_registry", "SELECT 20 AS kept, 'file_24' AS newest")
def _(spark, sf):
    import datetime as dt

    folder = _folder(spark)
    r = tables.Registry(f"{folder}/registry.json")
    for k in range(25):
        open(f"{folder}/file_{k:02d}", "w").close()
        r.add(f"{folder}/file_{k:02d}", "file", dt.datetime(2024, 1, 1, 0, k))
    got = r.load()
    return spark.createDataFrame([(len(got), os.path.basename(got[0]["path"]))], "kept int, newest string")
