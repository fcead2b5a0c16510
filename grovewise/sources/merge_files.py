"""Joining the files of a set, one for each tree, into one cloud."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grovewise.operators.merging import merged, source_problems
from grovewise.sources import las, ply


def merge_files(spark: SparkSession, sources: list[tuple[str, int | None]], target: str) -> int:
    """Write (path, tree id) files into one, each point with its file's tree; how many points. Ground has id 0.

    PLY: the fields that all files have, in the first one's types. LAS: the first file's format and scales, the least offsets, 0 for what a file lacks. Points keep the order of
    the files and of the points in them. Whatever stops the set is reported at once.
    """
    planned = spark.createDataFrame(sources or [], "path string, tree_id int")
    if wrong := source_problems(planned).collect():  # at most one row for each file
        raise ValueError("; ".join(f"{r['problem']}" + (f" {r['tree_id']}" if r["tree_id"] is not None else "") for r in wrong))
    ply.register(spark)
    kinds = {ply.sniff(p) for p, _ in sources}
    if len(kinds) != 1 or None in kinds:
        raise ValueError("the files aren't all of one readable format")
    kind = kinds.pop()
    parts, first = [], 0
    for path, tree in sources:
        df = spark.read.format(kind).load(path)
        parts.append((df.withColumn("point_id", F.col("point_id") + F.lit(first)), tree))
        first += ply.point_count(path)
    if kind == "ply":
        whole = merged(parts, "treeID")
        ply.save_ply(whole.withColumnRenamed("treeID", "tree_id"), target)
    else:
        layouts = [las.las_layout(p) for p, _ in sources]
        whole = merged(parts, "treeID", fill=True)
        las.save_las(whole, target, sources[0][0], "treeID", las.least_shift(layouts))
    return first
