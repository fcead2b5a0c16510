"""Queries of the training-data problems (1, 2, 8, 9, 10), over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.llm.contamination import leaks, without_leaks
from grovewise.llm.linkage import link
from grovewise.llm.packing import CAPACITY, fill_report, packed_documents
from grovewise.llm.percentiles import combine, exact_percentiles, summaries
from grovewise.llm.subjects import composition, subjects_of
from grovewise.operators.records import latest
from grovewise.operators.units import stem_diameters


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "points").filter(F.col("tree_id") > 0)


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    points = _labelled(spark, sf).select("tree_id", "point_id", "x", "y", "z")
    return exact_percentiles(points, ["tree_id"], ["x", "y", "z"], [5, 25, 50, 75, 95], item="point_id").withColumn("value", F.round("value", 4))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    points = _labelled(spark, sf).select("tree_id", "point_id", "z")
    got = exact_percentiles(points, ["tree_id"], ["z"], [50, 95], item="point_id")
    high = ((F.col("pct") == 50) & (F.col("value") >= 12.0)) | ((F.col("pct") == 95) & (F.col("value") >= 20.0))
    return got.filter(high).select("tree_id", F.col("pct").cast("int").alias("pct"))


def p1_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of z by label, from summaries that each cloud made for itself."""
    points = _labelled(spark, sf).select("tree_id", "cloud_id", "point_id", "z")
    apart = summaries(points, ["tree_id"], "cloud_id", ["z"], error=0.005, item="point_id")
    return combine(apart, ["tree_id"], [50, 95]).select("tree_id", F.col("pct").cast("int").alias("pct"), "n", F.round("value", 4).alias("value"))


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    trees = latest(table(spark, sf, "tree_stats"), ["tree_id"], ["dbh_quality"])
    stems = stem_diameters(latest(table(spark, sf, "stems"), ["stem_uid"], ["received_at"]), table(spark, sf, "clouds"))
    a = trees.select(F.col("tree_id").alias("a_id"), F.col("cloud_id").alias("cloud"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("height").alias("a_height"), F.col("dbh").alias("a_dbh"), F.col("dbh_quality").alias("a_fit"))
    b = stems.select(F.col("stem_uid").alias("b_id"), F.col("cloud_id").alias("cloud"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("height").alias("b_height"), F.col("metres").alias("b_dbh"))
    return link(a, b).select(F.col("a_id").alias("tree_id"), F.col("b_id").alias("stem_uid"), F.round("confidence", 4).alias("confidence"), F.round("apart", 3).alias("apart"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_links(spark, sf).select("tree_id", "stem_uid")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packer had to split."""
    return p8_packed(spark, sf).filter("piece > 0").select("doc_id").distinct()


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p8_packed(spark, sf), CAPACITY)


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, without the words of the stretches that they leak."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return without_leaks(documents, leaks(documents, table(spark, sf, "eval_items")), whole=False)


def p10_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects_of(table(spark, sf, "documents"), table(spark, sf, "subject_examples"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_subjects(spark, sf).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return composition(p10_subjects(spark, sf), table(spark, sf, "documents")).withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_combined, p2_found, p2_links, p8_found, p8_packed, p8_fill, p9_found, p9_leaks, p9_clean, p10_found, p10_subjects, p10_composition)}

_DISTINCT = "(SELECT DISTINCT tree_id, point_id, x, y, z FROM points WHERE tree_id > 0)"
SQL = {
    "p1_found": f"""SELECT tree_id, pct FROM (SELECT tree_id, 50 AS pct, quantile_cont(CAST(z AS DOUBLE), 0.5) AS v FROM {_DISTINCT} WHERE z IS NOT NULL GROUP BY tree_id
 UNION ALL SELECT tree_id, 95, quantile_cont(CAST(z AS DOUBLE), 0.95) FROM {_DISTINCT} WHERE z IS NOT NULL GROUP BY tree_id) WHERE (pct = 50 AND v >= 12) OR (pct = 95 AND v >= 20)""",
    "p1_percentiles": "SELECT tree_id, field, CAST(pct AS DOUBLE) AS pct, n, round(value, 4) AS value FROM ("
    + " UNION ALL ".join(f"SELECT tree_id, '{c}' AS field, {p} AS pct, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), {p / 100}) AS value FROM {_DISTINCT} WHERE {c} IS NOT NULL GROUP BY tree_id" for c in "xyz" for p in (5, 25, 50, 75, 95))
    + ")",
}
