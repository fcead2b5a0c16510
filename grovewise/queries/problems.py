"""Queries of the general data problems (3 to 7), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators.bad_rows import split_lines
from grovewise.operators.heavy_keys import distinct_counts, join_counts
from grovewise.operators.proximity import near, regions_of
from grovewise.operators.records import latest
from grovewise.operators.schema_drift import QUANTITIES, TYPES, consistent_table, file_changes, schema_changes
from grovewise.operators.units import stem_diameters, tile_diameters
from grovewise.plans.bounded import broadcast_bounded


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records_in_force(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "tree_records"), ["cloud_id", "tree_id"], ["saved_at", "received_at"])


def _world(df: DataFrame, clouds: DataFrame, x, y) -> DataFrame:
    shifts = broadcast_bounded(clouds.select("cloud_id", "shift_x", "shift_y").dropDuplicates(["cloud_id"]))
    return df.join(shifts, "cloud_id").withColumn("wx", x.cast("double") + F.col("shift_x")).withColumn("wy", y.cast("double") + F.col("shift_y")).drop("shift_x", "shift_y")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    clouds = table(spark, sf, "clouds")
    stems = latest(table(spark, sf, "stems").select("stem_uid", "received_at", "x", "y"), ["stem_uid"], ["received_at"]).select("stem_uid", F.col("x").alias("wx"), F.col("y").alias("wy"))
    points = _world(table(spark, sf, "points").select("point_id", "cloud_id", "x", "y").filter(F.col("x").isNotNull() & F.col("y").isNotNull()), clouds, F.col("x"), F.col("y"))
    trees = _world(records_in_force(spark, sf).filter(F.col("centroid").isNotNull()), clouds, F.col("centroid.x"), F.col("centroid.y")).withColumn("tree", F.col("tree_id").cast("long"))
    kinds = [("point", points, "point_id", 0.30), ("tree", trees, "tree", 2.00)]
    found = [near(stems, "stem_uid", others, of, radius, "wx", "wy").select(F.lit(kind).alias("near_kind"), F.col("query_id").alias("stem_uid"), F.col("other_id")) for kind, others, of, radius in kinds]
    return found[0].unionByName(found[1]).distinct()


def p3_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Stems within the boxes of saved trees, in the world frame."""
    clouds = table(spark, sf, "clouds")
    stems = latest(table(spark, sf, "stems").select("stem_uid", "received_at", "x", "y"), ["stem_uid"], ["received_at"])
    box = _world(_world(records_in_force(spark, sf), clouds, F.col("lo_x"), F.col("lo_y")).withColumnsRenamed({"wx": "x0", "wy": "y0"}), clouds, F.col("hi_x"), F.col("hi_y"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = box.select(F.struct("cloud_id", "tree_id").alias("box"), F.array(corner("x0", "y0"), corner("wx", "y0"), corner("wx", "wy"), corner("x0", "wy")).alias("ring"))
    return regions_of(stems, "stem_uid", rings, "box", "ring").select(F.col("point_id").alias("stem_uid"), "region_id.cloud_id", "region_id.tree_id").distinct()


def p4_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_counts(table(spark, sf, "points"), "tree_id", "point_id", "points")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    saved = records_in_force(spark, sf).groupBy("tree_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("saved"))
    return join_counts(saved, p4_label_counts(spark, sf), "tree_id", "points").filter(F.col("saved") != F.col("points")).select("tree_id")


def p5_diameters(spark: SparkSession, sf: str) -> DataFrame:
    stems = latest(table(spark, sf, "stems"), ["stem_uid"], ["received_at"])
    tiles = table(spark, sf, "tile_stems").dropDuplicates(["row_id"])
    s = stem_diameters(stems, table(spark, sf, "clouds")).select(F.lit("stems").alias("table_name"), F.col("stem_uid").alias("row_id"), "unit", F.round("metres", 6).alias("metres"), "unit_unique")
    t = tile_diameters(tiles).select(F.lit("tile_stems").alias("table_name"), "row_id", "unit", F.round("metres", 6).alias("metres"), "unit_unique")
    return s.unionByName(t)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_diameters(spark, sf).filter(F.col("metres").isNotNull() & (F.col("unit") != "m")).select("table_name", "row_id", "unit").distinct()


def p6_changes(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_files")
    return schema_changes(files, table(spark, sf, "source_rows")).unionByName(file_changes(files))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "source_files"), table(spark, sf, "source_rows")).select("source_id", "change_kind", "field").distinct()


def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    files, rows = table(spark, sf, "source_files"), table(spark, sf, "source_rows")
    return consistent_table(files, rows, schema_changes(files, rows)).withColumn("others", F.to_json("others"))


def p7_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split_lines(table(spark, sf, "stem_csv_lines"))[0]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_lines(table(spark, sf, "stem_csv_lines"))[1].select("line_id", "reason")


QUERIES = {f.__name__: f for f in (p3_found, p3_regions, p4_found, p4_label_counts, p5_found, p5_diameters, p6_found, p6_changes, p6_table, p7_found, p7_rows)}

_IN_FORCE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, tree_id ORDER BY saved_at DESC NULLS LAST, received_at DESC NULLS LAST) AS rn
 FROM tree_records) WHERE rn = 1)"""
_COUNTS = "(SELECT tree_id, count(DISTINCT point_id) AS points FROM points GROUP BY tree_id)"

_F = r"""(?:"(?:[^"]|"")*"|[^",]*)"""
_NUM = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
_OK = f"(regexp_matches({{0}}, '{_NUM}') AND coalesce(isfinite(TRY_CAST({{0}} AS DOUBLE)), false))"
#: Data lines with whether their quoting holds, and their fields.
_LINES = rf"""(SELECT line_id, well, f, well AND len(f) = 5 AND regexp_matches(f[1], '^[0-9]+$') AND regexp_matches(f[1], '[1-9]') AND {_OK.format('f[2]')} AND {_OK.format('f[3]')} AND (f[4] = '' OR ({_OK.format('f[4]')} AND coalesce(TRY_CAST(f[4] AS DOUBLE), -1) >= 0)) AS valid FROM
 (SELECT line_id, regexp_matches(s, '^\s*{_F}\s*(?:,\s*{_F}\s*)*$') AS well,
 [regexp_replace(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(',' || s, ',\s*({_F})\s*', 1)] AS f
 FROM (SELECT line_id, regexp_replace(ltrim(raw_line, chr(65279)), '[\r\n]+$', '') AS s FROM stem_csv_lines) WHERE regexp_matches(s, '\S') AND NOT regexp_matches(s, '^\s*#'))
 WHERE NOT (well AND [lower(x) FOR x IN f] = ['tree_id', 'x', 'y', 'dbh_m', 'species']))"""



def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_TYPE_NAMES, _QUANTITY_NAMES = _map(TYPES), _map({alias: q for q, names in QUANTITIES.items() for alias in names})


def _plain(c: str) -> str:
    return f"coalesce({_TYPE_NAMES}[lower({c})], lower({c}))"


def _known(c: str) -> str:
    return f"{_QUANTITY_NAMES}[lower({c})]"


_BEFORE = "list(name) FILTER (kept) OVER (PARTITION BY source_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: Fields of each file and of the one before, candidates for renaming, their records side by side, and the changes (c).
_CHANGES = f"""WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY received_at DESC NULLS LAST) AS rn FROM source_files WHERE source_id IS NOT NULL) WHERE rn = 1),
 v AS (SELECT series_id, source_id, label_field, path, attributes, row_number() OVER (PARTITION BY series_id ORDER BY written_at NULLS FIRST, source_id) AS ver FROM once),
 b AS (SELECT n.series_id, n.source_id, o.source_id AS before_id, n.label_field, o.label_field AS was_label, n.path, o.path AS was_path FROM v n JOIN v o ON n.series_id IS NOT DISTINCT FROM o.series_id AND n.ver = o.ver + 1),
 a0 AS (SELECT source_id, unnest(attributes) AS a, generate_subscripts(attributes, 1) AS i FROM v),
 a1 AS (SELECT source_id, a.name AS name, {_plain('a.type')} AS kind, i, row_number() OVER (PARTITION BY source_id, a.name ORDER BY i) AS k FROM a0 WHERE a.name IS NOT NULL),
 f AS (SELECT source_id, name, kind, row_number() OVER (PARTITION BY source_id ORDER BY i) AS place FROM a1 WHERE k = 1),
 nf AS (SELECT b.source_id, before_id, f.name, f.kind, f.place, o.kind AS was, o.name IS NOT NULL AS kept FROM b JOIN f ON f.source_id = b.source_id LEFT JOIN f o ON o.source_id = before_id AND o.name = f.name),
 wf AS (SELECT b.source_id, f.name, f.kind, f.place, n.name IS NOT NULL AS kept FROM b JOIN f ON f.source_id = before_id LEFT JOIN f n ON n.source_id = b.source_id AND n.name = f.name),
 na AS (SELECT *, coalesce(list_sort({_BEFORE}), []) AS after FROM nf), wa AS (SELECT *, coalesce(list_sort({_BEFORE}), []) AS after FROM wf),
 p AS (SELECT n.source_id, n.before_id, n.name, n.kind, n.place, o.name AS old, o.kind AS was, o.place AS old_place, coalesce({_known('n.name')} = {_known('o.name')}, lower(n.name) = lower(o.name)) AS known,
  {_known('n.name')} IS NULL OR {_known('o.name')} IS NULL AS strange FROM na n JOIN wa o ON o.source_id = n.source_id WHERE NOT n.kept AND NOT o.kept AND (n.place = o.place OR n.after = o.after)),
 r AS (SELECT DISTINCT ON (source_id, row_no) source_id, row_no, record FROM source_rows WHERE json_valid(record)),
 x AS (SELECT p.source_id, name, old, TRY_CAST(json_extract_string(r1.record, '$."' || name || '"') AS DOUBLE) AS v1, TRY_CAST(json_extract_string(r0.record, '$."' || old || '"') AS DOUBLE) AS v0
  FROM p JOIN r r1 ON r1.source_id = p.source_id JOIN r r0 ON r0.source_id = p.before_id AND r0.row_no = r1.row_no),
 s AS (SELECT source_id, name, old, count(*) AS tried, avg(CASE WHEN abs(v0 - v1) <= 0.0001::DOUBLE * greatest(1, abs(v0)) THEN 1 ELSE 0 END) AS share, count(DISTINCT v0) AS kinds FROM x WHERE v0 IS NOT NULL AND v1 IS NOT NULL GROUP BY ALL),
 m AS (SELECT *, row_number() OVER (PARTITION BY source_id, name ORDER BY known DESC, place, old_place) AS ra, row_number() OVER (PARTITION BY source_id, old ORDER BY known DESC, place, old_place) AS rb FROM p LEFT JOIN s USING (source_id, name, old)
  WHERE CASE WHEN tried >= 1 THEN share >= 0.6 AND (known OR (strange AND kinds >= 2) OR (share = 1 AND kinds >= 3)) ELSE known END),
 ren AS (SELECT * FROM m WHERE ra = 1 AND rb = 1),
 c AS (SELECT source_id, 'added' AS change_kind, name AS field, NULL AS was FROM nf WHERE NOT kept AND (source_id, name) NOT IN (SELECT source_id, name FROM ren)
  UNION ALL SELECT source_id, 'removed', name, NULL FROM wf WHERE NOT kept AND (source_id, name) NOT IN (SELECT source_id, old FROM ren)
  UNION ALL SELECT source_id, 'renamed', name, old FROM ren
  UNION ALL SELECT source_id, 'retyped', name, was FROM ren WHERE kind IS DISTINCT FROM was
  UNION ALL SELECT source_id, 'retyped', name, was FROM nf WHERE kept AND kind IS DISTINCT FROM was)"""

SQL = {
    "p6_found": f"{_CHANGES} SELECT DISTINCT source_id, change_kind, field FROM c",
    "p6_changes": f"""{_CHANGES} SELECT series_id, c.source_id, before_id, change_kind, field, was FROM c JOIN b USING (source_id)
 UNION ALL SELECT series_id, source_id, before_id, 'relabelled', label_field, was_label FROM b WHERE label_field IS DISTINCT FROM was_label
 UNION ALL SELECT series_id, source_id, before_id, 'moved', path, was_path FROM b WHERE path IS DISTINCT FROM was_path""",
    "p7_found": f"SELECT line_id, CASE WHEN NOT well THEN 'broken_quoting' WHEN len(f) <> 5 THEN 'wrong_columns' ELSE 'invalid_value' END AS reason FROM {_LINES} WHERE NOT valid",
    "p7_rows": f"SELECT line_id, CAST(f[1] AS BIGINT) AS tree_id, CAST(f[2] AS DOUBLE) AS x, CAST(f[3] AS DOUBLE) AS y, TRY_CAST(f[4] AS DOUBLE) AS dbh_m, nullif(f[5], '') AS species FROM {_LINES} WHERE valid",
    "p3_found": f"""WITH s AS (SELECT DISTINCT stem_uid, x, y FROM stems WHERE x IS NOT NULL AND y IS NOT NULL),
 p AS (SELECT DISTINCT point_id, CAST(x AS DOUBLE) + shift_x AS wx, CAST(y AS DOUBLE) + shift_y AS wy FROM points JOIN clouds USING (cloud_id) WHERE x IS NOT NULL AND y IS NOT NULL),
 t AS (SELECT tree_id, centroid.x + shift_x AS wx, centroid.y + shift_y AS wy FROM {_IN_FORCE} JOIN clouds USING (cloud_id) WHERE centroid IS NOT NULL),
 d AS (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS d),
 sc AS (SELECT s.*, CAST(floor(x / 2) AS BIGINT) + a.d AS cx, CAST(floor(y / 2) AS BIGINT) + b.d AS cy FROM s, d a, d b),
 pc AS (SELECT *, CAST(floor(wx / 2) AS BIGINT) AS cx, CAST(floor(wy / 2) AS BIGINT) AS cy FROM p),
 tc AS (SELECT *, CAST(floor(wx / 2) AS BIGINT) AS cx, CAST(floor(wy / 2) AS BIGINT) AS cy FROM t)
 SELECT DISTINCT 'point' AS near_kind, stem_uid, point_id AS other_id FROM sc JOIN pc USING (cx, cy) WHERE sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) <= 0.3
 UNION SELECT DISTINCT 'tree', stem_uid, CAST(tree_id AS BIGINT) FROM sc JOIN tc USING (cx, cy) WHERE sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) <= 2""",
    "p3_regions": f"""WITH s AS (SELECT DISTINCT stem_uid, x, y FROM stems WHERE x IS NOT NULL AND y IS NOT NULL),
 b AS (SELECT r.cloud_id, tree_id, lo_x + shift_x AS x0, lo_y + shift_y AS y0, hi_x + shift_x AS x1, hi_y + shift_y AS y1 FROM {_IN_FORCE} r JOIN clouds USING (cloud_id))
 SELECT DISTINCT stem_uid, cloud_id, tree_id FROM s JOIN b ON x >= least(x0, x1) AND x < greatest(x0, x1) AND y >= least(y0, y1) AND y < greatest(y0, y1)""",
    "p4_label_counts": f"SELECT * FROM {_COUNTS}",
    "p4_found": f"""SELECT s.tree_id FROM (SELECT tree_id, coalesce(sum(count), 0) AS saved FROM {_IN_FORCE} GROUP BY tree_id) s
 LEFT JOIN {_COUNTS} c ON c.tree_id = s.tree_id WHERE saved <> coalesce(points, 0)""",
}
