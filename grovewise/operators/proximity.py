"""Points near other points, and the regions that contain points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.plans.quadtree import Quadtree, RTree

#: Rows sampled of each side for the quadtree; rows, queries and expected pairs that a leaf's group is to hold.
SAMPLE_ROWS, LEAF_ROWS, GROUP_PAIRS = 40_000, 100_000, 5_000_000


def _sampled(df: DataFrame, x: str, y: str, most: int) -> tuple[np.ndarray, float]:
    """(coordinates of about ``most`` rows, the share of all rows that they are)."""
    given = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(_finite("x") & _finite("y"))
    part = min(1.0, most / max(given.count(), 1))
    sample = given if part == 1.0 else given.sample(fraction=part, seed=7)
    return sample.limit(2 * most).toPandas().to_numpy(dtype=float).reshape(-1, 2), part


def plan_quadtree(df: DataFrame, x: str, y: str, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, queries: DataFrame | None = None, radius: float = 0.0) -> Quadtree:
    """A quadtree whose leaves hold about ``leaf_rows`` rows of ``df`` and of ``queries`` (same column names), from a sample of about ``sample_rows`` of each.

    The tree has at most about ``sample_rows`` / 4 leaves however large the tables are. Past that, and in leaves that would be narrower than twice the radius, rows and queries are spread over shards, each
    side for itself; so are queries that expect more than ``GROUP_PAIRS`` pairs in a leaf.
    """
    xy, part = _sampled(df, x, y, sample_rows)
    asked, asked_part = _sampled(queries, x, y, sample_rows) if queries is not None else (None, 1.0)
    wanted, wanted_asked = max(8, int(leaf_rows * part)), max(8, int(leaf_rows * asked_part))
    tree = Quadtree.build(xy, wanted, queries=asked, query_capacity=wanted_asked, least=max(2 * radius, 1e-6))
    # The samples may be too small to split down to leaf_rows; what is left over is spread over shards of a leaf.
    shards = np.ceil(tree.shards * max(1.0, wanted / part / leaf_rows)).astype(np.int64)
    query_shards = np.ceil(tree.asked * max(1.0, wanted_asked / asked_part / leaf_rows)).astype(np.int64)
    if asked is not None and len(asked):
        rows, comers = (np.bincount(tree.leaf_of(c[:, 0], c[:, 1]), minlength=len(shards)) for c in (xy, asked))
        share = np.minimum(1.0, np.pi * radius * radius / np.maximum(tree.area, 1e-300))
        pairs = rows / part * comers / asked_part * share
        query_shards = np.maximum(query_shards, np.ceil(pairs / shards / GROUP_PAIRS).astype(np.int64))
    return Quadtree(tree.split_x, tree.split_y, tree.child, tree.leaf, shards, query_shards, tree.area)


def _finite(c):
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _copied(b: pa.RecordBatch, rows: np.ndarray, leaf: np.ndarray, shard: np.ndarray, copies: np.ndarray, step: np.ndarray) -> pa.RecordBatch:
    """The given rows of a batch, each in ``copies`` shards of its leaf: ``shard`` and every ``step``-th one from there."""
    place = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    shard = np.repeat(shard, copies) + place * np.repeat(step, copies)
    out = b.take(pa.array(np.repeat(rows, copies)))
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.repeat(leaf, copies)), pa.array(shard)], [*out.schema.names, "leaf", "shard"])


def _place_rows(df: DataFrame, tree: Quadtree, x: str, y: str) -> DataFrame:
    """Each row in its one leaf, there in one shard of rows, which is copied for each shard of queries."""

    def run(batches):
        seen = 0
        for b in batches:
            leaf = tree.leaf_of(b["x"].to_numpy(), b["y"].to_numpy())
            n = np.arange(len(leaf))
            yield _copied(b, n, leaf, (n + seen) % tree.shards[leaf], tree.asked[leaf], tree.shards[leaf])
            seen += len(leaf)

    slim = df.select(F.col("_id").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(_finite("x") & _finite("y"))
    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(run, f"id {kind}, x double, y double, leaf long, shard long")


def _place_boxes(df: DataFrame, tree: Quadtree) -> DataFrame:
    """Each box in every leaf that it overlaps, there in one shard of queries, which is copied for each shard of rows."""

    def run(batches):
        seen = 0
        for b in batches:
            rows, leaf = tree.leaves_touching(*(b[c].to_numpy() for c in ("lo_x", "lo_y", "hi_x", "hi_y")))
            yield _copied(b, rows, leaf, (rows + seen) % tree.asked[leaf] * tree.shards[leaf], tree.shards[leaf], np.ones(len(leaf), dtype=np.int64))
            seen += b.num_rows

    schema = ", ".join(f"{c} {kind}" for c, kind in df.dtypes)
    return df.mapInArrow(run, f"{schema}, leaf long, shard long")


def near(queries: DataFrame, query_id: str, others: DataFrame, other_id: str, radius: float, x: str = "x", y: str = "y", leaf_rows: int = LEAF_ROWS, tree: Quadtree | None = None) -> DataFrame:
    """All pairs (query_id, other_id, distance) at most ``radius`` apart in the plane.

    A quadtree from bounded samples of both sides splits the plane. Each other lies in one leaf only, the
    leaf of its own position, which serves as the reference point: a query that is copied into all leaves its disc touches meets each
    other exactly once, so no pair comes out twice. Within a leaf the others are bulk-loaded into an R-tree, the discs' boxes
    probe it in lots, and the distance is tested in double precision. Where a leaf can't be split, as many others or many queries of one position, both sides are spread over shards, and each shard of
    queries meets each shard of others.

    Rows with null or non-finite coordinates have no neighbours. Repeated rows give repeated pairs. Ids may clash in name; an empty
    side gives no rows.
    """
    q = queries.select(F.col(query_id).alias("_id"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")).filter(_finite("qx") & _finite("qy"))
    o = others.select(F.col(other_id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    tree = tree or plan_quadtree(o, "_x", "_y", leaf_rows, queries=q.select(F.col("qx").alias("_x"), F.col("qy").alias("_y")), radius=radius)
    grown = radius * (1 + 1e-9) + 1e-9
    boxes = q.select(F.col("_id").alias("id"), "qx", "qy", (F.col("qx") - grown).alias("lo_x"), (F.col("qy") - grown).alias("lo_y"), (F.col("qx") + grown).alias("hi_x"), (F.col("qy") + grown).alias("hi_y"))
    left = _place_boxes(boxes, tree)
    right = _place_rows(o, tree, "_x", "_y")
    kinds = dict(boxes.dtypes)["id"], dict(right.dtypes)["id"]

    def probe(a: pa.Table, b: pa.Table) -> pa.Table:
        px, py = b["x"].to_numpy(), b["y"].to_numpy()
        qx, qy = a["qx"].to_numpy(), a["qy"].to_numpy()
        got = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(px) and len(qx):
            for query, entry in RTree(px, py, px, py).probe_lots(*(a[c].to_numpy() for c in ("lo_x", "lo_y", "hi_x", "hi_y"))):
                apart = np.hypot(qx[query] - px[entry], qy[query] - py[entry])
                hit = apart <= radius
                got.append((query[hit], entry[hit], apart[hit]))
        query, entry, apart = (np.concatenate(v) for v in zip(*got))
        return pa.table({"query_id": a["id"].take(pa.array(query)), "other_id": b["id"].take(pa.array(entry)), "distance": apart})

    return left.groupBy("leaf", "shard").cogroup(right.groupBy("leaf", "shard")).applyInArrow(probe, f"query_id {kinds[0]}, other_id {kinds[1]}, distance double")


def regions_of(points: DataFrame, point_id: str, regions: DataFrame, region_id: str, ring: str, x: str = "x", y: str = "y", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Pairs (point_id, region_id) of points and the polygons that contain them, by the even-odd rule with half-open edges.

    ``ring`` is an array of structs with fields x and y, closed implicitly. The regions are copied into all leaves that their boxes
    touch, each point lies in one leaf. Regions of fewer than three vertices, or with null vertices, contain nothing.
    Many points or many regions of one place are spread over shards, as in ``near``.
    """
    r = regions.select(F.col(region_id).alias("id"), F.transform(ring, lambda p: p["x"].cast("double")).alias("xs"), F.transform(ring, lambda p: p["y"].cast("double")).alias("ys"))
    r = r.filter((F.size("xs") >= 3) & ~F.exists("xs", lambda v: v.isNull()) & ~F.exists("ys", lambda v: v.isNull()))
    r = r.select("*", F.array_min("xs").alias("lo_x"), F.array_min("ys").alias("lo_y"), F.array_max("xs").alias("hi_x"), F.array_max("ys").alias("hi_y"))
    middles = r.select(((F.col("lo_x") + F.col("hi_x")) / 2).alias("_x"), ((F.col("lo_y") + F.col("hi_y")) / 2).alias("_y"))
    tree = plan_quadtree(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", leaf_rows, queries=middles)
    left = _place_boxes(r, tree)
    right = _place_rows(points.select(F.col(point_id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y")), tree, "_x", "_y")
    kinds = dict(right.dtypes)["id"], dict(r.dtypes)["id"]

    def probe(a: pa.Table, b: pa.Table) -> pa.Table:
        px, py = b["x"].to_numpy(), b["y"].to_numpy()
        region, entry = [], []
        if len(px) and a.num_rows:
            for query, found in RTree(px, py, px, py).probe_lots(*(a[c].to_numpy() for c in ("lo_x", "lo_y", "hi_x", "hi_y"))):
                order = np.argsort(query, kind="stable")
                query, found = query[order], found[order]
                ends = np.flatnonzero(np.diff(query, append=-1)) + 1
                for k, at in zip(query[ends - 1], np.split(found, ends[:-1])):
                    inside = _even_odd(px[at], py[at], np.array(a["xs"][int(k)].as_py()), np.array(a["ys"][int(k)].as_py()))
                    entry.append(at[inside])
                    region.append(np.full(inside.sum(), k))
        entry, region = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (entry, region))
        return pa.table({"point_id": b["id"].take(pa.array(entry)), "region_id": a["id"].take(pa.array(region))})

    return left.groupBy("leaf", "shard").cogroup(right.groupBy("leaf", "shard")).applyInArrow(probe, f"point_id {kinds[0]}, region_id {kinds[1]}")


def _even_odd(px, py, vx, vy) -> np.ndarray:
    inside = np.zeros(len(px), dtype=bool)
    for x0, y0, x1, y1 in zip(vx, vy, np.roll(vx, -1), np.roll(vy, -1)):
        if y0 == y1:
            continue
        crosses = (min(y0, y1) <= py) & (py < max(y0, y1))
        inside ^= crosses & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return inside
