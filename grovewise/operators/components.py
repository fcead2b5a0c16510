"""Connected components of points within a distance, for each tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.operators.proximity import plan_quadtree
from grovewise.plans.quadtree import Quadtree
from grovewise.session import discard, materialize

AXES = ("x", "y", "z")
# Gaps offered, in spacings; and cells for each gap along an axis where points are taken together.
GAPS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
CELLS_PER_GAP = 3
#: Points are taken together only if that leaves at most this share of them.
WORTHWHILE = 0.9
#: Points that a block of space is to hold, and pairs of points that are measured at once within a block.
BLOCK_ROWS, PAIRS_AT_ONCE = 50_000, 1_000_000
#: Links that a task holds at once before it reduces them to a forest.
LINKS_AT_ONCE = 2_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of some links with the smallest id that these links lead to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return ids, ids[parent]
        np.minimum.at(parent, np.maximum(pa_, pb)[open_], np.minimum(pa_, pb)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _contracted(links: DataFrame) -> DataFrame:
    """(u, v) links reduced, in each partition, to a forest of the same components: at most one link for each id and partition."""

    def run(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            u, v = np.concatenate([u, b["u"].to_numpy()]), np.concatenate([v, b["v"].to_numpy()])
            if len(u) > LINKS_AT_ONCE:
                ids, roots = _forest(u, v)
                u, v = ids[ids != roots], roots[ids != roots]
                if len(u) > LINKS_AT_ONCE // 2:  # many ids: pass them on rather than hold them
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = u[:0], v[:0]
        if len(u):
            ids, roots = _forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ids != roots]), pa.array(roots[ids != roots])], ["u", "v"])

    return links.mapInArrow(run, "u bigint, v bigint")


def label_components(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """(id, component) for every id of an edge: the smallest id that it is connected with.

    Tasks first reduce the links they hold to forests. At most ``LINKS_AT_ONCE`` links, by count, are then reduced in one task. With more, large-star and small-star steps alternate: in each, every id's
    neighbours are tied to the least of them, so that after O(log n) rounds only stars are left. Edges stay distributed, each round is written to the shared folder, and neither components nor links reach
    the driver, only a checksum of each round's edges does.
    """
    links = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = materialize(_contracted(links).distinct(), "edges")
    if now.count() <= LINKS_AT_ONCE:
        stars = _contracted(now.coalesce(1))
        return _named(stars)
    sums = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours larger than an id are tied to the least around it.
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: an id and its smaller neighbours are tied to the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, now = now, materialize(small, "edges")
        discard(before)
        check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == sums:
            return _named(now)
        sums = check


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


class _Cells:
    """Occupied cells of points with a code each, and their neighbours by a step, found through one number for each cell."""

    def __init__(self, code: np.ndarray, cell: np.ndarray):
        rng = np.random.default_rng(11)
        while True:
            self.by = rng.integers(1 << 62, size=4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            key = self._key(code, cell)
            self.keys, first, self.of = np.unique(key, return_index=True, return_inverse=True)
            self.code, self.cell = code[first], cell[first]
            if (self.code[self.of] == code).all() and (self.cell[self.of] == cell).all():
                return  # else two cells share a number: draw others

    def _key(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return code.astype(np.uint64) * self.by[0] + (cell.astype(np.uint64) * self.by[1:]).sum(axis=1, dtype=np.uint64)

    def beside(self, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, the occupied cell of the same code one step on), for all cells that have it."""
        wanted = self.keys + (step.astype(np.uint64) * self.by[1:]).sum(dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == wanted)
        true = (self.code[here] == self.code[at[here]]) & (self.cell[here] + step == self.cell[at[here]]).all(axis=1)
        return here[true], at[here[true]]


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (a root for each node) after the nodes a and b are linked pairwise: the least node of each component."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _clusters(code: np.ndarray, cell: np.ndarray, xyz: np.ndarray, eps: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each point, root cell of each cell): points of one code and cell belong together, cells at most ``reach`` steps apart do if any two of their points are at most ``eps`` apart.

    Near cells are compared first, and cells that are connected by then aren't compared again, so dense places cost little.
    """
    cells = _Cells(code, cell)
    order = np.argsort(cells.of, kind="stable")
    xyz = xyz[order]
    start = np.searchsorted(cells.of[order], np.arange(len(cells.keys) + 1))
    size = np.diff(start)
    parent = np.arange(len(size))
    r = np.arange(-reach, reach + 1)
    steps = np.stack(np.meshgrid(r, r, r, indexing="ij"), axis=-1).reshape(-1, 3)
    steps = steps[len(steps) // 2 + 1 :]
    for step in steps[np.argsort((steps**2).sum(axis=1), kind="stable")]:
        a, b = cells.beside(step)
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        many = size[a] * size[b]
        lots = np.cumsum(many) // PAIRS_AT_ONCE
        for lot in np.unique(lots):
            these = lots == lot
            u, v = a[these], b[these]
            near = _any_near(xyz, start, int(u[0]), int(v[0]), eps) if len(u) == 1 and size[u[0]] * size[v[0]] > PAIRS_AT_ONCE else _near_pairs(xyz, start, size, u, v, eps)
            parent = _joined(parent, u[near], v[near])
    return cells.of, parent


def _near_pairs(xyz: np.ndarray, start: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, eps: float) -> np.ndarray:
    """For each pair of cells whether any two of their points are near."""
    many = size[u] * size[v]
    pair = np.repeat(np.arange(len(u)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    i, j = start[u][pair] + place // size[v][pair], start[v][pair] + place % size[v][pair]
    near = np.zeros(len(u), dtype=bool)
    near[pair[((xyz[i] - xyz[j]) ** 2).sum(axis=1) <= eps * eps]] = True
    return near


def _any_near(xyz: np.ndarray, start: np.ndarray, u: int, v: int, eps: float) -> np.ndarray:
    """``_near_pairs`` for one pair of cells with very many points, row by row of the one, up to the first hit."""
    theirs = xyz[start[v] : start[v + 1]]
    step = max(1, PAIRS_AT_ONCE // len(theirs))
    for i in range(start[u], start[u + 1], step):
        mine = xyz[i : min(i + step, start[u + 1])]
        if (((mine[:, None] - theirs[None]) ** 2).sum(axis=2) <= eps * eps).any():
            return np.array([True])
    return np.array([False])


def _in_blocks(points: DataFrame, keys: Sequence[str], ident: str, edge: float, reach: float, tree: Quadtree, slab: np.ndarray) -> DataFrame:
    """All points in the block of their cell (``own``), and again in each other block within ``reach`` of the cell; a cell's points go the same way together."""

    def run(batches):
        for b in batches:
            c = np.stack([np.floor(b[f"_{a}"].to_numpy() / edge).astype(np.int64) for a in AXES], axis=1)
            middle = (c + 0.5) * edge
            home = tree.leaf_of(middle[:, 0], middle[:, 1])
            home_slab = np.floor(middle[:, 2] / slab[home]).astype(np.int64)
            rows, leaf = tree.leaves_touching(middle[:, 0] - reach, middle[:, 1] - reach, middle[:, 0] + reach, middle[:, 1] + reach)
            first = np.floor((middle[rows, 2] - reach) / slab[leaf]).astype(np.int64)
            layers = np.floor((middle[rows, 2] + reach) / slab[leaf]).astype(np.int64) - first + 1
            level = np.repeat(first, layers) + np.arange(int(layers.sum())) - np.repeat(np.cumsum(layers) - layers, layers)
            rows, leaf = np.repeat(rows, layers), np.repeat(leaf, layers)
            own = (leaf == home[rows]) & (level == home_slab[rows])
            shared = np.bincount(rows, minlength=b.num_rows)[rows] > 1
            out = b.take(pa.array(rows))
            cells = [pa.array(c[rows, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*out.columns, *cells, pa.array(leaf), pa.array(level), pa.array(own), pa.array(shared)], [*out.schema.names, "_i", "_j", "_k", "_leaf", "_level", "_own", "_shared"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in points.dtypes)
    return points.mapInArrow(run, f"{schema}, _i long, _j long, _k long, _leaf long, _level long, _own boolean, _shared boolean")


def components_of(points: DataFrame, eps: float, keys: Sequence[str] = ("tree_id",), exact: bool = True, ident: str = "point_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ident, component): points of equal keys that are linked by steps of at most ``eps``; a component is named by its smallest id.

    A quadtree over a sample cuts space into blocks of about ``block_rows`` points, whatever their keys; deep or crowded leaves are cut into layers too. Each block is clustered in one pass over its own points
    and those within reach around it. Only cells that several blocks hold give links between blocks' clusters, and those links alone are solved for all blocks (``label_components``).

    ``exact`` finds all links: points within one cell of edge eps / sqrt(3) are near anyway, so heaps of equal or crowded points cost nothing. Otherwise points are first taken together by cells of a third
    of eps and only their first points are linked: components can come out split, never merged. Where that would leave nearly all points, they are linked exactly. With eps 0 points of one position belong
    together. Null, NaN and infinite coordinates are left out. Ids must be unique and whole numbers.
    """
    ok = F.lit(True)
    for a in AXES:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf"))
    given = points.filter(ok).select(*keys, F.col(ident).alias("_id"), *[F.col(a).cast("double").alias(f"_{a}") for a in AXES])
    if eps <= 0:
        names = [*keys, *[f"_{a}" for a in AXES]]
        least = given.groupBy(*names).agg(F.min("_id").alias("component"))
        left = given.select(*[F.col(n).alias(f"_o{k}") for k, n in enumerate(names)], "_id")
        same = [F.col(f"_o{k}").eqNullSafe(F.col(n)) for k, n in enumerate(names)]
        return left.join(least, same).select(*keys, F.col("_id").alias(ident), "component")
    given = materialize(given, "points")
    edge = eps / CELLS_PER_GAP
    if not exact:
        counted = given.groupBy(*keys, *[F.floor(F.col(f"_{a}") / edge).alias(f"_c{a}") for a in AXES]).agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.sum("n").alias("points")).first()
        exact = counted["cells"] > WORTHWHILE * (counted["points"] or 0)  # nearly every cell holds one point: taking them together saves nothing
    if exact:
        edge = eps / np.sqrt(3) * (1 - 1e-9)
    reach, around = eps + 2 * edge, (2 if exact else CELLS_PER_GAP)
    tree = plan_quadtree(given, "_x", "_y", block_rows, radius=4 * reach)
    height = given.agg(F.max("_z") - F.min("_z")).first()[0] or 0.0
    slab = np.maximum(8 * reach, (height + 1.0) / tree.shards)
    slab[tree.shards <= 1] = 1e18
    schema = dict(given.dtypes)

    def cluster(batch: pa.Table) -> pa.Table:
        cell = np.stack([batch[c].to_numpy() for c in ("_i", "_j", "_k")], axis=1)
        cell -= cell.min(axis=0)
        xyz = np.stack([batch[f"_{a}"].to_numpy() for a in AXES], axis=1)
        code = np.zeros(batch.num_rows, dtype=np.int64)
        for k in keys:
            coded = batch[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        ids = batch["_id"].to_numpy()
        if exact:
            of, root = _clusters(code, cell, xyz, eps, around)
            least_of_cell = np.full(len(root), np.iinfo(np.int64).max)
            np.minimum.at(least_of_cell, of, ids)
        else:
            cells = _Cells(code, cell)
            of = cells.of
            by_id = np.argsort(ids, kind="stable")[::-1]
            first = np.empty(len(cells.keys), dtype=np.int64)
            first[of[by_id]] = by_id  # the smallest id is written last
            least_of_cell = ids[first]
            of_first, root_of = _clusters(code[first], cell[first], xyz[first], eps, around)
            back = np.empty(len(first), dtype=np.int64)
            back[of_first] = np.arange(len(first))
            root = back[root_of][of_first]
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, least_of_cell)
        label = least[root]
        own = batch["_own"].to_numpy()
        border = np.unique(of[batch["_shared"].to_numpy()])
        ends = least_of_cell[border], label[border]
        mine = pa.array(own)
        columns = [*[batch[k].combine_chunks().filter(mine) for k in keys], pa.array(ids[own]), pa.array(label[of[own]]), pa.nulls(int(own.sum()), pa.int64())]
        links = [*[pa.nulls(len(border), batch.schema.field(k).type) for k in keys], pa.array(ends[0]), pa.array(ends[1]), pa.array(ends[0])]
        return pa.table([pa.concat_arrays([a, b]) for a, b in zip(columns, links)], names=[*keys, "_id", "_label", "_link"])

    given = given.withColumn("_id", F.col("_id").cast("long"))
    placed = _in_blocks(given, keys, ident, edge, reach, tree, slab)
    shape = ", ".join([*[f"`{k}` {schema[k]}" for k in keys], "_id long", "_label long", "_link long"])
    found = materialize(placed.groupBy("_leaf", "_level").applyInArrow(cluster, shape), "blocks")
    ties = label_components(found.filter(F.col("_link").isNotNull()).select(F.col("_link").alias("a_id"), F.col("_label").alias("b_id")))
    own = found.filter(F.col("_link").isNull())
    out = own.join(ties, F.col("_label") == F.col("id"), "left")
    return out.select(*keys, F.col("_id").cast(schema["_id"]).alias(ident), F.coalesce("component", "_label").cast(schema["_id"]).alias("component"))


def patch_of(points: DataFrame, seed: int, eps: float, shown=None, exact: bool = True) -> DataFrame:
    """(point_id): the connected piece of the seed's own tree that the seed lies in; with ``shown``, of that only what is shown. An unknown seed has no piece."""
    tree = points.filter(F.col("point_id") == seed).select("tree_id").first()
    if tree is None:
        return points.select("point_id").limit(0)
    own = points.filter(F.col("tree_id").eqNullSafe(F.lit(tree["tree_id"])))
    found = materialize(components_of(own, eps, ("tree_id",), exact), "patch")
    mine = found.filter(F.col("point_id") == seed).select("component")
    out = found.join(F.broadcast(mine), "component", "left_semi").select("point_id")
    return out if shown is None else out.join(points.filter(shown).select("point_id"), "point_id", "left_semi")


class ComponentCache:
    """Components kept by tree, gap and label version; the oldest leave beyond ``most``."""

    def __init__(self, most: int = 64):
        self.most, self.kept = most, {}

    def get(self, tree: int, gap: float, version: int, make) -> DataFrame:
        key = (tree, gap, version)
        found = self.kept.pop(key, None)
        self.kept[key] = found = found if found is not None else make()
        while len(self.kept) > self.most:
            self.kept.pop(next(iter(self.kept)))
        return found
