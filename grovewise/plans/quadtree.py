"""A quadtree over a bounded sample, and a packed R-tree for the rows of one leaf."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Quadtree:
    """Leaves as boxes that tile the plane: the outermost leaves reach to infinity.

    A node has split_x, split_y and its first child; a leaf has child -1 and its number in ``leaf``. ``shards`` and ``asked`` say into how
    many chunks the rows of a leaf and the queries that come to it are spread, where even the deepest leaf holds more than its share. ``area`` is the sampled area of each leaf.
    """

    split_x: np.ndarray
    split_y: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    shards: np.ndarray
    asked: np.ndarray
    area: np.ndarray

    @staticmethod
    def build(xy: np.ndarray, capacity: int, deepest: int = 24, queries: np.ndarray | None = None, query_capacity: int = 1, least: float = 1e-6) -> "Quadtree":
        """From sampled coordinates of rows and queries; a node with more than ``capacity`` rows or more than ``query_capacity`` queries is split at the middle of its box, down to an edge of ``least``."""
        sx, sy, child, leaf, shards, asked, area = [0.0], [0.0], [-1], [-1], [], [], []
        given = len(xy)
        both = np.concatenate([xy.reshape(-1, 2), (np.zeros((0, 2)) if queries is None else queries).reshape(-1, 2)])
        lo, hi = (both.min(axis=0), both.max(axis=0)) if len(both) else (np.zeros(2), np.zeros(2))
        todo = [(0, np.arange(len(both)), lo, hi, 0)]
        while todo:
            node, rows, lo, hi, depth = todo.pop()
            own = int((rows < given).sum())
            other = len(rows) - own
            if (own <= capacity and other <= query_capacity) or depth >= deepest or (hi - lo).max() <= least:
                leaf[node] = len(shards)
                shards.append(max(1, -(-own // max(capacity, 1))))
                asked.append(max(1, -(-other // max(query_capacity, 1))))
                area.append(float(np.prod(hi - lo)))
                continue
            mid = (lo + hi) / 2
            sx[node], sy[node], child[node] = mid[0], mid[1], len(child)
            part = (both[rows, 0] >= mid[0]) + 2 * (both[rows, 1] >= mid[1])
            for k in range(4):
                todo.append((len(child), rows[part == k], np.where([k & 1, k & 2], mid, lo), np.where([k & 1, k & 2], hi, mid), depth + 1))
                sx.append(0.0), sy.append(0.0), child.append(-1), leaf.append(-1)
        return Quadtree(*(np.array(a) for a in (sx, sy, child, leaf, shards, asked, area)))

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The one leaf of each point."""
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := self.child[node] >= 0).any():
            at = node[inner]
            node[inner] = self.child[at] + (x[inner] >= self.split_x[at]) + 2 * (y[inner] >= self.split_y[at])
        return self.leaf[node]

    def leaves_touching(self, lo_x, lo_y, hi_x, hi_y) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: each box with every leaf it overlaps."""
        rows, node = np.arange(len(lo_x)), np.zeros(len(lo_x), dtype=np.int64)
        out_rows, out_leaves = [], []
        while len(rows):
            done = self.child[node] < 0
            out_rows.append(rows[done])
            out_leaves.append(self.leaf[node[done]])
            rows, node = rows[~done], node[~done]
            next_rows, next_nodes = [], []
            for k in range(4):
                in_x = hi_x[rows] >= self.split_x[node] if k & 1 else lo_x[rows] < self.split_x[node]
                in_y = hi_y[rows] >= self.split_y[node] if k & 2 else lo_y[rows] < self.split_y[node]
                next_rows.append(rows[in_x & in_y])
                next_nodes.append(self.child[node[in_x & in_y]] + k)
            rows, node = np.concatenate(next_rows), np.concatenate(next_nodes)
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate(out_rows or [empty]), np.concatenate(out_leaves or [empty])


class RTree:
    """Boxes bulk-loaded by sort-tile-recursive packing; probed level by level for many queries at once."""

    def __init__(self, lo_x: np.ndarray, lo_y: np.ndarray, hi_x: np.ndarray, hi_y: np.ndarray, fan: int = 16):
        self.fan, n = fan, len(lo_x)
        slabs = max(1, int(np.ceil(np.sqrt(np.ceil(n / fan)))))
        by_x = np.argsort(lo_x + hi_x, kind="stable")
        slab = np.empty(n, dtype=np.int64)
        slab[by_x] = np.arange(n) * slabs // max(n, 1)
        self.order = np.lexsort((lo_y + hi_y, slab))
        self.levels = [np.stack([a[self.order] for a in (lo_x, lo_y, hi_x, hi_y)])]
        while self.levels[-1].shape[1] > fan:
            below = self.levels[-1]
            at = np.arange(0, below.shape[1], fan)
            self.levels.append(np.concatenate([np.minimum.reduceat(below[:2], at, axis=1), np.maximum.reduceat(below[2:], at, axis=1)]))

    def probe(self, lo_x, lo_y, hi_x, hi_y) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and entry numbers of all overlapping boxes."""
        lots = list(self.probe_lots(lo_x, lo_y, hi_x, hi_y))
        empty = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([lot[k] for lot in lots] or [empty]) for k in (0, 1))

    def probe_lots(self, lo_x, lo_y, hi_x, hi_y, most: int = 2_000_000):
        """As ``probe``, in lots that hold at most about ``most`` candidates at a time: queries that meet more are halved."""
        top = self.levels[-1].shape[1]
        step = max(1, most // max(top, 1))
        todo = [np.arange(i, min(i + step, len(lo_x))) for i in range(0, len(lo_x), step)][::-1]
        while todo:
            asked = todo.pop()
            query, node = np.repeat(asked, top), np.tile(np.arange(top), len(asked))
            for depth in range(len(self.levels) - 1, -1, -1):
                box = self.levels[depth]
                hit = (box[0][node] <= hi_x[query]) & (box[2][node] >= lo_x[query]) & (box[1][node] <= hi_y[query]) & (box[3][node] >= lo_y[query])
                query, node = query[hit], node[hit]
                if depth and len(query) * self.fan > most and len(asked) > 1:
                    todo += [asked[len(asked) // 2 :], asked[: len(asked) // 2]]
                    break
                if depth:
                    size = self.levels[depth - 1].shape[1]
                    query, node = np.repeat(query, self.fan), (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    query, node = query[node < size], node[node < size]
            else:
                if len(query):
                    yield query, self.order[node]
