"""Boxes, polygons, slabs, projections and wireframes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_box(axes: Sequence[Column], low: Sequence, high: Sequence) -> Column:
    """Whether all coordinates lie in the box, both ends included."""
    out = F.lit(True)
    for c, lo, hi in zip(axes, low, high):
        out = out & c.between(F.lit(lo) if isinstance(lo, (int, float)) else lo, F.lit(hi) if isinstance(hi, (int, float)) else hi)
    return out


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test with half-open edges: the box first, then one crossing for each edge that isn't level. Fewer than three vertices hold nothing.

    A plain expression over literals, so that it is compiled with the rest of its stage.
    """
    if len(polygon) < 3:
        return F.lit(False)
    x, y = x.cast("double"), y.cast("double")
    odd = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y0 == y1:
            continue
        at = (y - F.lit(float(y0))) * F.lit(float(x1) - float(x0)) / F.lit(float(y1) - float(y0)) + F.lit(float(x0))
        odd = odd + F.when((y >= float(min(y0, y1))) & (y < float(max(y0, y1))) & (x < at), 1).otherwise(0)
    xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (odd % 2 == 1)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """``in_polygon`` for an array of structs x, y."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, F.pmod(i + 1, n))["x"].alias("x1"), F.get(ring, F.pmod(i + 1, n))["y"].alias("y1")))
    sloped = F.filter(edges, lambda e: e["y0"] != e["y1"])
    hit = lambda e: (y >= F.least(e["y0"], e["y1"])) & (y < F.greatest(e["y0"], e["y1"])) & (x < (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]) + e["x0"])
    return (n >= 3) & F.aggregate(sloped, F.lit(False), lambda odd, e: odd != hit(e))


def slab(axis: Column, low: float, high: float) -> Column:
    return axis.between(low, high)


def moved_slab(low: float, high: float, start: float, end: float, by: float = 0.0, grow: float = 0.0, thinnest: float = 0.02, step: float = 0.05) -> tuple[float, float]:
    """A slab moved by ``by`` and thickened by ``grow`` steps (shares ``step`` of the extent), kept within start to end and never thinner than ``thinnest``."""
    thick = min(max(high - low + 2 * grow * step * (end - start), thinnest), max(end - start, thinnest))
    middle = (low + high) / 2 + by * step * (end - start)
    low = min(max(middle - thick / 2, start), max(start, end - thick))
    return low, low + thick


def quantised(value: float, start: float, end: float, parts: int = 1000) -> float:
    """The nearest of so many equal steps from start to end."""
    return start if end <= start else start + round((value - start) / (end - start) * parts) / parts * (end - start)


def projected(x: Column, y: Column, z: Column, matrix: Sequence[Sequence[float]], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column, Column]:
    """Canvas x, y, depth, and whether the point lies before the camera. ``matrix`` is 4 x 4: rows for x, y, z and the offset, columns for x, y, depth, w."""
    local = [c.cast("double") - F.lit(float(o)) for c, o in zip((x, y, z), origin)]
    out = [local[0] * float(matrix[0][k]) + local[1] * float(matrix[1][k]) + local[2] * float(matrix[2][k]) + float(matrix[3][k]) for k in range(4)]
    w = F.when(out[3] > 0, out[3]).otherwise(1.0)
    return out[0] / w, out[1] / w, out[2] / w, out[3] > 0


def thinned_path(path: Column, least: float = 3.0) -> Column:
    """The vertices (structs x, y) that lie at least ``least`` from the last one kept; the first always stays."""
    start = F.slice(path, 1, 1)

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = (p["x"] - last["x"]) ** 2 + (p["y"] - last["y"]) ** 2 >= least * least
        return F.when(F.size(kept) == 0, F.array(p)).when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(path, start, step)


def voxel(x: Column, y: Column, z: Column, size: float, low: Sequence[Column]) -> tuple[list[Column], Column]:
    """Cell numbers from the cloud's lowest corner, and the squared distance to the cell's centre, summed as single-precision numbers axis by axis."""
    cells, apart = [], None
    for c, lo in zip((x, y, z), low):
        rel = (c.cast("float") - lo.cast("float")) / F.lit(size).cast("float")
        cell = F.floor(rel.cast("float"))
        d = (rel.cast("float") - cell.cast("float") - F.lit(0.5).cast("float")).cast("float")
        sq = (d * d).cast("float")
        apart = sq if apart is None else (apart + sq).cast("float")
        cells.append(cell)
    return cells, apart


def cylinder_segments(stems: DataFrame, sides: int = 16, height: float = 8.0, dbh: float = 0.25, breast: float = 1.3) -> DataFrame:
    """(stem_id, seq, x0, y0, z0, x1, y1, z1): three rings and four verticals for each stem (stem_id, x, y, base_z, dbh, height); 0 and null take the usual size."""
    r = F.when(F.coalesce("dbh", F.lit(0.0)) == 0, dbh).otherwise(F.col("dbh")) / 2
    h = F.when(F.coalesce("height", F.lit(0.0)) == 0, height).otherwise(F.col("height"))
    rings = 3 * sides
    seq = F.col("seq")
    out = stems.select("stem_id", "x", "y", F.coalesce("base_z", F.lit(0.0)).alias("_f"), r.alias("_r"), h.alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(rings + 3))).alias("seq"))
    level = F.get(F.array(F.col("_f"), F.col("_f") + F.least(F.lit(breast), F.col("_h") * 0.5), F.col("_f") + F.col("_h")), F.floor(seq / sides).cast("int"))
    ring = seq < rings
    a = F.when(ring, (seq % sides) * (2 * math.pi / sides)).otherwise((seq - rings) * (math.pi / 2))
    b = F.when(ring, ((seq + 1) % sides) * (2 * math.pi / sides)).otherwise(a)
    at = lambda t: (F.col("x") + F.col("_r") * F.cos(t), F.col("y") + F.col("_r") * F.sin(t))
    (x0, y0), (x1, y1) = at(a), at(b)
    return out.select("stem_id", "seq", x0.alias("x0"), y0.alias("y0"), F.when(ring, level).otherwise(F.col("_f")).alias("z0"), x1.alias("x1"), y1.alias("y1"), F.when(ring, level).otherwise(F.col("_f") + F.col("_h")).alias("z1"))


#: Pairs of corners that an edge of a box joins; the bits of a corner's number say which end of x, y, z it has.
BOX_EDGES = [(i, i | bit) for i in range(8) for bit in (1, 2, 4) if not i & bit]


def box_edges(boxes: DataFrame, key: str = "tree_id") -> DataFrame:
    """(key, edge, x0, y0, z0, x1, y1, z1): the twelve edges of each box lo_x to hi_z."""
    pairs = F.array(*[F.struct(F.lit(k).alias("edge"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(BOX_EDGES)])
    out = boxes.select(key, "lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z", F.explode(pairs).alias("e"))
    end = lambda side, axis, bit: F.when(F.col(f"e.{side}").bitwiseAND(bit) > 0, F.col(f"hi_{axis}")).otherwise(F.col(f"lo_{axis}"))
    return out.select(key, F.col("e.edge").alias("edge"), *[end(s, a, bit).alias(f"{a}{n}") for n, s in ((0, "i"), (1, "j")) for a, bit in (("x", 1), ("y", 2), ("z", 4))])


def nice_length(most: Column) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    lead = most / power
    return F.when(most > 0, power * F.when(lead < 1.5, 1).when(lead < 3.5, 2).when(lead < 7.5, 5).otherwise(10)).otherwise(0.0)


def length_text(metres: Column) -> Column:
    """A length with the unit that suits it."""
    short = lambda v: F.regexp_replace(F.format_string("%.6f", v.cast("double")), r"\.?0+$", "")
    unit = lambda v, u: F.concat(short(v), F.lit(f" {u}"))
    return F.when(metres >= 1000, unit(metres / 1000, "km")).when(metres >= 1, unit(metres, "m")).when(metres >= 0.01, unit(metres * 100, "cm")).otherwise(unit(metres * 1000, "mm"))
