"""Cells of equal edge, so that a distance condition becomes an equality that can be hashed.

Cells are three times as wide as the distance asked for. One side's rows lie in their own cell only, the other side's are copied into all cells that their reach touches (on average
2.8 in the plane, 4.6 in space), so every pair within reach meets exactly once, in the first side's cell. A row is compared with as many others as with the usual 9 or 27 narrow cells around it, for a fraction of
the copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3.0
#: Copies reach a little farther, so that rounding at a cell's edge loses no pair.
_SLACK = 1 + 1e-6


def cell_names(n: int) -> list[str]:
    return [f"_c{k}" for k in range(n)]


def with_cells(df: DataFrame, axes: Sequence[str], reach: float) -> DataFrame:
    """Each row in its own cell."""
    return df.select("*", *[F.floor(F.col(a).cast("double") / (WIDTH * reach)).alias(n) for n, a in zip(cell_names(len(axes)), axes)])


def with_cells_around(df: DataFrame, axes: Sequence[str], reach: float) -> DataFrame:
    """Each row in all cells that hold places at most ``reach`` away along each axis."""
    out, size, wide = df, WIDTH * reach, reach * _SLACK
    for n, a in zip(cell_names(len(axes)), axes):
        c = F.col(a).cast("double")
        out = out.select("*", F.explode(F.sequence(F.floor((c - wide) / size), F.floor((c + wide) / size))).alias(n))
    return out
