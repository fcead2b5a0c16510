"""Plots with known truth: trees, their points, and a field inventory with errors. Small by design, made on the driver from a seed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass(frozen=True)
class Plot:
    """A plot's make: trees, side, least spacing, lean and slope in degrees, origin, and the cube that keeps one point."""

    trees: int = 15
    side: float = 30.0
    spacing: float = 5.0
    lean: float = 0.0
    slope: float = 0.0
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    thin: float = 0.02


#: Plots to test against.
PLOTS = {"open": Plot(), "canopy": Plot(40, 30.0, 2.2, 4.0, thin=0.03), "sloped": Plot(slope=15.0), "leaning": Plot(12, lean=20.0), "far": Plot(slope=3.0, origin=(204300.0, 7223250.0, 112.0), thin=0.012)}


def placed(plot: Plot, rng: np.random.Generator) -> pd.DataFrame:
    """Trees at random places at least the plot's spacing apart, each with height, diameter and lean."""
    spots: list[np.ndarray] = []
    for _ in range(200 * plot.trees):
        spot = rng.uniform(0, plot.side, 2)
        if all(np.hypot(*(spot - s)) >= plot.spacing for s in spots):
            spots.append(spot)
        if len(spots) == plot.trees:
            break
    xy = np.array(spots).reshape(-1, 2)
    height = rng.uniform(8, 24, len(xy))
    ground = np.tan(np.radians(plot.slope)) * xy[:, 0]
    return pd.DataFrame({"tree_id": np.arange(1, len(xy) + 1), "x": xy[:, 0] + plot.origin[0], "y": xy[:, 1] + plot.origin[1], "base_z": ground + plot.origin[2], "height_m": height, "dbh_m": np.round(0.012 * height + rng.uniform(0.02, 0.16, len(xy)), 3), "lean_deg": rng.uniform(0, plot.lean, len(xy))})


def points_of(trees: pd.DataFrame, plot: Plot, rng: np.random.Generator, trunk: int = 1500, crown: int = 300, ground: int = 2000) -> pd.DataFrame:
    """Hollow trunks, crown shells, ground and a little noise, one point kept for each cube (the first)."""
    parts = []
    for t in trees.itertuples():
        a, z = rng.uniform(0, 2 * np.pi, trunk), rng.uniform(0, 0.5 * t.height_m, trunk)
        way, tilt = rng.uniform(0, 2 * np.pi), np.tan(np.radians(t.lean_deg))
        r = t.dbh_m / 2
        parts.append(np.column_stack([t.x + r * np.cos(a) + tilt * z * np.cos(way), t.y + r * np.sin(a) + tilt * z * np.sin(way), t.base_z + z, np.full(trunk, t.tree_id)]))
        v = rng.normal(size=(crown, 3))
        v = v / np.linalg.norm(v, axis=1, keepdims=True) * [1.2, 1.2, 0.25 * t.height_m]
        top = t.base_z + 0.75 * t.height_m
        parts.append(np.column_stack([t.x + tilt * 0.75 * t.height_m * np.cos(way) + v[:, 0], t.y + tilt * 0.75 * t.height_m * np.sin(way) + v[:, 1], top + v[:, 2], np.full(crown, t.tree_id)]))
    g = rng.uniform(0, plot.side, (ground, 2))
    parts.append(np.column_stack([g[:, 0] + plot.origin[0], g[:, 1] + plot.origin[1], np.tan(np.radians(plot.slope)) * g[:, 0] + plot.origin[2] - 0.05, np.zeros(ground)]))
    parts.append(np.column_stack([rng.uniform(0, plot.side, (20, 3)) + plot.origin, np.full(20, -1)]))
    p = pd.DataFrame(np.concatenate(parts), columns=["x", "y", "z", "tree_id"]).astype({"tree_id": "int32"})
    cube = np.floor(p[["x", "y", "z"]] / plot.thin)
    p = p[~cube.duplicated()].reset_index(drop=True)
    p.insert(0, "point_id", np.arange(len(p)))
    return p


def field_map(trees: pd.DataFrame, rng: np.random.Generator, jitter: float = 0.5, missing: int = 2, extra: int = 1, shift: tuple[float, float] = (0.0, 0.0), turn: float = 0.0) -> pd.DataFrame:
    """A stem map with errors of position, height (5%) and diameter (1 cm), missing and additional stems, in a frame shifted and turned (degrees)."""
    kept = trees.sample(len(trees) - missing, random_state=int(rng.integers(1 << 30)))
    a = np.radians(turn)
    xy = kept[["x", "y"]].to_numpy() + rng.normal(0, jitter / 2, (len(kept), 2))
    xy = xy @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + shift
    out = pd.DataFrame({"stem_id": [f"F{t}" for t in kept.tree_id], "x": xy[:, 0], "y": xy[:, 1], "dbh": kept.dbh_m.to_numpy() + rng.normal(0, 0.01, len(kept)), "height": kept.height_m.to_numpy() * rng.normal(1, 0.05, len(kept)), "species": "oak"})
    ghosts = pd.DataFrame({"stem_id": [f"G{i}" for i in range(extra)], "x": xy[:, 0].max() + 30 + np.arange(extra), "y": xy[:, 1].max() + 30.0, "dbh": 0.2, "height": 10.0, "species": "oak"})
    return pd.concat([out, ghosts], ignore_index=True)
