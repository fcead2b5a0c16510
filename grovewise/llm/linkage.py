"""Matching records of two sources that share no key: blocking, agreement levels, expectation-maximisation, one-to-one links."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.plans.bounded import broadcast_bounded
from grovewise.session import discard, materialize


@dataclass(frozen=True)
class LinkSettings:
    """Limits in metres and natural logarithms; each list of bounds makes one agreement level more than it has bounds."""

    reach: float = 8.0  # farthest displacement of a survey
    near: float = 4.0  # farthest pair of the first pass, survey displacement removed
    far: float = 8.0  # farthest pair of the second pass, which needs like sizes
    vote_bin: float = 0.5
    distance: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
    dbh: tuple[float, ...] = (0.05, 0.1, 0.15, 0.25, 0.4)
    height: tuple[float, ...] = (0.5, 1.0, 1.5, 2.5, 4.0)
    poor_fit: float = 0.2  # above it a diameter isn't compared
    least: float = 0.5  # confidence of a link
    rounds: int = 60  # of expectation-maximisation at most


def _level(value: Column, bounds: tuple[float, ...]) -> Column:
    out = F.when(value.isNull(), -1)
    for i, b in enumerate(bounds):
        out = out.when(value <= b, i)
    return out.otherwise(len(bounds)).cast("int")


def _cells(df: DataFrame, x: str, y: str, size: float, spread: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return df.withColumn("_ox", F.explode(around)).withColumn("_oy", F.explode(around)).withColumn("_cx", cx + F.col("_ox")).withColumn("_cy", cy + F.col("_oy")).drop("_ox", "_oy")


def _log_ratio(s: LinkSettings) -> Column:
    ok = (F.col("a_dbh") > 0) & (F.col("b_dbh") > 0) & (F.coalesce("a_fit", F.lit(0.0)) <= s.poor_fit)
    return F.when(ok, F.abs(F.log(F.col("a_dbh") / F.col("b_dbh"))))


def survey_shifts(a: DataFrame, b: DataFrame, s: LinkSettings = LinkSettings()) -> DataFrame:
    """(cloud, dx, dy): how far the b side of each cloud is displaced, by votes of pairs of like size.

    Offsets of all pairs within reach and of like size vote in a histogram; the bin that has most votes together with its neighbours wins (ties: the
    smaller displacement) and is refined by the mean of the offsets around it. A cloud without pairs has no row.
    """
    size = _cells(a.filter("a_x is not null and a_y is not null"), "a_x", "a_y", s.reach, False)
    pairs = size.join(_cells(b.filter("b_x is not null and b_y is not null"), "b_x", "b_y", s.reach, True), ["cloud", "_cx", "_cy"])
    like = F.coalesce(_log_ratio(s) <= 0.2, F.lit(True)) & F.coalesce(F.abs(F.col("a_height") - F.col("b_height")) <= 2.0, F.lit(True))
    some = _log_ratio(s).isNotNull() | (F.col("a_height") - F.col("b_height")).isNotNull()
    pairs = pairs.withColumn("dx", F.col("b_x") - F.col("a_x")).withColumn("dy", F.col("b_y") - F.col("a_y"))
    pairs = materialize(pairs.filter((F.abs("dx") <= s.reach) & (F.abs("dy") <= s.reach) & like & some).select("cloud", "dx", "dy"), "votes")
    votes = pairs.groupBy("cloud", F.rint(F.col("dx") / s.vote_bin).alias("i"), F.rint(F.col("dy") / s.vote_bin).alias("j")).agg(F.count("*").alias("n"))
    around = F.array(*[F.lit(float(k)) for k in (-1, 0, 1)])
    smooth = votes.withColumn("oi", F.explode(around)).withColumn("oj", F.explode(around)).groupBy("cloud", (F.col("i") + F.col("oi")).alias("i"), (F.col("j") + F.col("oj")).alias("j")).agg(F.sum("n").alias("n"))
    best = smooth.groupBy("cloud").agg(F.max_by(F.struct("i", "j"), F.struct("n", -(F.col("i") ** 2 + F.col("j") ** 2), "i", "j")).alias("b"))
    best = best.select("cloud", (F.col("b.i") * s.vote_bin).alias("bx"), (F.col("b.j") * s.vote_bin).alias("by"))
    close = (F.abs(F.col("dx") - F.col("bx")) <= 2 * s.vote_bin) & (F.abs(F.col("dy") - F.col("by")) <= 2 * s.vote_bin)
    return pairs.join(broadcast_bounded(best), "cloud").filter(close).groupBy("cloud").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))


def candidate_pairs(a: DataFrame, b: DataFrame, s: LinkSettings = LinkSettings()) -> DataFrame:
    """Pairs of any of three blocking passes, each once: near one another; farther, with like diameter and height; and, where b has no position, like diameter and height in the same cloud.

    A cloud of any size is split by cells or size classes, so no pass pairs everything within a cloud.
    """
    narrow = ["a_id", "b_id"]
    p1 = _cells(a, "a_x", "a_y", s.near, False).join(_cells(b, "b_x", "b_y", s.near, True), ["cloud", "_cx", "_cy"])
    p1 = p1.filter(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= s.near)
    klass = lambda d, h: (F.floor(F.log(F.when(F.col(d) > 0, F.col(d))) / 0.2).alias("_d"), F.floor(F.col(h) / 2.0).alias("_h"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    ac = a.select("*", *klass("a_dbh", "a_height")).filter("_d is not null and _h is not null")
    bc = b.select("*", *klass("b_dbh", "b_height")).filter("_d is not null and _h is not null")
    bc = bc.withColumn("_od", F.explode(around)).withColumn("_oh", F.explode(around)).withColumn("_d", F.col("_d") + F.col("_od")).withColumn("_h", F.col("_h") + F.col("_oh")).drop("_od", "_oh")
    like = (_log_ratio(s) <= 0.15) & (F.abs(F.col("a_height") - F.col("b_height")) <= 1.5)
    p2 = _cells(ac, "a_x", "a_y", s.far, False).join(_cells(bc, "b_x", "b_y", s.far, True), ["cloud", "_cx", "_cy", "_d", "_h"])
    p2 = p2.filter(like & (F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) <= s.far))
    p3 = ac.join(bc.filter("b_x is null or b_y is null"), ["cloud", "_d", "_h"]).filter((_log_ratio(s) <= 0.05) & (F.abs(F.col("a_height") - F.col("b_height")) <= 0.5))
    return p1.select(*narrow).unionByName(p2.select(*narrow)).unionByName(p3.select(*narrow)).distinct()


def fit(patterns: list[tuple[tuple[int, ...], int]], levels: tuple[int, ...], rounds: int = 60, start: float = 0.3) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches, and for each comparison the levels' probabilities among matches and others, by expectation-maximisation over pattern counts.

    A level of -1 (not comparable) says nothing. The agreeing levels start as likelier among matches. Counts are bounded by the number of patterns, whatever the number of pairs.
    """
    p = start
    m = [np.array([2.0 ** -(i) for i in range(k)]) for k in levels]
    u = [np.ones(k) for k in levels]
    m, u = [x / x.sum() for x in m], [x / x.sum() for x in u]
    if not patterns:
        return p, m, u
    g = np.array([x for x, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    for _ in range(rounds):
        lm, lu = np.log(p) + np.zeros(len(g)), np.log(1 - p) + np.zeros(len(g))
        for k in range(len(levels)):
            known = g[:, k] >= 0
            lm[known] += np.log(m[k][g[known, k]])
            lu[known] += np.log(u[k][g[known, k]])
        w = 1 / (1 + np.exp(np.clip(lu - lm, -50, 50)))
        before, p = p, float(np.clip((w * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for k, size in enumerate(levels):
            known = g[:, k] >= 0
            a = np.bincount(g[known, k], (w * n)[known], size) + 0.5
            b = np.bincount(g[known, k], ((1 - w) * n)[known], size) + 0.5
            m[k], u[k] = a / a.sum(), b / b.sum()
        if abs(p - before) < 1e-7:
            break
    return p, m, u


def scored_pairs(a: DataFrame, b: DataFrame, s: LinkSettings = LinkSettings()) -> DataFrame:
    """(a_id, b_id, confidence, weight, apart): candidate pairs with the posterior probability of a match.

    ``a`` and ``b`` have a_id / b_id (unique), cloud, and x, y, height, dbh with the prefix; a has a_fit. Positions of b are used with its cloud's displacement taken off.
    """
    shifts = survey_shifts(a, b, s)
    b = b.join(broadcast_bounded(materialize(shifts, "shifts")), "cloud", "left")
    b = b.withColumn("b_x", F.col("b_x") - F.coalesce("dx", F.lit(0.0))).withColumn("b_y", F.col("b_y") - F.coalesce("dy", F.lit(0.0))).drop("dx", "dy")
    b = materialize(b, "aligned")
    # A pair without a position could be with any tree of its cloud.
    chance = a.groupBy("cloud").agg(F.log(F.count("*").cast("double")).alias("_trees"))
    pairs = candidate_pairs(a, b, s).join(a, "a_id").join(b.drop("cloud"), "b_id").join(broadcast_bounded(chance), "cloud")
    apart = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    pairs = pairs.select("a_id", "b_id", "_trees", apart.alias("apart"), _log_ratio(s).alias("_r"), F.abs(F.col("a_height") - F.col("b_height")).alias("_h"))
    # How far a pair is from perfect within its level, for ties only.
    blur = F.coalesce(F.col("apart") / 0.4, F.lit(3.0)) ** 2 + F.coalesce(F.col("_r") / 0.1, F.lit(1.0)) ** 2 + F.coalesce(F.col("_h") / 1.0, F.lit(1.0)) ** 2
    levels = [_level(F.col("apart"), s.distance).alias("l0"), _level(F.col("_r"), s.dbh).alias("l1"), _level(F.col("_h"), s.height).alias("l2")]
    pairs = materialize(pairs.select("a_id", "b_id", "apart", "_trees", blur.alias("blur"), *levels), "pairs")
    # Only the first pass takes pairs whatever their sizes, so only it tells how sizes differ by chance.
    near = pairs.filter(F.col("l0").between(0, len(s.distance) - 1))
    patterns = [((r["l0"], r["l1"], r["l2"]), r["count"]) for r in near.groupBy("l0", "l1", "l2").count().collect()]
    p, m, u = fit(patterns, (len(s.distance), len(s.dbh) + 1, len(s.height) + 1), s.rounds)
    tables = [np.log(m[k] / u[k]) for k in range(3)]
    # Beyond the first pass chance pairs grow with the area, and matches are taken as half as likely as in its last ring.
    ring = (s.far**2 - s.near**2) / (s.near**2 - s.distance[-2] ** 2)
    tables[0] = np.append(tables[0], min(tables[0][-1], 0.0) - np.log(2 * ring))
    weight = F.when(F.col("l0") < 0, -F.col("_trees")).otherwise(float(np.log(p / (1 - p))))
    for k in range(3):
        weight = weight + F.when(F.col(f"l{k}") >= 0, F.get(F.array(*[F.lit(float(x)) for x in tables[k]]), F.col(f"l{k}"))).otherwise(0.0)
    return pairs.withColumn("weight", weight).withColumn("confidence", 1 / (1 + F.exp(-F.col("weight")))).select("a_id", "b_id", "confidence", "weight", "apart", "blur")


def one_to_one(pairs: DataFrame, order: list[Column], a: str = "a_id", b: str = "b_id") -> DataFrame:
    """The greedy one-to-one choice in a strict total order, by rounds of pairs that are best for both sides.

    Equal to going through all pairs from the best: what is best for both sides is taken, all pairs of taken rows leave, until none are left. Each round is a
    maximum by either side, so no side's pairs are gathered; every round but the last takes at least the best pair left.
    """
    key = F.struct(*order, F.col(a).alias("_a"), F.col(b).alias("_b"))
    left = materialize(pairs.withColumn("_o", key), "left")
    taken = None
    while not left.isEmpty():
        best_a = left.groupBy(a).agg(F.min("_o").alias("_o"))
        best_b = left.groupBy(b).agg(F.min("_o").alias("_o"))
        both = left.join(best_a, [a, "_o"], "left_semi").join(best_b, [b, "_o"], "left_semi")
        both = materialize(both, "taken")
        taken = both if taken is None else taken.unionByName(both)
        before, left = left, materialize(left.join(both.select(a), a, "left_anti").join(both.select(b), b, "left_anti"), "left")
        discard(before)
    return (taken if taken is not None else left).drop("_o")


def link(a: DataFrame, b: DataFrame, s: LinkSettings = LinkSettings()) -> DataFrame:
    """(a_id, b_id, confidence, apart): one-to-one links of at least the least confidence, the most likely first; ties by closeness, then ids."""
    scored = scored_pairs(a, b, s).filter(F.col("confidence") >= s.least)
    order = [(-F.round("weight", 6)).alias("w"), F.round("blur", 6).alias("blur")]
    return one_to_one(scored, order).select("a_id", "b_id", "confidence", "apart")
