"""Exact percentiles of very many groups by one distributed sort, and summaries with bounded error that can be combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.constants import BROADCAST_ROWS
from grovewise.plans.ranking import Sorted


def usable(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def _long(df: DataFrame, groups: list[str], values: list[str], item: str | None) -> DataFrame:
    """One row for each group, column and usable value; ``_item`` tells repeats of one record from equal values."""
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("value")) for v in values])
    out = df.select(*groups, (F.col(item) if item else F.lit(0)).alias("_item"), F.explode(cells).alias("_c")).select(*groups, "_item", "_c.*")
    return out.filter(usable(F.col("value")))


def exact_percentiles(df: DataFrame, groups: list[str], values: list[str], pcts: list[float], item: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(groups, field, pct, n, value): percentiles with linear interpolation between neighbouring order statistics.

    All usable values are sorted once, by group, field, value and item, over all partitions, so that a group of any share is spread over many tasks. Counts
    for each partition and group give every group's offset; the one or two positions of each percentile are located from these, picked from the sorted
    table, and interpolated. ``item`` names a record id: rows alike in group, value and id count once. Null and NaN values don't count; a null
    group is a group; groups without usable values give no rows. Percentages lie in 0 to 100.
    """
    if bad := [p for p in pcts if not 0 <= p <= 100]:
        raise ValueError(f"percentages outside 0 to 100: {bad}")
    keys = [*groups, "field"]
    order = Sorted(_long(df, groups, values, item), keys, ["value", "_item"], distinct=item is not None)
    totals = order.pieces.groupBy(*keys).agg(F.max("_total").alias("_n"))
    wanted = totals.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in pcts])).alias("_pct"))
    at = (F.col("_n") - 1) * F.col("_pct") / 100
    wanted = wanted.withColumn("_lo", F.floor(at)).withColumn("_part", at - F.floor(at))
    ends = F.array_distinct(F.array(F.col("_lo"), F.least(F.col("_lo") + 1, F.col("_n") - 1)))
    wanted = wanted.select(*keys, "_n", "_pct", "_lo", "_part", F.explode(ends).alias("_want_rank"))
    keep = ["_n", "_pct", "_lo", "_part", "_want_rank"]
    found = order.at(wanted, "_want_rank", keep, [*keys, "value"], broadcast_rows)
    low = F.min(F.when(F.col("_want_rank") == F.col("_lo"), F.col("value")))
    high = F.max(F.when(F.col("_want_rank") > F.col("_lo"), F.col("value")))
    out = found.groupBy(*keys, "_pct").agg(F.max("_n").alias("n"), low.alias("_low"), high.alias("_high"), F.max("_part").alias("_part"))
    value = F.col("_low") + F.when(F.col("_part") > 0, F.col("_part") * (F.coalesce("_high", "_low") - F.col("_low"))).otherwise(0.0)
    return out.select(*keys, F.col("_pct").alias("pct"), "n", value.alias("value"))


def summaries(df: DataFrame, groups: list[str], part: str, values: list[str], error: float, item: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(groups, part, field, value, weight): order statistics that stand for ``weight`` values each, for each part apart.

    With n values, every s-th order statistic from the middle of its run of s is kept, s = max(1, floor(2 * error * n)), so that any value's rank is known to s / 2
    or better. Summaries of other parts, made at other times, are combined by ``combine``: their rank errors add up to at most ``error`` times
    all values, whatever the number of parts.
    """
    if not 0 < error < 0.5:
        raise ValueError("error lies between 0 and 0.5")
    keys = [*groups, part, "field"]
    order = Sorted(_long(df, [*groups, part], values, item), keys, ["value", "_item"], distinct=item is not None)
    ranked = order.ranked("_rank", "_all", broadcast_rows)
    step = F.greatest(F.lit(1), F.floor(2 * F.lit(error) * F.col("_all"))).cast("long")
    run = F.floor(F.col("_rank") / step)
    ranked = ranked.withColumn("_size", F.least(step, F.col("_all") - run * step)).withColumn("_in_run", F.col("_rank") - run * step)
    return ranked.filter(F.col("_in_run") == F.floor(F.col("_size") / 2)).select(*keys, "value", F.col("_size").alias("weight"))


def combine(summary: DataFrame, groups: list[str], pcts: list[float]) -> DataFrame:
    """(groups, field, pct, n, value) from the united summaries of any parts: the value whose run of weights holds the percentile's rank.

    A group has at most (1 / (2 * error) + 1) rows for each part, which bounds what one task of the window holds.
    """
    keys = [*groups, "field"]
    merged = summary.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    of_key = Window.partitionBy(*keys)
    upto = of_key.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("_end", F.sum("weight").over(upto)).withColumn("_n", F.sum("weight").over(of_key))
    asked = merged.select("*", F.explode(F.array(*[F.lit(float(p)) for p in pcts])).alias("pct"))
    rank = F.floor((F.col("_n") - 1) * F.col("pct") / 100)
    hit = asked.filter((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("weight")))
    return hit.select(*keys, "pct", F.col("_n").alias("n"), "value")
