"""Ranks within groups by one distributed sort, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.constants import BROADCAST_ROWS
from grovewise.plans.bounded import broadcast_bounded
from grovewise.session import materialize, partitions_of

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_SHIFT = 33
PLACE = "_place"


def place_of(partition, row):
    """The place column's value for a row of a partition."""
    return F.shiftleft(partition.cast("long"), _SHIFT) + row.cast("long")


class Sorted:
    """A table in global order of ``keys`` and ``order``, written once.

    ``rows`` has the table's columns and ``_place`` (partition and row in it); ``pieces`` has one row for each key
    and each partition that holds some of its rows: the first row there (``_first``), how many (``_n``), how many of the key lie before (``_before``)
    and in all (``_total``). A key spread over many partitions has many pieces, so no task needs a whole key.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], distinct: bool = False, partitions: int | None = None):
        by = [*keys, *order]
        ranged = df.repartitionByRange(partitions or partitions_of(df.sparkSession), *by)
        if distinct:  # rows alike in all of these lie in one partition already
            ranged = ranged.dropDuplicates(by)
        placed = ranged.sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id())
        self.keys, self.rows = keys, materialize(placed, "sorted")
        part = F.shiftright(PLACE, _SHIFT).alias("_part")
        row = F.col(PLACE).bitwiseAND((1 << _SHIFT) - 1)
        pieces = self.rows.groupBy(part, *keys).agg(F.min(row).alias("_first"), F.count("*").alias("_n"))
        of_key = Window.partitionBy(*keys)
        before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        self.pieces = materialize(
            pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(of_key)),
            "pieces",
        )

    def ranked(self, rank: str = "_rank", total: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
        """``rows`` with each row's 0-based rank within its key, and optionally the key's number of rows."""
        part = F.shiftright(PLACE, _SHIFT)
        row = F.col(PLACE).bitwiseAND((1 << _SHIFT) - 1)
        own = self.pieces.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], "_first", "_before", "_total")
        on = part == F.col("_p")
        for i, k in enumerate(self.keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = self.rows.join(broadcast_bounded(own, most), on).withColumn(rank, F.col("_before") + row - F.col("_first"))
        if total:
            out = out.withColumn(total, F.col("_total"))
        return out.drop(PLACE, "_p", "_first", "_before", "_total", *[f"_k{i}" for i in range(len(self.keys))])

    def at(self, targets: DataFrame, rank: str, keep: list[str], value: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
        """The rows at given ranks. ``targets`` has the keys, the column ``rank`` and the columns ``keep``; gives keep and value."""
        named = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col(rank).alias("_want"), F.struct(*keep).alias("_keep"))
        on = (F.col("_want") >= F.col("_before")) & (F.col("_want") < F.col("_before") + F.col("_n"))
        for i, k in enumerate(self.keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        wanted = materialize(
            self.pieces.join(named, on).select(place_of(F.col("_part"), F.col("_first") + F.col("_want") - F.col("_before")).alias(PLACE), "_keep"),
            "wanted",
        )
        return self.rows.select(PLACE, *value).join(broadcast_bounded(wanted, most), PLACE).select(*value, "_keep.*")


def percentile_by_sort(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): for each key the value at ``share`` (0 to 1), interpolated between neighbours; nulls and NaN don't count.

    The exact aggregate function holds all distinct values of a key in one task; here a key of any size is sorted over all tasks, and two rows of it are picked.
    """
    c = F.col(value).cast("double")
    given = df.filter(c.isNotNull() & ~F.isnan(c)).select(*keys, c.alias("_v"))
    if not keys:
        given, keys = given.withColumn("_all", F.lit(0)), ["_all"]
    order = Sorted(given, keys, ["_v"])
    at = (F.col("_total") - 1) * F.lit(share)
    ends = order.pieces.groupBy(*keys).agg(F.max("_total").alias("_total")).select(*keys, F.floor(at).alias("_lo"), (at - F.floor(at)).alias("_part"), F.least(F.floor(at) + 1, F.col("_total") - 1).alias("_hi"))
    wanted = ends.select("*", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_want_rank"))
    found = order.at(wanted, "_want_rank", ["_lo", "_part", "_want_rank"], [*keys, "_v"])
    low, high = F.min("_v"), F.max("_v")
    out = found.groupBy(*keys).agg((low + F.when(F.max("_part") > 0, F.max("_part") * (high - low)).otherwise(0.0)).alias(name))
    return out.drop("_all")
