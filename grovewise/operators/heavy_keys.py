"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows looked at to find heavy keys; a key counts as heavy above this share of them. The share bounds the heavy keys to 1 / share.
SAMPLE_ROWS, SHARE = 100_000, 0.002


def heavy_keys(df: DataFrame, key: str, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Keys that hold at least about ``share`` of the rows, from a sample of about ``sample_rows`` rows.

    At most ``1 / share`` rows come back, whatever the input's size, so the result may always be broadcast. Being missed or
    taken wrongly changes only the route of a key, never its result.
    """
    rows = df.count()
    sample = df.select(key) if rows <= sample_rows else df.select(key).sample(fraction=sample_rows / rows, seed=11)
    counts = sample.groupBy(key).agg(F.count("*").alias("_n"))
    least = max(2.0, share * min(rows, sample_rows))
    return counts.filter(F.col("_n") >= least).orderBy(F.desc("_n")).limit(int(1 / share)).select(key)


def distinct_counts(df: DataFrame, key: str, item: str, count: str = "n", share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each key the number of distinct non-null items, evenly loaded whatever the keys' shares.

    Rows of heavy keys, found by a broadcast join with the bounded list of those, are spread by key *and* item, so that one key's
    repeats are dropped in all tasks, and counted with a map-side partial count. All other rows take an ordinary shuffle
    by key. A null key is a key of its own; a key whose items are all null has count 0; an empty table gives none.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(item).alias("_item"))
    heavy = F.broadcast(heavy_keys(rows, "_key", share, sample_rows).select(F.col("_key").alias("_heavy")))
    on = F.col("_key").eqNullSafe(F.col("_heavy"))
    spread = rows.join(heavy, on, "left_semi").dropDuplicates(["_key", "_item"]).groupBy("_key").agg(F.count("_item").alias(count))
    light = rows.join(heavy, on, "left_anti").repartition("_key").dropDuplicates(["_key", "_item"]).groupBy("_key").agg(F.count("_item").alias(count))
    return spread.unionByName(light).withColumnRenamed("_key", key)


def join_counts(left: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` with its keys' counts, 0 where a key has none."""
    return left.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
