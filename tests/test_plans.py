import numpy as np
import pytest
from pyspark.sql import functions as F

from grovewise.plans.bounded import broadcast_bounded, small_enough
from grovewise.plans.quadtree import Quadtree, RTree
from grovewise.plans.ranking import Sorted


@pytest.mark.parametrize("most", [1000, 3])
def test_ranks_of_a_group_that_spans_partitions(spark, most):
    df = spark.range(500).select(F.when(F.col("id") < 400, "a").when(F.col("id") < 480, "b").alias("k"), (F.col("id") * 7919 % 500).alias("v"))
    order = Sorted(df, ["k"], ["v"], partitions=7)
    got = order.ranked("r", "n", most).toPandas()
    for key, part in got.groupby(got.k.fillna("none")):
        part = part.sort_values("v")
        assert part.r.tolist() == list(range(len(part))) and (part.n == len(part)).all(), key
    assert set(got.k.fillna("none")) == {"a", "b", "none"}
    wanted = spark.createDataFrame([("a", 0, "x"), ("a", 399, "y"), (None, 5, "z")], "k string, want bigint, tag string")
    values = {r["tag"]: r["v"] for r in order.at(wanted, "want", ["tag"], ["v"], most).collect()}
    own = {key: sorted(part.v) for key, part in got.groupby(got.k.fillna("none"))}
    assert values == {"x": own["a"][0], "y": own["a"][399], "z": own["none"][5]}


def test_ranks_without_rows_and_with_repeats(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert Sorted(df, ["k"], ["v"]).ranked().count() == 0
    twice = spark.createDataFrame([("a", 1)] * 5 + [("a", 2)], "k string, v int")
    assert sorted(r["_rank"] for r in Sorted(twice, ["k"], ["v"]).ranked().collect()) == list(range(6))
    assert sorted(r["_rank"] for r in Sorted(twice, ["k"], ["v"], distinct=True).ranked().collect()) == [0, 1]


def test_broadcast_only_when_counted(spark):
    df = spark.range(100)
    assert small_enough(df, 100) and not small_enough(df, 99)
    assert "Broadcast" in spark.range(9).join(broadcast_bounded(df, 100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in spark.range(9).join(broadcast_bounded(df, 99), "id")._jdf.queryExecution().executedPlan().toString()


def test_quadtree_and_rtree_against_comparing_all():
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 1, (400, 2)), rng.uniform(-20, 20, (300, 2)), np.zeros((50, 2))])
    tree = Quadtree.build(xy, 20)
    assert tree.shards.max() > 1  # one position holds more than a leaf's share
    leaf = tree.leaf_of(xy[:, 0], xy[:, 1])
    lo, hi = xy - 0.7, xy + 0.7
    rows, leaves = tree.leaves_touching(lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
    reached = set(zip(rows.tolist(), leaves.tolist()))
    inside = (np.abs(xy[:, None] - xy[None]) <= 0.7).all(axis=2)
    assert all((i, leaf[j]) in reached for i, j in zip(*np.nonzero(inside)))
    q, e = RTree(xy[:, 0], xy[:, 1], xy[:, 0], xy[:, 1], fan=4).probe(lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
    assert sorted(zip(q.tolist(), e.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(inside))))
    empty = Quadtree.build(np.zeros((0, 2)), 5)
    assert empty.leaf_of(np.array([3.0]), np.array([-9.0])).tolist() == [0]
