"""Versioned edits of labels and classes on immutable tables: an event log, undo and redo, differences and snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovewise.constants import NOISE, UNASSIGNED
from grovewise.functions.labels import is_tree
from grovewise.operators.neighbours import nearest
from grovewise.plans.bounded import broadcast_bounded
from grovewise.session import materialize

LOG = "seq long, target string, point_id long, old int, new int"


def applied(base: DataFrame, log: DataFrame, target: str = "tree_id", ident: str = "point_id") -> DataFrame:
    """``base`` with the log's active edits of one target: the newest value of each point, else the base's. The log is reduced to one row for each point before it is joined."""
    newest = log.filter(F.col("target") == target).groupBy("point_id").agg(F.max_by("new", "seq").alias("_new"))
    out = base.join(newest.withColumnRenamed("point_id", "_p"), F.col(ident) == F.col("_p"), "left")
    return out.withColumn(target, F.coalesce("_new", target)).drop("_new", "_p")


def edit_of(points: DataFrame, selected: DataFrame, value: int | Column, target: str = "tree_id", seq: int = 1) -> DataFrame:
    """The log rows of one edit: selected points (point_id, repeats count once) whose value changes. No change, no row; ids that aren't there are left out."""
    new = value if isinstance(value, Column) else F.lit(value)
    rows = points.join(selected.select("point_id").distinct(), "point_id", "left_semi").select("point_id", F.col(target).cast("int").alias("old"), new.cast("int").alias("new"))
    return rows.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.lit(seq).cast("long").alias("seq"), F.lit(target).alias("target"), "point_id", "old", "new")


def active_edits(operations: list[str]) -> list[int]:
    """Which do-operations (numbered from 1 in order) are in force after a run of do, undo and redo: the last one done is undone first, a new one clears what could be redone."""
    done: list[int] = []
    undone: list[int] = []
    number = 0
    for op in operations:
        if op == "do":
            number += 1
            done.append(number)
            undone.clear()
        elif op == "undo" and done:
            undone.append(done.pop())
        elif op == "redo" and undone:
            done.append(undone.pop())
    return done


@dataclass
class Scene:
    """Points under edit: the base table, an append-only log, and which edits are in force. A new scene has a new history."""

    points: DataFrame
    log: DataFrame | None = None
    done: list[int] = field(default_factory=list)
    undone: list[int] = field(default_factory=list)
    next_seq: int = 1
    first_free: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def edits(self) -> DataFrame:
        log = self.log if self.log is not None else self.spark.createDataFrame([], LOG)
        return log.filter(F.col("seq").isin(self.done)) if self.done else log.limit(0)

    def current(self) -> DataFrame:
        out = applied(self.points, self.edits(), "tree_id")
        return applied(out, self.edits(), "cls") if "cls" in out.columns else out

    def set(self, selected: DataFrame, value: int, target: str = "tree_id") -> int:
        """Give the selected points a value; the number of points changed. An edit that changes nothing leaves no trace in the history."""
        rows = materialize(edit_of(self.current(), selected, value, target, self.next_seq), "edit")
        changed = rows.count()
        if changed:
            self.log = rows if self.log is None else self.log.unionByName(rows)
            self.done.append(self.next_seq)
            self.undone.clear()
            self.next_seq += 1
        return changed

    def last_changed(self) -> DataFrame:
        last = self.done[-1:] or [0]
        return self.edits().filter(F.col("seq").isin(last)).select("point_id")

    def undo(self) -> bool:
        if self.done:
            self.undone.append(self.done.pop())
            return True
        return False

    def redo(self) -> bool:
        if self.undone:
            self.done.append(self.undone.pop())
            return True
        return False

    def free_id(self) -> int:
        """The id for a new tree: above all in use, and above all given out before."""
        top = self.current().agg(F.max("tree_id")).first()[0]
        new = max(1, (top if top is not None else 0) + 1, self.first_free or 1)
        self.first_free = new + 1
        return new

    def reassign(self, selected: DataFrame, tree: int) -> int:
        return self.set(selected, tree)

    def create_new(self, selected: DataFrame) -> int:
        """Split the selected points off as a new tree; its id."""
        new = self.free_id()
        self.set(selected, new)
        return new

    def mark_noise(self, selected: DataFrame) -> int:
        return self.set(selected, NOISE)

    def unassign(self, selected: DataFrame) -> int:
        return self.set(selected, UNASSIGNED)

    def set_class(self, selected: DataFrame, code: int) -> int:
        return self.set(selected, code, "cls")

    def switch_class_column(self, column: str) -> None:
        """Take another column as the class; refused while class edits are in force."""
        if not self.edits().filter(F.col("target") == "cls").isEmpty():
            raise ValueError("save or undo the class edits first")
        self.points = self.points.withColumn("cls", F.col(column).cast("int"))

    def target_of(self, selected: DataFrame, current: int | None) -> DataFrame:
        """The selection, or without one all points of the current tree."""
        if not selected.isEmpty():
            return selected.select("point_id")
        return self.current().filter(F.col("tree_id") == current).select("point_id") if current is not None else selected.select("point_id")


def changed_rows(current: DataFrame, base: DataFrame, target: str = "tree_id") -> DataFrame:
    """(point_id, old, new) where the value differs from the base's."""
    was = base.select(F.col("point_id"), F.col(target).alias("old"))
    return current.select("point_id", F.col(target).alias("new")).join(was, "point_id").filter(~F.col("old").eqNullSafe(F.col("new"))).select("point_id", "old", "new")


def touched_labels(log: DataFrame) -> DataFrame:
    """Labels that edits have taken from or given to."""
    return log.filter("target = 'tree_id'").select(F.explode(F.array("old", "new")).alias("tree_id")).distinct()


def whole_moves(points: DataFrame, before: str, after: str, code: Column | None = None, trees_only: bool = True) -> DataFrame:
    """(code, new): codes whose every working point changed, all to one value; for labels only real trees (before above 0)."""
    own = code if code is not None else F.col(before)
    kept = points.groupBy(own.alias("code")).agg(F.bool_and(F.col(before) != F.col(after)).alias("_all"), F.min(after).alias("_a"), F.max(after).alias("_b"), F.min(before).alias("_least"))
    one = F.col("_all") & (F.col("_a") == F.col("_b"))
    return kept.filter(one & (F.col("_least") > 0) if trees_only else one).select("code", F.col("_a").alias("new"))


def expanded(full: DataFrame, working: DataFrame, size: float, trees_only: bool = True) -> DataFrame:
    """(point_id, new): the edits of a thinned cloud carried to all its points.

    ``full`` has point_id, x, y, z, code; ``working`` the kept points with point_id, x, y, z, code, before, after. In order: a code moved whole takes all its points along, wherever they are; of the others,
    those within two voxels of the box of changed points follow the nearest working point of their own code, strictly nearer than two voxels, if that one changed. Points of untouched codes never change.
    """
    changed = working.filter(F.col("before") != F.col("after"))
    ends = changed.agg(*[f(F.col(a).cast("double")).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in "xyz"]).first()
    if ends["lx"] is None:
        return full.select("point_id", F.lit(0).alias("new")).limit(0)
    whole = materialize(whole_moves(working, "before", "after", F.col("code"), trees_only), "whole")
    moved = full.join(broadcast_bounded(whole), "code").select("point_id", "new")
    reach = 2.0 * size

    def near(wide: float) -> Column:
        out = F.lit(True)
        for a in "xyz":
            out = out & F.col(a).between(ends[f"l{a}"] - wide, ends[f"h{a}"] + wide)
        return out

    asked = full.filter(near(reach)).join(broadcast_bounded(whole.select("code")), "code", "left_anti")
    kept = working.filter(near(2 * reach)).select("code", F.col("point_id").alias("kept_id"), "x", "y", "z")
    hit = nearest(asked.select("code", "point_id", "x", "y", "z"), kept, reach, "point_id", "kept_id", ["code"], most=reach)
    follow = hit.join(changed.select(F.col("point_id").alias("kept_id"), F.col("after").alias("new")), "kept_id").select("point_id", "new")
    return moved.unionByName(follow)


def scene_points(points: DataFrame, trees: list[int], margin: float = 1.0) -> DataFrame:
    """Points of the trees and unassigned ones in their box widened by ``margin`` (ends in single precision), each once. No point of the trees is an error."""
    ends = points.filter(F.col("tree_id").isin(trees)).agg(*[f(F.col(a)).alias(f"{n}{a}") for n, f in (("l", F.min), ("h", F.max)) for a in "xyz"]).first()
    if ends["lx"] is None:
        raise ValueError(f"no points of {trees}")
    box = F.col("tree_id") == UNASSIGNED
    for a in "xyz":
        box = box & F.col(a).between((F.lit(ends[f"l{a}"]).cast("float") - F.lit(margin).cast("float")).cast("float"), (F.lit(ends[f"h{a}"]).cast("float") + F.lit(margin).cast("float")).cast("float"))
    return points.filter(F.col("tree_id").isin(trees) | box)


class Snapshots:
    """Versions of a table under one folder: each save writes the difference, and a snapshot can be built from the base and all differences."""

    def __init__(self, base: DataFrame, folder: str):
        self.base, self.folder, self.spark, self.version = base, folder, base.sparkSession, 0

    def at(self, version: int | None = None) -> DataFrame:
        out = self.base
        for v in range(1, (self.version if version is None else version) + 1):
            out = applied(out, self.spark.read.schema(LOG).parquet(f"{self.folder}/delta={v}"), "tree_id")
        return out

    def save(self, current: DataFrame) -> int:
        """Publish the rows that differ from the last version as the next one; how many. Without a difference there is no new version."""
        delta = materialize(changed_rows(current, self.at()), "delta")
        n = delta.count()
        if n:
            self.version += 1
            delta.select(F.lit(self.version).cast("long").alias("seq"), F.lit("tree_id").alias("target"), "point_id", F.col("old").cast("int"), F.col("new").cast("int")).write.mode("error").parquet(f"{self.folder}/delta={self.version}")
        return n

    def save_as(self, current: DataFrame, path: str) -> int:
        """Write the whole table elsewhere; the versions here stay as they are."""
        current.write.mode("error").parquet(path)
        return changed_rows(current, self.at()).count()


def linked(links: DataFrame, tree: int, stem: str) -> DataFrame:
    """Links (tree_id, stem_id) after one more: a stem has one tree and a tree one stem."""
    new = links.sparkSession.createDataFrame([(tree, stem)], links.schema)
    return links.filter((F.col("tree_id") != tree) & (F.col("stem_id") != stem)).unionByName(new)


def unlinked(links: DataFrame, tree: int) -> DataFrame:
    return links.filter(F.col("tree_id") != tree)


def click_chains(clicks: DataFrame, seconds: float = 2.5, pixels: float = 30.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``clicks`` (ts, x, y, click_id) with the chain they belong to and their step in it: a click soon after the last and near to it goes on with the chain."""
    order = Window.partitionBy(*keys).orderBy("ts", "click_id")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(order)
    far = (F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2
    goes_on = F.coalesce((gap <= seconds) & (far <= pixels * pixels), F.lit(False))
    out = clicks.withColumn("_new", (~goes_on).cast("int")).withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("step", F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("ts", "click_id")) - 1).drop("_new")


def shown(hide_unassigned: bool = False, hidden: list[int] | None = None, section: Column | None = None, label: str = "tree_id") -> Column:
    """Whether a point is seen: not unassigned or noise if those are hidden, not of a hidden tree, and in the section."""
    out = F.lit(True)
    if hide_unassigned:
        out = out & is_tree(F.col(label))
    if hidden:
        out = out & ~F.col(label).isin(hidden)
    return out & section if section is not None else out
