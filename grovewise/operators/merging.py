"""Sets of per-tree files: their tree ids, whether they can be joined, and the joined table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.functions.labels import LABEL_NAMES
from grovewise.functions.texts import NUMBER_IN_NAME, base_name, format_of, tree_in_name


def mapping_entries(lines: DataFrame) -> DataFrame:
    """(key, tree_id) from lines (line_no, path, value): the path as written and its bare name; the last line wins. Blank and # lines and values that are no number are left out."""
    value = F.trim("value").try_cast("double")
    ok = (F.trim("path") != "") & ~F.ltrim("path").startswith("#") & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 2147483648)
    rows = lines.filter(ok).select("line_no", F.explode(F.array(F.trim("path"), base_name(F.trim("path")))).alias("key"), value.cast("int").alias("tree_id"))
    return rows.groupBy("key").agg(F.max_by("tree_id", "line_no").alias("tree_id"))


def planned_sources(sources: DataFrame, mapping: DataFrame | None = None, ground: DataFrame | None = None, pattern: str = NUMBER_IN_NAME) -> DataFrame:
    """``sources`` (path) with their tree id: 0 for ground, else by the mapping's full path, else by its bare name, else by the file's own name."""
    out = sources.withColumn("_name", base_name(F.col("path"))).withColumn("_id", tree_in_name(F.col("path"), pattern))
    if mapping is not None:
        by_path, by_name = mapping.select(F.col("key").alias("path"), F.col("tree_id").alias("_p")), mapping.select(F.col("key").alias("_name"), F.col("tree_id").alias("_n"))
        out = out.join(by_path, "path", "left").join(by_name, "_name", "left").withColumn("_id", F.coalesce("_p", "_n", "_id"))
    if ground is not None:
        out = out.join(ground.select("path").distinct().withColumn("_g", F.lit(True)), "path", "left").withColumn("_id", F.when(F.col("_g"), 0).otherwise(F.col("_id")))
    return out.select(*sources.columns, F.col("_id").alias("tree_id"))


def source_problems(planned: DataFrame) -> DataFrame:
    """(problem, tree_id, n): what stops a set of files (path, tree_id): 'missing' ids, 'clash' of one id (ground may repeat), 'unreadable' formats, 'mixed' formats, 'empty' sets. No row: nothing does."""
    kind = format_of(F.col("path"))
    missing = planned.filter("tree_id is null").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("missing").alias("problem"), F.lit(None).cast("int").alias("tree_id"), "n")
    clash = planned.filter("tree_id <> 0").groupBy("tree_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("clash").alias("problem"), "tree_id", "n")
    kinds = planned.agg(F.count_distinct(kind).alias("k"), F.count(F.when(kind.isNull(), 1)).alias("bad"), F.count("*").alias("n"))
    none = F.lit(None).cast("int")
    whole = kinds.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") == 0, F.struct(F.lit("empty").alias("problem"), F.lit(0).cast("long").alias("n"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("unreadable").alias("problem"), F.col("bad").alias("n"))),
        F.when((F.col("bad") == 0) & (F.col("k") > 1), F.struct(F.lit("mixed").alias("problem"), F.col("k").alias("n"))),
    ))).alias("p")).select("p.problem", none.alias("tree_id"), "p.n")
    return missing.unionByName(clash).unionByName(whole)


def shared_columns(tables: list[DataFrame]) -> list[str]:
    """Columns that all tables have (in other case too), in the first one's order and spelling, without label columns."""
    common = set.intersection(*[{c.lower() for c in t.columns} for t in tables]) if tables else set()
    return [c for c in (tables[0].columns if tables else []) if c.lower() in common and c not in LABEL_NAMES]


def merged(tables: list[tuple[DataFrame, int]], label: str = "treeID", fill: bool = False) -> DataFrame:
    """One table of all per-tree tables with their tree id: the columns that all have in the first one's types, or with ``fill`` all columns of the first, 0 where another lacks them."""
    frames = [t for t, _ in tables]
    first = dict(frames[0].dtypes)
    names = [c for c in frames[0].columns if c not in LABEL_NAMES] if fill else shared_columns(frames)
    parts = []
    for t, tree in tables:
        own = {c.lower(): c for c in t.columns}
        parts.append(t.select(*[(F.col(own[n.lower()]) if n.lower() in own else F.lit(0)).cast(first[n]).alias(n) for n in names], F.lit(tree).cast("int").alias(label)))
    return reduce(DataFrame.unionByName, parts)


def progress_shares(sources: DataFrame) -> DataFrame:
    """``sources`` (ordinal, points) with the share of all points before and after each; one short list of files."""
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("points").over(Window.partitionBy())
    start = F.coalesce(F.sum("points").over(before), F.lit(0))
    return sources.withColumn("from_share", F.try_divide(start, total)).withColumn("to_share", F.try_divide(start + F.col("points"), total))


def review_order(trees: DataFrame, done: DataFrame, current: int) -> DataFrame:
    """One row: the next and the previous tree in order of id, and the next that isn't done, with wrap-around; null where there is none. No window over all trees: each is a minimum or maximum."""
    t = trees.select("tree_id").distinct().join(done.select("tree_id").distinct().withColumn("_d", F.lit(True)), "tree_id", "left")
    after, before = F.col("tree_id") > current, F.col("tree_id") < current
    open_ = F.col("_d").isNull() & (F.col("tree_id") != current)
    first = lambda c: F.min(F.when(c, F.col("tree_id")))
    last = lambda c: F.max(F.when(c, F.col("tree_id")))
    return t.agg(F.coalesce(first(after), F.min("tree_id")).alias("next"), F.coalesce(last(before), F.max("tree_id")).alias("previous"), F.coalesce(first(after & open_), first(open_)).alias("next_open"))


def table_filter(trees: DataFrame, prefix: str, done: DataFrame | None = None) -> DataFrame:
    """Trees whose id, written out, starts with ``prefix``, without those done if ``done`` is given."""
    out = trees.filter(F.col("tree_id").cast("string").startswith(prefix))
    return out if done is None else out.join(done.select("tree_id").distinct(), "tree_id", "left_anti")


def latest_release(releases: DataFrame) -> DataFrame:
    """The newest plain release (version, yanked) that isn't withdrawn."""
    from grovewise.functions.texts import release

    ok = releases.filter(~F.coalesce("yanked", F.lit(False)) & release(F.col("version")).isNotNull())
    return ok.agg(F.max_by("version", release(F.col("version"))).alias("version"))
