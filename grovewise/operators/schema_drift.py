"""Files whose fields drift from version to version: report each change, read all into one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.operators.components import label_components
from grovewise.operators.records import latest
from grovewise.plans.ranking import Sorted
from grovewise.session import materialize

# PLY types under one name each, and names of one quantity under its usual name.
TYPES = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}
QUANTITIES = {
    "tree_id": ["tree_id", "treeid", "instance", "instanceid", "predinstance", "scalar_treeid", "scalar_label", "segment_id", "label", "id", "scalar_instance"],
    "intensity": ["intensity", "scalar_intensity", "int_raw"],
    "deviation": ["deviation", "pulse_dev"],
    "gps_time": ["gps_time", "gpstime", "time", "t_gps"],
    "hag": ["hag", "height_above_ground", "z_norm"],
    "leafwood": ["leafwood", "leaf_wood", "semantic"],
    "classification": ["classification", "class", "cls"],
    "point_source": ["point_source", "pointsourceid", "scan_pos"],
    "red": ["red", "r"],
    "reflectance": ["reflectance", "refl", "scalar_refl"],
    "return_number": ["return_number", "returnnumber", "rn"],
    "amplitude": ["amplitude", "amp"],
    "x": ["x"], "y": ["y"], "z": ["z"],
}
#: The consistent table's columns: quantity and type.
COLUMNS = {"x": "double", "y": "double", "z": "double", "tree_id": "long", "intensity": "double", "deviation": "double", "gps_time": "double", "hag": "double", "leafwood": "long", "classification": "long", "point_source": "long", "red": "long", "reflectance": "double", "return_number": "long", "amplitude": "double"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def quantity_of(name: Column) -> Column:
    """The usual name of the quantity that a field's name is known to mean, else null."""
    return _lookup({alias: q for q, names in QUANTITIES.items() for alias in names}, F.lower(name))


def alias_order(name: Column) -> Column:
    """The place of a name among the known names of its quantity; unknown names come last."""
    order = {alias: i for names in QUANTITIES.values() for i, alias in enumerate(names)}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.lower(name)), F.lit(len(order)))


def plain_type(kind: Column) -> Column:
    return F.coalesce(_lookup(TYPES, F.lower(kind)), F.lower(kind))


def fingerprint(attributes: Column) -> Column:
    """A digest of the fields and plain types, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(attributes, lambda a: F.concat_ws(":", a["name"], plain_type(a["type"])))), ","), 256)


def versions(files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each file once (source_id), with its place in its series by ``written_at``, ``attributes`` cleaned and their fingerprint, and the columns ``more`` (null where ``files`` hasn't them).

    Fields without a name are dropped; a name that a file repeats counts where it stands first. A null list counts as no fields.
    """
    once = latest(files.filter(F.col("source_id").isNotNull()), ["source_id"], ["received_at"])
    named = F.filter(F.coalesce("attributes", F.array().cast(dict(files.dtypes)["attributes"])), lambda a: a.isNotNull() & a["name"].isNotNull())
    first = F.filter(named, lambda a, i: F.array_position(F.transform(named, lambda b: b["name"]), a["name"]) == i + 1)
    slim = once.select("series_id", "written_at", "source_id", first.alias("attributes"), *[F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in more])
    ranked = Sorted(slim, ["series_id"], ["written_at", "source_id"]).ranked("version")
    return ranked.withColumn("fingerprint", fingerprint(F.col("attributes")))


def schema_changes(files: DataFrame, rows: DataFrame | None = None, agree: float = 0.6) -> DataFrame:
    """(series_id, source_id, before_id, change_kind, field, was): every change of a file against the one written just before.

    A removed and an added field are one renamed field if they stand in the same place (the same number, or the same unchanged fields before
    them) and hold the same quantity: their records agree at the same row numbers in at least ``agree`` of the cases, or, with nothing to compare,
    both names are known for one quantity. Nulls are compared with nothing. Each field is in one renaming at most. retyped compares plain PLY types,
    of a renamed field too. Order alone is no change. A series of any share is sorted over all tasks, and no list of its files is gathered.
    """
    v = versions(files)
    before = v.select(F.col("series_id").alias("_series"), (F.col("version") + 1).alias("_next"), F.col("source_id").alias("before_id"), F.col("attributes").alias("was"), F.col("fingerprint").alias("was_print"))
    both = v.join(before, F.col("series_id").eqNullSafe(F.col("_series")) & (F.col("version") == F.col("_next"))).drop("_series", "_next", "version", "written_at")
    both = both.filter(F.col("fingerprint") != F.col("was_print")).drop("fingerprint", "was_print")
    name = lambda a: a["name"]
    both = both.withColumn("_now_n", F.transform("attributes", name)).withColumn("_was_n", F.transform("was", name))
    both = both.withColumn("_kept", F.array_intersect("_now_n", "_was_n"))

    def lone(fields: str, others: str) -> Column:
        """Fields only here: name, type, place, and which kept fields stand before."""
        placed = F.transform(fields, lambda a, i: F.struct(a["name"].alias("name"), plain_type(a["type"]).alias("type"), i.alias("place"), F.array_sort(F.array_intersect(F.transform(F.slice(fields, F.lit(1), i), name), F.col("_kept"))).alias("after")))
        return F.filter(placed, lambda a: ~F.array_contains(others, a["name"]))

    both = both.withColumn("_new", lone("attributes", "_was_n")).withColumn("_old", lone("was", "_now_n"))
    ids = ["series_id", "source_id", "before_id"]
    pairs = both.filter((F.size("_new") > 0) & (F.size("_old") > 0)).select(*ids, "_old", F.explode("_new").alias("new")).select(*ids, "new", F.explode("_old").alias("old"))
    pairs = pairs.filter((F.col("new.place") == F.col("old.place")) | (F.col("new.after") == F.col("old.after")))
    pairs = pairs.withColumn("_known", F.coalesce(quantity_of(F.col("new.name")) == quantity_of(F.col("old.name")), F.lower("new.name") == F.lower("old.name")))
    if rows is not None:
        values = rows.select(F.col("source_id").alias("_s"), "row_no", F.from_json("record", "map<string,string>").alias("_m")).dropDuplicates(["_s", "row_no"])
        value = lambda m, n: F.try_element_at(m, n).try_cast("double")
        names = pairs.select("source_id", "before_id", F.col("new.name").alias("_new_n"), F.col("old.name").alias("_old_n"))
        now = names.join(values, F.col("source_id") == F.col("_s")).select("source_id", "before_id", "_new_n", "_old_n", "row_no", value(F.col("_m"), F.col("_new_n")).alias("_v1"))
        old = values.select(F.col("_s").alias("_s0"), F.col("row_no").alias("_r0"), F.col("_m").alias("_m0"))
        seen = now.join(old, (F.col("before_id") == F.col("_s0")) & (F.col("row_no") == F.col("_r0"))).withColumn("_v0", value(F.col("_m0"), F.col("_old_n"))).filter(F.col("_v0").isNotNull() & F.col("_v1").isNotNull())
        close = F.abs(F.col("_v0") - F.col("_v1")) <= 1e-4 * F.greatest(F.lit(1.0), F.abs("_v0"))
        seen = seen.groupBy("source_id", "_new_n", "_old_n").agg(F.count("*").alias("_tried"), F.avg(close.cast("int")).alias("_share"), F.count_distinct("_v0").alias("_kinds"))
        pairs = pairs.withColumn("_new_n", F.col("new.name")).withColumn("_old_n", F.col("old.name")).join(seen, ["source_id", "_new_n", "_old_n"], "left")
        unknown = quantity_of(F.col("new.name")).isNull() | quantity_of(F.col("old.name")).isNull()
        same = F.when(F.col("_tried") >= 1, (F.col("_share") >= agree) & (F.col("_known") | (unknown & (F.col("_kinds") >= 2)) | ((F.col("_share") == 1) & (F.col("_kinds") >= 3)))).otherwise(F.col("_known"))
    else:
        same = F.col("_known")
    pairs = pairs.filter(same)
    order = [F.desc("_known"), F.asc("new.place"), F.asc("old.place")]
    pairs = pairs.withColumn("_a", F.row_number().over(Window.partitionBy("source_id", "new.name").orderBy(*order)))
    pairs = pairs.withColumn("_b", F.row_number().over(Window.partitionBy("source_id", "old.name").orderBy(*order))).filter((F.col("_a") == 1) & (F.col("_b") == 1))
    renamed = pairs.groupBy("source_id").agg(F.collect_list(F.struct(F.col("new.name").alias("new"), F.col("old.name").alias("old"), F.col("new.type").alias("type"), F.col("old.type").alias("was"))).alias("_ren"))
    both = both.join(renamed, "source_id", "left").withColumn("_ren", F.coalesce("_ren", F.array().cast("array<struct<new:string,old:string,type:string,was:string>>")))
    change = lambda kind, field, was: F.struct(F.lit(kind).alias("change_kind"), field.alias("field"), was.alias("was"))
    new_names, old_names = F.transform("_ren", lambda r: r["new"]), F.transform("_ren", lambda r: r["old"])
    old_type = lambda n: plain_type(F.filter("was", lambda b: b["name"] == n)[0]["type"])
    none = F.lit(None).cast("string")
    changes = F.concat(
        F.transform(F.filter("_new", lambda a: ~F.array_contains(new_names, a["name"])), lambda a: change("added", a["name"], none)),
        F.transform(F.filter("_old", lambda a: ~F.array_contains(old_names, a["name"])), lambda a: change("removed", a["name"], none)),
        F.transform("_ren", lambda r: change("renamed", r["new"], r["old"])),
        F.transform(F.filter("_ren", lambda r: ~r["type"].eqNullSafe(r["was"])), lambda r: change("retyped", r["new"], r["was"])),
        F.transform(F.filter("attributes", lambda a: F.array_contains("_kept", a["name"]) & ~plain_type(a["type"]).eqNullSafe(old_type(a["name"]))), lambda a: change("retyped", a["name"], old_type(a["name"]))),
    )
    return both.select(*ids, F.explode(changes).alias("c")).select(*ids, "c.*")


def file_changes(files: DataFrame) -> DataFrame:
    """Changes of ``label_field`` (relabelled) and ``path`` (moved) of a file against the one written just before, in the columns of ``schema_changes``: field is the value now, was the one before, null where none is stated."""
    kinds = {"relabelled": "label_field", "moved": "path"}
    v = versions(files, tuple(kinds.values())).select("series_id", "source_id", "version", F.explode(F.array(*[F.struct(F.lit(k).alias("change_kind"), F.col(c).alias("field")) for k, c in kinds.items()])).alias("c")).select("series_id", "source_id", "version", "c.*")
    before = v.select(F.col("series_id").alias("_series"), (F.col("version") + 1).alias("_next"), F.col("source_id").alias("before_id"), F.col("change_kind").alias("_kind"), F.col("field").alias("was"))
    both = v.join(before, F.col("series_id").eqNullSafe(F.col("_series")) & (F.col("version") == F.col("_next")) & (F.col("change_kind") == F.col("_kind")))
    return both.filter(~F.col("field").eqNullSafe(F.col("was"))).select("series_id", "source_id", "before_id", "change_kind", "field", "was")


def migrations(files: DataFrame, changes: DataFrame | None) -> DataFrame:
    """(source_id, label, routes): the field that holds each file's labels; and for each file a map from its fields' names to where their values belong: a column of ``COLUMNS``, or "?" and a name in ``others``.

    A field lives in a run of successive versions; a recorded renaming ties the end of one run to the start of another, so renamings compose, forwards and
    backwards, into chains over any number of versions. A chain's column is that of its newest name that is known, else its values go by its newest name (unless
    the file has a field of that name, or two chains claim it). A name used again later for something else is another run. Runs come from one distributed sort,
    chains from connected components; only the fields of one file are ever listed together.
    The label field is the one that ``label_field`` states; if the file has none of that name, the one of a chain that once had it, or spelt so but for case, or of a chain that another
    file of the series states, or the first known one, in this order. It and its chain are ``tree_id``.
    Of a file's fields for one column the label field, else the first in the order of known names has it; the others go to ``others`` under their own names.
    """
    fields = versions(files, ("label_field",)).select("series_id", "source_id", "version", "label_field", F.posexplode(F.transform("attributes", lambda a: a["name"])).alias("_nth", "_name"))
    fields = Sorted(fields, ["series_id", "_name"], ["version"]).ranked("_r").withColumn("_run", F.col("version") - F.col("_r")).drop("_r")
    runs = fields.groupBy("series_id", "_name", "_run").agg(F.max("version").alias("_last"))
    runs = materialize(runs.withColumn("_id", F.monotonically_increasing_id()), "runs")
    of_run = runs.select(F.col("series_id").alias("_series"), F.col("_name").alias("_n"), F.col("_run").alias("_at"), "_id", "_last")
    same_run = F.col("series_id").eqNullSafe(F.col("_series")) & (F.col("_name") == F.col("_n")) & (F.col("_run") == F.col("_at"))
    fields = materialize(fields.join(of_run, same_run).select("series_id", "source_id", "label_field", "_nth", "_name", "_id", "_last"), "fields")
    if changes is not None:
        end = lambda source, name, to: fields.select(F.col("source_id").alias(source), F.col("_name").alias(name), F.col("_id").alias(to))
        ties = changes.filter(F.col("change_kind") == "renamed").select("source_id", "field", "before_id", "was")
        ties = ties.join(end("source_id", "field", "a_id"), ["source_id", "field"]).join(end("before_id", "was", "b_id"), ["before_id", "was"])
        chains = label_components(ties.select("a_id", "b_id")).select(F.col("id").alias("_id"), F.col("component").alias("_chain"))
        fields = materialize(fields.join(chains, "_id", "left").withColumn("_chain", F.coalesce("_chain", "_id")), "chained")
    else:
        fields = fields.withColumn("_chain", F.col("_id"))
    exact = F.coalesce(F.col("_name") == F.col("label_field"), F.lit(False))
    stale = fields.groupBy("source_id").agg(F.first("series_id").alias("_series"), F.first("label_field").alias("_stated"), F.max(exact).alias("_there")).filter(~F.col("_there") & F.col("_stated").isNotNull())
    once = fields.select("series_id", "_name", "_chain").distinct()
    stale = stale.join(once, F.col("series_id").eqNullSafe(F.col("_series")) & (F.col("_name") == F.col("_stated"))).select("source_id", "_chain", F.lit(True).alias("_stale"))
    fields = fields.join(stale, ["source_id", "_chain"], "left").withColumn("_stale", F.coalesce("_stale", F.lit(False)))
    known = quantity_of(F.col("_name"))
    of_chain = fields.groupBy("_chain").agg(F.max(exact | F.col("_stale")).alias("_label"), F.max_by(known, F.when(known.isNotNull(), F.struct("_last", "_id"))).alias("_q"), F.max_by("_name", F.struct("_last", "_id")).alias("_newest"))
    fields = fields.join(of_chain, "_chain").withColumn("_q", F.when(F.col("_label"), "tree_id").otherwise(F.col("_q")))
    alike = F.coalesce(F.lower("_name") == F.lower("label_field"), F.lit(False))
    rank = F.when(exact, 0).when(F.col("_stale"), 1).when(alike, 2).when(F.col("_label"), 3).when(F.col("_q") == "tree_id", 4)
    best = F.when(rank.isNotNull(), F.struct(rank, alias_order(F.col("_name")), F.col("_nth")))
    labels = fields.groupBy("source_id").agg(F.min_by("_name", best).alias("label"))
    fields = fields.join(labels, "source_id").withColumn("_leads", F.coalesce(F.col("_name") == F.col("label"), F.lit(False)))
    fields = fields.withColumn("_q", F.when(F.col("_leads"), "tree_id").otherwise(F.col("_q")))
    one = F.struct((~F.col("_leads")).alias("rest"), alias_order(F.col("_name")).alias("order"), "_nth", F.col("_name").alias("name"), F.col("_q").alias("q"), F.col("_newest").alias("newest"))
    listed = fields.groupBy("source_id", "label").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    names = F.transform("_l", lambda g: g["name"])
    free = lambda f: ~F.array_contains(names, f["newest"]) & (F.size(F.filter("_l", lambda g: g["q"].isNull() & (g["newest"] == f["newest"]))) == 1)
    leads = lambda f, i: F.array_position(F.transform("_l", lambda g: g["q"]), f["q"]) == i + 1
    place = lambda f, i: F.when(leads(f, i), f["q"]).otherwise(F.concat(F.lit("?"), F.when(f["q"].isNull() & free(f), f["newest"]).otherwise(f["name"])))
    return listed.select("source_id", "label", F.map_from_entries(F.transform("_l", lambda f, i: F.struct(f["name"], place(f, i)))).alias("routes"))


def consistent_table(files: DataFrame, rows: DataFrame, changes: DataFrame | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """All ``rows`` under one schema: series, version, source, row number, ``label_field`` (the field that is ``tree_id`` in the row's file), ``COLUMNS``, and ``others`` (a map of what has no column).

    Each row goes through its own file's migration (``migrations``), composed from the recorded ``changes``; where there is none, or for names that a file doesn't list,
    a field's column is that of the quantity its name is known for. Values are cast with null for what doesn't fit; a column that a record has no field for
    gets its value in ``defaults``, else null, as the files themselves state none. Of a key that a record repeats the last value counts. Records that are no JSON objects give nulls; rows of files
    that aren't listed keep a null series. One pass over the rows; the file table and migrations are joined by source_id.
    """
    v = versions(files).select("source_id", "series_id", "version")
    table = rows.join(v, "source_id", "left").withColumn("_m", F.from_json("record", "map<string,string>"))
    table = table.join(migrations(files, changes), "source_id", "left")
    keys = F.map_keys("_m")

    def target(key: Column) -> Column:
        to = F.coalesce(F.try_element_at("routes", key), quantity_of(key), F.concat(F.lit("?"), key))
        name = F.substr(to, F.lit(2))
        return F.when(to.startswith("?") & (name != key) & F.array_contains(keys, name), F.concat(F.lit("?"), key)).otherwise(to)

    unlisted = lambda key: F.try_element_at("routes", key).isNull()
    entry = lambda e, i: F.struct(unlisted(e["key"]).alias("unlisted"), alias_order(e["key"]).alias("order"), i.alias("i"), e["key"].alias("key"), target(e["key"]).alias("q"), e["value"].alias("v"))
    once = F.filter(F.map_entries("_m"), lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - i)  # of a repeated key the last value counts
    table = table.withColumn("_e", F.array_sort(F.transform(once, entry)))
    qs, stated = F.transform("_e", lambda e: e["q"]), defaults or {}
    cast = lambda c, kind: c.try_cast("double").try_cast(kind) if kind == "long" else c.try_cast(kind)

    def column(q: str, kind: str) -> Column:
        at = F.array_position(qs, F.lit(q)).cast("int")
        return F.when(at == 0, F.lit(stated.get(q)).cast(kind)).otherwise(cast(F.get(F.transform("_e", lambda e: e["v"]), at - 1), kind)).alias(q)

    spare = F.filter("_e", lambda e, i: e["q"].startswith("?") | (F.array_position(qs, e["q"]) != i + 1))
    rest = F.map_from_entries(F.transform(spare, lambda e: F.struct(F.when(e["q"].startswith("?"), F.substr(e["q"], F.lit(2))).otherwise(e["key"]), e["v"])))
    return table.select("series_id", "version", "source_id", "row_no", F.col("label").alias("label_field"), *[column(q, kind) for q, kind in COLUMNS.items()], rest.alias("others"))
