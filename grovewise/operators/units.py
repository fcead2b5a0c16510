"""One quantity recorded in several units: parse, infer each group's unit, convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metres in one unit, and the spellings of each unit.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001, "in": 0.0254}
SPELLINGS = {
    "m": ["m", "metre", "metres", "meter", "meters"],
    "cm": ["cm", "cms", "centimetre", "centimetres", "centimeter", "centimeters"],
    "mm": ["mm", "mms", "millimetre", "millimetres", "millimeter", "millimeters"],
    "in": ["in", "ins", "inch", "inches", '"', "''", "”", "″"],
}
_NUMBER = r"[-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?"

#: A residual counts no more than this (natural logarithm), and so much does a row that states another unit.
CAP = 1.2
#: The second-best choice must be worse by this much, else the choice is flagged as not unique.
MARGIN = 0.35


def unit_of_word(word: Column) -> Column:
    """m, cm, mm or in for a unit as written, else null."""
    bare = F.regexp_replace(F.lower(F.trim(word)), r"[.\s]+$|^[.\s]+", "")
    pairs = [F.lit(x) for unit, words in SPELLINGS.items() for w in words for x in (w, unit)]
    return F.try_element_at(F.create_map(*pairs), bare)


def number_in(text: Column) -> Column:
    """The one number in a text, with decimal point or comma; null if there is none or it isn't finite."""
    found = F.regexp_extract(text, f"({_NUMBER})", 1)
    value = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def unit_in_value(text: Column) -> Column:
    """The unit that stands before or behind the number of a typed value."""
    rest = F.regexp_replace(F.lower(text), _NUMBER, " ")
    return unit_of_word(F.trim(F.regexp_replace(rest, r"~|\bca\b\.?|\babout\b|\bapprox\b\.?", " ")))


def unit_in_remark(text: Column) -> Column:
    """A unit that a free remark or a column header names; the word "in" only if nothing else could be meant (in brackets or as the last part of a name), and no unit of a number."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "_", " "), F.lit(" "))
    words = {u: "|".join(w for w in ws if w.isalpha() and w != "in") for u, ws in SPELLINGS.items()}
    hit = lambda u: low.rlike(rf"(?<![0-9.]\s?)(?<![a-z])(?:{words[u]})(?![a-z])")
    inches = hit("in") | low.rlike(r"[(\[]\s*in\.?\s*[)\]]") | low.rlike(r"(?<![0-9])\s(?:\"|''|″|”)")
    return F.when(hit("mm"), "mm").when(hit("cm"), "cm").when(inches, "in").when(hit("m"), "m")


def unit_in_header(header: Column, like: str = r"dbh|diam|^d$|girth") -> Column:
    """The unit that a header text names for the column whose name is like ``like``."""
    names = F.filter(F.split(header, r"[,;\t|]"), lambda n: F.lower(F.trim(n)).rlike(like))
    return unit_in_remark(F.get(names, 0))


def infer_units(df: DataFrame, group: str, value: str, stated: str, group_stated: str | None = None, expected: str | None = None, low: float = 0.03, high: float = 1.30) -> DataFrame:
    """``df`` with ``unit``, ``metres`` and ``unit_unique``.

    A unit stated with the row holds. Otherwise the unit of the row's group holds (what the group states, else the choice of one unit
    for the whole group with the least sum of log residuals against ``expected``, the logarithm of the metres that the
    physical identity with other columns gives), unless the size in metres would leave ``low`` to ``high``; then the unit with the least log residual
    among those of possible size. Inches are chosen only where the group states them. ``unit_unique`` is false where the second-best
    choice is within ``MARGIN`` of the best, or no unit gives a possible size. Null values get null units.

    Groups are summed with map-side partial sums and joined back; a group of any share costs no more than others. Equal rows get equal results.
    """
    fit = F.col(expected) if expected else F.lit(None).cast("double")
    usual = F.lit(-1.55)  # log of about 0.21 m, where nothing else is known
    base = df.withColumn("_stated", F.col(stated)).withColumn("_fit", F.coalesce(fit, usual))
    base = base.withColumn("_told", F.col(group_stated) if group_stated else F.lit(None).cast("string"))
    ok = (F.col(value) > 0) & F.col(value).isNotNull()
    metres = {u: F.col(value) * F.lit(f) for u, f in METRES.items()}
    fits = {u: ok & (metres[u] >= low * (1 - 1e-9)) & (metres[u] <= high * (1 + 1e-9)) for u in METRES}
    res = {u: F.when(fits[u], F.least(F.abs(F.log(metres[u]) - F.col("_fit")), F.lit(CAP))).otherwise(F.lit(CAP)) for u in METRES}
    bare = ok & F.col("_stated").isNull()
    cost = {u: F.sum(F.when(bare, res[u]).when(F.col("_stated").isNotNull() & (F.col("_stated") != u), CAP).otherwise(0.0)).alias(f"_c_{u}") for u in METRES}
    groups = base.groupBy(F.col(group).alias("_group")).agg(
        *cost.values(), F.max("_told").alias("_g_told"), F.sum(bare.cast("int")).alias("_bare"),
        F.sum((F.col("_stated") == "in").cast("int")).alias("_inches"), F.count("_stated").alias("_n_stated"), F.count(F.when(ok, 1)).alias("_n"),
    )
    by_inches = F.when(F.col("_g_told").isNotNull(), F.col("_g_told") == "in").otherwise((2 * F.col("_inches") > F.col("_n_stated")) & (F.col("_inches") >= F.greatest(F.lit(3), 0.2 * F.col("_n"))))
    groups = groups.withColumn("_g_inches", by_inches)
    inch_cost = F.when(F.col("_g_inches"), F.col("_c_in")).otherwise(float("inf"))
    ranked = F.array_sort(F.array(*[F.struct((inch_cost if u == "in" else F.col(f"_c_{u}")).alias("cost"), F.lit(u).alias("unit")) for u in METRES]))
    groups = groups.withColumn("_r", ranked).select(
        "_group", F.coalesce("_g_told", F.col("_r")[0]["unit"]).alias("_g_unit"), "_g_inches",
        (F.col("_g_told").isNotNull() | (F.col("_r")[1]["cost"] - F.col("_r")[0]["cost"] >= MARGIN * F.greatest(F.lit(1), F.col("_bare")))).alias("_g_sure"),
    )
    out = base.join(groups, base[group].eqNullSafe(groups["_group"]), "left")
    pick = lambda table, of: F.element_at(F.create_map(*[x for u in METRES for x in (F.lit(u), table[u])]), of)
    usable = {u: fits[u] & ((F.lit(u) != "in") | F.coalesce(F.col("_g_inches"), F.lit(False))) for u in METRES}
    own = F.array_sort(F.filter(F.array(*[F.struct(F.when(usable[u], F.abs(F.log(F.when(ok, metres[u])) - F.col("_fit"))).alias("cost"), F.lit(u).alias("unit")) for u in METRES]), lambda s: s["cost"].isNotNull()))
    out = out.withColumn("_own", own)
    holds = F.coalesce(pick(fits, F.col("_g_unit")), F.lit(False))
    unit = F.when(F.col(value).isNull(), None).when(F.col("_stated").isNotNull(), F.col("_stated")).when(holds, F.col("_g_unit")).otherwise(F.coalesce(F.get("_own", 0)["unit"], F.col("_g_unit")))
    sure = F.when(F.col(value).isNull(), None).when(F.col("_stated").isNotNull(), True).when(holds, F.col("_g_sure")).otherwise(
        F.when(F.size("_own") == 1, True).when(F.size("_own") == 0, False).otherwise(F.get("_own", 1)["cost"] - F.get("_own", 0)["cost"] >= MARGIN)
    )
    out = out.withColumn("unit", unit).withColumn("metres", F.col(value) * pick({u: F.lit(f) for u, f in METRES.items()}, F.col("unit"))).withColumn("unit_unique", sure)
    return out.drop("_stated", "_fit", "_told", "_group", "_g_unit", "_g_inches", "_g_sure", "_own")


def allometry(df: DataFrame, diameter_m: Column, height: Column) -> tuple[float, float]:
    """Intercept and slope of log diameter on log height over the rows that have both; one pass of sums."""
    ok = (diameter_m > 0) & (height > 0)
    got = df.select(F.when(ok, F.log(diameter_m)).alias("d"), F.when(ok, F.log(height)).alias("h")).agg(F.regr_intercept("d", "h").alias("a"), F.regr_slope("d", "h").alias("b"), F.avg("d").alias("m")).first()
    if got is None or got["b"] is None or got["a"] is None:
        return (got["m"] if got and got["m"] is not None else -1.55), 0.0
    return got["a"], got["b"]


def stem_diameters(stems: DataFrame, clouds: DataFrame) -> DataFrame:
    """Rows of ``stems``, one for each stem_uid, with ``unit``, ``metres`` and ``unit_unique`` of their diameter.

    The identity is the height-diameter curve, fitted over rows whose unit is stated with them or by their survey's header.
    """
    told = clouds.groupBy("cloud_id").agg(F.max("stem_header").alias("_header"))
    s = stems.join(told, "cloud_id", "left").withColumn("_told_unit", unit_in_header(F.col("_header")))
    stated = F.coalesce(unit_of_word(F.col("dbh_unit")), unit_in_remark(F.col("remark")))
    s = s.withColumn("_row_unit", stated)
    known = F.coalesce(F.col("_row_unit"), F.col("_told_unit"))
    sure = F.col("dbh") * F.element_at(F.create_map(*[F.lit(x) for kv in METRES.items() for x in kv]), known)
    a, b = allometry(s, F.when(sure.between(0.03, 1.30), sure), F.col("height"))
    s = s.withColumn("_expected", F.when(F.col("height") > 0, F.lit(a) + F.lit(b) * F.log("height")))
    return infer_units(s, "cloud_id", "dbh", "_row_unit", "_told_unit", "_expected").drop("_header", "_told_unit", "_row_unit", "_expected")


def tile_diameters(tile_stems: DataFrame) -> DataFrame:
    """Rows of ``tile_stems`` with the typed number, ``unit``, ``metres`` and ``unit_unique`` of their diameter."""
    t = tile_stems.withColumn("_typed", number_in(F.col("dbh_m"))).withColumn("_row_unit", F.when(F.col("_typed").isNotNull(), unit_in_value(F.col("dbh_m"))))
    return infer_units(t, "path", "_typed", "_row_unit").withColumnRenamed("_typed", "typed").drop("_row_unit")
