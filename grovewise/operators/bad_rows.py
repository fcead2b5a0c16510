"""Delimited text lines: load those that conform, set the others apart with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
HEADER = ["tree_id", "x", "y", "dbh_m", "species"]
REASONS = ("broken_quoting", "wrong_columns", "invalid_value")


def bare_line(raw: Column) -> Column:
    """The line without a byte-order mark at its start and the line end."""
    return F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), r"[\r\n]+$", "")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s﻿]+|[\s﻿]+$", "")


def whole_fields_of(line: Column) -> Column:
    """The fields of a line whose quoting holds, quotes removed, doubled quotes single."""
    # With a comma before the first field too, every match takes a character, so that an empty first field isn't passed over.
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",\s*+({_FIELD})\s*+"), 1)
    plain = lambda f: F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(parts, plain)


def fields_of(line: Column) -> Column:
    """The same fields, trimmed."""
    return F.transform(whole_fields_of(line), _trim)


def opens_well(line: Column, n: int) -> Column:
    """Whether the quoting of the first ``n`` fields holds and they end there, whatever follows."""
    spaced = rf"\s*+(?:{_FIELD})\s*+"
    return line.rlike(rf"^{spaced}(?:,{spaced}){{{n - 1}}}(?:,|$)")


def _whole(f: Column) -> Column:
    return f.rlike("^[0-9]+$") & f.rlike("[1-9]")


def _number(f: Column) -> Column:
    value = F.when(f.rlike(f"^{_NUMBER}$"), f.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def split_lines(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(valid, failed): typed rows (line_id and the five columns), and (line_id, raw line, reason).

    The strict load keeps lines that conform in every way, under their line ids; an anti join subtracts these ids from all data
    lines, and only the remainder is diagnosed. The first reason that applies holds: broken_quoting (a quote never closed, within an
    unquoted field, or closed and followed by text), wrong_columns (not five), invalid_value. Comments (#), blank lines, header lines and null lines are no data.
    Blanks around a quoted field count as part of the field's surroundings, not of an unquoted field. A tree id of more digits than a 64-bit number holds is
    valid and loads as null. Line ids must be unique. Line length isn't limited.
    """
    all_lines = lines.select(F.col(line_id).alias("line_id"), F.col(raw).alias("raw_line"), bare_line(F.col(raw)).alias("_line"))
    spaced = rf"\s*+(?:{_FIELD})\s*+"
    quoted_well = F.col("_line").rlike(rf"^{spaced}(?:,{spaced})*+$")
    data = all_lines.filter(F.col("_line").isNotNull() & F.col("_line").rlike(r"\S") & ~F.col("_line").rlike(r"^[\s﻿]*#"))
    data = data.withColumn("_well", quoted_well).withColumn("_f", F.when(F.col("_well"), fields_of(F.col("_line"))))
    names = F.array(*[F.lit(n) for n in HEADER])
    data = data.filter(~F.coalesce(F.transform("_f", lambda f: F.lower(f)) == names, F.lit(False)))
    f = lambda i: F.get("_f", i)
    five = F.size("_f") == 5
    values = _whole(f(0)) & _number(f(1)).isNotNull() & _number(f(2)).isNotNull() & ((f(3) == "") | (F.coalesce(_number(f(3)), F.lit(-1.0)) >= 0))
    valid = data.filter(F.col("_well") & five & values).select(
        "line_id", f(0).try_cast("long").alias("tree_id"), _number(f(1)).alias("x"), _number(f(2)).alias("y"), _number(f(3)).alias("dbh_m"), F.when(f(4) != "", f(4)).alias("species")
    )
    rest = data.join(valid.select("line_id"), "line_id", "left_anti")
    reason = F.when(~F.col("_well"), REASONS[0]).when(~five, REASONS[1]).otherwise(REASONS[2])
    return valid, rest.select("line_id", "raw_line", reason.alias("reason"))
