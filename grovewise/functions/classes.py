"""Point classes: decoding, limits, names and new codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard class names of the public LAS specification, by code.
STANDARD_NAMES = {0: "Never classified", 1: "Unclassified", 2: "Ground", 3: "Low vegetation", 4: "Medium vegetation", 5: "High vegetation", 6: "Building", 7: "Low point (noise)", 9: "Water"}
LOW_BITS = 31
#: Beyond so many values a field is coloured along a ramp instead of by class.
MOST_CLASSES = 64


def class_value(c: Column, low: float, high: float, packed: bool = False) -> Column:
    """A class code: only the low five bits of a packed field; else NaN as 0, rounded half to even, kept in the field's range."""
    if packed:
        return c.cast("int").bitwiseAND(LOW_BITS)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(F.nanvl(c.cast("double"), F.lit(0.0))))).cast("int")


def class_bits(old: Column, code: Column) -> Column:
    """The packed field with its class replaced and its flags kept."""
    return old.cast("int").bitwiseAND(~LOW_BITS).bitwiseOR(code.cast("int").bitwiseAND(LOW_BITS))


def class_bounds(kind: str, packed: bool = False) -> tuple[int, int]:
    """The codes that a field can hold."""
    if packed:
        return 0, LOW_BITS
    bits = {"char": 8, "uchar": 8, "short": 16, "ushort": 16, "int": 32, "uint": 32}.get(kind)
    if bits is None:
        return -(2**24), 2**24
    low, high = (0, 2**bits - 1) if kind.startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    return max(low, -(2**31)), min(high, 2**31 - 1)


def class_name(code: Column, field: str = "classification") -> Column:
    """The usual name of a class: that of the specification for its own field, else "Class n"."""
    plain = F.concat(F.lit("Class "), code.cast("string"))
    if field != "classification":
        return plain
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STANDARD_NAMES.items() for x in kv]), code.cast("int")), plain)


def new_class(largest: Column, low: int, high: int) -> Column:
    """One above the largest code named or present, at least the range's start; null if the range is full."""
    code = F.greatest(F.coalesce(largest + 1, F.lit(low)), F.lit(low))
    return F.when(code <= high, code)


def setup_problems(rows: list[tuple[str, str]], low: int, high: int) -> list[str]:
    """What is wrong with a list of (value, name) as typed: all of it, in order."""
    out, values, names = [], set(), set()
    for text, name in rows:
        try:
            value = int(str(text).strip())
        except ValueError:
            out.append(f"{text!r} is no whole number")
            continue
        if not low <= value <= high:
            out.append(f"{value} lies outside {low} to {high}")
        if value in values:
            out.append(f"{value} is given twice")
        if (key := name.strip().lower()) in names:
            out.append(f"the name {name.strip()!r} is given twice")
        values.add(value), names.add(key)
    return out
