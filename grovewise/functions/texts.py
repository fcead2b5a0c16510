"""Names, numbers, versions and dates in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of a stem map's columns by meaning, compared in small letters and digits only.
STEM_COLUMNS = {
    "stem_id": ["stemid", "treeid", "id", "tree", "stem", "number", "no", "plottreeid", "tag"],
    "x": ["x", "easting", "xcoord", "xm", "east", "gpsx", "longitude", "lon"],
    "y": ["y", "northing", "ycoord", "ym", "north", "gpsy", "latitude", "lat"],
    "dbh": ["dbh", "diameter", "dbhcm", "dbhm", "d", "diametercm", "dbh13"],
    "height": ["height", "h", "ht", "treeheight", "heightm", "totalheight"],
    "species": ["species", "spp", "sp", "taxon"],
}
#: The number in a file's name that is taken as its tree: the last run of digits.
NUMBER_IN_NAME = r"(\d+)"


def plain_name(text: Column) -> Column:
    """Small letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def stem_columns(header: list[str]) -> dict[str, str]:
    """Meaning to column: the first column in header order whose plain name is known for it and that no earlier meaning has taken."""
    plain = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in header}
    out: dict[str, str] = {}
    for meaning, known in STEM_COLUMNS.items():
        free = (c for c in header if c not in out.values() and plain[c] in known)
        if (hit := next(free, None)) is not None:
            out[meaning] = hit
    return out


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def tree_in_name(path: Column, pattern: str = NUMBER_IN_NAME) -> Column:
    """The number that the pattern's last match in a file's name gives (its first group, or all of it); null without a match, for an invalid pattern, or beyond 32 bits."""
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return F.lit(None).cast("int")
    last = F.try_element_at(F.regexp_extract_all(stem_of(path), F.lit(pattern), F.lit(min(groups, 1))), F.lit(-1))
    return last.try_cast("int")


def tree_file(path: Column, label: Column) -> Column:
    """The name of one tree's export."""
    return F.concat(stem_of(path), F.lit("_tree_"), label.cast("string"), extension_of(path))


def format_of(path: Column) -> Column:
    return F.when(extension_of(path) == ".ply", "ply").when(extension_of(path).isin(".las", ".laz"), "las")


def release(version: Column) -> Column:
    """A plain release (numbers and dots) as an array of eight numbers, else null; 0.6 equals 0.6.0."""
    parts = F.transform(F.split(F.trim(version), r"\."), lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(parts, F.array(*[F.lit(0)] * 8)), 1, 8)
    return F.when(F.trim(version).rlike(r"^\d+(\.\d+){0,7}$"), padded)


def age(then: Column, now: Column) -> Column:
    """How long ago, in words."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    days = F.floor(seconds / 86400)
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
        .when(days < 1, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" hr ago"))).when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.coalesce(F.date_format(then, "yyyy-MM-dd"), F.lit("")))
    )


def stem_label(stem_id: Column, species: Column) -> Column:
    return F.when(F.coalesce(species, F.lit("")) == "", stem_id).otherwise(F.concat(stem_id, F.lit(" ("), species, F.lit(")")))
