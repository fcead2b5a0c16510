"""Instance labels, their sentinels, and the roles of columns by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovewise.constants import INT_MAX, NOISE, UNASSIGNED

# Names that usually hold a label or a class, best first.
LABEL_NAMES = ["treeID", "tree_id", "TreeID", "PredInstance", "instance", "InstanceID", "segment_id", "label", "scalar_treeID", "scalar_label", "ID"]
CLASS_NAMES = ["classification", "semantic", "semantic_seg", "class", "classes", "label", "category", "scalar_classification"]


def normal_label(c: Column) -> Column:
    """A label as int: values out of the 32-bit range, and negative ones other than -1, become 0. Null stays null; fractions are cut off."""
    wide = c.cast("double")
    bad = (wide > INT_MAX) | ((wide < 0) & (wide != NOISE)) | F.isnan(wide)
    return F.when(bad, UNASSIGNED).otherwise(c.cast("double")).cast("int")


def is_tree(c: Column) -> Column:
    return (c != UNASSIGNED) & (c != NOISE)


def resolve_negative(label: Column, meaning: Column) -> Column:
    """-1 folded to 0 where the cloud's setting says that it means unassigned."""
    return F.when((label == NOISE) & (F.coalesce(meaning, F.lit("noise")) == "unassigned"), UNASSIGNED).otherwise(label)


def label_to_file(label: Column, meaning: str = "noise", unsigned: bool = False) -> Column:
    """A label as written back: noise as 0 into unsigned fields, and both 0 and -1 as -1 where -1 means unassigned."""
    out = F.when(label == NOISE, UNASSIGNED).otherwise(label) if unsigned else label
    return F.when(label.isin(NOISE, UNASSIGNED), NOISE).otherwise(out) if meaning == "unassigned" and not unsigned else out


def label_column(columns: Sequence[str], requested: str | None = None, names: Sequence[str] = tuple(LABEL_NAMES)) -> str | None:
    """The column that holds the label: as requested or none; else by the list, an exact match before one in other case, for each name in turn."""
    if requested is not None:
        return requested if requested in columns else None
    for name in names:
        if name in columns:
            return name
        for c in columns:
            if c.lower() == name.lower():
                return c
    return None


def next_free_id(largest: Column) -> Column:
    """The id for a new tree, from the largest label."""
    return F.greatest(F.coalesce(largest, F.lit(0)) + 1, F.lit(1))
