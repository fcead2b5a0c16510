"""Stem maps, mapping files, and the small JSON documents of a project."""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.constants import NOISE, UNASSIGNED  # noqa: F401
from grovewise.functions.texts import stem_columns
from grovewise.operators.inventory import inferred_scale

PROGRESS = "done array<int>, inventory map<string,string>"
REGISTRY_KEEPS = 20


def read_stem_map(spark: SparkSession, path: str, columns: dict[str, str] | None = None, units: str = "auto") -> DataFrame:
    """(ordinal, stem_id, x, y, dbh, height, species) of a stem map with any known header; diameters in metres, by the median if ``units`` is auto.

    Rows without numbers for x and y are left out; a missing tag becomes the row's number among those kept. All columns are read as text in one pass.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")
    used = stem_columns(raw.columns) | {k: v for k, v in (columns or {}).items() if v}
    if not {"x", "y"} <= set(used):
        raise ValueError("the stem map has no columns for x and y")
    number = lambda m: F.trim(F.col(f"`{used[m]}`")).try_cast("double") if m in used else F.lit(None).cast("double")
    text = lambda m: F.coalesce(F.trim(F.col(f"`{used[m]}`")), F.lit("")) if m in used else F.lit("")
    rows = raw.select(F.monotonically_increasing_id().alias("_at"), text("stem_id").alias("_tag"), number("x").alias("x"), number("y").alias("y"), number("dbh").alias("_dbh"), number("height").alias("height"), text("species").alias("species")).filter("x is not null and y is not null")
    from pyspark.sql import Window

    rows = rows.withColumn("ordinal", F.row_number().over(Window.orderBy("_at")))  # a field book, not a cloud: one short table
    scale = {"cm": 0.01, "m": 1.0}.get(units) or rows.agg(inferred_scale(F.col("_dbh"))).first()[0]
    tag = F.when(F.col("_tag") == "", F.col("ordinal").cast("string")).otherwise(F.col("_tag"))
    return rows.select("ordinal", tag.alias("stem_id"), "x", "y", F.when(F.col("_dbh") != 0, F.col("_dbh") * scale).alias("dbh"), "height", "species")


def read_mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, path, value) of a mapping file without header, for ``merging.mapping_entries``."""
    rows = spark.read.schema("path string, value string").csv(path, comment="#", ignoreLeadingWhiteSpace=True)
    return rows.filter("path is not null").select(F.monotonically_increasing_id().alias("line_no"), "path", F.coalesce("value", F.lit("")).alias("value"))


def write_match_file(matches: DataFrame, path: str, dx: float, dy: float) -> str:
    """The match file: a comment with the shift, the header, rows by tree id. A match table has one row for each tree, which bounds what the driver writes."""
    from grovewise.operators.inventory import MATCH_COLUMNS, match_table

    def cell(v) -> str:
        v = "" if v is None else str(v)
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v

    with open(f"{path}.part", "w", newline="", encoding="utf-8") as f:
        f.write(f"# inventory matches, stem map shifted by {dx:+.3f}, {dy:+.3f} m\n" + ",".join(MATCH_COLUMNS) + "\r\n")
        for r in match_table(matches).orderBy("tree_id", "stem_id").toLocalIterator():
            f.write(",".join(cell(r[c]) for c in MATCH_COLUMNS) + "\r\n")
    os.replace(f"{path}.part", path)
    return path


def read_json(path: str | os.PathLike) -> dict:
    """A JSON object; anything wrong with it gives an empty one."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def write_json(path: str | os.PathLike, value: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(f"{path}.part").write_text(json.dumps(value, indent=2), encoding="utf-8")
    os.replace(f"{path}.part", path)


def progress_path(cloud: str) -> Path:
    return Path(cloud).with_suffix(".progress.json")


def read_progress(cloud: str) -> tuple[set[int], dict[int, str]]:
    """Trees marked as done, and links of trees to stems."""
    got = read_json(progress_path(cloud))
    try:
        return {int(x) for x in got.get("done", [])}, {int(k): str(v) for k, v in got.get("inventory", {}).items()}
    except (TypeError, ValueError, AttributeError):
        return set(), {}


def write_progress(cloud: str, done: set[int] | None = None, links: dict[int, str] | None = None) -> None:
    """Replace what is given; keys of other tools stay."""
    got = read_json(progress_path(cloud))
    if done is not None:
        got["done"] = sorted(done)
    if links is not None:
        got["inventory"] = {str(k): v for k, v in sorted(links.items())}
    write_json(progress_path(cloud), got)


def progress_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """Sidecar texts as done and inventory; what can't be read gives empty ones."""
    got = F.from_json(column, PROGRESS)
    return texts.select(*[c for c in texts.columns if c != column], F.coalesce(got["done"], F.array().cast("array<int>")).alias("done"), F.coalesce(got["inventory"], F.create_map().cast("map<string,string>")).alias("inventory"))


class Project:
    """A folder with a working copy, a manifest, settings, and derived arrays."""

    def __init__(self, folder: str):
        self.folder, self.manifest = Path(folder), Path(folder) / "project.json"

    @staticmethod
    def create(folder: str, source: str, sources: list[dict] | None = None, name: str | None = None) -> "Project":
        """Start a project in a new or empty folder."""
        p = Project(folder)
        if p.folder.exists() and any(p.folder.iterdir()):
            raise ValueError(f"{folder} isn't empty")
        p.folder.mkdir(parents=True, exist_ok=True)
        got = {"source": source, "data_file": name or Path(source).name, "created": dt.datetime.now().isoformat(timespec="seconds")}
        write_json(p.manifest, got | ({"sources": sources} if sources else {}))
        return p

    def data_file(self) -> str | None:
        name = read_json(self.manifest).get("data_file")
        return str(self.folder / name) if name else None

    def settings(self) -> dict:
        """Decided settings; a key with None was decided as none, a missing key was never asked."""
        got = read_json(self.manifest).get("settings", {})
        return got if isinstance(got, dict) else {}

    def remember(self, **values) -> None:
        got = read_json(self.manifest)
        got["settings"] = self.settings() | values
        try:
            write_json(self.manifest, got)
        except OSError:
            pass  # a setting that can't be kept is asked for again

    def class_names(self, field: str) -> dict[int, str]:
        """Names of a field's classes; those of an older project with one field hold for its class field."""
        s = self.settings()
        own = (s.get("class_names_by_field") or {}).get(field)
        if own is None and s.get("class_field") == field:
            own = s.get("class_names")
        return {int(k): v for k, v in (own or {}).items()}

    def name_classes(self, field: str, names: dict[int, str]) -> None:
        by = dict(self.settings().get("class_names_by_field") or {})
        by[field] = {str(k): v for k, v in names.items()}
        self.remember(class_field=field, class_names_by_field=by)

    def _stamp(self, file: str) -> list[int]:
        s = os.stat(file)
        return [s.st_size, s.st_mtime_ns]

    def cached(self, file: str, kind: str) -> np.ndarray | None:
        """A derived array, if the file is as it was when the array was made."""
        at = self.folder / "cache" / f"{kind}.npz"
        try:
            with np.load(at) as got:
                return got["values"] if got["stamp"].tolist() == self._stamp(file) else None
        except (OSError, ValueError, KeyError):
            return None

    def cache(self, file: str, kind: str, values: np.ndarray) -> None:
        at = self.folder / "cache" / f"{kind}.npz"
        at.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{at}.part", "wb") as f:
            np.savez(f, values=values, stamp=np.array(self._stamp(file), dtype=np.int64))
        os.replace(f"{at}.part", at)


class Registry:
    """Projects and files opened before, the newest first, at most twenty; what is gone is dropped."""

    KINDS = ("file", "workspace")

    def __init__(self, path: str):
        self.path = path

    def load(self) -> list[dict]:
        entries = read_json(self.path).get("entries", [])
        entries = [e for e in entries if isinstance(e, dict) and "path" in e] if isinstance(entries, list) else []
        alive = [e for e in entries if os.path.exists(e["path"])]
        if len(alive) != len(entries):
            write_json(self.path, {"entries": alive})
        return sorted(alive, key=lambda e: e.get("last_opened") or "", reverse=True)

    def add(self, path: str, kind: str, now: dt.datetime | None = None) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        full = str(Path(path).resolve())
        entry = {"path": full, "type": kind, "last_opened": (now or dt.datetime.now()).isoformat(timespec="seconds")}
        write_json(self.path, {"entries": [entry, *[e for e in self.load() if e["path"] != full]][:REGISTRY_KEEPS]})


def recent_entries(entries: DataFrame, most: int = REGISTRY_KEEPS) -> DataFrame:
    """Registry entries (path, type, last_opened), each path once, the newest ``most``."""
    once = entries.groupBy("path").agg(F.max_by(F.struct("type", "last_opened"), "last_opened").alias("e")).select("path", "e.*")
    return once.orderBy(F.desc("last_opened"), "path").limit(most)
