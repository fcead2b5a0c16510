"""LAS by the public specification (versions 1.0 to 1.4, point formats 0 to 10, extra bytes): reader, label rewrite, subsets, merging. LAZ needs a codec that isn't there and is refused."""

from __future__ import annotations

import os
import shutil
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from grovewise.sources.ply import ROWS_PER_PARTITION, SPARK, _Rows, batches, files_of, join_parts, write_parts

# Fields of the point formats.
_OLD = [("X", "i4"), ("Y", "i4"), ("Z", "i4"), ("intensity", "u2"), ("flags", "u1"), ("raw_classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "u2")]
_NEW = [("X", "i4"), ("Y", "i4"), ("Z", "i4"), ("intensity", "u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "i2"), ("point_source_id", "u2"), ("gps_time", "f8")]
_RGB, _NIR = [("red", "u2"), ("green", "u2"), ("blue", "u2")], [("nir", "u2")]
_WAVE = [("wave_index", "u1"), ("wave_offset", "u8"), ("wave_size", "u4"), ("wave_location", "f4"), ("wave_x", "f4"), ("wave_y", "f4"), ("wave_z", "f4")]
_TIME = [("gps_time", "f8")]
FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 4: _OLD + _TIME + _WAVE, 5: _OLD + _TIME + _RGB + _WAVE, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR, 9: _NEW + _WAVE, 10: _NEW + _RGB + _NIR + _WAVE}
_EXTRA = {1: "u1", 2: "i1", 3: "u2", 4: "i2", 5: "u4", 6: "i4", 7: "u8", 8: "i8", 9: "f4", 10: "f8"}
_EXTRA_CODE = {v: k for k, v in _EXTRA.items()}
#: Wave packets and 64-bit unsigned fields aren't read as columns; they stay in the file on rewriting.
_HIDDEN = ("wave_",)


@dataclass(frozen=True)
class LasLayout:
    path: str
    version: tuple[int, int]
    point_format: int
    fields: tuple[tuple[str, str], ...]
    record: int
    count: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    extra: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        offsets, at = [], 0
        for _, t in self.fields:
            offsets.append(at)
            at += np.dtype(t).itemsize
        return np.dtype({"names": [n for n, _ in self.fields], "formats": ["<" + t for _, t in self.fields], "offsets": offsets, "itemsize": self.record})

    @property
    def shown(self) -> list[tuple[str, str]]:
        return [(n, t) for n, t in self.fields if n not in ("X", "Y", "Z") and t != "u8" and not n.startswith(_HIDDEN)]

    @property
    def packed_class(self) -> bool:
        return self.point_format <= 5


def las_layout(path: str) -> LasLayout:
    """Parse and check a header: the records must lie within the file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(375)
        if head[:4] != b"LASF" or len(head) < 227:
            raise ValueError(f"{path} is no LAS file")
        version = (head[24], head[25])
        header_size, offset, vlrs = struct.unpack_from("<HII", head, 94)
        kind, record, legacy = struct.unpack_from("<BHI", head, 104)
        if kind & 0x80 or path.lower().endswith(".laz"):
            raise ValueError(f"{path} is compressed (LAZ): there is no codec here; decompress it to LAS first")
        if kind not in FORMATS:
            raise ValueError(f"{path} has the unknown point format {kind}")
        scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
        count = struct.unpack_from("<Q", head, 247)[0] if version >= (1, 4) and header_size >= 375 else legacy
        f.seek(header_size)
        extra = []
        for _ in range(vlrs):
            vlr = f.read(54)
            if len(vlr) < 54:
                break
            user, code, length = vlr[2:18].split(b"\0")[0], *struct.unpack_from("<HH", vlr, 18)
            body = f.read(length)
            if user == b"LASF_Spec" and code == 4:
                for at in range(0, len(body) - 191, 192):
                    extra.append((body[at + 4 : at + 36].split(b"\0")[0].decode("utf-8", "replace"), _EXTRA.get(body[at + 2], "")))
    fields = list(FORMATS[kind])
    if sum(np.dtype(t).itemsize for _, t in fields) > record:
        raise ValueError(f"{path} has records shorter than its point format")
    known = []
    for name, t in extra:
        if not t or sum(np.dtype(x).itemsize for _, x in [*fields, (name, t)]) > record:
            break
        fields.append((name, t))
        known.append((name, t))
    if offset + count * record > size:
        raise ValueError(f"{path} is shorter than its header says")
    return LasLayout(path, version, kind, tuple(fields), record, count, offset, scale, shift, tuple(known))


class LasSource(DataSource):
    """``spark.read.format("las").load(path)``: point_id, x, y, z (double, scaled and shifted) and the records' fields."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        shown = las_layout(files_of(self.options["path"])[0]).shown
        return "point_id bigint, x double, y double, z double" + "".join(f", `{n}` {SPARK.get(t, 'bigint')}" for n, t in shown)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LasReader(files_of(self.options["path"]), int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)), [f.name for f in schema.fields][4:])


class _LasReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int, names: list[str]):
        self.paths, self.rows, self.names = paths, rows, names

    def partitions(self):
        out, first = [], 0
        for p in self.paths:
            n = las_layout(p).count
            out += [_Rows(p, a, min(a + self.rows, n), first + a) for a in range(0, max(n, 1), self.rows)]
            first += n
        return out

    def read(self, partition: _Rows):
        layout = las_layout(partition.path)
        rows = np.fromfile(partition.path, layout.dtype, max(partition.stop - partition.start, 0), offset=layout.offset + partition.start * layout.record) if partition.stop > partition.start else np.zeros(0, layout.dtype)
        done = 0
        for b in batches(rows, self.names, partition.first_id):
            some = rows[done : done + b.num_rows]
            done += b.num_rows
            axes = [pa.array(some[a].astype("f8") * s + o) for a, s, o in zip("XYZ", layout.scale, layout.shift)]
            yield pa.RecordBatch.from_arrays([b.columns[0], *axes, *b.columns[1:]], ["point_id", "x", "y", "z", *self.names])


def patch_labels(path: str, column: str, delta: DataFrame) -> int:
    """Write changed values (point_id, new) of one field into a LAS file in place; how many. Noise goes into unsigned fields as 0; of a packed class only the low five bits change."""
    layout = las_layout(path)
    at, kind = layout.dtype.fields[column][1], layout.dtype[column]
    record, offset, count = layout.record, layout.offset, layout.count
    bits = column == "raw_classification"

    def run(stream):
        n = 0
        raw = np.memmap(path, np.uint8, "r+")
        view = np.ndarray((count,), kind, raw, offset + at, (record,))
        for b in stream:
            ids, new = b["point_id"].to_numpy(), b["new"].to_numpy()
            if bits:
                new = (view[ids] & 0xE0) | (new & 31)
            elif kind.kind == "u":
                new = np.where(new < 0, 0, new)
            view[ids] = new.astype(kind)
            n += len(ids)
        raw.flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n])})

    return sum(r["n"] for r in delta.select("point_id", F.col("new").cast("long").alias("new")).mapInArrow(run, "n bigint").collect())


def _counted(header: bytearray, count: int) -> bytearray:
    struct.pack_into("<I", header, 107, count if count < 2**32 and header[104] <= 5 else 0)
    if (header[24], header[25]) >= (1, 4):
        struct.pack_into("<Q", header, 247, count)
    return header


def save_labels_as(source: str, target: str, column: str, labels: DataFrame) -> int:
    """A copy of a LAS file with its label field replaced by (point_id, new); the numbers of points must agree."""
    if (n := labels.count()) != las_layout(source).count:
        raise ValueError(f"{n} labels for {las_layout(source).count} points")
    shutil.copyfile(source, f"{target}.part")
    os.replace(f"{target}.part", target)
    return patch_labels(target, column, labels)


def new_las(path: str, columns: dict[str, np.ndarray], extra: dict[str, str] | None = None, point_format: int = 6, scale=(0.001,) * 3, shift=(0.0,) * 3) -> None:
    """A small LAS 1.4 file from arrays (x, y, z in world units, other fields by name); used for headers and tests."""
    extra = extra or {}
    fields = [*FORMATS[point_format], *extra.items()]
    rows = np.zeros(len(columns["x"]), np.dtype([(n, "<" + t) for n, t in fields]))
    for a, s, o in zip("xyz", scale, shift):
        rows[a.upper()] = np.rint((np.asarray(columns[a], "f8") - o) / s)
    for n, v in columns.items():
        if n not in "xyz":
            rows[n] = v
    body = b"".join(struct.pack("<HBB32s4s24s24s24s24s24s32s", 0, _EXTRA_CODE[t], 0, n.encode(), b"", b"", b"", b"", b"", b"", b"") for n, t in extra.items())
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"") + body if extra else b""
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4))
    struct.pack_into("<HIIBH", head, 94, 375, 375 + len(vlr), 1 if vlr else 0, point_format, rows.dtype.itemsize)
    struct.pack_into("<6d", head, 131, *scale, *shift)
    if len(rows):
        ends = [v for a in "xyz" for v in (np.max(columns[a]), np.min(columns[a]))]
        struct.pack_into("<6d", head, 179, *ends)
    with open(path, "wb") as f:
        f.write(bytes(_counted(head, len(rows))) + vlr)
        rows.tofile(f)


def export_trees(df: DataFrame, source: str, folder: str, label: str = "tree_id", only: list[int] | None = None, ident: str = "point_id") -> list[str]:
    """One LAS file for each real tree with the source's header and whole records, rows in file order. The records are cut out by the tasks through their places in the file."""
    layout = las_layout(source)
    os.makedirs(folder, exist_ok=True)
    trees = df.filter(F.col(label) > 0) if only is None else df.filter(F.col(label).isin(only) & (F.col(label) > 0))
    ordered = trees.repartitionByRange(label, ident).sortWithinPartitions(label, ident).select(F.col(label).alias("_tree"), F.col(ident).alias("place"))
    parts = write_parts(ordered, np.dtype([("place", "<i8")]), ["_tree"])
    with open(source, "rb") as f:
        header = bytearray(f.read(layout.offset))
    stem, ext = os.path.splitext(os.path.basename(source))
    out = []
    for tree in sorted({p[0] for p in parts}):
        mine = [p for p in parts if p[0] == tree]
        cut = [_cut(source, layout, p[-2]) for p in mine]
        path = os.path.join(folder, f"{stem}_tree_{tree}{ext}")
        join_parts(bytes(_counted(bytearray(header), sum(p[-1] for p in mine))), cut, path)
        out.append(path)
    return out


def _cut(source: str, layout: LasLayout, places: str, most: int = 1_000_000) -> str:
    """Replace a file of places by the records at them, a bounded number at a time."""
    whole = np.memmap(source, np.dtype((np.void, layout.record)), "r", layout.offset, (layout.count,))
    with open(f"{places}-rows", "wb") as out:
        for at in range(0, os.path.getsize(places) // 8, most):
            np.ascontiguousarray(whole[np.fromfile(places, "<i8", most, offset=8 * at)]).tofile(out)
    os.remove(places)
    return f"{places}-rows"


def least_shift(layouts: list[LasLayout]) -> tuple[float, float, float]:
    """The offsets of a merged file: the least of all files' along each axis."""
    return tuple(min(x.shift[k] for x in layouts) for k in range(3))


def save_las(df: DataFrame, path: str, like: str, label: str, shift: tuple[float, float, float] | None = None, ident: str = "point_id") -> None:
    """A LAS file in another file's format and scales, from x, y, z (world units) and the fields that the table has; others are 0. The label goes into the extra field ``label``, added as int if there is none."""
    layout = las_layout(like)
    with open(like, "rb") as f:
        header = bytearray(f.read(layout.offset))
    fields, record = list(layout.fields), layout.record
    if label not in [n for n, _ in fields]:
        if record != layout.dtype.fields[fields[-1][0]][1] + np.dtype(fields[-1][1]).itemsize:
            raise ValueError(f"{like} has record bytes of unknown meaning")
        body = struct.pack("<HBB32s4s24s24s24s24s24s32s", 0, 6, 0, label.encode(), b"", b"", b"", b"", b"", b"", b"")
        header += struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"") + body
        fields.append((label, "i4"))
        record += 4
        struct.pack_into("<I", header, 96, len(header))
        struct.pack_into("<I", header, 100, struct.unpack_from("<I", header, 100)[0] + 1)
        struct.pack_into("<H", header, 105, record)
    shift = shift or layout.shift
    struct.pack_into("<3d", header, 155, *shift)
    raw = [F.rint((F.col(a) - F.lit(o)) / F.lit(s)).cast("int").alias(a.upper()) for a, s, o in zip("xyz", layout.scale, shift)]
    rest = [F.col(n) if n in df.columns else F.lit(0).alias(n) for n, t in fields[3:]]
    ordered = df.repartitionByRange(ident).sortWithinPartitions(ident).select(*raw, *rest)
    offsets = np.cumsum([0, *[np.dtype(t).itemsize for _, t in fields]])[:-1].tolist()
    dtype = np.dtype({"names": [n for n, _ in fields], "formats": ["<" + t for _, t in fields], "offsets": offsets, "itemsize": record})
    parts = write_parts(ordered, dtype)
    join_parts(bytes(_counted(header, sum(p[-1] for p in parts))), [p[-2] for p in parts], path)


def decompress(path: str) -> None:
    """LAZ can't be read or written here."""
    raise ValueError(f"{path}: there is no LAZ codec; convert the file to LAS first")
