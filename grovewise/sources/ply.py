"""Binary PLY: a partitioned reader, writers, and the patching of labels in place."""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from grovewise.constants import UNASSIGNED
from grovewise.functions.labels import LABEL_NAMES, label_column
from grovewise.session import mounted_folder

# PLY's scalar types as NumPy's and Spark's (unsigned ones widened).
NUMPY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
PLY_OF = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "int", "float": "float", "double": "double"}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
ROWS_PER_PARTITION, ROWS_PER_BATCH = 2_000_000, 100_000


@dataclass(frozen=True)
class PlyLayout:
    """What a header says: byte order, fields (name, NumPy type) of a vertex, how many, where they start, and other elements that aren't empty."""

    path: str
    order: str
    fields: tuple[tuple[str, str], ...]
    count: int
    offset: int
    others: tuple[str, ...]
    header: bytes

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, self.order + t) for n, t in self.fields])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {SPARK[t]}" for n, t in self.fields)


def sniff(path: str) -> str | None:
    """ply or las by a file's first four bytes, else None, also for what can't be read."""
    try:
        with open(path, "rb") as f:
            start = f.read(4)
    except OSError:
        return None
    return "ply" if start[:3] == b"ply" and start[3:4] in (b"\n", b"\r") else "las" if start == b"LASF" else None


def ply_layout(path: str) -> PlyLayout:
    """Parse a header. ASCII files, and files of another kind, are refused. List properties of other elements are passed over."""
    order, fields, count, others, element = None, [], 0, [], None
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path} has no end of header")
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"]:
                order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1])
                if order is None:
                    raise ValueError(f"{path} isn't binary")
            elif words[:1] == ["element"]:
                element = words[1]
                if element == "vertex":
                    count = int(words[2])
                elif int(words[2]):
                    others.append(element)
            elif words[:1] == ["property"] and element == "vertex" and words[1] != "list":
                fields.append((words[2], NUMPY.get(words[1], "f4")))
            elif words[:1] == ["end_header"]:
                offset = f.tell()
                f.seek(0)
                return PlyLayout(path, order or "<", tuple(fields), count, offset, tuple(others), f.read(offset))


def point_count(path: str) -> int:
    """Points by the header alone."""
    if sniff(path) == "las":
        from grovewise.sources.las import las_layout

        return las_layout(path).count
    return ply_layout(path).count


def files_of(path: str) -> list[str]:
    """The file, the glob's files, or a folder's point files, sorted, each once."""
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if p.lower().endswith((".ply", ".las", ".laz")))
    return sorted(set(glob.glob(path))) or [path]


@dataclass
class _Rows(InputPartition):
    path: str
    start: int
    stop: int
    first_id: int


def batches(rows: np.ndarray, names: list[str], first_id: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), ROWS_PER_BATCH):
        some = rows[at : at + ROWS_PER_BATCH]
        columns = [pa.array(np.arange(first_id + at, first_id + at + len(some)))]
        for n in names:
            kind = some.dtype[n].newbyteorder("=")
            wide = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(kind.str[1:], kind.str[1:])
            columns.append(pa.array(np.ascontiguousarray(some[n]).astype(wide)))
        yield pa.RecordBatch.from_arrays(columns, ["point_id", *names])


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: point_id (place in the file, files in order of name) and the vertices' fields.

    All files have the first one's fields. Option ``rowsPerPartition``. Partitions are ranges of rows; each task reads its own bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "point_id bigint, " + ply_layout(files_of(self.options["path"])[0]).schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PlyReader(files_of(self.options["path"]), int(self.options.get("rowspartition", self.options.get("rowsPerPartition", ROWS_PER_PARTITION))), [f.name for f in schema.fields if f.name != "point_id"])


class _PlyReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int, names: list[str]):
        self.paths, self.rows, self.names = paths, rows, names

    def partitions(self):
        out, first = [], 0
        for p in self.paths:
            layout = ply_layout(p)
            if os.path.getsize(p) < layout.offset + layout.count * layout.dtype.itemsize:
                raise ValueError(f"{p} is shorter than its header says")
            out += [_Rows(p, a, min(a + self.rows, layout.count), first + a) for a in range(0, max(layout.count, 1), self.rows)]
            first += layout.count
        return out

    def read(self, partition: _Rows):
        layout = ply_layout(partition.path)
        size = layout.dtype.itemsize
        rows = np.fromfile(partition.path, layout.dtype, max(partition.stop - partition.start, 0), offset=layout.offset + partition.start * size) if partition.stop > partition.start else np.zeros(0, layout.dtype)
        yield from batches(rows, self.names, partition.first_id)


def register(spark: SparkSession) -> None:
    """Make the formats ply and las known to a session."""
    from grovewise.sources.las import LasSource

    spark.dataSource.register(PlySource)
    spark.dataSource.register(LasSource)


def refuse_others(layout: PlyLayout) -> None:
    if layout.others:
        raise ValueError(f"{layout.path} has other elements ({', '.join(layout.others)}), which would be lost")


def ply_header(fields: list[tuple[str, str]], count: int, order: str = "<") -> bytes:
    lines = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", f"element vertex {count}", *[f"property {t} {n}" for n, t in fields], "end_header", ""]
    return "\n".join(lines).encode()


def write_parts(df: DataFrame, dtype: np.dtype, keys: list[str] = ()) -> list[tuple]:
    """Write rows as packed records into part files of the shared folder; (keys..., part, path, rows) of each, in the order of the data's partitions.

    Records are streamed batch by batch; a key's rows may come in several parts. A task that runs again writes under a new name, and only what the job returns is used.
    """
    folder = mounted_folder(df.sparkSession) + f"/parts-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    names, keys = list(dtype.names), list(keys)
    kinds = dict(df.dtypes)

    def run(stream):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tag = uuid.uuid4().hex
        open_file, now, n, serial = None, None, 0, 0
        for b in stream:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            rows = np.zeros(b.num_rows, dtype)
            for c in names:
                rows[c] = np.nan_to_num(table[c].to_numpy(zero_copy_only=False)) if dtype[c].kind in "iu" else table[c].to_numpy(zero_copy_only=False)
            key_rows = list(zip(*[table[k].to_pylist() for k in keys])) if keys else [()] * len(rows)
            edges = [0, *[i for i in range(1, len(key_rows)) if key_rows[i] != key_rows[i - 1]], len(rows)]
            for a, z in zip(edges, edges[1:]):
                if open_file is None or key_rows[a] != now:
                    if open_file is not None:
                        open_file.close()
                        yield done(now, part, path, n)
                    now, n, serial = key_rows[a], 0, serial + 1
                    path = f"{folder}/{part:08d}-{serial:08d}-{tag}"
                    open_file = open(path, "wb")  # noqa: SIM115
                rows[a:z].tofile(open_file)
                n += z - a
        if open_file is not None:
            open_file.close()
            yield done(now, part, path, n)

    def done(key, part, path, n):
        return pa.RecordBatch.from_pydict({**{k: pa.array([v], ARROW.get(kinds[k], pa.string())) for k, v in zip(keys, key)}, "part": pa.array([part]), "path": [path], "rows": pa.array([n])})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "part bigint", "path string", "rows bigint"])
    out = df.mapInArrow(run, schema).collect()  # one short row for each part written
    return sorted((tuple(r) for r in out), key=lambda r: (*r[: len(keys)], r[-2]))


def join_parts(header: bytes, parts: list[str], path: str) -> None:
    """Put a header and parts together under a temporary name, then move it into place."""
    temporary = f"{path}.part"
    with open(temporary, "wb") as out:
        out.write(header)
        for p in parts:
            with open(p, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 24)
    os.replace(temporary, path)
    for p in parts:
        os.remove(p)


def save_ply(df: DataFrame, path: str, label: str = "tree_id", label_as: str = "treeID", ident: str = "point_id") -> None:
    """One PLY file: x, y, z as float, the label as int, then the other numeric columns, in order of ``ident``; written by all tasks and put together on the driver."""
    rest = [(c, PLY_OF[k]) for c, k in df.dtypes if c not in ("x", "y", "z", label, ident) and k in PLY_OF]
    fields = [("x", "float"), ("y", "float"), ("z", "float"), (label_as, "int"), *rest]
    ordered = df.repartitionByRange(ident).sortWithinPartitions(ident).withColumn(label_as, F.col(label)).select(*[n for n, _ in fields])
    parts = write_parts(ordered, np.dtype([(n, "<" + NUMPY[t]) for n, t in fields]))
    join_parts(ply_header(fields, sum(p[-1] for p in parts)), [p[-2] for p in parts], path)


def save_coloured_ply(df: DataFrame, path: str, label: str = "tree_id", ident: str = "point_id") -> None:
    """A PLY file whose colours stand for the labels (columns red, green, blue are there already): double x, y, z, time, nx, ny, nz first, other columns, red, green, blue, and alpha 255 where it is missing."""
    fixed = {"x": "double", "y": "double", "z": "double", "time": "double", "nx": "float", "ny": "float", "nz": "float"}
    colour = ["red", "green", "blue", "alpha"]
    out = df if "alpha" in df.columns else df.withColumn("alpha", F.lit(255))
    first = [(c, t) for c, t in fixed.items() if c in out.columns]
    rest = [(c, PLY_OF[k]) for c, k in out.dtypes if c not in (*fixed, *colour, label, ident) and k in PLY_OF]
    fields = [*first, *rest, *[(c, "uchar") for c in colour]]
    ordered = out.repartitionByRange(ident).sortWithinPartitions(ident).select(*[n for n, _ in fields])
    parts = write_parts(ordered, np.dtype([(n, "<" + NUMPY[t]) for n, t in fields]))
    join_parts(ply_header(fields, sum(p[-1] for p in parts)), [p[-2] for p in parts], path)


def export_trees(df: DataFrame, source: str, folder: str, only: list[int] | None = None, label: str = "tree_id", ident: str = "point_id") -> list[str]:
    """One file of the source's own layout for each real tree, ``source`` named, in ascending order of id, rows in file order; the files written.

    Rows are range-partitioned by tree and place and streamed, so a tree of any size is spread over tasks.
    """
    layout = ply_layout(source)
    refuse_others(layout)
    os.makedirs(folder, exist_ok=True)
    trees = df.filter(F.col(label) > 0) if only is None else df.filter(F.col(label).isin(only) & (F.col(label) > 0))
    ordered = trees.repartitionByRange(label, ident).sortWithinPartitions(label, ident)
    own = [F.col(label).cast(SPARK[t]).alias(n) if n == label_column(layout.names) and n != label else F.col(n) for n, t in layout.fields]
    parts = write_parts(ordered.select(F.col(label).alias("_tree"), *own), layout.dtype, ["_tree"])
    kinds = {v: k for k, v in list(NUMPY.items())[:8]}
    stem, ext = os.path.splitext(os.path.basename(source))
    out = []
    for tree in sorted({p[0] for p in parts}):
        mine = [p for p in parts if p[0] == tree]
        path = os.path.join(folder, f"{stem}_tree_{tree}{ext}")
        join_parts(ply_header([(n, kinds[t]) for n, t in layout.fields], sum(p[-1] for p in mine), layout.order), [p[-2] for p in mine], path)
        out.append(path)
    return out


def patch_column(path: str, column: str, delta: DataFrame, transform=None) -> int:
    """Write changed values (point_id, new) of one field into a PLY file in place; how many rows. Tasks write disjoint rows of the file; ``transform`` maps (old, new) arrays to what is stored."""
    layout = ply_layout(path)
    at = layout.dtype.fields[column][1]
    kind, size, offset, count = layout.dtype[column], layout.dtype.itemsize, layout.offset, layout.count

    def run(stream):
        n = 0
        rows = np.memmap(path, np.uint8, "r+")
        view = np.ndarray((count,), kind, rows, offset + at, (size,))
        for b in stream:
            ids, new = b["point_id"].to_numpy(), b["new"].to_numpy()
            view[ids] = (transform(view[ids], new) if transform else new).astype(kind)
            n += len(ids)
        rows.flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n])})

    return sum(r["n"] for r in delta.select("point_id", F.col("new").cast("long").alias("new")).mapInArrow(run, "n bigint").collect())


def load_points(spark: SparkSession, path: str, label_field: str | None = None) -> DataFrame:
    """A cloud with tree_id: from the label field, else from colours, else all unassigned; refuses a file whose ending belies its first bytes."""
    from grovewise.functions.colours import labels_from_colours
    from grovewise.functions.labels import normal_label

    register(spark)
    kind, ending = sniff(path), os.path.splitext(path)[1].lower()
    if kind is None or (ending in (".ply", ".las", ".laz") and (ending == ".ply") != (kind == "ply")):
        raise ValueError(f"{path} isn't the binary PLY or LAS file that its name says")
    df = spark.read.format(kind).load(path)
    name = label_column(df.columns, label_field, LABEL_NAMES)
    if name is not None:
        return df.withColumn("tree_id", normal_label(F.col(name))).drop(*([name] if name != "tree_id" else []))
    if kind == "ply" and {"red", "green", "blue"} <= set(df.columns):
        return labels_from_colours(df, "red", "green", "blue")
    return df.withColumn("tree_id", F.lit(UNASSIGNED))
