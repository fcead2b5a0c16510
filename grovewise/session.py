"""Session access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grovewise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor reaches.

    Only where the setting is absent, as in local tests, a temporary folder is made once per session and kept in
    the session's own configuration.
    """
    for source in (spark.conf, spark.sparkContext.getConf()):
        if folder := source.get("spark.checkpoint.dir", None):
            return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not (folder := spark.conf.get("spark.grovewise.scratch", None)):
        folder = tempfile.mkdtemp(prefix="grovewise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.grovewise.scratch", folder)
    return folder


def mounted_folder(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for files in formats that Spark doesn't write; it must be mounted on all executors."""
    folder = shared_folder(spark).rstrip("/")
    plain = folder.removeprefix("file://")
    if "://" in plain or plain.startswith(("hdfs:", "s3a:", "s3:", "gs:", "abfs")):
        raise RuntimeError(f"point files are written through a mounted folder; spark.checkpoint.dir is {folder}")
    return plain.removeprefix("file:")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that outlives executors.

    The columns stay prunable and filters are still pushed down, unlike with a row-wise checkpoint.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing reads any more, as the last round's of a loop; other DataFrames are left alone."""
    if path := getattr(df, "_written_to", None):
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def partitions_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
