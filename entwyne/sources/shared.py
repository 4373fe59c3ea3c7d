"""Tables that one step writes and others read, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: the warehouse, or if all of Spark is one
    local process, a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        folder = f"file://{tempfile.mkdtemp(prefix='entwyne-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/entwyne-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._entwyne_path = path
    return out


def _at(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more; other DataFrames are left alone."""
    for df in written:
        path = getattr(df, "_entwyne_path", None)
        if path is not None:
            files, at = _at(df.sparkSession, path)
            files.delete(at, True)


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path."""
    files, at = _at(spark, path)
    found, out = files.listFiles(at, True), []
    while found.hasNext():
        one = found.next()
        out.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return "\n".join(sorted(out))


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table over the files at ``source``: read if it was written from these very files, else built and written.

    ``name`` has to tell what is built, parameters included.
    """
    key = hashlib.md5(f"{spark.sparkContext.applicationId}\n{name}\n{_state(spark, source)}".encode()).hexdigest()
    path = f"{shared_dir(spark)}/entwyne-kept-{key}"
    files, done = _at(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
