"""Tables written to the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster, and is read from the session.  Where it is unset, a session with a
local master (tests) gets a folder of the machine; on a cluster that is an error, as executors don't share local folders.  A written table is read back from Parquet, so a lost
executor costs nothing that was computed before the write, and no job is run twice as with ``checkpoint()``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BLOCK = 16 << 20  # bytes of a row group: a writer holds one


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application; below ``spark.checkpoint.dir`` where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "recordloom-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the application's file system is closed."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", BLOCK).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Deletes the tables that were written since it began, but for those kept: ``with Scratch(spark) as s: out = s.keep(...)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept, self.sure = spark, set(), True

    def __enter__(self) -> Scratch:
        self.before = self._tables()
        return self

    def _tables(self) -> set[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(self.spark))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {s.getPath().toString() for s in fs.listStatus(path)} if fs.exists(path) else set()

    def keep(self, df: DataFrame) -> DataFrame:
        found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        self.kept |= found
        self.sure &= bool(found)  # of a table without files the folder isn't known
        return df

    def __exit__(self, *_) -> None:
        kept = {k.split("/")[-1] for k in self.kept}
        for name in self._tables() - self.before if self.sure else ():
            if name.split("/")[-1] not in kept:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that no later plan reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if f"{spark.sparkContext.applicationId}/" in name:
            hpath.getFileSystem(conf).delete(hpath, True)
