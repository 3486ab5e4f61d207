"""Versioned Parquet tables of one folder.

A pointer file names the folders that make up every table.  A commit writes new folders and then one new pointer,
``CURRENT-<n>.json``; the pointer of the highest number counts, and a pointer that was not written to its end is not read.
So a commit takes effect as a whole or not at all, and a crash leaves the state before it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

#: Appended folders of a table before they are written together anew.
PARTS = 64


class State:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[int, dict[str, list[str]]]:
        if not self._fs.exists(self._path(self.folder)):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        for n in sorted((int(m[1]) for m in map(re.compile(r"CURRENT-(\d+)\.json").fullmatch, names) if m), reverse=True):
            stream = self._fs.open(self._path(f"{self.folder}/CURRENT-{n}.json"))
            try:
                return n, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # cut off while it was written
                continue
            finally:
                stream.close()
        return 0, {}

    def versions(self) -> dict[str, list[str]]:
        """The folders of every table."""
        return self._pointer()[1]

    def read(self, table: str, schema: str) -> DataFrame:
        parts = self.versions().get(table)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{table}/{p}" for p in parts))

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None) -> None:
        """Write new snapshots and additions, then the pointer."""
        n, now = self._pointer()
        n += 1
        for name, df in replaced.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{n}")
            now[name] = [str(n)]
        for name, df in (appended or {}).items():
            parts = now.get(name, [])
            if len(parts) >= PARTS:
                df, parts = self.spark.read.schema(df.schema).parquet(*(f"{self.folder}/{name}/{p}" for p in parts)).unionByName(df), []
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{n}")
            now[name] = [*parts, str(n)]
        out = self._fs.create(self._path(f"{self.folder}/CURRENT-{n}.json"), True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
