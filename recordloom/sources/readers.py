"""Scans: incremental, by id, JSON files, JDBC tables, triples, event feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id STRING, data STRING, updated STRING"


def since(df: DataFrame, column: str, watermark, full: bool = False) -> DataFrame:
    """Rows newer than the watermark, and those without one; all rows on a full pass."""
    if full or watermark is None:
        return df
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(watermark)))


def newer_text(column: Column, watermark: str) -> Column:
    """Watermarks as text: by number if both are numbers, else by text."""
    n, w = column.try_cast("double"), F.lit(watermark).try_cast("double")
    return column.isNull() | F.when(n.isNotNull() & w.isNotNull(), n > w).otherwise(column > F.lit(watermark))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def json_records(spark: SparkSession, path: str, watermark: str | None = None, id_field: str = "id", data_field: str = "data", updated_field: str = "updated") -> DataFrame:
    """Records of JSON array files as ``(id, data as JSON, updated)``; a missing file is an empty source."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], RECORD)
    raw = spark.read.schema(f"`{id_field}` STRING, `{data_field}` STRING, `{updated_field}` STRING").option("multiLine", True).json(path)
    out = raw.select(F.col(id_field).alias("id"), F.col(data_field).alias("data"), F.col(updated_field).alias("updated"))
    return out if watermark is None else out.where(newer_text(F.col("updated"), watermark))


def jdbc_table(spark: SparkSession, url: str, table: str, watermark_column: str | None = None, watermark: str | None = None, **options: str) -> DataFrame:
    """A JDBC scan whose watermark condition is pushed to the database."""
    for name in filter(None, (table, watermark_column)):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name):
            raise ValueError(f"not an identifier: {name!r}")
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return since(df, watermark_column, watermark) if watermark_column else df


def triples_scan(triples: DataFrame, kind: str, properties: list[str], type_predicate: str = "a", modified: str | None = None, after: str | None = None, graph: str | None = None) -> DataFrame:
    """One row for each subject of a type and combination of its optional properties; of one named graph (column ``g``) if given."""
    if graph is not None:
        triples = triples.where(F.col("g") == graph)
    out = triples.where((F.col("p") == type_predicate) & (F.col("o") == kind) & ~F.col("s").startswith("_:")).select("s")
    for p in properties:
        out = out.join(triples.where(F.col("p") == p).select("s", F.col("o").alias(p)), "s", "left")
    if modified and after is not None:
        out = out.where(F.col(modified).isNull() | (F.col(modified) > after))
    return out.distinct()


def folded_events(events: DataFrame, entity: list[str], name: str, value: str, order: Column) -> DataFrame:
    """``(entity..., name, value)``: the last value of each property in a change feed."""
    return events.groupBy(*entity, name).agg(F.max_by(value, order).alias(value))


def change_records(events: DataFrame, entity: list[str], op: str, deletes: list[str], order: Column) -> DataFrame:
    """The last event of each entity as a record; a delete gives ``deleted`` true."""
    last = events.groupBy(*entity).agg(F.max_by(F.struct(*(c for c in events.columns if c not in entity)), order).alias("r")).select(*entity, "r.*")
    return last.withColumn("deleted", F.coalesce(F.col(op).isin(*deletes), F.lit(False)))


def next_watermark(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.max(column).alias("watermark"))
