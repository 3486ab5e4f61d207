"""Counters, breaker state and lineage as relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def action_counts(delta: DataFrame, by: str) -> DataFrame:
    """One row for each run with a counter for each action."""
    names = ("insert", "update", "skip", "delete", "error")
    return delta.groupBy(by).agg(*(F.count_if(F.col("action") == n).alias(f"n_{n}") for n in names), F.count("*").alias("n_all"))


def error_rate(results: DataFrame, by: str, order: list[str], failed: str, ring: int = 20, least: int = 3, trip: float = 0.5) -> DataFrame:
    """Share of failures among the last results of each group, and whether the breaker would trip."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(ring - 1), 0)
    rows = results.select("*", F.count("*").over(w).alias("n"), F.sum(F.col(failed).cast("int")).over(w).alias("bad"))
    return rows.select(*results.columns, (F.col("bad") / F.col("n")).alias("rate"), ((F.col("n") >= least) & (F.col("bad") / F.col("n") >= trip)).alias("open"))


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each group."""
    return rows.groupBy(by).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def lineage(spark: SparkSession, members: Iterable[tuple[str, str, list]]) -> DataFrame:
    """``(connector, entity, local, canonical, direction)`` from mapping specs."""
    rows = [(c, e, f.expression or f.source_path or f.local, f.target, f.direction) for c, e, fields in members for f in fields]
    return spark.createDataFrame(rows, "connector string, entity string, local string, canonical string, direction string").distinct()


def channel_status(links: DataFrame, shadow: DataFrame) -> DataFrame:
    """One row: linked records, canonicals over several connectors, known records, and the status they make."""
    spans = links.groupBy("canonical_id").agg(F.countDistinct("connector").alias("n"))
    a = spans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.count_if(F.col("n") > 1).alias("n_spanning"))
    b = shadow.agg(F.count("*").alias("n_known"))
    status = F.when(F.col("n_spanning") > 0, "ready").when(F.col("n_known") > 0, "partially-collected").otherwise("uninitialized")
    return a.crossJoin(F.broadcast(b)).select("n_links", "n_spanning", "n_known", status.alias("status"))  # one row each
