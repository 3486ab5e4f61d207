"""Joins of the state's tables: links, shadows, facts, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_shadow(rows: DataFrame, shadow: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with what was last known of them as ``was_*``; new rows have nulls."""
    return rows.join(shadow.select(key, *(F.col(f).alias(f"was_{f}") for f in fields)), key, "left")


def canonical_of(rows: DataFrame, links: DataFrame, connector: str) -> DataFrame:
    """Rows ``(external_id, ...)`` with their canonical id, null where there is none."""
    return rows.join(links.where(F.col("connector") == connector).select("external_id", "canonical_id"), "external_id", "left")


def contributing(links: DataFrame, shadow: DataFrame) -> DataFrame:
    """Shadow rows of every canonical."""
    return shadow.join(links, ["connector", "external_id"])


def created_by_source(links: DataFrame, shadow: DataFrame) -> DataFrame:
    """``(canonical_id, connector, created)``: when each source first had it; a source without a time has no row."""
    return contributing(links, shadow).where("created IS NOT NULL").groupBy("canonical_id", "connector").agg(F.min("created").alias("created"))


def children_of(parents: DataFrame, parent_map: DataFrame, shadow: DataFrame, path: str) -> DataFrame:
    """Shadow rows of the children of some parents at an array path."""
    own = parent_map.where(F.col("array_path") == path).join(parents.select("parent_id").distinct(), "parent_id", "left_semi")
    return own.join(shadow.withColumnRenamed("id", "child_id"), "child_id")


def requests_of(journal: DataFrame, log: DataFrame) -> DataFrame:
    """Logged changes with the requests of their batch."""
    return log.join(journal, "batch_id")


def first_of(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """One value for each key: the scalar lookup of a sibling entity."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def split_links(children: DataFrame, links: DataFrame) -> DataFrame:
    """Where the ids that a split made are linked: ``(split_of, canonical_id, connector, external_id)``."""
    return children.select("canonical_id", "split_of").join(links, "canonical_id").select("split_of", "canonical_id", "connector", "external_id")


def leftovers(shadow: DataFrame, links: DataFrame) -> DataFrame:
    """Known records without a link."""
    return shadow.join(links, ["connector", "external_id"], "left_anti")


def probe(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(node, canonical_id)``: every canonical that a row meets by one of its identity keys; rows and known are exploded keys."""
    return rows.join(known, list(keys)).select("node", "canonical_id").distinct()


def merged_facts(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, val, prev, ts, src)``: incoming facts over existing ones, with the value before; others stay."""
    old = existing.select(*key, F.col("val").alias("o_val"), F.col("prev").alias("o_prev"), F.col("ts").alias("o_ts"), F.col("src").alias("o_src"))
    both = incoming.select(*key, "val", "ts", "src", F.lit(True).alias("now")).join(old, list(key), "full")
    pick = lambda new, was: F.when(F.col("now"), new).otherwise(F.col(was))
    return both.select(*key, pick(F.col("val"), "o_val").alias("val"), pick(F.col("o_val"), "o_prev").alias("prev"), pick(F.col("ts"), "o_ts").alias("ts"), pick(F.col("src"), "o_src").alias("src"))


def plain_records(facts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Facts as records: a column for each field."""
    return facts.groupBy(key).pivot("field", list(fields)).agg(F.first("val"))
