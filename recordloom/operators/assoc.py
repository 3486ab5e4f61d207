"""Associations: typed references between records of different systems.

Edges are ``(record_id, predicate, target_entity, target_id)``; links are ``(canonical_id, connector, external_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract(df: DataFrame, id_col: str, refs: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Edges from reference columns, given as ``(predicate, target entity, id)``; of one predicate the first non-null counts."""
    entry = lambda p, e, c: F.when(c.isNotNull(), F.struct(F.lit(p).alias("predicate"), F.lit(e).alias("target_entity"), c.cast("string").alias("target_id")))
    by: dict[str, list[Column]] = {}
    for p, e, c in refs:
        by.setdefault(p, []).append(entry(p, e, c))
    entries = F.array_compact(F.array(*(F.coalesce(*cs) for cs in by.values())))
    return df.select(F.col(id_col).alias("record_id"), F.explode(entries).alias("e")).select("record_id", "e.*")


def last_per_predicate(edges: DataFrame, order: Column) -> DataFrame:
    return edges.groupBy("record_id", "predicate").agg(F.max_by(F.struct("target_entity", "target_id"), order).alias("t")).select("record_id", "predicate", "t.*")


def remap(edges: DataFrame, links: DataFrame, source: str, target: str, predicates: dict[str, str] | None = None) -> DataFrame:
    """Edges in the target's ids, over the canonical id; ``target_id`` is null where a hop is missing, and an empty id stays."""
    here = links.where(F.col("connector") == source).select(F.col("external_id").alias("target_id"), "canonical_id")
    there = links.where(F.col("connector") == target).select("canonical_id", F.col("external_id").alias("remapped"))
    name = F.col("predicate")
    if predicates is not None:
        edges = edges.where(name.isin(*predicates))
        for k, v in predicates.items():
            name = F.when(F.col("predicate") == k, v).otherwise(name)
    out = edges.join(here, "target_id", "left").join(there, "canonical_id", "left")
    return out.select("record_id", name.alias("predicate"), "target_entity", F.when(F.col("target_id") == "", F.lit("")).otherwise(F.col("remapped")).alias("target_id"))


def remap_strict(edges: DataFrame, links: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Remapped edges of records with none unresolved, and the ids of the records to defer."""
    done = remap(edges, links, source, target)
    deferred = done.groupBy("record_id").agg(F.bool_or(F.col("target_id").isNull()).alias("open")).where("open").select("record_id")
    return done.join(deferred, "record_id", "left_anti"), deferred


def remap_partial(edges: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    return remap(edges, links, source, target).where("target_id is not null")


def merge_outbound(resolved: DataFrame, existing: DataFrame, expressible: Sequence[str]) -> DataFrame:
    """The source's edges, and those of the target which the source has no word for."""
    return resolved.unionByName(existing.where(~F.col("predicate").isin(*expressible)).select(*resolved.columns))


def inject(df: DataFrame, edges: DataFrame, id_col: str, predicates: Sequence[str]) -> DataFrame:
    """Remapped ids as plain columns."""
    wide = edges.groupBy("record_id").pivot("predicate", list(predicates)).agg(F.max("target_id"))
    return df.join(wide.withColumnRenamed("record_id", id_col), id_col, "left")


def sentinel(edges: DataFrame) -> DataFrame:
    """``(record_id, sentinel)``: a record's edges as one text, in order of predicate."""
    return edges.groupBy("record_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("predicate", "target_entity", "target_id")))).alias("sentinel"))


def retry(deferred: DataFrame, current: DataFrame, processed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Deferred records to process again (found, and not in this pass), and those to purge (found nowhere)."""
    found = current.join(deferred.select(key).distinct(), key, "left_semi").join(processed.select(key), key, "left_anti")
    return found, deferred.select(key).distinct().join(current.select(key), key, "left_anti")
