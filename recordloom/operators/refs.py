"""References in records, and what specs say about them: guards, stripping, extraction, names across systems.

An inline reference is a JSON object with ``@id`` and perhaps ``@entity``, as text or as a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_ref(value: Column) -> Column:
    """Whether a text is a JSON object with a text ``@id``; null is none."""
    return F.coalesce(F.get_json_object(value, "$['@id']").isNotNull() & F.ltrim(value).startswith("{"), F.lit(False))


def ref_id(value: Column) -> Column:
    return F.get_json_object(value, "$['@id']")


def ref_entity(value: Column) -> Column:
    return F.get_json_object(value, "$['@entity']")


def without_refs(df: DataFrame, foreign: Sequence[str] = ()) -> DataFrame:
    """Rows for a target: declared reference columns go, and inline references become null in every text column."""
    out = [c for c in df.columns if c not in foreign]
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.when(~is_ref(F.col(c)), F.col(c)).alias(c) if c in text else F.col(c) for c in out))


def extract(df: DataFrame, id_col: str, inline: Sequence[str] = (), declared: dict[str, str] | None = None, annotated: Sequence[tuple[str, Column, str]] = ()) -> DataFrame:
    """Edges ``(record_id, predicate, target_entity, target_id)`` in three passes, of which the first that finds a predicate counts.

    inline: text columns that may hold an inline reference; its entity is its own, else the declared one, else it is no
    edge.  declared: plain id columns and the entity they point to.  annotated: ``(predicate, id, entity)`` of a spec.
    """
    declared = declared or {}
    entry = lambda p, e, c: F.when(c.isNotNull() & e.isNotNull(), F.struct(F.lit(p).alias("predicate"), e.alias("target_entity"), c.cast("string").alias("target_id")))
    by: dict[str, list[Column]] = {}
    for c in inline:
        by.setdefault(c, []).append(F.when(is_ref(F.col(c)), entry(c, F.coalesce(ref_entity(F.col(c)), F.lit(declared.get(c))), ref_id(F.col(c)))))
    for c, e in declared.items():
        plain = F.when(~is_ref(F.col(c).cast("string")), F.col(c).cast("string"))
        by.setdefault(c, []).append(entry(c, F.lit(e), plain))
    for p, c, e in annotated:
        by.setdefault(p, []).append(entry(p, F.lit(e), c))
    if not by:
        return df.select(F.col(id_col).alias("record_id"), *(F.lit(None).cast("string").alias(c) for c in ("predicate", "target_entity", "target_id"))).where("false")
    return df.select(F.col(id_col).alias("record_id"), F.explode(F.array_compact(F.array(*(F.coalesce(*cs) for cs in by.values())))).alias("e")).select("record_id", "e.*")


def expressible(edges: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Edges whose predicate the target's schema declares as a reference."""
    return edges.where(F.col("predicate").isin(*fields)) if fields else edges.where("false")


def translated(edges: DataFrame, names: dict[tuple[str, str], str], source: str, target: str) -> DataFrame:
    """Entity names in the target's words; ``names``: ``(connector, entity)`` to the channel.  A name that no channel knows stays."""
    back = {channel: entity for (c, entity), channel in names.items() if c == target}
    name = F.col("target_entity")
    for (c, entity), channel in names.items():
        if c == source and channel in back:
            name = F.when(F.col("target_entity") == entity, back[channel]).otherwise(name)
    return edges.withColumn("target_entity", name)


def unknown_entities(edges: DataFrame, names: dict[tuple[str, str], str], source: str) -> DataFrame:
    """Edges to an entity of the source that no channel has: errors, not deferrals."""
    known = [e for c, e in names if c == source]
    return edges.where(~F.col("target_entity").isin(*known)) if known else edges


def dangling(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges whose target is missing from ``records`` ``(entity, id)``; an empty id points nowhere on purpose."""
    have = records.select(F.col("entity").alias("target_entity"), F.col("id").cast("string").alias("target_id"))
    return edges.where("target_id <> ''").join(have, ["target_entity", "target_id"], "left_anti")
