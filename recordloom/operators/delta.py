"""Change detection: what is new, changed, unchanged, or gone, against the last known state.

Rows are compared as canonical JSON text of their fields, null-safe, so nested values compare like scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(columns: Sequence[str], normalize: dict[str, str] | None = None) -> Column:
    """Canonical text of some columns; ``normalize`` has a SQL expression by column."""
    cols = [(F.expr(normalize[c]) if normalize and c in normalize else F.col(c)).alias(c) for c in columns]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def unordered(array: Column) -> Column:
    """An array's elements as text in a fixed order, for comparison of arrays without one."""
    return F.array_sort(F.transform(array, lambda x: F.to_json(F.struct(x.alias("x")))))


def classify(incoming: DataFrame, state: DataFrame, key: str, fields: Sequence[str], normalize: dict[str, str] | None = None, tombstone: str | None = None) -> DataFrame:
    """``(key, action)``: ``insert``, ``update``, ``skip`` (an echo), or ``resurrect`` for a row whose tombstone stands in the state."""
    old = state.select(key, text_of(fields, normalize).alias("old"), (F.col(tombstone).isNotNull() if tombstone else F.lit(False)).alias("gone"), F.lit(True).alias("known"))
    new = incoming.select(key, text_of(fields, normalize).alias("new"))
    action = F.when(F.col("known").isNull(), "insert").when(F.col("gone"), "resurrect").when(F.col("new") == F.col("old"), "skip").otherwise("update")
    return new.join(old, key, "left").select(key, action.alias("action"))


def unchanged(incoming: DataFrame, state: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The echoes: incoming rows equal to the state."""
    return classify(incoming, state, key, fields).where("action = 'skip'").select(key)


def not_echoes(incoming: DataFrame, state: DataFrame, key: str, fields: Sequence[str], again: DataFrame | None = None) -> DataFrame:
    """Incoming rows that differ from the state, and those to try ``again`` although they don't."""
    echoes = unchanged(incoming, state, key, fields)
    return incoming.join(echoes if again is None else echoes.join(again.select(key), key, "left_anti"), key, "left_anti")


def guarded(rows: DataFrame, resolved: str, target_id: str) -> DataFrame:
    """``action``: a record the target lacks is inserted, even without fields; one with nothing resolved is a skip; others are updates."""
    return rows.withColumn("action", F.when(F.col(target_id).isNull(), "insert").when(F.size(resolved) == 0, "skip").otherwise("update"))


def changed_fields(incoming: DataFrame, state: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``(key, field, before, after)`` of every field that differs."""
    old = state.select(key, *(F.col(f).cast("string").alias(f"old_{f}") for f in fields))
    rows = incoming.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).join(old, key)
    entries = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.col(f).alias("after"))) for f in fields))
    return rows.select(key, F.explode(F.array_compact(entries)).alias("d")).select(key, "d.*")


def absent(known: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    return known.select(key).join(returned.select(key), key, "left_anti")


def absence_guard(known: DataFrame, returned: DataFrame, key: str, most: float = 0.5) -> DataFrame:
    """One row ``(n_known, n_missing, ratio, tripped)``: nothing is deleted if nothing came back or too much is missing."""
    n = known.select(key).distinct().join(returned.select(key).distinct().withColumn("here", F.lit(1)), key, "left").agg(F.count("*").alias("n_known"), F.count_if(F.col("here").isNull()).alias("n_missing"))
    ratio = F.when(F.col("n_known") > 0, F.col("n_missing") / F.col("n_known")).otherwise(F.lit(0.0))
    return n.select("n_known", "n_missing", ratio.alias("ratio"), ((F.col("n_missing") == F.col("n_known")) | (ratio > most)).alias("tripped"))


def snapshot_deletes(known: DataFrame, returned: DataFrame, key: str, most: float = 0.5) -> DataFrame:
    """Keys to delete after a full snapshot, unless the guard trips."""
    guard = absence_guard(known, returned, key, most).where("NOT tripped").select(F.lit(1).alias("ok"))
    return absent(known, returned, key).crossJoin(F.broadcast(guard)).select(key)  # the guard is one row


def fan_out_deletes(gone: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """``(connector, external_id)`` to delete in the other connectors of the canonicals whose source row is gone."""
    canon = links.where(F.col("connector") == source).join(gone.select(F.col(gone.columns[0]).alias("external_id")), "external_id", "left_semi").select("canonical_id")
    return links.where(F.col("connector") != source).join(canon, "canonical_id", "left_semi").select("connector", "external_id")


def upsert(state: DataFrame, delta: DataFrame, key: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: delta rows replace state rows; ``keep_first`` columns keep their first value."""
    key = list(key)
    old = state.select(*key, *(F.col(c).alias(f"old_{c}") for c in state.columns if c not in key), F.lit(True).alias("was"))
    both = delta.withColumn("now", F.lit(True)).join(old, key, "full")
    pick = lambda c: F.coalesce(f"old_{c}", c) if c in keep_first else F.when(F.col("now"), F.col(c)).otherwise(F.col(f"old_{c}"))
    return both.select(*key, *(pick(c).alias(c) for c in state.columns if c not in key))


def insert_ignore(state: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """State and those new rows whose key it lacks."""
    return state.unionByName(rows.dropDuplicates(list(key)).join(state.select(*key), list(key), "left_anti").select(*state.columns))


def rollback(log: DataFrame, batch: str, key: str) -> DataFrame:
    """``(key, action, payload)`` that undoes a batch: inserts become deletes, updates go back to their before image."""
    rows = log.where(F.col("batch_id") == batch)
    return rows.select(key, F.when(F.col("action") == "insert", "delete").when(F.col("action") == "delete", "insert").otherwise("update").alias("action"), F.col("before").alias("payload"))
