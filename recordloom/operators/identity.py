"""Entity resolution: records that share an identity key, directly or over others, are one entity.

Keys of all groups are exploded to rows; records with one key are joined to the least of them (a star), never with
each other, so a key with very many records costs as many edges as records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.components import connected_components

Groups = Sequence[Sequence[str]]


def normalised(value: Column, kind: str) -> Column:
    """A key part: text trimmed and in lower case, other values as text, null as empty."""
    return F.coalesce(F.lower(F.trim(value)) if kind == "string" else value.cast("string"), F.lit(""))


def keys(nodes: DataFrame, groups: Groups, node: str = "node") -> DataFrame:
    """``(node, grp, key)``: each group's key of each record; a group with a blank part gives none."""
    kinds = dict(nodes.dtypes)
    entries = []
    for g, fields in enumerate(groups):
        parts = [normalised(F.col(f), kinds[f]) for f in fields if f in kinds]
        if len(parts) < len(fields):
            continue
        full = parts[0] != ""
        for p in parts[1:]:
            full = full & (p != "")
        entries.append(F.when(full, F.struct(F.lit(g).alias("grp"), F.concat_ws("\x01", *parts).alias("key"))))
    if not entries:
        return nodes.select(F.col(node).alias("node"), F.lit(0).alias("grp"), F.lit("").alias("key")).where("false")
    return nodes.select(F.col(node).alias("node"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("node", "e.grp", "e.key")


def star_edges(keyed: DataFrame) -> DataFrame:
    """``(a, b)``: each record and the least one with the same key."""
    hubs = keyed.groupBy("grp", "key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub <> far").select("grp", "key", "hub")
    return keyed.join(hubs, ["grp", "key"]).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def components(nodes: DataFrame, groups: Groups, node: str = "node") -> DataFrame:
    """``(node, component)`` of all records; a record without partners is its own component."""
    found = connected_components(star_edges(keys(nodes, groups, node)))
    return nodes.select(F.col(node).alias("node")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def single_key_components(nodes: DataFrame, field: str, node: str = "node") -> DataFrame:
    """As :func:`components` for one group of one field, where the key itself is the component."""
    key = normalised(F.col(field), dict(nodes.dtypes)[field])
    least = nodes.where(key != "").groupBy(key.alias("key")).agg(F.min(node).alias("component"))
    return nodes.withColumn("key", key).join(least, "key", "left").select(F.col(node).alias("node"), F.coalesce("component", F.col(node)).alias("component"))


def ambiguous(members: DataFrame) -> DataFrame:
    """``(component)`` in which one connector has several records."""
    return members.groupBy("component", "connector").count().where("count > 1").select("component").distinct()


def discover(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """``(node, connector, component, status)``: ``matched`` over connectors, else ``unique``; ambiguous components are unique."""
    members = nodes.select("node", "connector").join(comp, "node")
    stats = members.groupBy("component", "connector").count().groupBy("component").agg(F.count("*").alias("connectors"), F.max("count").alias("most"))
    return members.join(stats, "component").select("node", "connector", "component", F.when((F.col("connectors") > 1) & (F.col("most") == 1), "matched").otherwise("unique").alias("status"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("connector").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "unique").alias("only_here"))


def without_blocked(edges: DataFrame, no_link: DataFrame) -> DataFrame:
    """Candidate links less those that ``no_link`` (in either order) forbids."""
    both = no_link.select(F.col("a"), F.col("b")).union(no_link.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return edges.join(both, ["a", "b"], "left_anti")


def provisional_id(connector: Column, external: Column) -> Column:
    """A canonical id from the record itself, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\x01", connector, external), 256), 1, 32)


def split_cluster(links: DataFrame, canonical: str) -> DataFrame:
    """Every link of one canonical gets an id of its own."""
    return links.withColumn("canonical_id", F.when(F.col("canonical_id") == canonical, F.concat("canonical_id", F.lit("/"), "connector")).otherwise(F.col("canonical_id")))


def split_one(links: DataFrame, canonical: str, connector: str) -> tuple[DataFrame, DataFrame]:
    """Detach one connector's link; also the no-link rows to those it leaves."""
    hit = (F.col("canonical_id") == canonical) & (F.col("connector") == connector)
    out = links.withColumn("canonical_id", F.when(hit, F.concat("canonical_id", F.lit("/"), "connector")).otherwise(F.col("canonical_id")))
    own = links.where(hit).select(F.col("external_id").alias("a"), "canonical_id")
    barred = links.where((F.col("canonical_id") == canonical) & (F.col("connector") != connector)).select(F.col("external_id").alias("b"), "canonical_id").join(own, "canonical_id").select("a", "b")
    return out, barred


def merge(links: DataFrame, winner: str, loser: str) -> DataFrame:
    """Repoint a canonical's links; of two links of one connector the winner's stays."""
    moved = links.withColumn("was", F.col("canonical_id")).withColumn("canonical_id", F.when(F.col("canonical_id") == loser, winner).otherwise(F.col("canonical_id")))
    best = moved.groupBy("canonical_id", "connector").agg(F.min_by("external_id", F.struct((F.col("was") == loser).cast("int"), "external_id")).alias("external_id"))
    return best.select("canonical_id", "connector", "external_id")


def pivot(members: DataFrame, connectors: Sequence[str]) -> DataFrame:
    """One row for each component with a column for each connector."""
    return members.groupBy("component").pivot("connector", list(connectors)).agg(F.min("node"))


def spanning(links: DataFrame) -> DataFrame:
    """``(canonical_id)`` linked in more than one connector: the fan-out guard's set."""
    return links.groupBy("canonical_id").agg(F.countDistinct("connector").alias("n")).where("n > 1").select("canonical_id")
