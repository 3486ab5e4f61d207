"""Conflict resolution over field facts in long form.

A fact is ``(entity, field, val, ts, src, created)``.  :func:`decide` tells for each incoming fact whether it
replaces the existing one; the golden functions fold all facts of an entity at once, with one grouped ``min_by`` or
``max_by`` each and no sort.  Ties are broken by source, then by value, so results don't depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 2**62


@dataclass(frozen=True)
class Policy:
    """Strategy by field (else ``default``), priorities by source (and by field), masters by field, groups of fields."""

    default: str = "last_modified"
    strategies: dict[str, str] = field(default_factory=dict)
    priorities: dict[str, int] = field(default_factory=dict)
    field_priorities: dict[tuple[str, str], int] = field(default_factory=dict)
    masters: dict[str, str] = field(default_factory=dict)
    reducers: dict[str, str] = field(default_factory=dict)
    normalize: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)


def _lookup(table: dict, key: Column, other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def priority(policy: Policy, src: Column, name: Column) -> Column:
    """A field's own priority, else the source's, else last."""
    out = _lookup(policy.priorities, src, F.lit(FAR))
    for (s, f), v in policy.field_priorities.items():
        out = F.when((src == s) & (name == f), F.lit(v)).otherwise(out)
    return out


def newer() -> Column:
    """Last write wins: at equal times the incoming, unless the existing source is known to be older."""
    i, e = F.col("in_ts"), F.col("ex_ts")
    older = F.coalesce(F.col("ex_created") < F.col("in_created"), F.lit(False))
    return F.when(i > e, True).when(i < e, False).otherwise(~older)


def earlier_origin(ties: bool = False) -> Column:
    """The source that was there first; one without a creation time loses; else last write wins.  ties: equal creation times are for the incoming."""
    i, e = F.col("in_created"), F.col("ex_created")
    later = F.col("in_ts") >= F.col("ex_ts")
    return F.when(i.isNotNull() & e.isNotNull(), F.when(i != e, i < e).otherwise(F.lit(True) if ties else later)).when(i.isNotNull(), True).when(e.isNotNull(), False).otherwise(later)


def as_list(value: Column) -> Column:
    """A collected value as an array: the text is a JSON array, else it is one value."""
    found = F.from_json(value, "array<string>")
    return F.when(value.startswith("[") & found.isNotNull(), found).otherwise(F.array(value))


def decide(incoming: DataFrame, existing: DataFrame, policy: Policy) -> DataFrame:
    """``(entity, field, val, accepted)`` of every incoming fact; a reducer or ``collect`` may change the value.

    A field of a group is taken or refused with its whole group, and no other rule counts for it.  Of the others, a field
    equal to the existing one after ``normalize`` (SQL over ``v``) is refused; then its reducer (SQL over ``incoming`` and
    ``existing``) decides, else its own strategy, else its master, else the default strategy.  ``collect`` gives a JSON array
    of different values in the order they came; null is a value.  A field that the entity lacks is taken.
    """
    i = incoming.select("entity", "field", F.col("val").alias("incoming"), F.col("ts").alias("in_ts"), F.col("src").alias("in_src"), F.col("created").alias("in_created"))
    e = existing.select("entity", "field", F.col("val").alias("existing"), F.col("ts").alias("ex_ts"), F.col("src").alias("ex_src"), F.col("created").alias("ex_created"), F.lit(True).alias("known"))
    both = i.join(e, ["entity", "field"], "left")
    name = F.col("field")
    pi, pe = priority(policy, F.col("in_src"), name), priority(policy, F.col("ex_src"), name)
    by = {
        "last_modified": newer(),
        "origin_wins": earlier_origin(),
        "coalesce": F.when(pi != pe, pi < pe).otherwise(F.col("in_ts") >= F.col("ex_ts")),
        "collect": F.lit(True),
        "bool_or": (F.lower("incoming") == "true") & ~F.coalesce(F.lower("existing") == "true", F.lit(False)),
    }
    plan = _lookup(policy.strategies, name, F.lit(policy.default))
    chosen = F.lit(None).cast("boolean")
    for k, v in by.items():
        chosen = F.when(plan == k, v).otherwise(chosen)
    master = _lookup(policy.masters, name, F.lit(None).cast("string"))
    own = _lookup(policy.strategies, name, F.lit(None).cast("string")).isNotNull()
    chosen = F.when(~own & master.isNotNull(), master == F.col("in_src")).otherwise(chosen)
    have = as_list(F.col("existing"))
    collected = F.to_json(F.when(F.exists(have, lambda x: x.eqNullSafe(F.col("incoming"))), have).otherwise(F.array_append(have, F.col("incoming"))))
    value = F.when(plan == "collect", collected).otherwise(F.col("incoming"))
    for f, text in policy.reducers.items():
        value, chosen = F.when(name == f, F.expr(text)).otherwise(value), F.when(name == f, True).otherwise(chosen)
    for f, text in policy.normalize.items():
        pair = F.expr(f"transform(array(incoming, existing), v -> {text})")  # v is bound as a name, whatever else the text holds
        chosen = F.when((name == f) & F.get(pair, F.lit(0)).eqNullSafe(F.get(pair, F.lit(1))), False).otherwise(chosen)
    known = F.col("known").isNotNull()
    out = both.withColumns({"accepted": F.when(known, F.coalesce(chosen, F.lit(False))).otherwise(True), "val": F.when(known, value).otherwise(F.col("incoming"))})
    if policy.groups:
        group = _lookup(policy.groups, name, F.lit(None).cast("string"))
        out = out.withColumn("grp", group).join(group_winners(i, e, policy), ["entity", "grp"], "left")
        out = out.withColumns({"accepted": F.when(F.col("grp").isNotNull(), F.col("wins")).otherwise(F.col("accepted")), "val": F.when(F.col("grp").isNotNull(), F.col("incoming")).otherwise(F.col("val"))})
    return out.select("entity", "field", "val", "accepted")


def group_winners(i: DataFrame, e: DataFrame, policy: Policy) -> DataFrame:
    """``(entity, grp, wins)``: whether the incoming side takes a group.

    The group's existing side is its newest field with that field's source (of equal times the least name): by origin that
    source's creation time counts, equal ones being for the incoming; with priorities, the best priority that a side's
    source has for any field of the group, else the source's own; else the newest times.  A group without existing fields
    is the incoming's.
    """
    grp = _lookup(policy.groups, F.col("field"), F.lit(None).cast("string")).alias("grp")
    new = i.select("*", grp).where("grp is not null").groupBy("entity", "grp").agg(F.max("in_ts").alias("in_ts"), F.min("in_src").alias("in_src"), F.min("in_created").alias("in_created"))
    old = e.select("*", grp).where("grp is not null").groupBy("entity", "grp").agg(F.min_by(F.struct("ex_ts", "ex_src", "ex_created"), F.struct(-F.col("ex_ts"), F.col("field"))).alias("o")).select("entity", "grp", "o.*")
    if policy.default == "origin_wins":
        wins = earlier_origin(ties=True)
    elif policy.priorities:
        best: dict[tuple[str, str], int] = {}
        for (src, field), n in policy.field_priorities.items():
            if field in policy.groups:
                key = (src, policy.groups[field])
                best[key] = min(n, best.get(key, n))

        def rank(src: str) -> Column:
            out = _lookup(policy.priorities, F.col(src), F.lit(FAR))
            for (s, g), n in best.items():
                out = F.when((F.col(src) == s) & (F.col("grp") == g), F.lit(n)).otherwise(out)
            return out

        wins = F.when(rank("in_src") != rank("ex_src"), rank("in_src") < rank("ex_src")).otherwise(F.col("in_ts") >= F.col("ex_ts"))
    else:
        wins = F.col("in_ts") >= F.col("ex_ts")
    return new.join(old, ["entity", "grp"], "left").select("entity", "grp", F.when(F.col("ex_ts").isNull(), True).otherwise(wins).alias("wins"))


def golden(facts: DataFrame, order: Column, largest: bool = True) -> DataFrame:
    """``(entity, field, val, src)``: the fact with the largest (or least) order; ties go to the least source."""
    pick = F.max_by if largest else F.min_by
    return facts.groupBy("entity", "field").agg(pick(F.struct("val", "src"), order).alias("w")).select("entity", "field", "w.val", "w.src")


def last_write(facts: DataFrame) -> DataFrame:
    return golden(facts, F.struct(-F.col("ts"), F.col("src"), F.col("val")), largest=False)


def first_non_null(facts: DataFrame) -> DataFrame:
    """The value of the first source that has one."""
    return golden(facts.where("val is not null"), F.struct("src", "val"), largest=False)


def merge_fold(facts: DataFrame) -> DataFrame:
    """The value of the first source, null or not."""
    return golden(facts, F.struct("src", "val"), largest=False)


def by_priority(facts: DataFrame, policy: Policy) -> DataFrame:
    return golden(facts, F.struct(priority(policy, F.col("src"), F.col("field")), -F.col("ts"), F.col("src")), largest=False)


def by_origin(facts: DataFrame) -> DataFrame:
    return golden(facts, F.struct(F.coalesce("created", F.lit(FAR)), -F.col("ts"), F.col("src")), largest=False)


def collected(facts: DataFrame) -> DataFrame:
    """All different values of a field as an array, in the order they first came; one row for each value is shuffled."""
    first = facts.groupBy("entity", "field", "val").agg(F.min(F.struct("ts", "src")).alias("at"))
    return first.groupBy("entity", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "val"))), lambda x: x["val"]).alias("val"))


def any_true(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity", "field").agg(F.coalesce(F.bool_or(F.lower("val") == "true"), F.lit(False)).alias("val"))
