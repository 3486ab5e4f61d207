"""Conflict resolution: golden values and per-field decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import resolve as R
from recordloom.plans.registry import query


@query("SELECT entity, field, arg_min(struct_pack(v := val), (-ts, src)).v AS val, arg_min(src, (-ts, src)) AS src FROM facts GROUP BY entity, field", "facts")
def resolve_lww(s):
    return R.last_write(s["facts"])


@query("SELECT entity, field, arg_min(val, src) AS val FROM facts WHERE val IS NOT NULL GROUP BY entity, field", "facts")
def golden_first_non_null(s):
    return R.first_non_null(s["facts"]).select("entity", "field", "val")


@query("SELECT entity, field, arg_min(struct_pack(v := val), src).v AS val FROM facts GROUP BY entity, field", "facts")
def golden_merge_fold(s):
    return R.merge_fold(s["facts"]).select("entity", "field", "val")


@query("SELECT entity, field, arg_min(struct_pack(v := val), CASE src WHEN 'erp' THEN 1 ELSE 2 END).v AS val FROM facts GROUP BY entity, field", "facts")
def resolve_coalesce_priority(s):
    return R.by_priority(s["facts"], R.Policy(priorities={"erp": 1, "crm": 2})).select("entity", "field", "val")


@query("SELECT entity, field, arg_min(struct_pack(v := val), (created, -ts, src)).v AS val FROM facts GROUP BY entity, field", "facts")
def resolve_origin_wins(s):
    return R.by_origin(s["facts"]).select("entity", "field", "val")


@query("SELECT entity, field, string_agg(coalesce(val, '-'), '|' ORDER BY o) AS vals FROM (SELECT entity, field, val, min((ts, src)) AS o FROM facts GROUP BY entity, field, val) GROUP BY entity, field", "facts")
def resolve_collect(s):
    return R.collected(s["facts"]).select("entity", "field", F.array_join("val", "|", "-").alias("vals"))


@query("SELECT 'u' || user_id AS entity, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id")
def resolve_bool_or(s):
    facts = s["events"].select(F.concat(F.lit("u"), "user_id").alias("entity"), F.lit("bought").alias("field"), (F.col("event_type") == "purchase").cast("string").alias("val"))
    return R.any_true(facts).select("entity", F.col("val").alias("bought"))


PAIR = "SELECT i.entity, i.field, i.val AS iv, e.val AS ev, i.ts AS its, e.ts AS ets, i.created AS ic, e.created AS ec, e.entity AS known FROM (SELECT * FROM facts WHERE src = 'erp') i LEFT JOIN (SELECT * FROM facts WHERE src = 'crm') e ON i.entity = e.entity AND i.field = e.field"


def _decide(s, policy):
    return R.decide(s["facts"].where("src = 'erp'"), s["facts"].where("src = 'crm'"), policy)


@query(f"SELECT entity, field, known IS NULL OR its > ets OR (its = ets AND NOT ec < ic) AS accepted FROM ({PAIR})", "facts")
def resolve_lww_tiebreak(s):
    return _decide(s, R.Policy()).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN true WHEN ic <> ec THEN ic < ec ELSE its >= ets END AS accepted FROM ({PAIR})", "facts")
def resolve_origin_decision(s):
    return _decide(s, R.Policy(default="origin_wins")).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN true WHEN field = 'balance' THEN false WHEN field = 'segment' THEN true ELSE its > ets OR (its = ets AND NOT ec < ic) END AS accepted FROM ({PAIR})", "facts")
def resolve_field_master(s):
    return _decide(s, R.Policy(masters={"balance": "crm", "segment": "erp"})).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN iv ELSE cast(greatest(cast(iv AS bigint), cast(ev AS bigint)) AS varchar) END AS val FROM ({PAIR}) WHERE field = 'balance'", "facts")
def resolve_reducer(s):
    policy = R.Policy(reducers={"balance": "CAST(greatest(CAST(incoming AS bigint), CAST(existing AS bigint)) AS string)"})
    rows = R.decide(s["facts"].where("src = 'erp' AND field = 'balance'"), s["facts"].where("src = 'crm' AND field = 'balance'"), policy)
    return rows.select("entity", "field", "val")


GROUPS = {"balance": "money", "segment": "money"}
#: Of each group: the newest times of both sides, and the source and creation time of the newest existing field.
SIDES = """SELECT i.entity, i.its, i.ic, o.ets, o.ec, o.entity IS NULL AS alone FROM
(SELECT entity, max(ts) AS its, min(created) AS ic FROM facts WHERE src = 'erp' AND field IN ('balance', 'segment') GROUP BY entity) i LEFT JOIN
(SELECT entity, arg_min(ts, (-ts, field)) AS ets, arg_min(created, (-ts, field)) AS ec FROM facts WHERE src = 'crm' AND field IN ('balance', 'segment') GROUP BY entity) o ON o.entity = i.entity"""
GROUPED = "SELECT p.entity, p.field, CASE WHEN p.field IN ('balance', 'segment') THEN g.alone OR {wins} WHEN known IS NULL THEN true ELSE {single} END AS accepted FROM ({pair}) p LEFT JOIN ({sides}) g ON g.entity = p.entity"
NEWER = "p.its > p.ets OR (p.its = p.ets AND NOT p.ec < p.ic)"


@query(GROUPED.format(wins="g.its >= g.ets", single=NEWER, pair=PAIR, sides=SIDES), "facts")
def resolve_group_atomic(s):
    return _decide(s, R.Policy(groups=GROUPS)).select("entity", "field", "accepted")


@query(GROUPED.format(wins="g.ic <= g.ec", single="CASE WHEN p.ic <> p.ec THEN p.ic < p.ec ELSE p.its >= p.ets END", pair=PAIR, sides=SIDES), "facts")
def resolve_group_origin(s):
    return _decide(s, R.Policy(default="origin_wins", groups=GROUPS)).select("entity", "field", "accepted")


@query(GROUPED.format(wins="true", single=NEWER, pair=PAIR, sides=SIDES), "facts")
def resolve_group_priority(s):
    """The incoming source ranks last, but for one field of the group."""
    return _decide(s, R.Policy(groups=GROUPS, priorities={"crm": 2, "erp": 3}, field_priorities={("erp", "segment"): 1})).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN true WHEN field = 'segment' THEN false ELSE its > ets OR (its = ets AND NOT ec < ic) END AS accepted FROM ({PAIR})", "facts")
def resolve_coalesce_decision(s):
    return _decide(s, R.Policy(strategies={"segment": "coalesce"}, priorities={"crm": 1, "erp": 2})).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN true WHEN field = 'name' AND lower(iv) IS NOT DISTINCT FROM lower(ev) THEN false ELSE its > ets OR (its = ets AND NOT ec < ic) END AS accepted FROM ({PAIR})", "facts")
def normalize_guard(s):
    return _decide(s, R.Policy(normalize={"name": "lower(v)"})).select("entity", "field", "accepted")


@query(f"SELECT entity, field, CASE WHEN known IS NULL THEN iv WHEN iv IS NOT DISTINCT FROM ev THEN '[' || coalesce('\"' || ev || '\"', 'null') || ']' ELSE '[' || coalesce('\"' || ev || '\"', 'null') || ',' || coalesce('\"' || iv || '\"', 'null') || ']' END AS val FROM ({PAIR})", "facts")
def resolve_collect_decision(s):
    return _decide(s, R.Policy(default="collect")).select("entity", "field", "val")
