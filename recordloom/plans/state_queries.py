"""References, joins of state tables, sinks, watermarks and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import delta, identity, refs, state_joins
from recordloom.plans.registry import query
from recordloom.sources import readers, writers


def _referring(s):
    """Orders with an inline reference (text), a declared id, and a plain text."""
    ref = F.when(F.col("o_orderkey") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("crm-"), "o_custkey").alias("@id"), F.lit("customers").alias("@entity")))).when(F.col("o_orderkey") % 4 == 1, F.to_json(F.struct(F.concat(F.lit("x-"), "o_custkey").alias("@id")))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("id "), "o_custkey"))
    return s["orders"].select("o_orderkey", ref.alias("buyer"), F.col("o_custkey").cast("string").alias("payer"), "o_orderpriority")


@query("SELECT o_orderkey AS record_id, 'buyer' AS predicate, CASE WHEN o_orderkey % 4 = 0 THEN 'customers' ELSE 'people' END AS target_entity, CASE o_orderkey % 4 WHEN 0 THEN 'crm-' WHEN 1 THEN 'x-' ELSE 'id ' END || o_custkey AS target_id FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, 'payer', 'accounts', o_custkey::varchar FROM orders UNION ALL SELECT o_orderkey, 'priority', 'priorities', o_orderpriority FROM orders")
def ref_extract(s):
    """Inline references, then declared columns, then annotated ones; of one predicate the first counts."""
    late = [("priority", F.col("o_orderpriority"), "priorities"), ("payer", F.lit("never"), "late")]
    return refs.extract(_referring(s), "o_orderkey", inline=["buyer"], declared={"buyer": "people", "payer": "accounts"}, annotated=late)


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS is_ref FROM orders")
def ref_guard(s):
    return _referring(s).select("o_orderkey", refs.is_ref(F.col("buyer")).alias("is_ref"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'id ' || o_custkey END AS buyer, o_orderpriority FROM orders")
def ref_strip(s):
    return refs.without_refs(_referring(s), foreign=["payer"])


@query("SELECT o_orderkey AS record_id, 'payer' AS predicate FROM orders")
def ref_target_fields(s):
    edges = refs.extract(_referring(s), "o_orderkey", inline=["buyer"], declared={"buyer": "people", "payer": "accounts"})
    return refs.expressible(edges, ["payer"]).select("record_id", "predicate")


NAMES = {("crm", "customers"): "contacts", ("erp", "clients"): "contacts", ("crm", "accounts"): "ledger"}


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'clients' ELSE 'people' END AS target_entity, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1 UNION ALL SELECT 'accounts', count(*) FROM orders")
def ref_translate(s):
    edges = refs.extract(_referring(s), "o_orderkey", inline=["buyer"], declared={"buyer": "people", "payer": "accounts"})
    return refs.translated(edges, NAMES, "crm", "erp").groupBy("target_entity").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS record_id, 'people' AS target_entity FROM orders WHERE o_orderkey % 4 IN (1, 2)")
def ref_unknown_entity(s):
    edges = refs.extract(_referring(s), "o_orderkey", inline=["buyer"], declared={"buyer": "people", "payer": "accounts"})
    return refs.unknown_entities(edges, NAMES, "crm").select("record_id", "target_entity")


@query("SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 4 = 0 AND NOT (o_custkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer))")
def ref_dangling(s):
    edges = refs.extract(_referring(s), "o_orderkey", inline=["buyer"]).where("target_entity = 'customers'")
    return refs.dangling(edges, s["crm"].select(F.lit("customers").alias("entity"), F.col("external_id").alias("id"))).select("record_id")


def _shadow(s):
    """Known rows of two systems."""
    row = lambda c: s[c].select(F.lit(c).alias("connector"), "external_id", "name", F.when(F.col("k") % 5 != 0, F.col("created")).alias("created"))
    return row("crm").unionByName(row("erp"))


@query("SELECT i.canonical_id, i.connector, s.name FROM ids i JOIN (SELECT 'crm' AS connector, external_id, name FROM crm UNION ALL SELECT 'erp', external_id, name FROM erp) s ON s.connector = i.connector AND s.external_id = i.external_id", "ids")
def contributing_shadows(s):
    return state_joins.contributing(s["ids"], _shadow(s)).select("canonical_id", "connector", "name")


@query("SELECT 'c' || k AS canonical_id, 'crm' AS connector, created FROM crm WHERE k % 5 <> 0 UNION ALL SELECT 'c' || k, 'erp', created FROM erp WHERE k % 5 <> 0", "crm", "erp")
def created_by_source(s):
    return state_joins.created_by_source(s["ids"], _shadow(s))


@query("SELECT 'n' || nation AS parent_id, external_id AS child_id, name FROM crm WHERE nation % 2 = 0 AND k % 2 = 0", "crm")
def children_of_parent(s):
    up = s["crm"].select(F.col("external_id").alias("child_id"), F.concat(F.lit("n"), "nation").alias("parent_id"), F.expr("IF(k % 2 = 0, 'people', 'others')").alias("array_path"))
    some = s["nation"].where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("parent_id"))
    return state_joins.children_of(some, up, s["crm"].select(F.col("external_id").alias("id"), "name"), "people").select("parent_id", "child_id", "name")


@query("SELECT l_orderkey AS batch_id, line_no, o_orderstatus AS status FROM lines JOIN orders ON o_orderkey = l_orderkey", "lines")
def journal_by_batch(s):
    log = s["lines"].select(F.col("l_orderkey").alias("batch_id"), "line_no")
    return state_joins.requests_of(s["orders"].select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderstatus").alias("status")), log)


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY o_custkey")
def sibling_lookup(s):
    return state_joins.first_of(s["orders"], "o_custkey", "o_orderpriority", F.struct("o_orderdate", "o_orderkey")).withColumnRenamed("o_orderpriority", "first_priority")


@query("SELECT 'c' || k AS split_of, 'c' || k || '/crm' AS canonical_id, external_id FROM crm WHERE k % 10 = 1", "crm")
def split_children_links(s):
    links = s["ids"]
    cut = links.withColumn("canonical_id", F.when((F.col("connector") == "crm") & F.col("canonical_id").endswith("1"), F.concat("canonical_id", F.lit("/crm"))).otherwise(F.col("canonical_id")))
    children = cut.where("canonical_id LIKE '%/crm'").select("canonical_id", F.substring_index("canonical_id", "/", 1).alias("split_of"))
    return state_joins.split_links(children, cut).select("split_of", "canonical_id", "external_id")


@query("SELECT connector, external_id FROM ids WHERE connector = 'crm' AND substr(external_id, 5)::bigint % 7 = 0", "ids")
def unlinked_leftovers(s):
    links = s["ids"].where("NOT (connector = 'crm' AND cast(substring(external_id, 5) AS bigint) % 7 = 0)")
    return state_joins.leftovers(s["ids"].where("connector <> 'hr'").select("connector", "external_id"), links)


@query("SELECT 'erp' || k AS node, 'c' || k AS canonical_id FROM erp WHERE k % 3 <> 0 AND k IN (SELECT k FROM crm) UNION ALL SELECT 'erp' || k, 'h' || k FROM erp WHERE k % 5 = 0", "erp", "crm")
def identity_probe(s):
    """Every canonical that new rows meet by any of their keys."""
    groups = (("email",), ("tax_id",))
    known = s["crm"].select(F.concat(F.lit("c"), "k").alias("node"), "email", F.lit(None).cast("string").alias("tax_id")).unionByName(s["hr"].select(F.concat(F.lit("h"), "k").alias("node"), F.lit(None).cast("string").alias("email"), "tax_id"))
    rows = s["erp"].select(F.concat(F.lit("erp"), "k").alias("node"), "email", "tax_id")
    return state_joins.probe(identity.keys(rows, groups), identity.keys(known, groups).withColumnRenamed("node", "canonical_id"), ["grp", "key"])


@query("SELECT 'c' || k AS entity, CASE WHEN n.k IS NULL THEN o.balance ELSE n.balance END AS val, CASE WHEN n.k IS NOT NULL THEN o.balance END AS prev FROM (SELECT k, balance FROM crm WHERE k % 4 <> 1) o FULL JOIN (SELECT k, balance FROM crm_t1) n USING (k)", "crm_t1")
def field_data_merge(s):
    fact = lambda df: df.select(F.concat(F.lit("c"), "k").alias("entity"), F.lit("balance").alias("field"), F.col("balance").alias("val"), F.lit(None).cast("double").alias("prev"), "ts", F.lit("crm").alias("src"))
    return state_joins.merged_facts(fact(s["crm"].where("k % 4 <> 1")), fact(s["crm_t1"]), ["entity", "field"]).select("entity", "val", "prev")


@query("SELECT 'c' || k AS entity, segment, CASE WHEN k % 4 = 0 THEN NULL ELSE name END AS name FROM crm", "crm")
def field_data_plain(s):
    return state_joins.plain_records(s["facts"].where("src = 'crm'"), "entity", ["segment", "name"])


@query("SELECT event_id, event_type = 'error' AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def delete_events(s):
    return readers.change_records(s["events"], ["user_id"], "event_type", ["error"], F.struct("ts", "event_id")).select("event_id", "deleted")


@query("SELECT 'n' || n_nationkey AS s, n_name AS name FROM nation WHERE n_regionkey = 2")
def triples_named_graph(s):
    row = lambda p, o: s["nation"].select(F.concat(F.lit("g"), "n_regionkey").alias("g"), F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit(p).alias("p"), o.alias("o"))
    return readers.triples_scan(row("a", F.lit("Nation")).unionByName(row("name", F.col("n_name"))), "Nation", ["name"], graph="g2")


@query("SELECT '<http://x.test/' || n_nationkey || '>' AS s, 'name' AS p, '\"a \\\"' || n_name || '\\\"\\nb\"' AS o FROM nation UNION ALL SELECT '<http://x.test/' || n_nationkey || '>', 'region', '<http://x.test/r+' || n_regionkey || '>' FROM nation UNION ALL SELECT '<http://x.test/' || n_nationkey || '>', 'n', n_regionkey::varchar FROM nation UNION ALL SELECT '<http://x.test/' || n_nationkey || '>', 'a', 'Nation' FROM nation UNION ALL SELECT '<http://x.test/' || n_nationkey || '>', 'page', '<http://y.test/' || n_nationkey || '>' FROM nation WHERE n_nationkey % 2 = 0")
def triples_terms(s):
    rows = s["nation"].select("n_nationkey", F.concat(F.lit('a "'), "n_name", F.lit('"\nb')).alias("name"), F.concat(F.lit("ref:r "), "n_regionkey").alias("region"), F.col("n_regionkey").alias("n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("http://y.test/"), "n_nationkey")).alias("page"))
    return writers.as_triples(rows, "n_nationkey", "Nation", {"name": "name", "region": "region", "n": "n", "page": "page"}, "http://x.test/")


@query("SELECT n_regionkey, max(n_nationkey) + 1 AS mark FROM nation WHERE n_regionkey = 1 GROUP BY n_regionkey UNION ALL SELECT -1, NULL UNION ALL SELECT -2, 1")
def watermark_next(s):
    """The next whole number; none if a mark is a time; 1 for an empty table."""
    one = writers.next_mark(s["nation"].where("n_regionkey = 1").withColumn("m", F.col("n_nationkey").cast("string")), "m").select(F.lit(1).alias("n_regionkey"), "mark")
    two = writers.next_mark(s["nation"].withColumn("m", F.when(F.col("n_nationkey") == 3, "2024-01-01").otherwise("5")), "m").select(F.lit(-1), "mark")
    return one.union(two).union(writers.next_mark(s["nation"].where("false").withColumn("m", F.col("n_name")), "m").select(F.lit(-2), "mark"))


@query("SELECT k, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 1 THEN name || '!' ELSE name END AS name, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'S' ELSE segment END AS segment FROM crm", "crm")
def sink_patch(s):
    """Only the fields that a row names are overwritten, by null too."""
    given = F.array_compact(F.array(F.when((F.col("k") % 3 == 1) | (F.col("k") % 5 == 0), "name"), F.when((F.col("k") % 3 == 1) & (F.col("k") % 2 == 0), "segment")))
    new = s["crm"].select("k", F.when(F.col("k") % 5 != 0, F.concat("name", F.lit("!"))).alias("name"), F.lit("S").alias("segment"), given.alias("given"))
    return writers.patched(s["crm"].select("k", "name", "segment"), new, "k")[0]


@query("SELECT n_nationkey AS k, NOT (n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT c_custkey FROM customer)) AS not_found FROM nation")
def sink_delete(s):
    return writers.removed(s["crm"], s["nation"].select(F.col("n_nationkey").alias("k")), "k")[1]


@query("SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'o' || o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'no data' END AS error FROM orders")
def sink_insert(s):
    rows = s["orders"].select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("o"), "o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"))
    done = writers.inserted(rows, "id", ["p"])
    return done.select("ord", F.when(F.length("id") < 32, F.col("id")).alias("id"), "error")


@query("SELECT user_id, event_id, CASE WHEN open THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (SELECT *, lag(open, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT *, count(*) OVER w >= 3 AND cast(count(*) FILTER (event_type = 'error') OVER w AS double) / count(*) OVER w >= 0.5 AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) WHERE open <> was")
def breaker_log(s):
    rows = s["events"].withColumn("failed", F.col("event_type") == "error")
    return writers.breaker_events(rows, "user_id", ["ts", "event_id"], "failed").select("user_id", "event_id", "state")


@query("SELECT external_id, CASE WHEN k % 6 = 1 THEN 'insert' WHEN k % 10 = 0 THEN 'update' ELSE 'skip' END AS action FROM crm_t1", "crm_t1")
def zero_key_guard(s):
    """Nothing resolved for a record that the target has is a skip; a new record goes out even without fields."""
    rows = s["crm_t1"].select("external_id", F.when(F.col("k") % 10 == 0, F.array(F.lit("balance"))).otherwise(F.array().cast("array<string>")).alias("resolved"), F.when(F.col("k") % 6 != 1, F.concat(F.lit("t-"), "k")).alias("target_id"))
    return delta.guarded(rows, "resolved", "target_id").select("external_id", "action")


@query("SELECT external_id, (k * 7) % 1000 > 500 OR k % 9 = 0 AS fresh FROM crm", "crm")
def echo_bypass(s):
    """Unchanged records are echoes, unless they are tried again."""
    again = s["crm"].where("k % 9 = 0").select("external_id")
    state = s["crm"].withColumn("name", F.expr("IF(ts > 500, concat(name, '?'), name)"))
    fresh = delta.not_echoes(s["crm"], state, "external_id", ["name", "segment"], again).withColumn("fresh", F.lit(True))
    return s["crm"].select("external_id").join(fresh.select("external_id", "fresh"), "external_id", "left").select("external_id", F.coalesce("fresh", F.lit(False)).alias("fresh"))
