"""Change detection, deletes, arrays, associations and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.operators import arrays, assoc, delta, state_joins, stats
from recordloom.plans.registry import query
from recordloom.sources import writers

FIELDS = ["name", "segment", "balance"]


@query("SELECT n.external_id FROM crm_t1 n JOIN crm o ON n.external_id = o.external_id WHERE n.balance = o.balance", "crm_t1")
def echo_skip(s):
    return delta.unchanged(s["crm_t1"], s["crm"], "external_id", FIELDS)


@query("SELECT n.external_id, CASE WHEN o.external_id IS NULL THEN 'insert' WHEN n.balance = o.balance THEN 'skip' ELSE 'update' END AS action FROM crm_t1 n LEFT JOIN (SELECT * FROM crm WHERE k % 6 <> 1) o ON n.external_id = o.external_id", "crm_t1")
def delta_classify(s):
    return delta.classify(s["crm_t1"], s["crm"].where("k % 6 <> 1"), "external_id", FIELDS)


@query("SELECT c.k, e.balance IS NOT DISTINCT FROM round(c.balance, 0) AND lower(c.segment) = e.segment AS noop FROM crm c JOIN erp e ON c.k = e.k", "crm", "erp")
def target_noop(s):
    sent = s["crm"].select("k", F.round("balance", 0).alias("balance"), F.lower("segment").alias("segment"))
    return delta.classify(sent.join(s["erp"].select("k"), "k", "left_semi"), s["erp"], "k", ["balance", "segment"]).select("k", (F.col("action") == "skip").alias("noop"))


@query("SELECT n.external_id, n.balance = o.balance AS noop FROM crm_t1 n JOIN crm o ON n.external_id = o.external_id WHERE o.k % 2 = 0", "crm_t1")
def written_noop(s):
    rows = delta.classify(s["crm_t1"], s["crm"].where("k % 2 = 0"), "external_id", FIELDS).where("action <> 'insert'")
    return rows.select("external_id", (F.col("action") == "skip").alias("noop"))


@query("SELECT external_id, k % 10 = 0 AS changed, balance + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS balance FROM crm WHERE k % 17 <> 0", "crm")
def join_shadow(s):
    rows = state_joins.with_shadow(s["crm_t1"], s["crm"], "external_id", ["balance"])
    return rows.select("external_id", (F.col("balance") != F.col("was_balance")).alias("changed"), "balance")


@query("SELECT external_id FROM crm WHERE k % 17 = 0", "crm")
def snapshot_absence(s):
    return delta.snapshot_deletes(s["crm"], s["crm_t1"], "external_id")


@query("SELECT nation % 3 AS part, count(*) AS n_known, count(*) FILTER (NOT kept) AS n_missing, count(*) FILTER (NOT kept) / count(*) AS ratio, count(*) FILTER (NOT kept) / count(*) > 0.5 AS tripped FROM (SELECT *, CASE nation % 3 WHEN 0 THEN k % 17 <> 0 WHEN 1 THEN k % 5 = 0 ELSE false END AS kept FROM crm) GROUP BY nation % 3", "crm")
def snapshot_guard(s):
    """A few rows missing, most missing, and all missing."""
    kept = ("k % 17 <> 0", "k % 5 = 0", "false")
    rows = [delta.absence_guard(s["crm"].where(f"nation % 3 = {i}"), s["crm"].where(f"nation % 3 = {i} AND {w}"), "external_id").withColumn("part", F.lit(i)) for i, w in enumerate(kept)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT i.connector, i.external_id FROM ids i WHERE i.connector <> 'crm' AND i.canonical_id IN (SELECT 'c' || k FROM crm WHERE k % 17 = 0)", "ids")
def delete_fanout(s):
    gone = delta.absent(s["crm"], s["crm_t1"], "external_id")
    return delta.fan_out_deletes(gone, s["ids"], "crm")


@query("SELECT n.external_id, CASE WHEN n.k % 8 = 0 THEN 'resurrect' WHEN n.balance = o.balance THEN 'skip' ELSE 'update' END AS action FROM crm_t1 n JOIN crm o ON n.external_id = o.external_id", "crm_t1")
def resurrection(s):
    state = s["crm"].withColumn("deleted_at", F.expr("CASE WHEN k % 8 = 0 THEN ts END"))
    return delta.classify(s["crm_t1"], state, "external_id", FIELDS, tombstone="deleted_at")


@query("SELECT l_orderkey AS order_id, count(*) FILTER (line_no = 2 AND l_orderkey % 3 = 0) = 0 AS same, count(*) < 2 AND count(*) FILTER (line_no = 2 AND l_orderkey % 3 = 0) = 0 AS same_order FROM lines GROUP BY l_orderkey", "lines")
def unordered_array_diff(s):
    """Arrays turned around, and every third changed in its second element."""
    other = F.transform("lines", lambda e: F.when((F.col("order_id") % 3 == 0) & (e["line_no"] == 2), e.withField("sku", e["sku"] + 1)).otherwise(e))
    rows = s.nested_orders().withColumn("turned", F.reverse(other))
    return rows.select("order_id", (delta.unordered(F.col("lines")) == delta.unordered(F.col("turned"))).alias("same"), (F.col("lines") == F.col("turned")).alias("same_order"))


@query("SELECT n.external_id, 'balance' AS field, o.k AS k FROM crm_t1 n JOIN crm o ON n.external_id = o.external_id WHERE n.balance <> o.balance", "crm_t1")
def audit_changed_keys(s):
    rows = delta.changed_fields(s["crm_t1"], s["crm"], "external_id", FIELDS)
    return rows.select("external_id", "field", F.regexp_extract("external_id", r"\d+", 0).cast("bigint").alias("k"))


@query("SELECT external_id, CASE WHEN k % 10 = 0 AND k % 17 <> 0 THEN balance + 1 ELSE balance END AS balance, created FROM crm", "crm")
def state_upsert(s):
    state = s["crm"].select("external_id", "balance", "created")
    return delta.upsert(state, s["crm_t1"].select("external_id", "balance", (F.col("created") + 1).alias("created")), ["external_id"], keep_first=["created"])


@query("SELECT external_id, 'update' AS action, name AS payload FROM crm WHERE k % 10 = 0 AND k % 17 <> 0", "crm")
def rollback_batch(s):
    log = s["crm"].where("k % 17 <> 0").select("external_id", F.lit("update").alias("action"), F.expr("CASE WHEN k % 10 = 0 THEN 'b1' ELSE 'b0' END").alias("batch_id"), F.col("name").alias("before"))
    return delta.rollback(log, "b1", "external_id")


@query("SELECT l_orderkey || '#lines[' || line_no || ']' AS id, l_orderkey AS parent_id, line_no AS elem_key, l_partkey AS sku FROM lines", "lines")
def array_expand(s):
    rows = arrays.expand(s.nested_orders(), "order_id", "lines", key="line_no")
    return rows.select("id", "parent_id", F.col("elem_key").cast("bigint").alias("elem_key"), F.col("element.sku").alias("sku"))


@query("SELECT DISTINCT o_custkey || '#tags[' || o_orderpriority || ']' AS id, o_orderpriority AS elem_key FROM orders")
def array_expand_scalar(s):
    nested = s["orders"].groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("tags"))
    return arrays.expand(nested, "o_custkey", "tags", scalar=True).select("id", "elem_key")


def _two_levels(s):
    rows = s.nested_orders().withColumnRenamed("lines", "items").join(s["orders"].select(F.col("o_orderkey").alias("order_id"), "o_custkey"), "order_id")
    return rows.groupBy(F.col("o_custkey").alias("cust_id")).agg(F.array_sort(F.collect_list(F.struct("order_id", "items"))).alias("orders"))


@query("SELECT o_custkey || '#orders[' || l_orderkey || ']#items[' || line_no || ']' AS id, cast(l_orderkey AS varchar) AS key_0, cast(line_no AS varchar) AS key_1, l_partkey AS sku FROM lines JOIN orders ON l_orderkey = o_orderkey", "lines")
def array_expand_multilevel(s):
    return arrays.expand_chain(_two_levels(s), "cust_id", [("orders", "order_id"), ("items", "line_no")]).select("id", "key_0", "key_1", F.col("element.sku").alias("sku"))


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::int & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"SELECT {UUID} AS child_id, external_id FROM (SELECT external_id, sha256('recordloom-child:' || canonical_id || ':lines[' || external_id || ']') AS h FROM ids)", "ids")
def array_child_uuid(s):
    return s["ids"].select(arrays.child_uuid(F.col("canonical_id"), "lines", F.col("external_id")).alias("child_id"), "external_id")


@query("SELECT l_orderkey || '#lines[' || line_no || ']' AS child_id, l_orderkey AS parent_id, 'lines' AS array_path, cast(line_no AS varchar) AS element_key FROM lines", "lines")
def array_parent_map(s):
    return arrays.parent_map(arrays.expand(s.nested_orders(), "order_id", "lines", key="line_no"), "lines")


@query("SELECT l_orderkey || '#lines[' || line_no || ']' AS id FROM lines WHERE l_quantity > 45", "lines")
def array_element_absence(s):
    before = arrays.expand(s.nested_orders(), "order_id", "lines", key="line_no")
    now = arrays.expand(s.nested_orders(), "order_id", "lines", key="line_no", where=lambda e, i: e["qty"] <= 45)
    return delta.absent(before, now, "id")


@query("SELECT l_orderkey AS order_id, cast(sum(CASE WHEN line_no = 1 THEN 100 ELSE l_quantity END) AS double) AS total, count(*) AS n FROM lines GROUP BY l_orderkey", "lines")
def array_collapse_patch(s):
    patches = s["lines"].where("line_no = 1").select(F.col("l_orderkey").alias("order_id"), "line_no", F.lit(100.0).alias("qty"))
    patches = arrays.gathered(patches.select("order_id", "line_no", F.lit("qty").alias("field"), F.col("qty").cast("string").alias("val")), ["order_id"], ["line_no"], F.lit(0))
    rows = arrays.patch(s.nested_orders(), "order_id", [("lines", "line_no")], patches)
    return rows.select("order_id", F.aggregate("lines.qty", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("lines").cast("bigint").alias("n"))


@query("SELECT l_orderkey, line_no, CASE WHEN l_quantity > 25 THEN 'a' ELSE 'b' END AS src FROM lines WHERE l_quantity > 25 OR l_discount > 0.05", "lines")
def array_element_set(s):
    one = s["lines"].where("l_quantity > 25").select("l_orderkey", "line_no", F.lit("qty").alias("field"), F.col("l_quantity").alias("val"), F.lit("a").alias("src"), F.lit(1).alias("pri"))
    two = s["lines"].where("l_discount > 0.05").select("l_orderkey", "line_no", F.lit("qty").alias("field"), F.col("l_quantity").alias("val"), F.lit("b").alias("src"), F.lit(2).alias("pri"))
    return arrays.element_set(one.unionByName(two), "l_orderkey", "line_no", F.struct("pri", "src")).select("l_orderkey", "line_no", "src")


@query("SELECT l_orderkey, string_agg(l_partkey::varchar, ',' ORDER BY line_no) AS parts FROM lines GROUP BY l_orderkey", "lines")
def array_rebuild(s):
    rows = arrays.rebuild(s["lines"], "l_orderkey", [F.col("line_no")], ["l_partkey"])
    return rows.select("l_orderkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT l_orderkey AS order_id, string_agg(line_no::varchar, ',' ORDER BY l_quantity DESC, line_no) AS lines FROM lines GROUP BY l_orderkey", "lines")
def order_by_multi(s):
    return s.nested_orders().select("order_id", F.array_join(F.transform(arrays.ordered(F.col("lines"), [("qty", False), ("line_no", True)]), lambda x: x["line_no"].cast("string")), ",").alias("lines"))


@query("SELECT l_orderkey AS order_id, string_agg(line_no::varchar, ',' ORDER BY CASE WHEN line_no % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN line_no % 3 = 0 THEN line_no ELSE -line_no END) AS lines FROM lines GROUP BY l_orderkey", "lines")
def order_crdt_ordinal(s):
    marked = F.transform("lines", lambda e: e.withField("_ordinal", F.when(e["line_no"] % 3 != 0, -e["line_no"])))
    return s.nested_orders().select("order_id", F.array_join(F.transform(arrays.by_ordinal(marked), lambda x: x["line_no"].cast("string")), ",").alias("lines"))


@query("SELECT l_orderkey AS order_id, string_agg(line_no::varchar, ',' ORDER BY line_no) AS lines FROM lines GROUP BY l_orderkey", "lines")
def order_linked_list(s):
    near = lambda i: F.get("lines", i)["line_no"].cast("string")
    w = F.transform("lines", lambda e, i: F.struct(e["line_no"].cast("string").alias("key"), F.when(i > 0, near(i - 1)).alias("prev"), near(i + 1).alias("next")))
    mixed = s.nested_orders().select("order_id", F.reverse(w).alias("items"))
    return arrays.linked_list(mixed, "order_id", "items").select(F.col("id").alias("order_id"), F.array_join("items", ",").alias("lines"))


def _edges(s):
    return assoc.extract(s["orders"], "o_orderkey", [("customer", "customers", F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("crm-"), "o_custkey")))])


@query("SELECT o_orderkey AS record_id, 'customer' AS predicate, 'customers' AS target_entity, 'crm-' || o_custkey AS target_id FROM orders WHERE o_custkey % 3 <> 0")
def assoc_extract(s):
    return _edges(s)


@query("SELECT o_orderkey AS record_id, 'buyer' AS predicate, e.external_id AS target_id FROM orders LEFT JOIN ids c ON c.external_id = 'crm-' || o_custkey LEFT JOIN ids e ON e.canonical_id = c.canonical_id AND e.connector = 'erp' WHERE o_custkey % 3 <> 0", "ids")
def assoc_remap(s):
    return assoc.remap(_edges(s), s["ids"], "crm", "erp", {"customer": "buyer"}).select("record_id", "predicate", "target_id")


@query("SELECT o_orderkey AS record_id, e.external_id AS target_id FROM orders JOIN ids c ON c.external_id = 'crm-' || o_custkey JOIN ids e ON e.canonical_id = c.canonical_id AND e.connector = 'erp' WHERE o_custkey % 3 <> 0", "ids")
def assoc_remap_partial(s):
    return assoc.remap_partial(_edges(s), s["ids"], "crm", "erp").select("record_id", "target_id")


@query("SELECT o_orderkey AS record_id, 'customer' AS predicate, 'crm-' || o_custkey AS target_id FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def assoc_merge_outbound(s):
    have = assoc.extract(s["orders"], "o_orderkey", [("customer", "customers", F.lit("old")), ("priority", "priorities", F.col("o_orderpriority"))])
    return assoc.merge_outbound(_edges(s), have, ["customer"]).select("record_id", "predicate", "target_id")


@query("SELECT o_orderkey AS record_id FROM orders WHERE o_custkey % 3 <> 0 AND NOT ('crm-' || o_custkey IN (SELECT c.external_id FROM ids c JOIN ids e ON e.canonical_id = c.canonical_id AND e.connector = 'erp' WHERE c.connector = 'crm'))", "ids")
def assoc_deferred(s):
    return assoc.remap_strict(_edges(s), s["ids"], "crm", "erp")[1]


@query("SELECT o_orderkey, e.external_id AS buyer FROM orders LEFT JOIN ids c ON o_custkey % 3 <> 0 AND c.external_id = 'crm-' || o_custkey LEFT JOIN ids e ON e.canonical_id = c.canonical_id AND e.connector = 'erp'", "ids")
def assoc_inject(s):
    edges = assoc.remap(_edges(s), s["ids"], "crm", "erp", {"customer": "buyer"})
    return assoc.inject(s["orders"], edges, "o_orderkey", ["buyer"]).select("o_orderkey", "buyer")


@query("SELECT event_id, cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS double) / count(*) OVER w AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def breaker_error_rate(s):
    rows = s["events"].withColumn("failed", F.col("event_type") == "error")
    return stats.error_rate(rows, "user_id", ["ts", "event_id"], "failed").select("event_id", "rate")


@query("SELECT nation, count(*) FILTER (k % 10 = 0) AS n_update, count(*) FILTER (k % 10 <> 0) AS n_skip, count(*) AS n_all FROM crm WHERE k % 17 <> 0 GROUP BY nation", "crm")
def run_summary(s):
    acts = delta.classify(s["crm_t1"], s["crm"], "external_id", FIELDS).join(s["crm"].select("external_id", "nation"), "external_id")
    return stats.action_counts(acts, "nation").select("nation", "n_update", "n_skip", "n_all")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_event(s):
    return stats.latest(s["events"], "user_id", ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events")
def previous_value(s):
    return s["events"].select("event_id", F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("prev"))


@query("SELECT external_id, round(balance, 2) AS was, round(balance + 1, 2) AS now, CASE WHEN k % 20 = 0 THEN 'null' ELSE '-' END AS name_after, CASE WHEN k % 20 = 0 THEN 2 ELSE 1 END AS n FROM crm WHERE k % 10 = 0 AND k % 17 <> 0", "crm")
def audit_log(s):
    new = s["crm_t1"].withColumn("name", F.expr("CASE WHEN k % 20 = 0 THEN NULL ELSE name END"))
    rows = writers.audit(new, s["crm"], "external_id", FIELDS)
    at = lambda c: F.round(F.get_json_object(c, "$.balance").cast("double"), 2)
    return rows.select("external_id", at("before").alias("was"), at("after").alias("now"), F.when(F.contains("after", F.lit('"name":null')), "null").otherwise("-").alias("name_after"), F.size(F.json_object_keys("after")).alias("n"))
