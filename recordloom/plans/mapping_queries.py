"""Scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import mapping as M
from recordloom.operators.mapping import Field
from recordloom.plans.registry import query
from recordloom.sources import readers, writers


@query("SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00' OR ts IS NULL")
def scan_incremental(s):
    return readers.since(s["events"], "ts", "2024-01-02 00:00:00").select("event_id", "user_id", "event_type")


@query("SELECT external_id, name FROM crm WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "crm")
def scan_lookup(s):
    ids = s["nation"].where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    return readers.lookup(s["crm"], ids, "nation").select("external_id", "name")


@query("SELECT max(epoch_us(ts) // 1000) AS watermark, event_type FROM events GROUP BY event_type")
def watermark_advance(s):
    return readers.next_watermark(s["events"].withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "ms", ["event_type"]).select("watermark", "event_type")


@query("SELECT external_id, name AS full_name, email AS mail FROM crm", "crm")
def map_rename_whitelist(s):
    return M.inbound(s["crm"], [Field("full_name", "name"), Field("mail", "email")], keep=["external_id"])


@query("SELECT external_id, name, email FROM crm", "crm")
def map_outbound_roundtrip(s):
    fields = [Field("full_name", "name"), Field("mail", "email")]
    return M.outbound(M.inbound(s["crm"], fields, keep=["external_id"]), fields, keep=["external_id"])


@query("SELECT external_id, name AS a, segment AS b FROM crm", "crm")
def map_direction(s):
    return M.inbound(s["crm"], [Field("a", "name"), Field("b", "segment", direction="forward_only"), Field("c", "email", direction="reverse_only")], keep=["external_id"])


@query("SELECT external_id, upper(name) || ':' || segment AS label, round(balance * 2, 2) AS twice FROM crm", "crm")
def map_expression(s):
    return M.inbound(s["crm"], [Field("label", expression="concat(upper(name), ':', segment)"), Field("twice", expression="round(balance * 2, 2)")], keep=["external_id"])


@query("SELECT external_id, split_part(name, '#', 1) AS first_part, split_part(name, '#', 2) AS second_part FROM crm", "crm")
def map_reverse_decompose(s):
    fields = [Field("name", reverse_expression="named_struct('first_part', split_part(name, '#', 1), 'second_part', split_part(name, '#', 2))")]
    return M.outbound(s["crm"].select("external_id", "name"), fields, keep=["external_id"])


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def map_source_path_json(s):
    return M.inbound(s["events"], [Field("k", source_path="props.k")], keep=["event_id"]).select("event_id", F.col("k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, cast(sum(l_quantity) AS double) AS q1 FROM (SELECT l_orderkey AS o_orderkey, l_quantity, line_no FROM lines) WHERE line_no = 1 GROUP BY o_orderkey", "lines")
def map_source_path_index(s):
    rows = M.inbound(s.nested_orders(), [Field("q1", source_path="lines[0].qty", direction="forward_only")], keep=["order_id"])
    return rows.select(F.col("order_id").alias("o_orderkey"), "q1")


@query("SELECT external_id, name AS who, segment AS seg, email AS mail FROM crm", "crm")
def map_nested_assign(s):
    fields = [Field("name", source_path="person.name"), Field("email", source_path="person.contact.mail"), Field("segment")]
    out = M.outbound(s["crm"], fields, keep=["external_id"])
    return out.select("external_id", F.col("person.name").alias("who"), F.col("segment").alias("seg"), F.col("person.contact.mail").alias("mail"))


@query("SELECT 'c' || k AS id, coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE name END, 'unknown') AS name, coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE name END, 'unknown') || '!' AS shout FROM crm", "crm")
def map_default(s):
    src = s["crm"].select(F.concat(F.lit("c"), "k").alias("id"), F.expr("CASE WHEN k % 4 = 0 THEN NULL ELSE name END").alias("name"), F.lit(None).cast("string").alias("shout"))
    return M.inbound(src, [Field("name", default="unknown"), Field("shout", default_expression="concat(name, '!')")], keep=["id"])


MODES = {"click": "web", "view": "web", "purchase": "shop"}


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' ELSE event_type END AS kind, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' END AS strict_kind FROM events")
def map_value_map(s):
    return M.inbound(s["events"], [Field("kind", "event_type", value_map=MODES), Field("strict_kind", "event_type", value_map=MODES, fallback="null")], keep=["event_id"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS event_type FROM events")
def map_value_map_reverse(s):
    fields = [Field("kind", "event_type", value_map=MODES)]
    return M.outbound(M.inbound(s["events"], fields, keep=["event_id"]), fields, keep=["event_id"])


@query("SELECT l_orderkey AS order_id, count(*) AS n, cast(sum(l_partkey) AS bigint) AS parts, round(sum(l_quantity), 2) AS pieces FROM lines GROUP BY l_orderkey", "lines")
def map_element_fields(s):
    rows = M.inbound(s.nested_orders(), [Field("items", "lines", element_fields=(Field("part", "sku"), Field("pieces", "qty")))], keep=["order_id"])
    total = lambda c, t: F.aggregate(f"items.{c}", F.lit(0).cast(t), lambda a, x: a + x)
    return rows.select("order_id", F.size("items").cast("bigint").alias("n"), total("part", "bigint").alias("parts"), F.round(total("pieces", "double"), 2).alias("pieces"))


@query("SELECT external_id, external_id AS code, name FROM crm", "crm")
def map_id_field(s):
    return M.inbound(M.with_id_field(s["crm"], "code", "external_id"), [Field("code"), Field("name")], keep=["external_id"])


@query("SELECT external_id, name FROM crm", "crm")
def map_strip_metadata(s):
    return M.without_metadata(s["crm"].select("external_id", "name", F.lit(1).alias("_version")))


@query("SELECT n.external_id, CASE WHEN n.balance = o.balance THEN greatest(o.ts, 500) ELSE n.ts END AS field_ts FROM crm_t1 n JOIN crm o ON n.external_id = o.external_id", "crm_t1")
def map_field_timestamps(s):
    old = s["crm"].select("external_id", F.col("balance").alias("was"), F.col("ts").alias("shadow_ts"))
    both = s["crm_t1"].join(old, "external_id")
    return both.select("external_id", M.field_timestamp(None, F.col("balance") == F.col("was"), F.col("shadow_ts"), F.col("ts"), F.lit(500).cast("bigint")).alias("field_ts"))


@query("SELECT external_id AS id, name AS val FROM crm UNION ALL SELECT external_id || '#address', 'n' || nation FROM crm", "crm")
def embedded_split(s):
    parent, child = M.split_embedded(s["crm"].withColumnRenamed("external_id", "id"), "id", "address", [Field("val", "name")], [Field("val", expression="concat('n', nation)")])
    return parent.unionByName(child)


@query("SELECT external_id, balance FROM crm WHERE balance > 0 AND segment = 'BUILDING'", "crm")
def filter_record(s):
    return M.passing(s["crm"], "balance > 0 AND segment = 'BUILDING'").select("external_id", "balance")


@query("SELECT external_id, name AS label FROM crm WHERE name LIKE '%1'", "crm")
def filter_reverse(s):
    return M.passing(M.outbound(s["crm"], [Field("name", "label")], keep=["external_id"]), "label LIKE '%1'")


@query("SELECT l_orderkey AS order_id, count(*) AS n FROM lines WHERE l_quantity >= 25 GROUP BY l_orderkey", "lines")
def filter_element(s):
    from recordloom.operators import arrays

    rows = arrays.expand(s.nested_orders(), "order_id", "lines", key="line_no", where=lambda e, i: e["qty"] >= 25)
    return rows.groupBy(F.col("parent_id").alias("order_id")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce((event_type = 'error') <> false, false) AS by_flag, value IS NOT NULL AS by_time, NOT coalesce(event_type <> 'view', false) AS by_active, coalesce(value < 10, false) AS by_expr FROM events")
def soft_delete_four(s):
    rows = s["events"].withColumns({"flag": F.col("event_type") == "error", "active": F.col("event_type") != "view"})
    return rows.select("event_id", M.deleted("deleted_flag", "flag").alias("by_flag"), M.deleted("timestamp", "value").alias("by_time"), M.deleted("active_flag", "active").alias("by_active"), M.deleted("expression", "value < 10").alias("by_expr"))


@query("SELECT entity AS id, val AS label FROM facts WHERE field = 'name' AND src = 'crm' AND val IS NOT NULL", "facts")
def reverse_required(s):
    fields = [Field("val", "label", reverse_required=True)]
    rows = s["facts"].where("field = 'name' AND src = 'crm'").select(F.col("entity").alias("id"), "val")
    return M.required_present(M.outbound(rows, fields, keep=["id"]), fields)


@query("SELECT event_id, 'sales' AS route FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'alerts' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'all' FROM events")
def route_discriminator(s):
    return M.routed(s["events"], {"sales": "event_type = 'purchase'", "alerts": "event_type = 'error'", "all": None}).select("event_id", "route")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def webhook_fold(s):
    return readers.folded_events(s["events"], ["user_id"], "event_type", "value", F.col("event_id")).select("user_id", "event_type", "value")


TRIPLES = "SELECT external_id AS s, 'a' AS p, 'person' AS o FROM crm UNION ALL SELECT external_id, 'name', name FROM crm UNION ALL SELECT external_id, 'nation', 'n' || nation FROM crm WHERE k % 2 = 0 UNION ALL SELECT external_id, 'nation', 'm' || nation FROM crm WHERE k % 6 = 4"


def _triples(s):
    return s.spark.sql(TRIPLES.replace("FROM crm", "FROM {crm}"), crm=s["crm"])


@query(f"SELECT DISTINCT t.s, n.o AS name, x.o AS nation FROM ({TRIPLES}) t LEFT JOIN ({TRIPLES}) n ON n.s = t.s AND n.p = 'name' LEFT JOIN ({TRIPLES}) x ON x.s = t.s AND x.p = 'nation' WHERE t.p = 'a' AND t.o = 'person'", "crm")
def triples_optional_scan(s):
    return readers.triples_scan(_triples(s), "person", ["name", "nation"]).select("s", "name", "nation")


@query(f"SELECT s, p, o FROM ({TRIPLES}) t WHERE NOT (p = 'nation' AND s IN (SELECT external_id FROM crm WHERE k % 4 = 0)) UNION ALL SELECT external_id, 'nation', 'moved' FROM crm WHERE k % 4 = 0", "crm")
def triples_update(s):
    patch = s["crm"].where("k % 4 = 0").select(F.col("external_id").alias("s"), F.lit("nation").alias("p"), F.lit("moved").alias("o"))
    return writers.update_triples(_triples(s), patch).select("s", "p", "o")


@query("SELECT external_id AS key, CASE WHEN k % 7 = 0 THEN NULL ELSE '{\"name\":\"' || name || '\",\"nation\":' || nation || '}' END AS value, CASE WHEN k % 7 = 0 THEN 'delete' ELSE 'update' END AS op FROM crm", "crm")
def kafka_payload(s):
    delta = s["crm"].withColumn("action", F.expr("CASE WHEN k % 7 = 0 THEN 'delete' ELSE 'update' END"))
    return writers.kafka_messages(delta, "external_id", ["name", "nation"])
