"""Identity resolution, discovery and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import identity as I, state_joins
from recordloom.operators import stats
from recordloom.plans.registry import query

GROUPS = (("email",), ("tax_id",))
NODES = "nodes AS (SELECT external_id AS node, 'crm' AS connector, lower(trim(email)) AS email, NULL AS tax_id, name FROM crm UNION ALL SELECT external_id, 'erp', lower(trim(email)), tax_id, name FROM erp UNION ALL SELECT external_id, 'hr', NULL, tax_id, name FROM hr)"
#: The closure by joins: erp records bridge crm (by e-mail) and hr (by tax id), so a component's label is its least node.
CLOSURE = """edges AS (SELECT a.node AS x, b.node AS y FROM nodes a JOIN nodes b ON a.email = b.email OR a.tax_id = b.tax_id),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
comp AS (SELECT r.x AS node, n.connector, min(r.y) AS component FROM reach r JOIN nodes n ON n.node = r.x GROUP BY r.x, n.connector)"""


def _nodes(s):
    crm = s["crm"].select(F.col("external_id").alias("node"), F.lit("crm").alias("connector"), "email", F.lit(None).cast("string").alias("tax_id"), "name")
    erp = s["erp"].select(F.col("external_id").alias("node"), F.lit("erp").alias("connector"), "email", "tax_id", "name")
    hr = s["hr"].select(F.col("external_id").alias("node"), F.lit("hr").alias("connector"), F.lit(None).cast("string").alias("email"), "tax_id", "name")
    return crm.union(erp).union(hr)


def _comp(s):
    return I.components(_nodes(s), GROUPS)


def _with(tail: str, closure: bool = True) -> str:
    return f", {NODES}" + (f", {CLOSURE}" if closure else "") + f" {tail}"


@query(_with("SELECT e.grp, e.key, min(e.node) AS hub, count(*) AS n FROM (SELECT node, 0 AS grp, email AS key FROM nodes WHERE email <> '' UNION ALL SELECT node, 1, tax_id FROM nodes WHERE tax_id <> '') e GROUP BY 1, 2", closure=False), "crm", "erp", "hr")
def identity_match_groups(s):
    return I.keys(_nodes(s), GROUPS).groupBy("grp", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n"))


@query(_with("SELECT node, component FROM comp"), "crm", "erp", "hr")
def identity_components(s):
    return _comp(s).select("node", "component")


@query("SELECT external_id AS node, min(external_id) OVER (PARTITION BY nation, segment) AS component FROM crm", "crm")
def identity_compound(s):
    nodes = s["crm"].select(F.col("external_id").alias("node"), "nation", "segment")
    return I.components(nodes, (("nation", "segment"),))


@query("SELECT component, n FROM (SELECT min(external_id) AS component, count(*) AS n FROM crm GROUP BY nation, segment) WHERE n > 1", "crm")
def identity_ambiguous(s):
    nodes = s["crm"].select(F.col("external_id").alias("node"), F.lit("crm").alias("connector"), "nation", "segment")
    members = nodes.join(I.components(nodes, (("nation", "segment"),)), "node")
    return members.join(I.ambiguous(members), "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN k % 3 <> 0 THEN 'c' || k END AS canonical_id, external_id FROM crm WHERE k % 4 <> 0 UNION ALL SELECT NULL, 'none-' || n_nationkey FROM nation", "crm")
def identity_lookup(s):
    """Records of one system and some that it does not know."""
    rows = s["crm"].where("k % 4 <> 0").select("external_id").unionByName(s["nation"].select(F.concat(F.lit("none-"), "n_nationkey").alias("external_id")))
    return state_joins.canonical_of(rows, s["ids"], "crm").select("canonical_id", "external_id")


@query("SELECT e.external_id AS a, c.external_id AS b FROM erp e JOIN crm c ON e.k = c.k WHERE e.k % 4 <> 0", "crm", "erp")
def identity_no_link(s):
    edges = I.star_edges(I.keys(_nodes(s).where("connector <> 'hr'"), (("email",),)))
    barred = s["crm"].join(s["erp"].select("k", F.col("external_id").alias("b")), "k").where("k % 4 = 0").select(F.col("external_id").alias("a"), "b")
    return I.without_blocked(edges.where("a <> b"), barred).select("a", "b")


@query("SELECT connector, external_id, CASE WHEN canonical_id = 'c5' THEN 'c5/' || connector ELSE canonical_id END AS canonical_id FROM ids", "ids")
def identity_split_cluster(s):
    return I.split_cluster(s["ids"], "c5").select("connector", "external_id", "canonical_id")


@query("SELECT a.external_id AS a, b.external_id AS b FROM ids a JOIN ids b ON a.canonical_id = b.canonical_id WHERE a.canonical_id = 'c5' AND a.connector = 'hr' AND b.connector <> 'hr'", "ids")
def identity_split_one(s):
    return I.split_one(s["ids"], "c5", "hr")[1]


@query("SELECT CASE WHEN canonical_id = 'c6' THEN 'c5' ELSE canonical_id END AS canonical_id, connector, arg_min(external_id, CASE WHEN canonical_id = 'c6' THEN 1 ELSE 0 END) AS external_id FROM ids GROUP BY 1, 2", "ids")
def identity_merge(s):
    return I.merge(s["ids"], "c5", "c6")


STATUS = "stat AS (SELECT node, connector, component, CASE WHEN count(*) OVER (PARTITION BY component) > 1 AND component NOT IN (SELECT component FROM comp GROUP BY component, connector HAVING count(*) > 1) THEN 'matched' ELSE 'unique' END AS status FROM comp)"


def _found(s):
    return I.discover(_nodes(s), _comp(s))


@query(_with("SELECT node, connector, component FROM stat WHERE status = 'matched'").replace(" SELECT node, connector, component FROM stat", f", {STATUS} SELECT node, connector, component FROM stat"), "crm", "erp", "hr")
def discover_matched(s):
    return _found(s).where("status = 'matched'").select("node", "connector", "component")


@query(_with("SELECT node, connector FROM stat WHERE status = 'unique'").replace(" SELECT node, connector FROM stat", f", {STATUS} SELECT node, connector FROM stat"), "crm", "erp", "hr")
def discover_unique(s):
    return _found(s).where("status = 'unique'").select("node", "connector")


@query(_with("SELECT connector, count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'unique') AS only_here FROM stat GROUP BY connector").replace(" SELECT connector, count(*) AS total", f", {STATUS} SELECT connector, count(*) AS total"), "crm", "erp", "hr")
def discover_summary(s):
    return I.summary(_found(s))


@query("SELECT m.connector AS target, i.canonical_id FROM (SELECT DISTINCT canonical_id FROM ids) i CROSS JOIN (VALUES ('crm'), ('erp'), ('hr')) m(connector) LEFT JOIN ids x ON x.canonical_id = i.canonical_id AND x.connector = m.connector WHERE x.connector IS NULL", "ids")
def onboard_delta(s):
    """Inserts that bring every entity to every system: an explode over three members and an anti-join."""
    want = s["ids"].select("canonical_id").distinct().withColumn("target", F.explode(F.array(F.lit("crm"), F.lit("erp"), F.lit("hr"))))
    have = s["ids"].select("canonical_id", F.col("connector").alias("target"))
    return want.join(have, ["canonical_id", "target"], "left_anti").select("target", "canonical_id")


@query("SELECT CASE WHEN c.k IS NULL THEN 'new' WHEN h.k IS NULL THEN 'missing' ELSE 'linked' END AS state, count(*) AS n FROM (SELECT DISTINCT k FROM (SELECT k FROM crm UNION ALL SELECT k FROM erp)) c FULL JOIN hr h ON c.k = h.k GROUP BY 1", "crm", "erp", "hr")
def add_source_report(s):
    known = s["ids"].where("connector <> 'hr'").select("canonical_id").distinct().withColumn("a", F.lit(1))
    joiner = s["ids"].where("connector = 'hr'").select("canonical_id").withColumn("b", F.lit(1))
    return known.join(joiner, "canonical_id", "full").select(F.expr("CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'missing' ELSE 'linked' END").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT canonical_id AS component, min(external_id) FILTER (connector = 'crm') AS crm, min(external_id) FILTER (connector = 'erp') AS erp, min(external_id) FILTER (connector = 'hr') AS hr FROM ids GROUP BY canonical_id", "ids")
def cluster_pivot(s):
    return I.pivot(s["ids"].select(F.col("canonical_id").alias("component"), "connector", F.col("external_id").alias("node")), ["crm", "erp", "hr"])


@query("SELECT cast(sum(n) AS bigint) AS n_links, count(*) FILTER (n > 1) AS n_spanning, (SELECT count(*) FROM crm) AS n_known, 'ready' AS status FROM (SELECT canonical_id, count(DISTINCT connector) AS n FROM ids GROUP BY canonical_id)", "ids")
def channel_status(s):
    return stats.channel_status(s["ids"], s["crm"])


@query("SELECT external_id FROM crm WHERE 'c' || k IN (SELECT canonical_id FROM ids GROUP BY canonical_id HAVING count(DISTINCT connector) > 1)", "ids")
def fanout_guard(s):
    rows = s["crm"].withColumn("canonical_id", F.concat(F.lit("c"), "k"))
    return rows.join(I.spanning(s["ids"]), "canonical_id", "left_semi").select("external_id")


@query("SELECT substr(sha256(connector || chr(1) || external_id), 1, 32) AS canonical_id, external_id FROM ids", "ids")
def provisional_ids(s):
    return s["ids"].select(I.provisional_id(F.col("connector"), F.col("external_id")).alias("canonical_id"), "external_id")


GOLDEN = "SELECT 'c' || k AS component, lower(trim(email)) AS email, segment, balance, ts, 'crm' AS src FROM crm UNION ALL SELECT 'c' || k, lower(trim(email)), segment, balance, ts, 'erp' FROM erp"


@query(f"SELECT email, arg_min(segment, (-ts, src)) AS segment, arg_min(balance, (-ts, src)) AS balance, count(*) AS n_sources FROM ({GOLDEN}) GROUP BY email", "crm", "erp")
def golden_records(s):
    """The flagship: which records of two systems are one customer, and its newest values."""
    rows = s["crm"].select("external_id", "email", "segment", "balance", "ts", F.lit("crm").alias("src")).union(s["erp"].select("external_id", "email", "segment", "balance", "ts", F.lit("erp").alias("src")))
    comp = I.single_key_components(rows, "email", "external_id")
    full = rows.join(comp, rows["external_id"] == comp["node"])
    best = F.min_by(F.struct("segment", "balance"), F.struct(-F.col("ts"), F.col("src")))
    return full.groupBy("component").agg(F.min(F.lower(F.trim("email"))).alias("email"), best.alias("w"), F.count("*").alias("n_sources")).select("email", "w.segment", "w.balance", "n_sources")
