"""The engine end to end, specs, the streaming driver, and operators that queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.engine import Engine
from recordloom.operators import arrays, assoc, delta, identity, mapping, resolve, stats
from recordloom.operators.components import connected_components
from recordloom.operators.mapping import Field
from recordloom.sources import readers, writers
from recordloom.spec import SpecError, load_channels, parse_channels
from recordloom.streaming.driver import Breaker, run

SPEC = {
    "channels": [{"id": "contacts", "identity": ["email"], "propagate_deletes": True}],
    "mappings": [
        {"channel": "contacts", "connector": "crm", "entity": "people", "fields": [{"target": "email", "source": "mail"}, {"target": "name"}], "soft_delete": {"type": "deleted_flag", "field": "gone_flag"}},
        {"channel": "contacts", "connector": "erp", "entity": "staff", "fields": ["email", {"target": "name", "source": "full_name"}], "full_snapshot": True},
    ],
}


def systems(spark, crm, erp):
    tables = {"crm": spark.createDataFrame(crm, "id string, mail string, name string, gone_flag boolean"), "erp": spark.createDataFrame(erp, "id string, email string, full_name string")}
    return lambda connector, entity: tables[connector]


CRM = [("1", "Ann@x", "Ann", False), ("2", "bob@x", "Bob", False), ("3", "", "Nobody", False)]
ERP = [("a", "ann@X ", "Ann A", ), ("b", "cid@x", "Cid")]


def test_onboard_then_nothing_then_changes(spark, tmp_path):
    e = Engine(spark, parse_channels([SPEC]), str(tmp_path / "s"), systems(spark, CRM, ERP), now=1)
    found = {(r["connector"], r["external_id"]): r["status"] for r in e.discover("contacts").collect()}
    assert found == {("crm", "1"): "matched", ("erp", "a"): "matched", ("crm", "2"): "unique", ("crm", "3"): "unique", ("erp", "b"): "unique"}
    assert sorted(r["target"] for r in e.onboard("contacts").collect()) == ["crm", "erp", "erp"]
    assert e.clusters("contacts").where("crm IS NOT NULL AND erp IS NOT NULL").count() == 1
    for c in ("crm", "erp"):
        assert e.ingest("contacts", c).count() == 0
    e.read, e.now = systems(spark, [("1", "Ann@x", "Anna", False), ("2", "bob@x", "Bob", False), ("3", "", "Nobody", False), ("4", "cid@X", "Cid", False)], ERP), 2
    out = {(r["action"], json.loads(r["payload"])["full_name"]) for r in e.ingest("contacts", "crm").collect()}
    assert out == {("update", "Anna"), ("update", "Cid")}  # the new row meets erp's by its key
    assert e.ingest("contacts", "crm").count() == 0
    e.read = systems(spark, [("1", "Ann@x", "Anna", True), ("2", "bob@x", "Bob", False), ("3", "", "Nobody", False), ("4", "cid@X", "Cid", False)], ERP)
    assert [r["action"] for r in e.ingest("contacts", "crm").collect()] == ["delete"]
    e.read = systems(spark, CRM, ERP)
    assert "update" in {r["action"] for r in e.ingest("contacts", "crm").collect()}  # it is back


def test_snapshot_absence_and_guard(spark, tmp_path):
    erp = [(str(i), f"p{i}@x", "P") for i in range(10)]
    crm = [(str(i), f"p{i}@x", "P", False) for i in range(10)]
    e = Engine(spark, parse_channels([SPEC]), str(tmp_path / "s"), systems(spark, crm, erp), now=1)
    e.onboard("contacts")
    e.read = systems(spark, crm, erp[:8])
    assert [r["action"] for r in e.ingest("contacts", "erp").collect()] == ["delete", "delete"]
    e.read = systems(spark, crm, erp[:2])
    assert e.ingest("contacts", "erp").count() == 0


def test_split_gives_every_link_its_own_id(spark, tmp_path):
    e = Engine(spark, parse_channels([SPEC]), str(tmp_path / "s"), systems(spark, CRM, ERP))
    e.onboard("contacts")
    both = e.clusters("contacts").where("crm = '1'").first()
    e.split("contacts", both["component"])
    assert e.table("contacts", "links").groupBy("canonical_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize(
    "entry",
    [
        {"connector": "x", "entity": "y", "fields": [{"target": "a", "source": "b", "source_path": "c"}]},
        {"connector": "x", "entity": "y", "fields": [{"target": "a", "source_path": "c[0]"}]},
        {"connector": "x", "entity": "y", "fields": [{"target": "a", "value_map": {"1": "2"}, "expression": "b"}]},
        {"connector": "x", "entity": "y", "scalar": True, "element_key": "k"},
        {"connector": "x", "entity": "y", "parent": "nobody"},
        {"connector": "x", "entity": "y", "array_path": "l", "full_snapshot": True},
        {"entity": "y"},
        {"connector": "x", "entity": "y", "fields": [{"target": "a", "strategy": "guess"}]},
    ],
)
def test_bad_specs_are_refused(entry):
    with pytest.raises(SpecError):
        parse_channels([{"mappings": [{"channel": "c", **entry}]}])


def test_specs_are_merged_from_files_and_promoted(tmp_path):
    (tmp_path / "a.yaml").write_text("channels: [{id: c, identity: [email, [name, dob]]}]\nmappings:\n- {channel: c, connector: '${WHO:-}x', entity: e, fields: [{target: email, priority: 1, group: g}]}\n")
    (tmp_path / "b.json").write_text(json.dumps({"mappings": [{"channel": "c", "connector": "y", "entity": "e", "fields": [{"target": "email", "master": "y"}]}]}))
    c = load_channels(str(tmp_path))["c"]
    assert c.identity == (("email",), ("name", "dob")) and len(c.members) == 2
    assert c.policy.masters == {"email": "y"} and c.policy.groups == {"email": "g"}


def test_streaming_equals_batch_and_late_rows_lose(spark, tmp_path):
    schema = "id bigint, v string, ts bigint"
    src = tmp_path / "in"
    for i, rows in enumerate([[(1, "a", 5), (2, "b", 1)], [(1, "old", 2), (2, "c", 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src / f"day={i}"))
    held = {"state": spark.createDataFrame([], schema), "acts": []}

    def commit(batch_id, acts, state):
        held["acts"] += [tuple(r) for r in acts.collect()]
        held["state"] = spark.createDataFrame(state.collect(), schema)

    stream = spark.readStream.schema(schema + ", day int").option("maxFilesPerTrigger", 1).json(str(src)).drop("day")
    run(stream, lambda: held["state"], commit, "id", ["v"], ["ts"], str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["v"]) for r in held["state"].collect()} == {(1, "a"), (2, "c")}


def test_breaker():
    b = Breaker()
    assert [b.record(x, 0) for x in (True, False, False)] == ["CLOSED", "CLOSED", "OPEN"]
    assert (b.state(9_999), b.state(10_000)) == ("OPEN", "HALF_OPEN")
    assert b.record(False, 10_000) == "OPEN" and b.record(True, 20_000) == "CLOSED"


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)}
    assert got == want
    salted = connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), hub=3)
    assert {r["node"]: r["component"] for r in salted.collect()} == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_identity_groups_skip_blanks(spark):
    nodes = spark.createDataFrame([("1", "A@x ", None), ("2", "a@X", "7"), ("3", "", "7"), ("4", None, None)], "node string, email string, tax string")
    got = {r["node"]: r["component"] for r in identity.components(nodes, (("email",), ("tax",))).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_nested_fields_and_linked_lists(spark):
    rows = [("c", "b", "x"), ("a", None, "b"), ("b", "a", "c"), ("y", "x", None), ("x", "gone", "y"), ("x", "gone", "c"), (None, None, "a")]
    df = spark.createDataFrame([(1, rows), (2, [("p", "q", "q"), ("q", "p", "p")]), (3, [("m", None, "z"), ("n", "m", None)]), (4, None)], "id int, items array<struct<key:string,prev:string,next:string>>")
    assert {r["id"]: r["items"] for r in arrays.linked_list(df, "id", "items").collect()} == {1: ["a", "b", "c", "x", "y"], 2: ["p", "q"], 3: ["m", "n"], 4: None}
    near = df.select(arrays.neighbours(F.col("items"), "key").alias("n")).first()["n"]
    assert [(x["_prev"], x["_next"]) for x in near][:2] == [(None, "a"), ("c", "b")]
    row = spark.createDataFrame([('{"a":[{"b":3}]}', None)], "doc string, x string")
    assert mapping.inbound(row, [Field("v", source_path="doc.a[0].b", direction="forward_only"), Field("x", default="d")]).first()[:] == ("3", "d")
    with pytest.raises(ValueError):
        mapping.outbound(spark.createDataFrame([("1",)], "v string"), [Field("v", source_path="a[0]")])


def test_ordering_mixes_numbers_text_and_missing(spark):
    df = spark.createDataFrame([([("10", "x"), ("9", "y"), (None, "z"), ("9", "a")],)], "a array<struct<k:string,n:string>>")
    assert [x["n"] for x in df.select(arrays.ordered(F.col("a"), [("k", True)]).alias("o")).first()["o"]] == ["z", "y", "a", "x"]


def test_collect_and_bool_or_decisions(spark):
    schema = "entity string, field string, val string, ts bigint, src string, created bigint"
    inc = spark.createDataFrame([("e", "tags", "b", 1, "x", 1), ("e", "flag", "true", 1, "x", 1), ("e", "new", "1", 0, "x", None)], schema)
    old = spark.createDataFrame([("e", "tags", "a", 9, "y", 1), ("e", "flag", "false", 9, "y", 1)], schema)
    policy = resolve.Policy(strategies={"tags": "collect", "flag": "bool_or"})
    got = {r["field"]: (r["val"], r["accepted"]) for r in resolve.decide(inc, old, policy).collect()}
    assert got == {"tags": ('["a","b"]', True), "flag": ("true", True), "new": ("1", True)}
    again = spark.createDataFrame([("e", "tags", x, 1, "x", 1) for x in ("a|b", None)], schema)
    have = spark.createDataFrame([("e", "tags", '["c",null]', 9, "y", 1)], schema)
    assert sorted(r["val"] for r in resolve.decide(again, have, policy).collect()) == ['["c",null,"a|b"]', '["c",null]']


def test_groups_are_taken_or_refused_as_a_whole(spark):
    schema = "entity string, field string, val string, ts bigint, src string, created bigint"
    groups = {"street": "addr", "city": "addr"}
    frame = lambda *rows: spark.createDataFrame([("e", *r) for r in rows], schema)
    taken = lambda inc, old, **kw: {r["field"]: r["accepted"] for r in resolve.decide(inc, old, resolve.Policy(groups=groups, **kw)).collect()}
    inc = frame(("street", "new", 9, "a", 5), ("city", "old city", 1, "a", 5), ("name", "n", 1, "a", 5))
    old = frame(("street", "s", 3, "b", 7), ("city", "c", 4, "b", 7), ("name", "m", 2, "b", 7))
    assert taken(inc, old) == {"street": True, "city": True, "name": False}
    assert taken(frame(("street", "new", 2, "a", 5), ("city", "x", 3, "a", 5)), old) == {"street": False, "city": False}
    # the existing side's newest field may be one that does not come in
    assert taken(frame(("street", "new", 3, "a", 5)), old) == {"street": False}
    assert taken(frame(("street", "new", 0, "a", 5)), frame(("name", "m", 2, "b", 7))) == {"street": True}
    # by origin: the creation time of the newest field's source, equal ones for the incoming
    mixed = frame(("street", "s", 3, "b", 9), ("city", "c", 4, "c", 4))
    assert taken(inc, mixed, default="origin_wins") == {"street": False, "city": False, "name": True}
    assert taken(inc, frame(("city", "c", 40, "c", 5)), default="origin_wins") == {"street": True, "city": True, "name": True}
    # by priority: a field's own replaces the source's for the whole group
    late = frame(("street", "new", 1, "a", 5), ("city", "x", 1, "a", 5))
    assert taken(late, old, priorities={"a": 5, "b": 3}) == {"street": False, "city": False}
    assert taken(late, old, priorities={"a": 5, "b": 3}, field_priorities={("a", "city"): 1}) == {"street": True, "city": True}
    assert taken(late, old, priorities={"a": 1, "b": 3}, field_priorities={("a", "city"): 7}) == {"street": False, "city": False}


def test_expressions_bind_names_and_nothing_else(spark):
    schema = "entity string, field string, val string, ts bigint, src string, created bigint"
    inc = spark.createDataFrame([("e", "a", "xv", 9, "x", 1), ("e", "b", "2", 9, "x", 1)], schema)
    old = spark.createDataFrame([("e", "a", "vx", 1, "y", 1), ("e", "b", "5", 1, "y", 1)], schema)
    policy = resolve.Policy(normalize={"a": "array_join(array_sort(split(cast(v as varchar(9)), '')), 'v')"}, reducers={"b": "concat(incoming, ' incoming over existing ', existing)"})
    got = {r["field"]: (r["val"], r["accepted"]) for r in resolve.decide(inc, old, policy).collect()}
    assert got == {"a": ("xv", False), "b": ("2 incoming over existing 5", True)}


def test_elements_go_through_the_whole_mapping(spark):
    df = spark.sql("SELECT 'r' AS id, array(named_struct('sku', 'a', 'qty', 2, 'state', 'x', 'in', named_struct('d', 5)), NULL, named_struct('sku', NULL, 'qty', 3, 'state', 'y', 'in', NULL)) AS lines, 'a' AS kind")
    fields = [
        Field("items", "lines", element_fields=(
            Field("code", "sku", default="none"), Field("double", expression="qty * 2 + length('qty')"), Field("status", "state", value_map={"x": "open"}, fallback="null"),
            Field("deep", source_path="in.d"), Field("label", default_expression="concat(code, '!')"), Field("hidden", "qty", direction="reverse_only"))),
        Field("kind", value_map={"a": "b", "b": "c"}, default_expression="'a'"),
        Field("late", default_expression="upper(kind)", default="no"),
    ]
    got = mapping.inbound(df, fields, keep=["id"])
    row = got.first()
    assert [x and x.asDict() for x in row["items"]] == [{"code": "a", "double": 7, "status": "open", "deep": 5, "label": "a!"}, None, {"code": "none", "double": 9, "status": None, "deep": None, "label": "none!"}]
    assert (row["kind"], row["late"]) == ("b", "B")
    back = mapping.outbound(got, [Field("items", "lines", element_fields=(Field("code", "sku"), Field("status", "state", value_map={"x": "open"}), Field("deep", direction="forward_only")))])
    assert [x and x.asDict() for x in back.first()["lines"]] == [{"sku": "a", "state": "x"}, None, {"sku": "none", "state": None}]


def test_sinks_and_sources(spark, tmp_path):
    assert readers.json_records(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"id": "1", "data": {"a": 1}, "updated": "9"}, {"id": "2", "data": {}, "updated": "10"}, {"id": "3", "data": {}}]))
    assert {r["id"] for r in readers.json_records(spark, str(tmp_path / "r.json"), "9").collect()} == {"2", "3"}
    state = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", None)], "id string, v string")
    writers.write_json_snapshot(state, new, "id", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert writers.audit(new, state, "id", ["v"]).first()["after"] == '{"v":"c"}'
    log = spark.createDataFrame([('{"token": "abc", "x": 1}', None)], "body string, status int")
    assert writers.journal(log).first()[:] == ('{"token": "***", "x": 1}', -1)
    with pytest.raises(ValueError):
        readers.jdbc_table(spark, "jdbc:x", "a; drop")


def test_references_and_guards(spark):
    edges = spark.createDataFrame([("r", "p", "t", "1"), ("r", "q", "t", "2")], "record_id string, predicate string, target_entity string, target_id string")
    assert json.loads(assoc.sentinel(edges).first()["sentinel"])[0]["predicate"] == "p"
    current = spark.createDataFrame([("a",), ("b",)], "id string")
    again, purge = assoc.retry(spark.createDataFrame([("a",), ("c",)], "id string"), current, current.where("false"), "id")
    assert [r[0] for r in again.collect()] == ["a"] and [r[0] for r in purge.collect()] == ["c"]
    assert delta.absence_guard(current, current.where("false"), "id").first()["tripped"]
    assert stats.lineage(spark, [("c", "e", [Field("a", "b")])]).first()[:] == ("c", "e", "b", "a", "bidirectional")


def test_specs_common_settings_names_and_warnings():
    base = {"channel": "c", "connector": "x", "entity": "orders", "name": "o"}
    docs = [
        {"conflict": {"strategy": "origin_wins", "priorities": {"x": 2, "y": 3}, "fields": {"a": {"strategy": "collect"}}}},
        {"channels": [{"id": "c", "conflict": {"priorities": {"x": 1}, "fields": {"b": "coalesce"}}}], "mappings": [base, {"channel": "c", "parent": "o", "array_path": "lines", "name": "l"}]},
    ]
    c = parse_channels(docs)["c"]
    assert (c.policy.default, c.policy.priorities, c.policy.strategies) == ("origin_wins", {"x": 1, "y": 3}, {"a": "collect", "b": "coalesce"})
    assert [m.entity for m in c.members] == ["orders", "orders/lines"]
    with pytest.warns(UserWarning, match="written back"):
        parse_channels([{"mappings": [{**base, "fields": [{"target": "a", "value_map": {"1": "x", "2": "x"}}]}]}])
    with pytest.warns(UserWarning, match="no channel"):
        parse_channels([{"mappings": [{**base, "fields": [{"target": "a", "entity": "nowhere"}]}]}])
    for bad in ({"fields": [{"target": "a", "entity_connector": "y"}]}, {"parent": "o", "connector": "", "entity": "", "name": "z"}):
        with pytest.raises(SpecError):
            parse_channels([{"mappings": [base, {**base, "name": "p", **bad}]}])
    for conflict in ({"fields": {"strategy": "x"}}, {"fields": {"a": "guess"}}):
        with pytest.raises(SpecError):
            parse_channels([{"conflict": conflict, "mappings": [base]}])


def test_breaker_gates_a_stream_and_is_restored(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5)], "id bigint, v string, ts bigint").write.json(str(tmp_path / "in"))
    held = {"state": spark.createDataFrame([], "id bigint, v string, ts bigint"), "fail": True}

    def commit(batch_id, acts, state):
        if held["fail"]:
            raise ValueError("down")
        held["state"] = spark.createDataFrame(state.collect(), state.schema)

    b, clock = Breaker(least=1), [0]
    stream = spark.readStream.schema("id bigint, v string, ts bigint").json(str(tmp_path / "in"))
    go = lambda: run(stream, lambda: held["state"], commit, "id", ["v"], ["ts"], str(tmp_path / "cp"), breaker=b, now=lambda: clock[0]).awaitTermination()
    for want in ("down", "too many failures"):
        with pytest.raises(Exception, match=want):
            go()
    clock[0], held["fail"] = 10_000, False
    go()
    assert held["state"].count() == 1 and b.state(clock[0]) == "CLOSED"
    log = spark.createDataFrame([(1, True, 1), (2, False, 2), (3, False, 3)], "n int, ok boolean, at bigint")
    assert Breaker.restored(log, ["n"], "ok", "at").state(4) == "OPEN"


def test_connectors_keep_small_values(spark, tmp_path):
    e = Engine(spark, parse_channels([SPEC]), str(tmp_path / "s"), systems(spark, CRM, ERP))
    e.remember("crm", cursor="1", page="2")
    e.remember("crm", cursor="3", page=None)
    assert e.remembered("crm") == {"cursor": "3"} and e.remembered("erp") == {}
