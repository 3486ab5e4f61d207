"""Passes of the engine step by step: what each decides, delivers and keeps."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.engine import Engine
from recordloom.spec import parse_channels
from recordloom.state.tables import State

FIELDS = [{"target": "email", "source": "mail"}, "name", "phone"]
BASE = {
    "channels": [{"id": "people", "identity": ["email", "phone"], "propagate_deletes": True}],
    "mappings": [{"channel": "people", "connector": c, "entity": "p", "fields": FIELDS} for c in ("crm", "erp", "web")],
}
COLUMNS = "id string, mail string, name string, phone string, seen bigint, born bigint, hide boolean"


class World:
    """Systems in memory; what is written to one is read from it again."""

    def __init__(self, spark, tmp_path, spec=BASE, schema=COLUMNS, **rows):
        self.spark, self.schema, self.rows, self.sent, self.broken = spark, schema, {c: {} for c in ("crm", "erp", "web")}, [], set()
        self.made = dict.fromkeys(self.rows, 0)
        for c, given in rows.items():
            for r in given:
                self.put(c, *r)
        self.engine = Engine(spark, parse_channels([spec]), str(tmp_path / "state"), self.read, self.write, now=100)

    def put(self, c, *r):
        names = [x.split()[0] for x in self.schema.split(", ")]
        self.rows[c][r[0]] = dict(zip(names, [*r, *[None] * (len(names) - len(r))], strict=True))

    def read(self, connector, entity):
        return self.spark.createDataFrame([tuple(r.values()) for r in self.rows[connector].values()], self.schema)

    def write(self, target, rows):
        out = []
        for r in rows.collect():
            if target in self.broken:
                out.append((r["canonical_id"], r["external_id"], "down"))
                continue
            self.made[target] += not r["external_id"]
            ext = r["external_id"] or f"{target}-{self.made[target]}"
            self.sent.append((target, r["action"], r["payload"] and json.loads(r["payload"])))
            if r["action"] == "delete":
                self.rows[target].pop(ext, None)
            else:
                held = self.rows[target].get(ext) or dict.fromkeys((x.split()[0] for x in self.schema.split(", ")))
                self.rows[target][ext] = held | {"id": ext} | {k: v for k, v in json.loads(r["payload"]).items() if k in held}
            out.append((r["canonical_id"], ext, None))
        return self.spark.createDataFrame(out, "canonical_id string, external_id string, error string")

    def go(self, connector, now=None, **kw):
        """What a pass sends: ``(target, action)`` and one field of the payloads."""
        self.sent, self.engine.now = [], now or self.engine.now + 1
        self.engine.ingest("people", connector, **kw)
        return sorted((t, a, (p or {}).get("name")) for t, a, p in self.sent)


def test_what_is_delivered_is_known_and_comes_back_as_an_echo(spark, tmp_path):
    w = World(spark, tmp_path, crm=[("1", "a@x", "Ann", "7")])
    assert w.go("crm") == [("erp", "insert", "Ann"), ("web", "insert", "Ann")]
    assert [w.go(c) for c in ("crm", "erp", "web")] == [[], [], []]
    w.put("erp", "erp-1", "a@x", "Anna", "7")
    assert w.go("erp") == [("crm", "update", "Anna"), ("web", "update", "Anna")]
    assert w.go("crm") == [] and w.rows["crm"]["1"]["name"] == "Anna"
    assert w.engine.status("people") == "ready" and w.engine.linked_sources("people") == ["crm", "erp", "web"]
    log = w.engine.table("people", "log")
    assert log.count() == 4 and json.loads(log.where("target = 'web' AND action = 'update'").first()["before"])["name"] == "Ann"
    runs = {r["batch_id"]: (r["n_insert"], r["n_update"], r["snapshot_at"]) for r in w.engine.table("people", "runs").collect()}
    assert runs["crm-101"] == (2, 0, 101) and (0, 2, 105) in runs.values()
    del w.rows["crm"]["1"]
    w.rows["erp"].clear()
    assert w.go("crm") == []  # not a snapshot source: absence says nothing


def test_priorities_and_masters_decide_for_the_target(spark, tmp_path):
    spec = {**BASE, "channels": [{**BASE["channels"][0], "conflict": {"field_masters": {"phone": "crm"}, "field_strategies": {"name": "coalesce"}, "priorities": {"crm": 1, "erp": 2, "web": 3}}}]}
    w = World(spark, tmp_path, spec, crm=[("1", "a@x", "Ann", "7")])
    w.go("crm")
    w.put("erp", "erp-1", "a@x", "Anna", "8")
    assert w.go("erp") == [("web", "update", "Ann")] or w.go("erp") == []  # crm's name and phone stay
    assert (w.rows["crm"]["1"]["name"], w.rows["crm"]["1"]["phone"]) == ("Ann", "7")
    w.put("crm", "1", "a@x", "Annie", "9")
    assert ("erp", "update", "Annie") in w.go("crm")
    assert (w.rows["erp"]["erp-1"]["phone"], w.rows["web"]["web-1"]["name"]) == ("9", "Annie")


def test_a_new_row_merges_all_canonicals_it_meets_unless_they_must_not(spark, tmp_path):
    w = World(spark, tmp_path, crm=[("1", "a@x", "A", "")], erp=[("2", "", "B", "7")])
    for c in ("crm", "erp"):
        w.go(c, collect_only=True)
    assert w.engine.status("people") == "collected"
    w.put("web", "3", "A@x ", "C", "7")
    w.go("web", collect_only=True)
    links = w.engine.table("people", "links")
    assert links.select("canonical_id").distinct().count() == 1 and links.count() == 3
    canonical = links.first()["canonical_id"]
    new = w.engine.split_canonical("people", canonical, "erp")
    assert w.engine.table("people", "no_link").count() == 2
    for bad in (("people", canonical, "erp"), ("people", new, "erp")):
        with pytest.raises(ValueError):
            w.engine.split_canonical(*bad)
    w.rows["web"].clear()
    w.put("web", "4", "", "D", "7")  # meets erp's record only
    w.go("web", collect_only=True)
    assert w.engine.table("people", "links").where("external_id = '4'").first()["canonical_id"] == new
    w.engine.remove_no_link("people", ("crm", "1"), ("erp", "2"))
    assert w.engine.table("people", "no_link").count() == 1


def test_two_new_rows_of_one_source_do_not_share_a_canonical(spark, tmp_path):
    w = World(spark, tmp_path, crm=[("1", "a@x", "A", "")])
    w.go("crm", collect_only=True)
    w.put("erp", "2", "a@x", "B", "")
    w.put("erp", "3", "a@x", "C", "")
    w.go("erp", collect_only=True)
    assert w.engine.table("people", "links").groupBy("canonical_id", "connector").count().where("count > 1").count() == 0
    assert w.engine.table("people", "links").select("canonical_id").distinct().count() == 2


def test_watermarks_are_kept_by_passes_that_read_since_them(spark, tmp_path):
    spec = {**BASE, "mappings": [{**m, "watermark": "seen"} for m in BASE["mappings"]]}
    w = World(spark, tmp_path, spec, crm=[("1", "a@x", "A", "", 9), ("2", "b@x", "B", "", 10)])
    w.go("crm")
    mark = lambda: {r["connector"]: r["mark"] for r in w.engine.state.read("marks", "connector string, entity string, mark string").collect()}
    assert mark() == {"crm": "10"}
    w.put("crm", "1", "a@x", "A changed, but older", "", 9)
    w.put("crm", "3", "c@x", "C", "", 11)
    assert {n for _, _, n in w.go("crm")} == {"C"}
    assert mark() == {"crm": "11"}
    w.put("crm", "4", "d@x", "D", "", 12)
    assert {n for _, _, n in w.go("crm", full=True)} == {"A changed, but older", "D"}
    assert mark() == {"crm": "11"}  # a full pass leaves it


def test_filters_required_fields_and_reverse_filters(spark, tmp_path):
    crm, erp, web = BASE["mappings"]
    need = [{"target": "email", "source": "mail"}, "name", {"target": "phone", "reverse_required": True}]
    spec = {**BASE, "mappings": [{**crm, "filter": "name <> 'skip'"}, {**erp, "fields": need}, {**web, "reverse_filter": "name LIKE 'A%'"}]}
    w = World(spark, tmp_path, spec, crm=[("1", "a@x", "Ann", None), ("2", "b@x", "Bob", "5"), ("3", "c@x", "skip", "6")])
    assert w.go("crm") == [("erp", "insert", "Bob"), ("web", "insert", "Ann")]
    w.put("crm", "2", "b@x", "skip", "5")
    assert w.go("crm") == []
    assert w.engine.table("people", "facts").where("connector = 'crm' AND external_id = '2'").count() == 0
    w.put("crm", "2", "b@x", "Bob", "5")
    assert w.go("crm") == []  # it is back, and erp holds the same


def test_deletes_resurrections_and_the_snapshot_guard(spark, tmp_path):
    crm, erp, web = BASE["mappings"]
    spec = {**BASE, "mappings": [{**crm, "soft_delete": {"type": "deleted_flag", "field": "hide"}}, {**erp, "full_snapshot": True}]}
    w = World(spark, tmp_path, spec, crm=[(str(i), f"{i}@x", f"N{i}", "", None, None, False) for i in range(6)])
    w.go("crm")
    w.go("erp")
    w.put("crm", "1", "1@x", "N1", "", None, None, True)
    assert w.go("crm") == [("erp", "delete", None)]
    w.put("crm", "1", "1@x", "N1", "", None, None, False)
    assert w.go("crm") == [("erp", "insert", "N1")]
    w.go("erp")
    gone = next(k for k, r in w.rows["erp"].items() if r["name"] == "N2")
    del w.rows["erp"][gone]
    assert w.go("erp") == [("crm", "delete", None)]
    for k in list(w.rows["erp"])[:4]:
        del w.rows["erp"][k]
    assert w.go("erp") == [] and w.engine.breaker("people").state(w.engine.now) == "OPEN"
    assert w.go("crm") == []  # the breaker gates the channel
    w.put("crm", "9", "9@x", "N9", "", None, None, False)
    assert w.go("crm", now=w.engine.now + 20_000) == [("erp", "insert", "N9")]


def test_failed_deliveries_are_not_known(spark, tmp_path):
    w = World(spark, tmp_path, crm=[("1", "a@x", "Ann", "7")])
    w.broken = {"erp"}
    assert w.go("crm") == [("web", "insert", "Ann")]
    assert w.engine.table("people", "links").where("connector = 'erp'").count() == 0
    assert w.engine.table("people", "runs").first()["n_error"] == 1
    w.broken = set()
    w.put("crm", "1", "a@x", "Anna", "7")
    assert w.go("crm") == [("erp", "insert", "Anna"), ("web", "update", "Anna")]


def test_references_wait_until_their_record_is_linked(spark, tmp_path):
    fields = [{"target": "email", "source": "mail"}, "name", {"target": "boss", "source": "phone", "entity": "p"}]
    spec = {"channels": [{"id": "people", "identity": ["email"]}], "mappings": [{"channel": "people", "connector": c, "entity": "p", "fields": fields} for c in ("crm", "erp")]}
    w = World(spark, tmp_path, spec, crm=[("1", "a@x", "Ann", "2"), ("3", "c@x", "Cid", "")])
    w.go("crm")
    assert [r["external_id"] for r in w.engine.table("people", "deferred").collect()] == ["1"]
    assert {r["name"]: r["phone"] for r in w.rows["erp"].values()} == {"Ann": None, "Cid": ""}
    w.put("crm", "2", "b@x", "Bob", None)
    w.go("crm")
    w.go("crm")
    bob = next(k for k, r in w.rows["erp"].items() if r["name"] == "Bob")
    assert next(r["phone"] for r in w.rows["erp"].values() if r["name"] == "Ann") == bob
    assert w.engine.table("people", "deferred").count() == 0
    assert w.go("erp") == [] and w.go("crm") == []


def test_onboard_and_add_source(spark, tmp_path):
    crm, erp, web = BASE["mappings"]
    two = {**BASE, "mappings": [crm, erp]}
    w = World(spark, tmp_path, two, crm=[("1", "a@x", "Ann", "7"), ("2", "b@x", "Bob", "8")], erp=[("9", "A@x", "Ann", "7")])
    assert w.engine.status("people") == "uninitialized"
    assert w.engine.seeds("people").where("crm IS NOT NULL AND erp IS NOT NULL").count() == 1
    w.engine.onboard("people", dry_run=True)
    assert w.sent == []
    w.engine.onboard("people")
    assert [(t, a, p["name"]) for t, a, p in w.sent] == [("erp", "insert", "Bob")]
    assert w.go("crm") == [] and w.go("erp") == []
    w.engine.channels = parse_channels([BASE])
    with pytest.raises(ValueError):
        w.engine.add_source("people", "web")
    w.put("web", "5", "b@x", "Robert", "8")
    w.put("web", "6", "d@x", "Dan", "")
    w.go("web", collect_only=True)
    report, out = w.engine.add_source("people", "web", dry_run=True)
    assert report.first()[:] == (2, 1, 1, 1) and w.sent == []
    w.engine.add_source("people", "web")
    assert sorted((t, a, p["name"]) for t, a, p in w.sent) == [("crm", "insert", "Dan"), ("erp", "insert", "Dan"), ("web", "insert", "Ann"), ("web", "update", "Bob")]
    assert [w.go(c) for c in ("crm", "erp", "web")] == [[], [], []]
    assert w.engine.clusters("people").where("crm IS NULL OR erp IS NULL OR web IS NULL").count() == 0
    assert set(w.engine.dump("people")) >= {"facts", "links", "log"}


def test_a_cut_off_pointer_is_not_read(spark, tmp_path):
    s = State(spark, str(tmp_path / "s"))
    frame = lambda v: spark.createDataFrame([(v,)], "v string")
    s.commit({"t": frame("a")}, {"log": frame("1")})
    s.commit({"t": frame("b")}, {"log": frame("2")})
    (tmp_path / "s" / "CURRENT-3.json").write_text('{"t": ["3"')
    assert s.read("t", "v string").first()[0] == "b"
    assert sorted(r[0] for r in s.read("log", "v string").collect()) == ["1", "2"]
    assert s.read("nothing", "v string").count() == 0
