"""The engine: ingest, discover, onboard, add a source, split, as set operations over the tables of a state folder.

A pass over a source is a few plans over whole tables, in the order in which one record would go through: read since the
watermark, filter, map, echo, identity, then for every target: references, conflicts, empty and unchanged records, outbound
mapping, required fields, reverse filter, what was written last.  What a pass changes is one commit.

The state of a channel: ``facts`` (what each system was last known to hold, by field, with time and source), ``records``
(when a record was first seen, and deleted), ``links`` (canonical ids), ``written`` (last payloads), ``deferred``
(references that wait), ``no_link`` (pairs that must not meet), ``log`` and ``runs`` (appended), and ``marks`` (watermarks).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators import assoc, delta, identity, mapping, resolve, state_joins
from recordloom.operators.components import connected_components
from recordloom.sources import readers
from recordloom.spec import Channel, Member
from recordloom.state.shared import Scratch, materialise
from recordloom.state.tables import State
from recordloom.streaming.driver import Breaker

FACTS = "connector string, external_id string, field string, val string, prev string, ts bigint, src string"
RECORDS = "connector string, external_id string, created bigint, deleted_at bigint"
LINKS = "canonical_id string, connector string, external_id string"
WRITTEN = "connector string, canonical_id string, payload string"
DEFERRED = "connector string, external_id string, target string"
NO_LINK = "a string, b string"
LOG = "batch_id string, target string, canonical_id string, external_id string, action string, before string, payload string"
RUNS = "batch_id string, connector string, n_insert bigint, n_update bigint, n_delete bigint, n_defer bigint, n_error bigint, snapshot_at bigint"
MARKS = "connector string, entity string, mark string"
KEPT = "connector string, key string, value string"
ACTIONS = "target string, canonical_id string, external_id string, action string, before string, payload string"
TABLES = {"facts": FACTS, "records": RECORDS, "links": LINKS, "written": WRITTEN, "deferred": DEFERRED, "no_link": NO_LINK, "log": LOG, "runs": RUNS}


def node_of() -> Column:
    """A record's name across systems."""
    return F.concat_ws("\x01", "connector", "external_id")


class Engine:
    """``read(connector, entity)`` gives a source's rows with a string column ``id``.

    ``write(target, rows)`` delivers rows ``(canonical_id, external_id, action, payload)`` and gives ``(canonical_id,
    external_id, error)``; what it took is linked and known from then on.  Without it passes only say what is to be written.
    """

    def __init__(self, spark: SparkSession, channels: dict[str, Channel], state_dir: str, read: Callable[[str, str], DataFrame], write: Callable[[str, DataFrame], DataFrame] | None = None, now: int = 0):
        self.spark, self.channels, self.read, self.write, self.now = spark, channels, read, write, now
        self.state = State(spark, state_dir)
        self.breakers: dict[str, Breaker] = {}

    # state

    def table(self, channel: str, name: str) -> DataFrame:
        return self.state.read(f"{name}_{channel}", TABLES[name])

    def _commit(self, channel: str, tables: dict[str, DataFrame], log: DataFrame | None = None, runs: DataFrame | None = None, marks: DataFrame | None = None) -> None:
        out = {f"{k}_{channel}": v for k, v in tables.items()}
        if marks is not None:
            out["marks"] = marks
        self.state.commit(out, {f"{k}_{channel}": v for k, v in (("log", log), ("runs", runs)) if v is not None})

    def breaker(self, channel: str) -> Breaker:
        return self.breakers.setdefault(channel, Breaker())

    def _member(self, channel: str, connector: str) -> Member:
        return next(m for m in self.channels[channel].members if m.connector == connector)

    def _connectors(self, channel: str) -> list[str]:
        return [m.connector for m in self.channels[channel].members]

    def _fields(self, channel: str) -> list[str]:
        return list(dict.fromkeys(f.target for m in self.channels[channel].members for f in m.fields if f.direction != "reverse_only"))

    # sources

    def _mapped(self, raw: DataFrame, m: Member, fields: Sequence[str]) -> DataFrame:
        """``(external_id, <canonical fields>, gone, passes, updated, born)``; fields the source lacks are left out."""
        if m.id_field:
            raw = mapping.with_id_field(raw, m.id_field, "id")
        when = lambda c: mapping.parse_ts(F.col(c)) if c else F.lit(None).cast("bigint")
        own = {"_gone": mapping.deleted(*m.soft_delete) if m.soft_delete else F.lit(False), "_passes": F.coalesce(F.expr(m.filter), F.lit(False)) if m.filter else F.lit(True), "_updated": when(m.updated), "_born": when(m.created)}
        out = mapping.inbound(raw.withColumns(own), m.fields, keep=["id", *own])
        refs = {f.target: f.options["entity"] for f in m.fields if f.options.get("entity")}
        text = lambda c: F.col(c).cast("string") if not isinstance(out.schema[c].dataType, T.ArrayType | T.StructType) else F.to_json(c)
        value = lambda c: F.when(text(c).isNotNull(), F.concat_ws("\x01", F.lit(m.connector), F.lit(refs[c]), text(c))) if c in refs else text(c)
        return out.select(F.col("id").cast("string").alias("external_id"), *(value(c).alias(c) for c in out.columns if c in fields), F.col("_gone").alias("gone"), F.col("_passes").alias("passes"), F.col("_updated").alias("updated"), F.col("_born").alias("born"))

    def _facts(self, rows: DataFrame, m: Member, fields: Sequence[str]) -> DataFrame:
        """Rows in long form; a field's time is its record's, else this pass."""
        have = [c for c in fields if c in rows.columns]
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("val")) for c in have))
        return rows.select(F.lit(m.connector).alias("connector"), "external_id", F.coalesce("updated", F.lit(self.now)).cast("bigint").alias("ts"), F.inline(pairs)).withColumn("src", F.lit(m.connector))

    def _wide(self, facts: DataFrame, fields: Sequence[str]) -> DataFrame:
        return facts.groupBy("connector", "external_id").pivot("field", list(fields)).agg(F.first("val"))

    def _nodes(self, channel: str) -> DataFrame:
        """Every source's records with their fields, from the sources as they are now."""
        fields = self._fields(channel)
        out = None
        for m in self.channels[channel].members:
            rows = self._mapped(self.read(m.connector, m.entity), m, fields).where("NOT gone AND passes")
            rows = rows.withColumns({f: F.lit(None).cast("string") for f in fields if f not in rows.columns}).select("external_id", *fields, "updated", "born", F.lit(m.connector).alias("connector")).withColumn("node", node_of())
            out = rows if out is None else out.unionByName(rows)
        return out

    # discovery

    def discover(self, channel: str) -> DataFrame:
        """``(connector, external_id, component, status)`` of all members' rows."""
        if len(self.channels[channel].members) < 2:
            raise ValueError(f"{channel}: discovery needs two members")
        return self._discovered(channel, self._nodes(channel))

    def _discovered(self, channel: str, nodes: DataFrame) -> DataFrame:
        found = identity.discover(nodes, self._components(channel, nodes))
        return found.join(nodes.select("node", "external_id"), "node").select("connector", "external_id", "component", "status")

    def _components(self, channel: str, nodes: DataFrame) -> DataFrame:
        """Components of the identity keys; those that hold a pair which must not meet fall apart."""
        comp = identity.components(nodes, self.channels[channel].identity)
        barred = self.table(channel, "no_link")
        pairs = barred.join(comp.withColumnRenamed("node", "a"), "a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("component").distinct()
        return comp.join(pairs.withColumn("apart", F.lit(True)), "component", "left").select("node", F.when(F.col("apart"), F.col("node")).otherwise(F.col("component")).alias("component"))

    def onboard(self, channel: str, dry_run: bool = False) -> DataFrame:
        """Link what was discovered, know every source's facts, and give the inserts for what members lack."""
        with Scratch(self.spark) as scratch:
            nodes = materialise(self._nodes(channel), "nodes")
            found = materialise(self._discovered(channel, nodes), "found")
            own = identity.provisional_id(F.col("connector"), F.col("external_id"))
            links = materialise(found.select(F.when(F.col("status") == "matched", F.substring(F.sha2("component", 256), 1, 32)).otherwise(own).alias("canonical_id"), "connector", "external_id"), "links")
            fields = self._fields(channel)
            facts = None
            for m in self.channels[channel].members:
                part = self._facts(nodes.where(F.col("connector") == m.connector).select("external_id", *[f for f in fields if f in {x.target for x in m.fields if x.direction != "reverse_only"}], "updated"), m, fields)
                facts = part if facts is None else facts.unionByName(part)
            facts = materialise(facts.withColumn("prev", F.lit(None).cast("string")).select(*(c.split()[0] for c in FACTS.split(", "))), "facts")
            missing = links.groupBy("canonical_id").agg(F.collect_set("connector").alias("have")).select("canonical_id", F.explode(F.array_except(F.array(*(F.lit(c) for c in self._connectors(channel))), "have")).alias("target"))
            golden = state_joins.contributing(links, facts).select(F.col("canonical_id").alias("entity"), "field", "val", "ts", "src", F.lit(None).cast("bigint").alias("created"))
            best = resolve.first_non_null(golden).select(F.col("entity").alias("canonical_id"), "field", "val", F.lit(self.now).cast("bigint").alias("ts"), "src")
            out = scratch.keep(materialise(self._payloads(channel, missing.withColumns({"external_id": F.lit(None).cast("string"), "action": F.lit("insert")}), missing.join(best, "canonical_id"), links), "onboard"))
            if not dry_run:
                records = nodes.select("connector", "external_id", F.coalesce("born", F.lit(self.now)).cast("bigint").alias("created"), F.lit(None).cast("bigint").alias("deleted_at"))
                done = self._delivered(channel, out, missing.join(best, "canonical_id"), facts, links, records)
                self._commit(channel, {k: done[k] for k in ("facts", "records", "links", "written")}, self._log(f"onboard-{channel}-{self.now}", out))
        return out

    # one pass

    def ingest(self, channel: str, connector: str, full: bool = False, collect_only: bool = False) -> DataFrame:
        """One pass over a source: ``(target, canonical_id, external_id, action, before, payload)``; a second pass gives none."""
        spec, m, fields = self.channels[channel], self._member(channel, connector), self._fields(channel)
        none = self.spark.createDataFrame([], ACTIONS)
        if self.breaker(channel).state(self.now) == "OPEN":
            return none
        marks = self.state.read("marks", MARKS)
        with Scratch(self.spark) as scratch:
            raw = self.read(connector, m.entity)
            mark = None
            if m.watermark and not full and not m.full_snapshot:
                row = marks.where((F.col("connector") == connector) & (F.col("entity") == m.entity)).first()
                mark = row and row["mark"]
            new = raw if mark is None else raw.where(readers.newer_text(F.col(m.watermark).cast("string"), mark))
            deferred = self.table(channel, "deferred")
            waiting = deferred.where(F.col("connector") == connector)
            if mark is not None and not waiting.isEmpty():  # what waits is looked up, as its row may be older than the watermark
                new = new.unionByName(raw.join(waiting.select(F.col("external_id").alias("id")).distinct(), "id", "left_semi").join(new.select("id"), "id", "left_anti"))
            rows = materialise(self._mapped(new, m, fields), "rows")  # the source is read once
            facts, records, links = self.table(channel, "facts"), self.table(channel, "records"), self.table(channel, "links")
            mine = facts.where(F.col("connector") == connector)
            known = records.where(F.col("connector") == connector)
            acts = self._acts(rows, m, mine, known, fields, waiting)
            if m.full_snapshot:
                alive = known.where("deleted_at IS NULL")
                back = rows.where("NOT gone")
                guard = delta.absence_guard(alive, back, "external_id").first()
                if guard["tripped"] and guard["n_known"] and not back.isEmpty():
                    self.breaker(channel).opened = self.now
                elif not guard["tripped"]:
                    acts = acts.unionByName(delta.absent(alive, back, "external_id").withColumn("action", F.lit("delete")))
            acts = materialise(acts, "acts")
            new_marks = self._new_marks(m, new, marks) if m.watermark and not full else None
            if acts.isEmpty() and waiting.isEmpty():  # nothing but echoes
                self._commit(channel, {}, None, self._run(connector, none, deferred.where("false"), 0), new_marks)
                self.breaker(channel).record(True, self.now)
                return none
            links = materialise(self._identified(channel, connector, acts, rows, facts, links, fields), "links")
            ours = links.where(F.col("connector") == connector).select("external_id", "canonical_id")
            changed = acts.where("action IN ('insert', 'update', 'resurrect')")
            fresh = self._facts(rows.join(changed, "external_id", "left_semi"), m, fields)
            out, waits, values = none, self.spark.createDataFrame([], DEFERRED), None
            targets = [x.connector for x in spec.members if x.connector != connector]
            if targets and not collect_only:
                out, waits, values = self._fan_out(channel, connector, m, acts, fresh, rows, facts, records, links, ours, targets)
            out = scratch.keep(materialise(out, "pass"))
            cleared = acts.where("action = 'clear'").select(F.lit(connector).alias("connector"), "external_id")
            stays = facts.join(cleared, ["connector", "external_id"], "left_anti")
            merged = materialise(state_joins.merged_facts(stays, fresh, ["connector", "external_id", "field"]), "merged")
            seen = acts.where("action <> 'clear'").join(rows.select("external_id", "born"), "external_id", "left").select(F.lit(connector).alias("connector"), "external_id", F.coalesce("born", F.lit(self.now)).cast("bigint").alias("created"), F.when(F.col("action") == "delete", F.lit(self.now)).cast("bigint").alias("deleted_at"))
            records = delta.upsert(records.join(cleared, ["connector", "external_id"], "left_anti"), seen, ["connector", "external_id"], keep_first=["created"])
            done = self._delivered(channel, out, values, merged, links, records)
            done_waiting = rows.select(F.lit(connector).alias("connector"), "external_id").union(waiting.select("connector", "external_id"))  # looked up again, or gone from the source
            deferred = deferred.join(done_waiting.distinct(), ["connector", "external_id"], "left_anti").unionByName(waits)
            runs = self._run(connector, out, waits, done["errors"])
            self._commit(channel, {**{k: done[k] for k in ("facts", "records", "links", "written")}, "deferred": deferred}, self._log(f"{connector}-{self.now}", out), runs, new_marks)
            self.breaker(channel).record(done["errors"] == 0, self.now)
        return out

    def _run(self, connector: str, out: DataFrame, waits: DataFrame, errors: int) -> DataFrame:
        """One row of counters."""
        n = out.agg(*(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("insert", "update", "delete")))
        one = n.crossJoin(F.broadcast(waits.agg(F.count("*").alias("n_defer"))))  # one row each
        return one.select(F.lit(f"{connector}-{self.now}").alias("batch_id"), F.lit(connector).alias("connector"), "n_insert", "n_update", "n_delete", "n_defer", F.lit(errors).cast("bigint").alias("n_error"), F.lit(self.now).cast("bigint").alias("snapshot_at"))

    def _new_marks(self, m: Member, new: DataFrame, marks: DataFrame) -> DataFrame | None:
        """The watermarks with the source's greatest one, by number where it is one; None if no row has any."""
        mark = F.col(m.watermark).cast("string")
        top = new.where(mark.isNotNull()).select(F.max_by(mark, F.struct(F.coalesce(mark.try_cast("double"), F.lit(0.0)), mark)).alias("mark")).first()["mark"]
        return None if top is None else delta.upsert(marks, self.spark.createDataFrame([(m.connector, m.entity, top)], MARKS), ["connector", "entity"])

    def _acts(self, rows: DataFrame, m: Member, mine: DataFrame, known: DataFrame, fields: Sequence[str], waiting: DataFrame) -> DataFrame:
        """``(external_id, action)`` without the skips: a row that fails the filter is cleared, an echo is a skip unless it waits."""
        have = [f for f in fields if f in rows.columns]
        was = self._wide(mine, have).drop("connector") if have else mine.select("external_id").distinct()
        # what was delivered to a system is known before the system is read
        old = known.select("external_id", "deleted_at").join(was.select("external_id", delta.text_of(have).alias("old")), "external_id", "full").select("external_id", "old", F.col("deleted_at").isNotNull().alias("dead"), F.lit(True).alias("known"))
        again = waiting.select("external_id").distinct().withColumn("again", F.lit(True))
        both = rows.select("external_id", "gone", "passes", delta.text_of(have, {f.target: f.normalize.replace("v", f"`{f.target}`") for f in m.fields if f.normalize == "v"}).alias("new")).join(old, "external_id", "left").join(again, "external_id", "left")
        alive = F.col("known") & ~F.col("dead")
        action = (
            F.when(F.col("gone"), F.when(alive, "delete").otherwise("skip")).when(~F.col("passes"), F.when(F.col("known"), "clear").otherwise("skip"))
            .when(F.col("known").isNull(), "insert").when(F.col("dead"), "resurrect").when((F.col("old") == F.col("new")) & F.col("again").isNull(), "skip").otherwise("update")
        )
        return both.select("external_id", F.coalesce(action, F.lit("skip")).alias("action")).where("action <> 'skip'")

    def _identified(self, channel: str, connector: str, acts: DataFrame, rows: DataFrame, facts: DataFrame, links: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Links after the pass: all canonicals that new rows meet are merged, but for pairs that must not meet."""
        groups = self.channels[channel].identity
        new = acts.where("action = 'insert'").join(links.where(F.col("connector") == connector), "external_id", "left_anti").join(rows, "external_id").withColumn("connector", F.lit(connector))
        others = self._wide(facts.where(F.col("connector") != connector), fields).join(links, ["connector", "external_id"])
        keyed = identity.keys(others.withColumn("node", F.col("canonical_id")), groups).withColumnRenamed("node", "canonical_id")
        hits = materialise(state_joins.probe(identity.keys(new.withColumn("node", node_of()), groups), keyed, ["grp", "key"]), "hits")
        barred = self.table(channel, "no_link")
        both = barred.unionByName(barred.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = links.select(node_of().alias("b"), "canonical_id")
        hits = hits.join(both.withColumnRenamed("a", "node").join(at, "b").select("node", "canonical_id"), ["node", "canonical_id"], "left_anti")
        least = hits.groupBy("node").agg(F.min("canonical_id").alias("hub"))
        bridges = hits.join(least, "node").where("canonical_id <> hub").select(F.col("canonical_id").alias("a"), F.col("hub").alias("b")).distinct()
        apart = both.join(at.select(F.col("b").alias("a"), F.col("canonical_id").alias("x")), "a").join(at.withColumnRenamed("canonical_id", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        winners = connected_components(bridges.join(apart, ["a", "b"], "left_anti")).select(F.col("node").alias("canonical_id"), F.col("component").alias("winner"))
        moved = links.join(winners, "canonical_id", "left").withColumn("was", F.col("canonical_id")).withColumn("canonical_id", F.coalesce("winner", "canonical_id"))
        take = least.withColumnRenamed("hub", "canonical_id").join(winners, "canonical_id", "left").select(F.split("node", "\x01")[1].alias("external_id"), F.coalesce("winner", "canonical_id").alias("canonical_id"))
        wanted = moved.select("canonical_id", "connector", "external_id", (F.col("was") != F.col("canonical_id")).cast("int").alias("rank")).unionByName(take.select("canonical_id", F.lit(connector).alias("connector"), "external_id", F.lit(2).alias("rank")))
        wanted = wanted.unionByName(new.join(take, "external_id", "left_anti").select(identity.provisional_id(F.col("connector"), F.col("external_id")).alias("canonical_id"), "connector", "external_id", F.lit(2).alias("rank")))
        # of two records of one system the one that was there keeps the canonical, the other gets its own
        first = wanted.groupBy("canonical_id", "connector").agg(F.min_by("external_id", F.struct("rank", "external_id")).alias("keeps"))
        own = identity.provisional_id(F.col("connector"), F.col("external_id"))
        return wanted.join(first, ["canonical_id", "connector"]).select(F.when(F.col("external_id") == F.col("keeps"), F.col("canonical_id")).otherwise(own).alias("canonical_id"), "connector", "external_id")

    def _fan_out(self, channel: str, connector: str, m: Member, acts: DataFrame, fresh: DataFrame, rows: DataFrame, facts: DataFrame, records: DataFrame, links: DataFrame, ours: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What to write to whom, the references that have to wait, and the values that targets hold when it is written."""
        spec = self.channels[channel]
        there = links.where(F.col("connector").isin(*targets)).select("canonical_id", F.col("connector").alias("target"), F.col("external_id").alias("target_id"))
        every = F.explode(F.array(*(F.lit(t) for t in targets))).alias("target")
        changed = acts.where("action IN ('insert', 'update', 'resurrect')").join(ours, "external_id").select("external_id", "canonical_id", every).join(there, ["canonical_id", "target"], "left")
        changed = materialise(changed, "changed")
        key = F.concat_ws("\x01", "target", "canonical_id").alias("entity")
        born = state_joins.created_by_source(links, records)
        mine = fresh.join(changed, "external_id").join(born.where(F.col("connector") == connector).select("canonical_id", "created"), "canonical_id", "left")
        theirs = changed.where("target_id IS NOT NULL").select("canonical_id", F.col("target").alias("connector"), F.col("target_id").alias("external_id"), "target").join(facts, ["connector", "external_id"])
        theirs = theirs.join(born.select("canonical_id", F.col("connector").alias("src"), "created"), ["canonical_id", "src"], "left")
        fact = lambda df: df.select(key, "field", "val", "ts", "src", "created")
        got, waits = self._remapped(spec, resolve.decide(fact(mine), fact(theirs), spec.policy).where("accepted").drop("accepted"))
        held = fact(theirs).select("entity", "field", F.col("val").alias("has"), F.lit(True).alias("there"))
        # nothing new for a record that the target has: a skip
        news = got.join(held, ["entity", "field"], "left").where("there IS NULL OR NOT val <=> has")
        todo = changed.withColumn("entity", key).join(news.select("entity").distinct().withColumn("news", F.lit(True)), "entity", "left").where("target_id IS NULL OR news")
        todo = todo.select("target", "canonical_id", F.col("target_id").alias("external_id"), F.when(F.col("target_id").isNull(), "insert").otherwise("update").alias("action"))
        over = held.select("entity", "field", F.col("has").alias("val")).join(got.select("entity", "field"), ["entity", "field"], "left_anti").unionByName(got.select("entity", "field", "val"))
        parts = F.split("entity", "\x01")
        out = self._payloads(channel, todo, over.select(parts[0].alias("target"), parts[1].alias("canonical_id"), "field", "val"), links)
        last = self.table(channel, "written").select("canonical_id", F.col("connector").alias("target"), F.col("payload").alias("last"))
        out = out.join(last, ["canonical_id", "target"], "left").where("action = 'insert' OR last IS NULL OR last <> payload").select("target", "canonical_id", "external_id", "action", F.col("last").alias("before"), "payload")
        if spec.propagate_deletes:
            gone = acts.where("action = 'delete'").join(ours, "external_id").select("canonical_id").join(there, "canonical_id")
            out = out.unionByName(gone.select("target", "canonical_id", F.col("target_id").alias("external_id"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("payload")))
        late = waits.select(parts[0].alias("target"), parts[1].alias("canonical_id")).distinct().join(ours, "canonical_id").select(F.lit(connector).alias("connector"), "external_id", "target")
        values = got.join(fact(mine).select("entity", "field", "ts", "src"), ["entity", "field"]).select(parts[0].alias("target"), parts[1].alias("canonical_id"), "field", "val", "ts", "src")
        return out, late, values

    def _remapped(self, spec: Channel, got: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Reference fields in the target's ids, over the canonical id; those that no link leads to are left out, and given too."""
        names = {f.target: f.options["entity"] for x in spec.members for f in x.fields if f.options.get("entity")}
        if not names:
            return got, got.where("false")
        got = materialise(got, "accepted")
        refs = got.where(F.col("field").isin(*names))
        parts = F.split("val", "\x01")
        edges = refs.select("entity", "field", F.split("entity", "\x01")[0].alias("target"), parts[0].alias("source"), parts[1].alias("of"), F.coalesce(parts[2], F.lit("")).alias("target_id"), "val")
        known = None
        for name, c in self.channels.items():
            for x in c.members:
                part = self.table(name, "links").where(F.col("connector") == x.connector).select("canonical_id", "connector", "external_id", F.lit(x.entity).alias("of"), F.lit(name).alias("channel"))
                known = part if known is None else known.unionByName(part)
        here = known.select(F.col("connector").alias("source"), "of", F.col("external_id").alias("target_id"), "channel", "canonical_id")
        there = known.select(F.col("connector").alias("target"), "channel", "canonical_id", F.col("external_id").alias("remapped"), F.col("of").alias("there"))
        done = edges.join(here, ["source", "of", "target_id"], "left").join(there, ["target", "channel", "canonical_id"], "left")
        done = done.withColumn("remapped", F.when(F.col("target_id") == "", F.col("target_id")).otherwise(F.col("remapped")))
        resolved = done.where("val IS NULL OR remapped IS NOT NULL").select("entity", "field", F.when(F.col("val").isNotNull(), F.concat_ws("\x01", "target", F.coalesce("there", "of"), "remapped")).alias("val"))
        return got.where(~F.col("field").isin(*names)).unionByName(resolved), done.where("val IS NOT NULL AND remapped IS NULL").select("entity")

    def _payloads(self, channel: str, todo: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
        """Actions with their payloads in each target's terms; rows that lack a required field, or fail the reverse filter, go."""
        spec, fields, out = self.channels[channel], self._fields(channel), self.spark.createDataFrame([], ACTIONS)
        wide = values.where(F.col("field").isin(*fields)).groupBy("target", "canonical_id").pivot("field", fields).agg(F.first("val"))
        for m in spec.members:
            refs = [f.target for f in m.fields if f.options.get("entity")]
            mine = todo.where(F.col("target") == m.connector).join(wide, ["target", "canonical_id"], "left")
            mine = mine.withColumns({c: F.element_at(F.split(c, "\x01"), -1) for c in refs if c in fields})
            keep = ["target", "canonical_id", "external_id", "action"]
            rows = mapping.passing(mapping.required_present(mapping.outbound(mine, m.fields, keep=keep), m.fields), m.reverse_filter)
            body = [c for c in rows.columns if c not in keep]
            out = out.unionByName(rows.select(*keep, F.lit(None).cast("string").alias("before"), (F.to_json(F.struct(*body)) if body else F.lit("{}")).alias("payload")))
        return out

    def _delivered(self, channel: str, out: DataFrame, values: DataFrame | None, facts: DataFrame, links: DataFrame, records: DataFrame) -> dict:
        """Facts, links, records and written payloads after delivery; without a writer nothing was taken.

        ``values``: ``(target, canonical_id, field, val, ts, src)``, which a target holds from now on.
        """
        written, errors = self.table(channel, "written"), 0
        if self.write is None or values is None:
            return {"facts": facts, "links": links, "records": records, "written": written, "errors": 0}
        values = materialise(values, "values")
        for target in self._connectors(channel):
            rows = out.where(F.col("target") == target)
            if rows.isEmpty():
                continue
            answer = materialise(self.write(target, rows.select("canonical_id", "external_id", "action", "payload")), "answer")
            errors += answer.where("error IS NOT NULL").count()
            ok = rows.drop("external_id").join(answer.where("error IS NULL").select("canonical_id", "external_id"), "canonical_id").withColumn("connector", F.col("target"))
            gone = ok.where("action = 'delete'").select("connector", "canonical_id", "external_id")
            put = ok.where("action <> 'delete'").select("connector", "canonical_id", "external_id", "payload")
            new = put.join(values.where(F.col("target") == target), "canonical_id").select("connector", "external_id", "field", "val", "ts", "src")
            facts = state_joins.merged_facts(facts, new, ["connector", "external_id", "field"]).join(gone.select("connector", "external_id"), ["connector", "external_id"], "left_anti")
            links = links.join(gone.select("connector", "external_id"), ["connector", "external_id"], "left_anti")  # a record that comes back is inserted anew
            links = delta.insert_ignore(links, put.select("canonical_id", "connector", "external_id"), ["canonical_id", "connector"])
            stamp = lambda df, dead: df.select("connector", "external_id", F.lit(self.now).cast("bigint").alias("created"), F.lit(dead).cast("bigint").alias("deleted_at"))
            records = delta.upsert(records, stamp(put, None).unionByName(stamp(gone, self.now)), ["connector", "external_id"], keep_first=["created"])
            written = delta.upsert(written.join(gone.select("connector", "canonical_id"), ["connector", "canonical_id"], "left_anti"), put.select("connector", "canonical_id", "payload"), ["connector", "canonical_id"])
        return {**{k: materialise(v, k) for k, v in (("facts", facts), ("links", links), ("records", records), ("written", written))}, "errors": errors}

    def _log(self, batch: str, out: DataFrame) -> DataFrame:
        return out.select(F.lit(batch).alias("batch_id"), "target", "canonical_id", "external_id", "action", "before", "payload")

    # what is known

    def clusters(self, channel: str) -> DataFrame:
        """One row for each canonical with a column for each connector, and one for each record without a link."""
        links = self.table(channel, "links")
        names = self._connectors(channel)
        loose = state_joins.leftovers(self.table(channel, "records").select("connector", "external_id"), links).select(F.lit(None).cast("string").alias("component"), *(F.when(F.col("connector") == c, F.col("external_id")).alias(c) for c in names))
        return identity.pivot(links.select(F.col("canonical_id").alias("component"), "connector", F.col("external_id").alias("node")), names).unionByName(loose)

    def seeds(self, channel: str) -> DataFrame:
        """The clusters that onboarding would make, before it is done: ``(component, <connectors>)``."""
        found = self.discover(channel)
        own = F.when(F.col("status") == "matched", F.col("component")).otherwise(node_of())
        return identity.pivot(found.select(own.alias("component"), "connector", F.col("external_id").alias("node")), self._connectors(channel))

    def dump(self, channel: str) -> dict[str, DataFrame]:
        """All tables of a channel."""
        return {name: self.table(channel, name) for name in TABLES}

    def remembered(self, connector: str) -> dict[str, str]:
        """What a connector keeps between passes."""
        return {r["key"]: r["value"] for r in self.state.read("kept", KEPT).where(F.col("connector") == connector).collect()}

    def remember(self, connector: str, **values: str | None) -> None:
        """Keep small values for a connector; None forgets one."""
        rows = self.spark.createDataFrame([(connector, k, v) for k, v in values.items()], KEPT)
        self.state.commit({"kept": materialise(delta.upsert(self.state.read("kept", KEPT), rows, ["connector", "key"]).where("value IS NOT NULL"), "kept")})

    def status(self, channel: str) -> str:
        """``ready`` if canonicals span sources, else ``collected`` if any record is known, else ``uninitialized``."""
        names = self._connectors(channel)
        if not names:
            return "uninitialized"
        own = lambda name: self.table(channel, name).where(F.col("connector").isin(*names))
        if not identity.spanning(own("links")).isEmpty():
            return "ready"
        return "uninitialized" if own("records").isEmpty() else "collected"

    def linked_sources(self, channel: str) -> list[str]:
        """Sources with a record whose canonical spans sources."""
        links = self.table(channel, "links")
        return sorted(r[0] for r in links.join(identity.spanning(links), "canonical_id", "left_semi").select("connector").distinct().collect())

    def add_source(self, channel: str, connector: str, dry_run: bool = False, propagate: bool = True) -> tuple[DataFrame, DataFrame]:
        """Bridge a collected source to the channel: ``(report, actions)``.

        The report is one row ``(n_source, n_linked, n_new, n_missing)``.  Its records are linked with all canonicals that
        they meet; the actions bring its linked records up to date, and insert what it lacks and what others lack.
        """
        fields, names = self._fields(channel), self._connectors(channel)
        facts, links = self.table(channel, "facts"), self.table(channel, "links")
        mine = facts.where(F.col("connector") == connector)
        if mine.isEmpty():
            raise ValueError(f"{connector} has no known records: ingest it with collect_only first")
        with Scratch(self.spark) as scratch:
            ids = mine.select("external_id").distinct()
            rows = self._wide(mine, fields).drop("connector")
            before = links.where(F.col("connector") != connector)
            joined = materialise(self._identified(channel, connector, ids.withColumn("action", F.lit("insert")), rows, facts, before, fields), "joined")
            ours = joined.where(F.col("connector") == connector).select("external_id", "canonical_id")
            there = joined.where(F.col("connector") != connector).select("canonical_id").distinct()
            n = lambda df: df.count()
            linked = ours.join(there, "canonical_id", "left_semi")
            report = self.spark.createDataFrame([(n(ids), n(linked), n(ours.join(there, "canonical_id", "left_anti")), n(there.join(ours, "canonical_id", "left_anti")))], "n_source bigint, n_linked bigint, n_new bigint, n_missing bigint")
            have = joined.groupBy("canonical_id").agg(F.collect_set("connector").alias("have"))
            lacks = have.select("canonical_id", F.explode(F.array_except(F.array(*(F.lit(c) for c in names)), "have")).alias("target"))
            if not propagate:
                lacks = lacks.where(F.col("target") != connector)
            own = ours.join(mine, "external_id").where("val IS NOT NULL").select("canonical_id", "field", "val", "src")
            moved = joined.where(F.col("connector") != connector).select("connector", "external_id", "canonical_id")
            best = resolve.first_non_null(facts.join(moved, ["connector", "external_id"]).select(F.col("canonical_id").alias("entity"), "field", "val", "ts", "src")).select(F.col("entity").alias("canonical_id"), "field", "val", "src")
            values = best.unionByName(own.join(best, ["canonical_id", "field"], "left_anti"))
            differs = linked.join(best, "canonical_id").join(mine.select("external_id", "field", F.col("val").alias("has")), ["external_id", "field"]).where("NOT val <=> has").select("canonical_id", "external_id").distinct()
            todo = lacks.select("target", "canonical_id", F.lit(None).cast("string").alias("external_id"), F.lit("insert").alias("action")).unionByName(differs.select(F.lit(connector).alias("target"), "canonical_id", "external_id", F.lit("update").alias("action")))
            values = todo.select("target", "canonical_id").distinct().join(values, "canonical_id").withColumn("ts", F.lit(self.now).cast("bigint"))
            out = scratch.keep(materialise(self._payloads(channel, todo, values, joined), "add"))
            if not dry_run:
                done = self._delivered(channel, out, values, facts, joined, self.table(channel, "records"))
                self._commit(channel, {k: done[k] for k in ("facts", "records", "links", "written")}, self._log(f"add-{connector}-{self.now}", out))
        return report, out

    # cuts

    def split(self, channel: str, canonical: str) -> None:
        """Every link of a canonical gets an id of its own."""
        self._commit(channel, {"links": materialise(identity.split_cluster(self.table(channel, "links"), canonical), "links")})

    def split_canonical(self, channel: str, canonical: str, connector: str) -> str:
        """Detach one connector's record, which must not meet the others again; the detached record's new canonical id."""
        links = self.table(channel, "links")
        own = links.where(F.col("canonical_id") == canonical)
        if own.where(F.col("connector") == connector).isEmpty():
            raise ValueError(f"{canonical} has no link to {connector}")
        if own.where(F.col("connector") != connector).isEmpty():
            raise ValueError(f"{connector} is the only link of {canonical}")
        out, _ = identity.split_one(links, canonical, connector)
        pairs = own.where(F.col("connector") == connector).select("canonical_id", node_of().alias("a")).join(own.where(F.col("connector") != connector).select("canonical_id", node_of().alias("b")), "canonical_id").select("a", "b")
        self._commit(channel, {"links": materialise(out, "links"), "no_link": materialise(self.table(channel, "no_link").unionByName(pairs).distinct(), "no-link")})
        return f"{canonical}/{connector}"

    def remove_no_link(self, channel: str, a: tuple[str, str], b: tuple[str, str]) -> None:
        """Let two records ``(connector, id)`` meet again; the order doesn't matter, and a pair that isn't there is no error."""
        x, y = "\x01".join(a), "\x01".join(b)
        hit = ((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x))
        self._commit(channel, {"no_link": materialise(self.table(channel, "no_link").where(~hit), "no-link")})
