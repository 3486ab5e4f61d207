"""Sinks: merged snapshots, audit rows, Kafka messages, triple updates, JDBC upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.delta import changed_fields, upsert
from recordloom.operators.stats import error_rate

#: What request logs must not show.
SECRETS = r'(?i)("?(?:authorization|api[-_]?key|token|password|secret)"?\s*[:=]\s*"?)[^"&\s,}]+'


def next_mark(state: DataFrame, column: str) -> DataFrame:
    """One row ``(mark)``: the greatest whole-number watermark and one; null if a value is no whole number (time is the mark then)."""
    n = F.col(column).try_cast("bigint")
    whole = F.count_if(F.col(column).isNotNull() & n.isNull()) == 0
    return state.agg(F.when(whole, F.coalesce(F.max(n), F.lit(0)) + 1).alias("mark"))


def marked(state: DataFrame, delta: DataFrame, column: str, now: str) -> DataFrame:
    """Rows to write with the next watermark of the state: a number, else the time."""
    one = F.broadcast(next_mark(state, column))  # one row
    return delta.crossJoin(one).withColumn(column, F.coalesce(F.col("mark").cast("string"), F.lit(now))).drop("mark")


def write_json_snapshot(state: DataFrame, delta: DataFrame, key: str, path: str, watermark: str | None = None, now: str = "") -> None:
    """The merged snapshot as JSON lines, to a path that ``state`` isn't read from; new rows get the next watermark."""
    upsert(state, delta if watermark is None else marked(state, delta, watermark, now), [key]).write.mode("overwrite").json(path)


def inserted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(ord, id, error)`` in the order of ``ord``: what an insert answers; an id is made of the row where it has none, so a second try gives it again."""
    made = F.substring(F.sha2(F.concat_ws("\x01", F.lit(key), F.to_json(F.struct(*fields))), 256), 1, 32)
    empty = F.forall(F.array(*(F.col(f).cast("string") for f in fields)), lambda x: x.isNull())
    return rows.select("ord", F.coalesce(F.col(key).cast("string"), made).alias("id"), F.when(empty, "no data").alias("error"))


def patched(state: DataFrame, delta: DataFrame, key: str, given: str = "given") -> tuple[DataFrame, DataFrame]:
    """State with the fields that each row names in ``given`` overwritten, by null too; and the keys that the state lacks."""
    new = delta.select(key, F.col(given).alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in state.columns if c != key and c in delta.columns))
    pick = lambda c: F.when(F.array_contains("_given", F.lit(c)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in new.columns else F.col(c)
    out = state.join(new, key, "left").select(key, *(pick(c) for c in state.columns if c != key)).select(*state.columns)
    return out, delta.select(key).join(state.select(key), key, "left_anti")


def removed(state: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """State without some keys, and of each asked key whether it was not found."""
    asked = ids.select(key).distinct()
    return state.join(asked, key, "left_anti"), asked.join(state.select(key).distinct().withColumn("here", F.lit(True)), key, "left").select(key, F.col("here").isNull().alias("not_found"))


def rdf_term(value: Column, base: str) -> Column:
    """A value as a term: an IRI, a number or boolean as it stands, ``ref:`` a minted IRI, other text as an escaped literal."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    plain = value.rlike(r"^(-?[0-9]+(\.[0-9]+)?|true|false)$")
    return F.when(value.rlike("^https?://[^<>\"{}|^`\\x00-\\x20]*$"), F.concat(F.lit("<"), value, F.lit(">"))).when(value.startswith("ref:"), minted(F.substring(value, 5, 1 << 30), base)).when(plain, value).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def minted(id_: Column, base: str) -> Column:
    """The IRI of an id below a base, with what an IRI can't hold encoded; an id that is one stays."""
    return F.when(id_.rlike("^https?://"), F.concat(F.lit("<"), id_, F.lit(">"))).otherwise(F.concat(F.lit(f"<{base}"), F.url_encode(id_), F.lit(">")))


def as_triples(rows: DataFrame, key: str, kind: str, fields: dict[str, str], base: str) -> DataFrame:
    """``(s, p, o)`` of records as terms; ``fields``: predicate by column; a null gives none."""
    pairs = F.array(F.struct(F.lit("a").alias("p"), F.lit(kind).alias("o")), *(F.struct(F.lit(p).alias("p"), rdf_term(F.col(c).cast("string"), base).alias("o")) for c, p in fields.items()))
    return rows.select(minted(F.col(key).cast("string"), base).alias("s"), F.inline(F.filter(pairs, lambda x: x["o"].isNotNull())))


def breaker_events(results: DataFrame, by: str, order: list[str], failed: str, **limits) -> DataFrame:
    """``(by, *order, state)``: each change of a breaker's state, to be appended to its log."""
    rows = error_rate(results, by, order, failed, **limits)
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("was", F.coalesce(F.lag("open").over(w), F.lit(False))).where("open <> was").select(by, *order, F.when(F.col("open"), "OPEN").otherwise("CLOSED").alias("state"))


def audit(delta: DataFrame, state: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, before, after)`` as JSON of the changed fields only."""
    rows = changed_fields(delta, state, key, fields)
    pairs = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c)))), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg(pairs("before").alias("before"), pairs("after").alias("after"))


def kafka_messages(delta: DataFrame, key: str, fields: list[str], action: str = "action") -> DataFrame:
    """``(key, value, op)``: the row as JSON; a delete has a null value."""
    gone = F.col(action) == "delete"
    return delta.select(F.col(key).cast("string").alias("key"), F.when(~gone, F.to_json(F.struct(*fields))).alias("value"), F.col(action).alias("op"))


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    headers = F.array(F.struct(F.lit("op").alias("key"), F.col("op").cast("binary").alias("value")))
    messages.select("key", "value", headers.alias("headers")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "gzip").option("includeHeaders", "true").option("topic", topic).save()


def update_triples(triples: DataFrame, patch: DataFrame) -> DataFrame:
    """Triples after a partial update: what the patch sets replaces all values of that subject and predicate."""
    kept = triples.join(patch.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return kept.unionByName(patch.where("o is not null").select(*triples.columns))


def delete_subjects(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    return triples.join(subjects.select("s").distinct(), "s", "left_anti")


def write_jdbc(delta: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    delta.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def journal(requests: DataFrame, most: int = 65536) -> DataFrame:
    """Request log rows with secrets masked and bodies cut; a request without an answer has status -1."""
    masked = F.substring(F.regexp_replace("body", SECRETS, "$1***"), 1, most)
    return requests.withColumn("body", masked).withColumn("status", F.coalesce("status", F.lit(-1)))
