"""A corpus pipeline of five stages: language ID, near-duplicates, repeated passages, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.  Each is written
as Parquet and read again before the next.

Each stage holds the columns of ``documents`` only, so extra columns go and can't clash; null and repeated ids, ties and
repeated rows have a defined result (below), an empty table gives an empty one, and a long text takes memory as the
stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import jaccard_join, language_id, packing, secrets, substring_dedup
from recordloom.state.shared import Scratch, drop, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any language go (null, or without a letter); a null label becomes the prediction.  Rows are independent, so repeated ones and ids, null ones too, stay as they are.

    Nothing goes by the prediction itself.  With nothing to learn from, texts with letters stay and null labels stay null.
    """
    net = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select(*COLUMNS), net, keep=COLUMNS, unlearned=None).where("lang_pred IS NULL OR score > 0")
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the least id (null last), of one id that of the least text hash.

    Rows of one id and one text count as one; of their other columns the least stay.
    """
    own = {"h": F.xxhash64("doc_id", F.col("doc_id").isNull()), "k": F.xxhash64(F.coalesce("text", F.lit("")))}
    stay = jaccard_join.firsts(docs).select(F.col("id").alias("doc_id"), "k").withColumn("h", own["h"]).select("h", "k").distinct()
    rows = docs.select(*COLUMNS).withColumns(own).join(stay, ["h", "k"], "left_semi")
    # hashes deal the rows, but only rows of equal ids and texts are one
    one = rows.groupBy("h", "k", "doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("of"))
    return one.select("doc_id", "text", "of.lang", "of.source", "of.n_chars")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut, at all their places, so ties don't matter; a document of which nothing is left goes.  A null text stays null; rows of one id and text are places of their own."""
    marked = docs.select(*COLUMNS, F.col("text").isNotNull().alias("given"))
    out = substring_dedup.dedup(marked, keep=("lang", "source", "n_chars", "given")).where("text <> '' OR n_removed = 0")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("given"), F.col("text")).alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.  Rows are independent; a null text becomes empty."""
    return secrets.redact(docs.select(*COLUMNS), keep=("lang", "source", "n_chars")).select(F.col("id").alias("doc_id"), "text", "lang", "source", F.when(F.col("changed"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.  Rows of one id are packed as documents of their own; a null text is empty."""
    return packing.pack(docs)


STAGES = [("language ID", identified), ("n-gram Jaccard join", distinct_documents), ("substring dedup", without_repeats), ("secret scans", without_secrets), ("packing", packed)]
#: Language ID, the automata and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with Scratch(spark) as scratch:  # what a stage wrote on its way goes when its result is written
            docs = scratch.keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if last is not None:
            drop(last)
        last = docs
    return docs
