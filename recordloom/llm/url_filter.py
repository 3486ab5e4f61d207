"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are learned from the URLs that a rule
decides.  The probability of a character interpolates orders 0 to ``ORDER``: ``(n(context, c) + L * shorter) /
(n(context) + L)``, so a longer context weighs the more the more often it was seen.  A URL's score is the mean over
its characters of the log-likelihood difference; the threshold that separates them is calibrated on a fifth of the
labelled URLs (by hash), which the counts leave out.

Counts cover every other labelled URL, exactly: a table of (byte with the four before it, counts by class) that grows
with the URLs, from which shorter contexts are summed.  The log ratio is worked out once for each different gram of the
URLs to judge, by joins of tables of grams, and summed by URL; nothing of the model passes through the driver, and what is
broadcast has at most 65,536 rows.  A byte 0 in a URL counts as the zeros that stand before its begin.

A null URL, or one without ``://``, has an empty host and path; its text (null: empty) is still scored.  Without
labelled URLs of both kinds the method allows everything.  A URL is scored once and repeated rows share the result.  Extra
columns go, so names can't clash; a long URL takes about 100 bytes of memory a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import small_batches, tidy
from recordloom.state.shared import materialise

ORDER, WEIGHT, BINS, FREQUENT = 4, 2.0, 400, 65_536
#: Verdict and rule; the rule's host ends at its first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A to Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``(*keep, gram, n)``: the bytes of each URL with the ``ORDER`` before them as one number, zeros before its begin, and how often."""

    def each(batches):
        for b in batches:
            data = [x.encode("utf-8", "surrogatepass") for x in b.column("url").to_pylist()]
            size = np.array([len(x) for x in data], np.int64)
            raw = np.frombuffer(b"".join([bytes(ORDER) + x for x in data]), np.uint8)
            row = np.repeat(np.arange(len(data)), size + ORDER)
            at = np.arange(len(raw)) - np.repeat(np.cumsum(size + ORDER) - size - ORDER, size + ORDER)
            gram = np.zeros(len(raw), np.int64)
            for k in range(ORDER + 1):
                gram[k:] |= raw[: len(raw) - k].astype(np.int64) << 8 * k
            order = np.lexsort((gram, row))
            order = order[at[order] >= ORDER]
            row, gram = row[order], gram[order]
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]) if len(row) else np.empty(0, int)
            own = pa.array(row[cut])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(own) for c in keep), pa.array(gram[cut]), pa.array(np.diff(np.append(cut, len(row))))], [*keep, "gram", "n"])

    return df.select(*keep, "url").mapInArrow(tidy(each), ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", gram bigint, n bigint")


def ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``ratio``: log of a gram's last byte's probability among accepted URLs over that among rejected ones.

    The counts of shorter contexts are sums over ``counts``, the exact table of ``(gram, n0, n1)``.  A key of ``k`` bytes has
    at most ``256 ** (ORDER + 1 - k)`` different grams, so no key is hot.
    """
    bits = lambda k: F.lit((1 << 8 * k) - 1)
    both = (F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    out = wanted
    for k in range(ORDER + 1):
        for name, key, size in (("joint", F.col("gram").bitwiseAND(bits(k + 1)), k + 1), ("context", F.shiftright("gram", 8).bitwiseAND(bits(k)), k)):
            table = counts.groupBy(key.alias("key")).agg(*both).select("key", F.col("a").alias(f"{name}{k}_0"), F.col("b").alias(f"{name}{k}_1"))
            # at most 65,536 keys of two bytes
            out = out.withColumn("key", key).join(F.broadcast(table) if size <= 2 else table, "key", "left").drop("key")
    total = F.lit(0.0)
    for kind, sign in ((0, 1), (1, -1)):
        p = F.lit(1 / 256)
        for k in range(ORDER + 1):
            p = (F.coalesce(f"joint{k}_{kind}", F.lit(0)) + WEIGHT * p) / (F.coalesce(f"context{k}_{kind}", F.lit(0)) + WEIGHT)
        total = total + sign * F.log(p)
    return out.select(*wanted.columns, total.alias("ratio"))


def scores(used: DataFrame, ratio: DataFrame) -> DataFrame:
    """``(h, t, score)``: the mean ratio of the bytes of each URL; the ``FREQUENT`` grams on most URLs are joined without a shuffle."""
    often = F.broadcast(ratio.orderBy(F.desc("urls"), "gram").limit(FREQUENT).select("gram", F.col("ratio").alias("known")))
    first = used.join(often, "gram", "left")
    rest = first.where("known IS NULL").join(ratio.select("gram", "ratio"), "gram")
    part = lambda df, c: df.groupBy("h", "t").agg(F.sum(F.col("n") * F.col(c)).alias("sum"), F.sum("n").alias("n"))
    all_of = part(first.where("known IS NOT NULL"), "known").unionByName(part(rest, "ratio"))
    # sums of doubles depend on their order by some 1e-16; rounding keeps equal URLs and runs equal
    return all_of.groupBy("h", "t").agg(F.round(F.sum("sum") / F.sum("n"), 9).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Of ``(kind, score)``: accepted at or above it, rejected below it, with the least balanced error, nearest to 0."""
    bins = scored.groupBy("kind", F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), "score")) * (BINS / 4)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    hist = np.zeros((2, BINS + 1))
    for r in bins:
        hist[r["kind"], r["bin"] + BINS // 2] += r["n"]
    share = hist / np.maximum(1, hist.sum(1, keepdims=True))
    wrong = np.concatenate([[0], np.cumsum(share[0])[:-1]]) + (1 - np.concatenate([[0], np.cumsum(share[1])[:-1]]))
    best = min(range(BINS + 1), key=lambda i: (round(wrong[i], 9), abs(i - BINS // 2)))
    return (best - BINS // 2 - 0.5) / (BINS / 4)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` of every URL."""
    raw = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    src = raw.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    small_batches(pages.sparkSession)
    labelled = src.where("ruled is not null").select("url", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("kind"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    if labelled.groupBy("kind").count().count() < 2:
        return src.select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    urls = src.select("url").distinct().withColumns({"h": F.xxhash64("url"), "t": F.xxhash64("url", F.lit(1))})
    counts = materialise(grams(labelled.where("NOT held").select("kind", "url"), ("kind",)).groupBy("gram").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1))), "gram-counts")
    used = grams(urls, ("h", "t"))
    ratio = materialise(ratios(counts, used.groupBy("gram").agg(F.count("*").alias("urls"))), "gram-ratios")
    scored = materialise(scores(used, ratio), "url-scores")
    keyed = lambda df: df.withColumns({"h": F.xxhash64("url"), "t": F.xxhash64("url", F.lit(1))}).join(scored, ["h", "t"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    least = threshold(keyed(labelled.where("held")))
    return keyed(src).select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), "score")
