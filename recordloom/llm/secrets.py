"""Secret scans with SQL functions only.

Base spans come from three patterns (assignments, access keys, long hex runs).  The method adds tokens that look
random: character Markov models of random strings and of ordinary identifiers, both as transition counts over 80
characters, interpolated with the counts of single characters, are compared by log-likelihood ratio; a token counts as a secret if the ratio outweighs the prior odds.
The labels are what the base patterns find (random) and other words of at least eight characters (ordinary), in a
sample of at most ``sample_docs`` documents chosen by a hash of their ids.

Spans are found without leaving the JVM: ``\\G(.*?)pattern`` gives each match together with the gap before it, and
running sums of their lengths are the positions in code points.  The plan has no shuffle over documents.  The 6,400
log ratios become one array literal.

A null text is empty and has no spans; a null id is kept.  Repeated rows give repeated results; without any
document the models fall back to their smoothing.  Extra columns go unless kept, so names can't clash.  A text is one row
throughout, so a long one takes memory in proportion to its bytes, and time with the square of the spans it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import texts

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of 16 and more; a shorter run holds no match
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
LOW, SPAN = 43, 80  # first character code and number of codes of the models
SAMPLE_DOCS, PRIOR_ODDS, SMOOTH, WEIGHT = 4_000, 1000.0, 0.5, 10.0


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, kind: int, least: int, group: int | None = None, quick: str | None = None) -> str:
    """SQL for ``array<struct<start,kind,end,value>>`` of the non-overlapping matches whose match (or group) has ``least`` characters.

    quick: a condition that must hold where there is any match; texts without one cost no more than that.
    """
    whole = _quote(rf"(?s)\G(.*?)({pattern})")
    part = lambda g: f"regexp_extract_all({text}, {whole}, {g})"
    group_at = 2 if group is None else group + 2
    value = part(group_at)
    rows = f"arrays_zip({part(1)}, {part(2)}, {value})"
    fold = (
        f"aggregate({rows}, named_struct('at', 0, 'found', CAST(array() AS array<struct<start:int,kind:int,end:int,value:string>>)), "
        f"(a, x) -> named_struct('at', a.at + length(x['0']) + length(x['1']), 'found', IF(length(x['2']) >= {least}, "
        f"array_append(a.found, named_struct('start', a.at + length(x['0']), 'kind', {kind}, 'end', a.at + length(x['0']) + length(x['1']), 'value', x['2'])), a.found)), a -> a.found)"
    )
    condition = quick or f"{text} rlike {_quote(pattern)}"
    return f"CASE WHEN {condition} THEN {fold} ELSE CAST(array() AS array<struct<start:int,kind:int,end:int,value:string>>) END"


def long_token(text: str = "text") -> Column:
    """Whether any token is long enough for a key, a hex run or the models; a text without one needs no closer look at these."""
    return F.expr(f"{text} rlike {_quote(TOKEN.replace(',}', '}'))}")


def base_spans(text: str = "text", long: str = "long") -> Column:
    """The base spans of a text column, by start and kind; ``long`` holds its :func:`long_token`."""
    found = [
        spans(text, ASSIGN, 0, 12, group=2, quick=f"(contains({text}, '=') OR contains({text}, ':')) AND {text} rlike {_quote(ASSIGN)}"),
        spans(text, ACCESS, 1, 18, quick=f"{long} AND contains({text}, 'AKIA')"),
        spans(text, HEX, 2, 16, quick=long),
    ]
    return F.expr(f"array_sort(concat({', '.join(found)}))")


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, computed once for each row: a generator of one row keeps them from being moved into lambdas."""
    return df.select(F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _chars(value: str) -> str:
    return f"split({value}, '')"


def transitions(values: DataFrame) -> DataFrame:
    """``(label, pair, n)``: how often each pair of adjacent characters occurs, over characters the models know."""
    chars = _fixed(values, label=F.col("label"), c=F.expr(_chars("value")))
    pairs = chars.select("label", F.expr(f"transform(sequence(0, size(c) - 2), i -> (ascii(c[i]) - {LOW}) * {SPAN} + ascii(c[i + 1]) - {LOW})").alias("p"))
    return pairs.select("label", F.explode("p").alias("pair")).where(f"pair between 0 and {SPAN * SPAN - 1}").groupBy("label", "pair").agg(F.count("*").alias("n"))


def training_values(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(label, value)`` from a bounded sample of ``(id, text)``: secrets of the base patterns, and other long words."""
    total = docs.count()
    thin = docs if total <= sample_docs else docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil((1 << 40) * sample_docs / total))
    base = _fixed(_fixed(thin, text=F.col("text"), long=long_token()), text=F.col("text"), b=base_spans())
    random = base.where("size(b) > 0").select(F.lit("random").alias("label"), F.explode("b.value").alias("value"))
    # words that no base span of the text contains, with two digits at most
    ordinary = base.select(F.expr(r"filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{7,}', 0), w -> length(translate(w, '0123456789', '')) >= length(w) - 2 AND NOT exists(b, s -> contains(s.value, w)))").alias("w"))
    return random.where(r"value rlike '^[A-Za-z0-9+/_=.-]{2,}$'").unionByName(ordinary.select(F.lit("ordinary").alias("label"), F.explode("w").alias("value")))


def log_ratios(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, smooth: float = SMOOTH) -> list[float]:
    """Of every pair of characters: log of its probability among random strings over that among ordinary ones."""
    counts = {"random": [0.0] * (SPAN * SPAN), "ordinary": [0.0] * (SPAN * SPAN)}
    for r in transitions(training_values(docs, sample_docs)).collect():  # at most two rows for each pair of characters
        counts[r["label"]][r["pair"]] += r["n"]
    logs = {}
    for label, n in counts.items():
        single = [sum(n[b::SPAN]) + smooth for b in range(SPAN)]
        single = [x / sum(single) for x in single]
        rows = [sum(n[a * SPAN : (a + 1) * SPAN]) for a in range(SPAN)]
        logs[label] = [math.log((n[a * SPAN + b] + WEIGHT * single[b]) / (rows[a] + WEIGHT)) for a in range(SPAN) for b in range(SPAN)]
    return [x - y for x, y in zip(logs["random"], logs["ordinary"], strict=True)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, prior_odds: float = PRIOR_ODDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, *keep, base, spans)``: all base spans, and these with the method's; spans have start, kind, end and value."""
    docs = texts(df, id_col, text_col) if not keep else df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    kept = {c: F.col(c) for c in keep}
    table = ",".join(f"{x:.5f}" for x in log_ratios(docs, sample_docs))
    ratio = (
        f"aggregate({_chars('s.value')}, named_struct('last', -1, 'sum', 0D), (a, c) -> named_struct('last', ascii(c) - {LOW}, "
        f"'sum', a.sum + IF(a.last < 0, 0D, get(ratios, a.last * {SPAN} + ascii(c) - {LOW}))), a -> a.sum)"
    )
    docs = _fixed(docs, id=F.col("id"), text=F.col("text"), **kept, long=long_token())
    found = _fixed(docs, id=F.col("id"), text=F.col("text"), **kept, base=base_spans(), tokens=F.expr(spans("text", TOKEN, 3, 16, quick="long")))
    ratios = f"CAST(split('{table}', ',') AS array<double>)"
    extra = f"filter(tokens, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end) AND {ratio.replace('get(ratios', f'get({ratios}')} > {math.log(prior_odds)}D)"
    return found.select("id", "text", *keep, "base", F.expr(f"CASE WHEN size(tokens) = 0 THEN base ELSE array_sort(concat(base, {extra})) END").alias("spans"))


def joined(column: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their checksum, and all spans, of every text."""
    n = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS bigint)")
    return scan(docs).select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(df: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, *keep, changed)`` with every stretch that spans cover replaced by ``mark``; other texts stay as they are."""
    merged = (
        "aggregate(spans, CAST(array() AS array<struct<s:int,e:int>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).e >= x.start "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.end)))) "
        "ELSE array_append(a, named_struct('s', x.start, 'e', x.end)) END)"
    )
    put = f"aggregate({merged}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), '{mark}')), a -> concat(a.out, substring(text, a.at + 1)))"
    return scan(df, id_col, text_col, keep=keep).select("id", F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE {put} END").alias("text"), *keep, F.expr("size(spans) > 0").alias("changed"))
