"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A document's set is its distinct 5-word shingles.  Documents with equal sets form a class and are searched once.
Two classes link when ``100 * intersection >= 80 * union``, which needs ``T = ceil(0.8 n)`` common shingles of a
set of ``n``.

*Who can meet.*  With shingles ordered by hash, linked sets share at least ``floor(0.05 * ceil(0.8 n)) + 1`` of their
first ``n - T + floor(0.05 n) + 1`` shingles (the prefix filter with longer prefixes).  A class with fewer shared
prefix shingles links with nothing.  Of the shared ones, the most frequent may be left out but for one less than that
number; two linked classes still share one of the rest.  Classes that share one, directly or over others, form a
candidate group (connected components); nothing outside a group can link with a class in it.

A group of more than ``group_most`` classes is held together by passages that many documents share.  Its classes are
grouped anew by all their shingles, of which the rarest ``n - T + 1`` decide; what remains larger is near copies.

*Search.*  A task holds the inverted lists of a group and asks each class as a query: the longest lists are set
aside, a heap merges the short ones and skips what can't reach the threshold, and candidates are probed in the long
lists by binary search, however long the lists are; equal lists are one with their number.  A query first tries two documents of its rarest list directly, which
connects most near copies.  Candidates that are already connected with the query are skipped, so a group of near copies
costs one check per document and no pairs leave the task, only a spanning forest.

A group that is still larger is dealt over tasks: by bands of set sizes (linked sets are in one or
in neighbouring bands) and blocks of a band; a task holds a block and sees the queries of its band and of the next
larger one as a stream.

All columns but the id and the text go, so names can't clash; the memory of a long text is that of
:mod:`recordloom.llm.words`.  Lower case is for A to Z only.  Texts with fewer than five words have their whole word sequence as one shingle; a
null text, or one without words, has an empty set and links with nothing.  Repeated rows are copies of each other.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import texts, tidy
from recordloom.llm.words import Batch, chunks, mix
from recordloom.operators.components import connected_components
from recordloom.state.shared import materialise

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
GROUP_MOST = 500
MU = 0.0085  # DivideSkip's weight of merging against probing


def shingle_sets(data: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    b = Batch.of(data, fold=True)
    runs = b.runs(k)
    out = []
    for a, n in zip(b.first.tolist(), b.count.tolist(), strict=True):
        if n >= k:
            x = np.sort(runs[a : a + n - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            out.append(_short(b.hashes[a : a + n]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _short(h: np.ndarray) -> np.ndarray:
    x = np.zeros(1, np.uint64)
    for w in h:
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
    return x


def least_overlap(n: int) -> int:
    """Common shingles that any partner of a set of ``n`` must have."""
    return -(-NUMERATOR * n // DENOMINATOR)


def depth(n: int) -> int:
    return n // 20 + 1


def prefix(n: int) -> int:
    return min(n, n - least_overlap(n) + depth(n))


def needed(n: int) -> int:
    return depth(least_overlap(n))


def linked(common: int, a: int, b: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def _signatures(df: DataFrame, salt: int) -> DataFrame:
    """``(id, k, n, c, c2, prefix)`` of each text: a hash of it, size of its set, two hashes of the set, and its first shingles."""

    def each(batches):
        for b in batches:
            sets = [s for _, data in chunks(x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()) for s in shingle_sets(data)]
            one = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(salt + 1)))) if len(s) else 0 for s in sets]
            two = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            first = [s[: prefix(len(s))].astype(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(one, np.uint64).astype(np.int64)), pa.array(np.array(two, np.uint64).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *first])))],
                ["id", "k", "n", "c", "c2", "prefix"],
            )

    return df.mapInArrow(tidy(each), f"id {df.schema['id'].dataType.simpleString()}, k bigint, n bigint, c bigint, c2 bigint, prefix array<bigint>")


def classes(df: DataFrame) -> DataFrame:
    """Signatures of all rows, written; hashed anew in the unlikely case that two sets share a hash."""
    for salt in range(4):
        docs = materialise(_signatures(df, salt), "shingles")
        if docs.where("n > 0").groupBy("c").agg((F.min("c2") != F.max("c2")).alias("clash")).where("clash").isEmpty():
            return docs
    raise RuntimeError("set hashes keep clashing")


def candidate_groups(first: DataFrame, need: Column) -> DataFrame:
    """``(c, g)``: classes that may have partners and their candidate group, from ``(c, n, h)``: shingles of which linked classes share ``need``.

    Of a class's shared shingles the rarest decide: all but ``need`` less one.
    """
    # a shingle of copies of one class only is not shared
    shared = first.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("h", "df")
    rows = first.join(shared, "h").groupBy("c", "n").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("s"))
    rare = rows.withColumn("keep", (F.size("s") - need + 1).cast("int")).where("keep > 0").select("c", F.explode(F.expr("slice(s, 1, keep).h")).alias("h"))
    rare = materialise(rare, "postings")
    hubs = rare.groupBy("h").agg(F.min("c").alias("hub"), F.max("c").alias("far")).where("hub <> far").select("h", "hub")
    edges = rare.join(hubs, "h").select("c", "hub").distinct()
    return connected_components(edges, "c", "hub").select(F.col("node").alias("c"), F.col("component").alias("g"))


def _all_shingles(df: DataFrame) -> DataFrame:
    """``(c, n, h)``: every shingle of the texts of ``(c, text)``."""

    def each(batches):
        for b in batches:
            for at, data in chunks(x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()):
                sets = shingle_sets(data)
                size = np.array([len(s) for s in sets])
                own = pa.array(np.repeat(np.arange(len(sets)) + at, size))
                yield pa.RecordBatch.from_arrays([b.column("c").take(own), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets).astype(np.int64))], ["c", "n", "h"])

    return df.mapInArrow(tidy(each), "c bigint, n bigint, h bigint")


def grouped(docs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], group_most: int) -> DataFrame:
    """``(c, g)`` by prefixes; groups of more than ``group_most`` classes, which common passages hold together, anew by all shingles.

    Of all its shingles a class needs only its rarest fifth to meet every partner, and passages that many share are not
    among these.
    """
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    groups = materialise(candidate_groups(docs.where("n > 0").select("c", "n", F.explode("prefix").alias("h")), F.floor(least / 20) + 1), "groups")
    size = groups.groupBy("g").agg(F.count("*").alias("m"))
    wide = groups.join(size.where(F.col("m") > group_most), "g").select("c")
    if wide.isEmpty():
        return groups
    finer = candidate_groups(materialise(_all_shingles(texts_of(wide)), "all-shingles"), least)
    return materialise(groups.join(size.where(F.col("m") <= group_most), "g").select("c", "g").unionByName(finer), "finer")


class Lists:
    """Inverted lists of sets in order of size; positions in that order are the documents' numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        d = np.repeat(np.arange(len(sets), dtype=np.int64), self.size)
        order = np.lexsort((d, h))
        h, self.docs = h[order], d[order]
        self.start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        self.key = h[self.start]
        self.end = np.append(self.start[1:], len(h))
        self.root = np.arange(len(sets))

    def of(self, s: np.ndarray, most: int) -> np.ndarray:
        """The numbers of the lists of a set's shingles that begin before document ``most``."""
        at = np.searchsorted(self.key, s)
        at = at[(at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == s)]
        return at[self.docs[self.start[at]] < most]

    def cut(self, at: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some lists for which ``free`` holds, list by list, and where each list that has any begins."""
        size = self.end[at] - self.start[at]
        before = np.cumsum(size) - size
        docs = self.docs[np.repeat(self.start[at] - before, size) + np.arange(int(size.sum()))]
        keep = docs < len(free)
        keep[keep] = free[docs[keep]]
        which = np.repeat(np.arange(len(at)), size)[keep]
        return docs[keep], np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which

    def common(self, s: np.ndarray, d: int) -> int:
        t = self.sets[d]
        at = np.searchsorted(t, s)
        return int((t[np.minimum(at, len(t) - 1)] == s).sum())


def divide_skip(lists: list[list[int]], t: int, times: list[int] | None = None) -> list[tuple[int, int]]:
    """Numbers on at least ``t`` of the sorted lists, with their counts; ``times``: how many lists each stands for."""
    times = times or [1] * len(lists)
    if t < 1 or sum(times) < t:
        return []
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    most = min(t - 1, int(t / (MU * math.log(max(2, len(lists[order[-1]]))) + 1)))
    aside, cut = 0, len(order)
    while aside + times[order[cut - 1]] <= most:
        cut -= 1
        aside += times[order[cut]]
    short, weight = [lists[i] for i in order[:cut]], [times[i] for i in order[:cut]]
    long = [(lists[i], times[i]) for i in order[cut:]]
    least = t - aside
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    out = []
    while heap:
        d, popped, got = heap[0][0], [], 0
        while heap and heap[0][0] == d:
            popped.append(heapq.heappop(heap)[1])
            got += weight[popped[-1]]
        if got >= least:
            count, left = got, aside
            for x, n in long:
                if count + left < t:
                    break
                left -= n
                j = bisect_left(x, d)
                if j < len(x) and x[j] == d:
                    count += n
            if count >= t:
                out.append((d, count))
            for i in popped:
                at[i] += 1
        else:
            # documents below the next head can't be on enough lists: jump there
            while heap and got + weight[heap[0][1]] < least:
                popped.append(heapq.heappop(heap)[1])
                got += weight[popped[-1]]
            if not heap:
                break
            for i in popped:
                at[i] = bisect_left(short[i], heap[0][0], at[i])
        for i in popped:
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))
    return out


def merged(docs: np.ndarray, begin: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """The different ones of lists that lie behind each other in ``docs``, and how often each occurs; near copies share most of theirs."""
    size = np.diff(np.append(begin, len(docs)))
    name = np.add.reduceat(mix(docs.astype(np.uint64) + np.uint64(1)), begin)
    kinds: dict[tuple, int] = {}
    order = np.lexsort((name, size))
    times: list[int] = []
    heads: list[int] = []
    for i in order.tolist():
        x = docs[begin[i] : begin[i] + size[i]]
        key = (int(size[i]), int(name[i]))
        k = kinds.get(key)
        if k is not None and np.array_equal(x, docs[begin[heads[k]] : begin[heads[k]] + size[i]]):
            times[k] += 1
            continue
        kinds[key] = len(heads)
        heads.append(i)
        times.append(1)
    return [docs[begin[i] : begin[i] + size[i]].tolist() for i in heads], times


def partners(lists: Lists, s: np.ndarray, most: int, own: int | None = None) -> list[int]:
    """Documents before ``most`` that connect a query with every component of the index that it links with.

    own: the query's number, if it is in the index.  The components met are merged in ``lists.root``.
    """
    n, t = len(s), least_overlap(len(s))
    found = lists.of(s, most)
    if len(found) < t:
        return []
    out: list[int] = []
    mine: set[int] = set()

    def take(d: int) -> None:
        r = int(lists.root[d])
        if r not in mine:
            out.append(d)
            mine.add(r)

    # an owner of the rarest shingle is the likeliest partner: one check connects a near copy with all others
    rarest = found[np.argmin(lists.end[found] - lists.start[found])]
    owners = lists.docs[lists.start[rarest] : lists.end[rarest]]
    owners = owners[: int(np.searchsorted(owners, most))]
    for d in dict.fromkeys((int(owners[-1]), int(owners[0]))):
        if int(lists.root[d]) not in mine and linked(lists.common(s, d), n, int(lists.size[d])):
            take(d)
    free = ~np.isin(lists.root[:most], list(mine))
    free[: int(np.searchsorted(lists.size[:most], t))] = False
    if free.any():
        docs, begin = lists.cut(found, free)
        if len(begin) >= t:
            lists_of, times = merged(docs, begin)
            for d, common in divide_skip(lists_of, t, times):
                if linked(common, n, int(lists.size[d])):
                    take(d)
    if own is not None:
        mine.add(int(lists.root[own]))
    if len(mine) > 1:
        lists.root[np.isin(lists.root, list(mine))] = min(mine)
    return out


def _search(batches):
    """Rows come sorted by group, band, block and role: 0 is in the index, 1 a query, 2 both."""
    group, index, names, lists = None, [], [], None
    out: list[tuple[int, int, bool]] = []

    def own_links(final: bool) -> Lists:
        """Search what is held against itself; of a whole group the components are final."""
        order = sorted(range(len(index)), key=lambda i: (len(index[i]), names[i]))
        index[:], names[:] = [index[i] for i in order], [names[i] for i in order]
        made = Lists(index)
        for i in range(1, len(index)):
            partners(made, index[i], i, i)
        least: dict[int, int] = {}
        for c, r in zip(names, made.root.tolist(), strict=True):
            least[r] = min(least.get(r, c), c)
        out.extend((c, least[r], final) for c, r in zip(names, made.root.tolist(), strict=True) if least[r] != c)
        return made

    def batch():
        got = out[:]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.bool_())], ["a", "b", "final"])

    whole, held = False, set()
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("g", "band", "block", "role", "c")]
        sets = [s for _, data in chunks(x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()) for s in shingle_sets(data)]
        for g, band, block, role, c, s in zip(*cols, sets, strict=True):
            if (g, band, block) != group:
                if len(names) > 1 and lists is None:
                    own_links(whole)
                group, index, names, lists, whole = (g, band, block), [], [], None, role == 2
            if role != 1:
                if not names or c != names[-1]:
                    index.append(s)
                    names.append(c)
                continue
            if not index:
                continue
            if lists is None:
                lists = own_links(False)
                held = set(names)
            if c in held:
                continue
            # smaller sets, and of equal ones those with a smaller name
            most = int(np.searchsorted(lists.size, len(s)))
            while most < len(names) and lists.size[most] == len(s) and names[most] < c:
                most += 1
            out.extend((c, names[d], False) for d in partners(lists, s, most))
        if len(out) >= 10_000:
            yield batch()
    if len(names) > 1 and lists is None:
        own_links(whole)
    if out:
        yield batch()


def links(df: DataFrame, docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """``(a, b, final)``: a spanning forest of the links between classes; final ones lead from a class to the least of its component."""
    spark = df.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = docs.where("n > 0").groupBy("c").agg(F.min(F.struct("id", "k")).alias("h"), F.min("n").alias("n")).select("c", F.col("h.id").alias("head"), F.col("h.k").alias("head_k"), "n")

    def with_text(rows: DataFrame) -> DataFrame:
        """One text of each class: an id may be null, or stand for several texts."""
        return rows.join(df, (rows["head_k"] == df["k"]) & rows["head"].eqNullSafe(df["id"]))

    groups = grouped(docs, lambda wide: with_text(wide.join(heads, "c")).select("c", "text"), group_most)
    members = groups.join(heads, "c")
    size = groups.groupBy("g").agg(F.count("*").alias("m"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int")
    members = members.join(size, "g").withColumn("band", F.when(F.col("m") > group_most, band).otherwise(-1))
    # blocks of the bands of large groups only
    blocks = members.where("band >= 0").groupBy("g", "band").agg(F.ceil(F.count("*") / group_most).cast("int").alias("blocks"))
    small = members.where("band < 0").select("g", "band", F.lit(0).alias("block"), F.lit(2).alias("role"), "c", "head", "head_k")
    large = members.where("band >= 0").select("g", "band", "c", "head", "head_k")
    held = large.join(blocks, ["g", "band"]).select("g", "band", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "c", "head", "head_k")
    asked = large.withColumn("band", F.explode(F.array("band", F.col("band") - 1, F.col("band") - 2))).join(blocks, ["g", "band"])
    asked = asked.select("g", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "c", "head", "head_k")
    members = small.union(held).union(asked)
    rows = with_text(members).repartition(parts, "g", "band", "block").sortWithinPartitions("g", "band", "block", "role", "c")
    return rows.select("g", "band", "block", "role", "c", "text").mapInArrow(tidy(_search), "a bigint, b bigint, final boolean")


def _members(df: DataFrame, group_most: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows of ``(id, text)``, and ``(id, k, n, component)`` of those with shingles; k is the text's hash."""
    src = df.withColumn("k", F.xxhash64("text"))
    docs = classes(src)
    found = materialise(links(src, docs, group_most), "forest")
    comp = found.where("final").select(F.col("a").alias("c"), F.col("b").alias("component"))
    loose = found.where("NOT final")
    if not loose.isEmpty():  # groups dealt over several tasks
        comp = comp.unionByName(connected_components(loose).select(F.col("node").alias("c"), "component"))
    return docs, docs.where("n > 0").select("id", "k", "n", "c").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row; the component is the least id that links reach."""
    docs, rows = _members(texts(df, id_col, text_col), group_most)
    least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    full = rows.join(least, "component").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return full.unionByName(docs.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """``(id, k)`` of the first row of each component: least id, null last, then least hash ``k`` of the text; a row without words is its own."""
    docs, rows = _members(texts(df, id_col, text_col), group_most)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "k")).alias("of")).select("of.id", "of.k")
    return first.unionByName(docs.where("n = 0").select("id", "k"))
