"""Substring dedup: repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  The steps:

1. *Seeds.*  In every run of windows, the least hash of an 8-word phrase is chosen, ties included, so that equal
   windows choose equal phrases (about one word in fifteen begins a seed).  Seeds that occur once anywhere end here:
   no window that chooses them can be repeated.
2. *Stretches.*  Every document is read again and cut into stretches: the words of at most ``RUN`` windows in a row that
   choose the same repeated seed.
3. *Confirm.*  Windows that recur are found, and joined to passages: windows that always follow each other, at each of
   their places, are one passage.  Every recurring window lies in exactly one passage, which is kept once, as words.
4. *Automata.*  Passages are compiled into sharded pyahocorasick automata over exact words, and the stretches of all
   documents are streamed through the automata of their seeds.  Places are what the automata find, and nothing else.
5. *Remove.*  Every document is read once more with its located spans.

A shard holds whole seeds, confirms their passages from its own stretches and then streams these; a passage that its
automaton meets only once (two windows shared a hash) is dropped.  A seed of more than ``hot`` places is not held by one
task: its equal stretches are summed first, their windows are counted by two hashes (126 bits) in Spark, and passages
and stretches meet in several shards: at most ``most`` passages, dealt by the hash of their first window, with ``hot``
stretches at a time, each stretch going where its windows' passages are.  Both ways give the same spans.

A null text has no words.  Two rows with one id and one text count as two places; rows are told apart by hashes of
id and text.  Texts of fewer than ``WINDOW`` words lose nothing.  All columns but the id, the text and ``keep`` go, so
names can't clash.  A long text takes memory as :mod:`recordloom.llm.words` says.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import texts, tidy
from recordloom.llm.words import Batch, chunks, window_max, window_min
from recordloom.state.shared import materialise

WINDOW, PHRASE, HOT, MOST = 35, 8, 2_000, 20_000
SPAN = WINDOW - PHRASE + 1  # phrases of a window
RUN = 256  # windows of a stretch
SEEDS = np.int64((1 << 63) - 1)  # seeds have 63 bits; a mark is a seed and a bit for hot ones
HELD = 8 << 20  # bytes of stretches that a shard holds at a time, but for one seed's


def _encode(col: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in col.to_pylist()]


def _keyed(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, k, t)`` and the kept columns as ``keep_*``: two hashes tell rows apart."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    return texts(own, "id", "text", keep=tuple(f"keep_{c}" for c in keep)).withColumns({"k": F.xxhash64("id", "text"), "t": F.xxhash64("text", "id", F.lit(1))})


def _chosen(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a batch: its text, whether a window starts there, and the phrase hash that window chooses."""
    n = len(b.hashes)
    text = np.repeat(np.arange(len(b.count)), b.count)
    left = b.first[text] + b.count[text] - np.arange(n)
    starts = left >= WINDOW
    phrase = b.runs(PHRASE) >> np.uint64(1)
    least = window_min(phrase, SPAN)
    out = np.zeros(n, np.uint64)
    out[: len(least)] = least
    return text, starts, out


def seeds(keyed: DataFrame) -> DataFrame:
    """``(k, t, seed, n)``: the chosen phrases of every text and how often it has them."""

    def each(batches):
        for b in batches:
            k, t = b.column("k").to_numpy(), b.column("t").to_numpy()
            for at, data in chunks(_encode(b.column("text"))):
                w = Batch.of(data)
                text, starts, least = _chosen(w)
                if not starts.any():
                    continue
                # a phrase is chosen if one of the windows that hold it has it for its least
                phrase = w.runs(PHRASE) >> np.uint64(1)
                choice = np.where(starts, least, np.uint64(0))
                around = window_max(np.concatenate([np.zeros(SPAN - 1, np.uint64), choice]), SPAN)[: len(phrase)]
                # windows lie within their text, but the maximum also sees those of the text before, which hold none of
                # this one's phrases; what that adds is a phrase more at most
                pick = np.flatnonzero(around == phrase)
                # of a text's equal phrases one row is kept, with their number
                order = np.lexsort((phrase[pick], text[pick]))
                pick = pick[order]
                new = np.r_[True, (phrase[pick[1:]] != phrase[pick[:-1]]) | (text[pick[1:]] != text[pick[:-1]])]
                head = pick[new]
                n = np.diff(np.append(np.flatnonzero(new), len(pick)))
                doc = at + text[head]
                yield pa.RecordBatch.from_arrays([pa.array(k[doc]), pa.array(t[doc]), pa.array(phrase[head].astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "t", "seed", "n"])

    return keyed.select("text", "k", "t").mapInArrow(tidy(each), "k bigint, t bigint, seed bigint, n bigint")


def _stretches(marked: DataFrame) -> DataFrame:
    """``(seed, hot, k, t, start, words)``: the words of each run of at most ``RUN`` windows with one repeated seed."""

    def each(batches):
        for b in batches:
            k, t, marks = b.column("k").to_numpy(), b.column("t").to_numpy(), b.column("marks")
            for at, data in chunks(_encode(b.column("text"))):
                w = Batch.of(data)
                text, starts, least = _chosen(w)
                repeated = np.zeros(len(least), bool)
                heated = np.zeros(len(least), bool)
                for i in range(len(data)):
                    a, z = w.first[i], w.first[i] + w.count[i]
                    own, mark = least[a:z].astype(np.int64), marks[at + i].values.to_numpy()
                    repeated[a:z] = np.isin(own, mark >> 1 & SEEDS)
                    heated[a:z] = np.isin(own, mark[mark & 1 == 1] >> 1 & SEEDS)
                repeated &= starts
                heated &= repeated
                if not repeated.any():
                    continue
                edge = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (repeated[1:] != repeated[:-1])])
                stop = np.append(edge[1:], len(least))
                pick = repeated[edge]
                edge, stop = edge[pick], stop[pick]
                parts = -(-(stop - edge) // RUN)
                nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                edge, stop = np.repeat(edge, parts) + nth * RUN, np.repeat(stop, parts)
                stop = np.minimum(stop, edge + RUN)
                warm = heated[edge]
                split = {i: data[i].split() for i in np.unique(text[edge])}
                doc = text[edge]
                local = edge - w.first[doc]
                size = stop - edge + WINDOW - 1
                body = [b" ".join(split[d][a : a + n]) for d, a, n in zip(doc, local, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[edge].astype(np.int64)), pa.array(warm), pa.array(k[at + doc]), pa.array(t[at + doc]), pa.array(local.astype(np.int32)), pa.array(body, pa.binary())],
                    ["seed", "hot", "k", "t", "start", "words"],
                )

    return marked.mapInArrow(tidy(each), "seed bigint, hot boolean, k bigint, t bigint, start int, words binary")


def _starts(w: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window starts, and their texts."""
    text = np.repeat(np.arange(len(w.count)), w.count)
    at = np.flatnonzero(w.first[text] + w.count[text] - np.arange(len(text)) >= WINDOW)
    return at, text[at]


def passages(stretches: list[bytes], times: np.ndarray) -> list[list[bytes]]:
    """The passages of recurring windows, each once; ``times``: how often each stretch occurs.  Windows are told apart by hashes."""
    w = Batch.of(stretches)
    at, text = _starts(w)
    if not len(at):
        return []
    _, first, kind = np.unique(w.runs(WINDOW)[at], return_index=True, return_inverse=True)
    again = np.bincount(kind, weights=times[text])[kind] > 1
    near = (np.diff(at) == 1) & (text[1:] == text[:-1]) & again[1:] & again[:-1]
    after, before = np.r_[np.where(near, kind[1:], -1), -1], np.r_[-1, np.where(near, kind[:-1], -1)]
    order = np.argsort(kind, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0])
    alone = lambda x: (np.minimum.reduceat(x[order], cut) == np.maximum.reduceat(x[order], cut)) & (x[first] >= 0)
    linked = near & alone(after)[kind[:-1]] & alone(before)[kind[1:]]
    kept = again & (first[kind] == np.arange(len(kind)))
    begin = np.flatnonzero(kept & ~np.r_[False, linked & kept[:-1]])
    end = np.flatnonzero(kept & ~np.r_[linked & kept[1:], False])
    out = []
    for a, z in zip(begin.tolist(), end.tolist(), strict=True):
        i = text[a]
        out.append(stretches[i].split()[at[a] - w.first[i] : at[z] - w.first[i] + WINDOW])
    return out


class Machine:
    """An automaton of passages as sequences of exact words, which are numbered for it alone; 0 is any other word."""

    def __init__(self, found: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.sizes = [len(p) for p in found]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(found):
            self.trie.add_word(tuple([self.number.setdefault(x, len(self.number) + 1) for x in p]), i)
        if found:
            self.trie.make_automaton()

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Every place of a passage: its number and the word after it."""
        if not self.sizes:
            return []
        return [(i, last + 1) for last, i in self.trie.iter(tuple([self.number.get(x, 0) for x in words]))]

    def spans(self, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for i, z in places:
            a = z - self.sizes[i]
            while out and out[-1][1] >= a:
                b, y = out.pop()
                a, z = min(a, b), max(z, y)
            out.append((a, z))
        return out


def locate(stretches: list[bytes]) -> list[list[tuple[int, int]]]:
    """Of each stretch, the spans of words that recurring windows cover.  All places of these windows must be in the list."""
    kinds: dict[bytes, int] = {}
    own = [kinds.setdefault(x, len(kinds)) for x in stretches]
    once = list(kinds)
    times = np.bincount(own)
    machine = Machine(passages(once, times))
    found = [machine.places(x.split()) for x in once]
    met = np.zeros(len(machine.sizes), np.int64)
    for n, places in zip(times, found, strict=True):
        for i, _ in places:
            met[i] += n
    spans = [machine.spans([p for p in places if met[p[0]] > 1]) for places in found]
    return [spans[i] for i in own]


def _shard(batches):
    """Stretches come sorted by seed; whole seeds are held until there are ``HELD`` bytes."""
    wait: list[tuple] = []
    held = 0

    def flush(rows):
        found = locate([r[4] for r in rows])
        flat = [(r[1], r[2], r[3] + a, r[3] + z) for r, spans in zip(rows, found, strict=True) for a, z in spans]
        cols = list(zip(*flat, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k", "t", "a", "z"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("seed", "k", "t", "start", "words")), strict=True):
            if held >= HELD and row[0] != wait[-1][0]:
                yield flush(wait)
                wait, held = [], 0
            wait.append(row)
            held += len(row[4])
    if wait:
        yield flush(wait)


def _windows(contents: DataFrame) -> DataFrame:
    """``(seed, stretch, pos, one, two, n, after, before)``: hashes of every window of the distinct stretches, and of its neighbours (null at an end)."""

    def each(batches):
        for b in batches:
            for at, data in chunks(b.column("words").to_pylist()):
                w = Batch.of(data)
                pick, doc = _starts(w)
                one, two = w.runs(WINDOW)[pick].astype(np.int64), w.runs(WINDOW, salt=0xA5A5A5A5)[pick].astype(np.int64)
                near = (np.diff(pick) == 1) & (doc[1:] == doc[:-1])
                own = pa.array(at + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).take(own) for c in ("seed", "stretch")), pa.array((pick - w.first[doc]).astype(np.int32)), pa.array(one), pa.array(two), b.column("n").take(own),
                        pa.array(np.r_[one[1:], 0][: len(one)], mask=~np.r_[near, False][: len(one)]), pa.array(np.r_[0, one[:-1]][: len(one)], mask=~np.r_[False, near][: len(one)]),
                    ],
                    ["seed", "stretch", "pos", "one", "two", "n", "after", "before"],
                )

    return contents.mapInArrow(tidy(each), "seed bigint, stretch string, pos int, one bigint, two bigint, n bigint, after bigint, before bigint")


def _cut_passages(batches):
    """``(seed, route, words)``: passages from the recurring windows for which a stretch stands."""
    for b in batches:
        out = []
        for seed, words, places in zip(b.column("seed").to_pylist(), b.column("words").to_pylist(), b.column("places").to_pylist(), strict=True):
            split = words.split()
            places.sort(key=lambda p: p["pos"])
            begin = last = None
            for p in places:
                if last is not None and p["pos"] == last["pos"] + 1 and last["on"] and p["back"]:
                    last = p
                    continue
                if last is not None:
                    out.append((seed, begin["one"], b" ".join(split[begin["pos"] : last["pos"] + WINDOW])))
                begin = last = p
            if last is not None:
                out.append((seed, begin["one"], b" ".join(split[begin["pos"] : last["pos"] + WINDOW])))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["seed", "route", "words"])


def _stream(batches):
    """Rows come sorted by seed, shard, part and role: passages (role 0) are compiled, stretches (role 1) streamed."""
    group, found, machine = None, [], None
    for b in batches:
        out = []
        for seed, shard, part, role, stretch, words in zip(*(b.column(c).to_pylist() for c in ("seed", "shard", "part", "role", "stretch", "words")), strict=True):
            if (seed, shard, part) != group:
                group, found, machine = (seed, shard, part), [], None
            if role == 0:
                found.append(words.split())
                continue
            if machine is None:
                machine = Machine(found)
            out += [(stretch, a, z) for a, z in machine.spans(machine.places(words.split()))]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["stretch", "a", "z"])


def _hot_spans(rows: DataFrame, hot: int, most: int, parts: int) -> DataFrame:
    """``(k, t, a, z)`` of stretches of hot seeds."""
    named = rows.withColumn("stretch", F.md5("words"))
    contents = materialise(named.groupBy("seed", "stretch", "words").agg(F.count("*").alias("n")), "hot")
    windows = _windows(contents)
    only = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    many = windows.groupBy("seed", "one", "two").agg(F.sum("n").alias("n"), F.min(F.struct("stretch", "pos")).alias("at"), only("after").alias("on"), only("before").alias("back")).where("n > 1")
    found = many.groupBy("seed", F.col("at.stretch").alias("stretch")).agg(F.collect_list(F.struct("at.pos", "one", "on", "back")).alias("places"))
    found = materialise(contents.join(found, ["seed", "stretch"]).select("seed", "words", "places").mapInArrow(tidy(_cut_passages), "seed bigint, route bigint, words binary"), "passages")
    size = found.groupBy("seed").agg(F.ceil(F.count("*") / most).cast("int").alias("shards"))
    size = size.join(contents.groupBy("seed").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")), "seed")
    ask = contents.join(size, "seed").withColumn("part", F.pmod(F.xxhash64("stretch"), F.col("parts")).cast("int"))
    wide = ask.where("shards > 1")
    goes = _windows(wide.select("seed", "stretch", "words", "n")).select("seed", "stretch", "one").join(size, "seed").select("stretch", F.pmod("one", "shards").cast("int").alias("shard")).distinct()
    asked = ask.where("shards = 1").withColumn("shard", F.lit(0)).unionByName(wide.join(goes, "stretch"))
    held = found.join(size, "seed").select("seed", F.pmod("route", "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(None).cast("string").alias("stretch"), "words")
    dealt = held.unionByName(asked.select("seed", "shard", "part", F.lit(1).alias("role"), "stretch", "words"))
    spans = dealt.repartition(parts, "seed", "shard", "part").sortWithinPartitions("seed", "shard", "part", "role").mapInArrow(tidy(_stream), "stretch string, a int, z int")
    spans = spans.groupBy("stretch").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    return named.select("stretch", "k", "t", "start").join(spans, "stretch").select("k", "t", "start", F.inline("spans")).select("k", "t", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))


def repeated_spans(keyed: DataFrame, hot: int = HOT, most: int = MOST) -> DataFrame:
    """``(k, t, spans)``: of each text with recurring windows, spans of words that they cover, as ``array<struct<a,z>>``."""
    spark = keyed.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = materialise(seeds(keyed), "seeds")
    again = own.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed", (F.col("n") > hot).alias("hot"))
    marks = own.select("k", "t", "seed").join(again, "seed").groupBy("k", "t").agg(F.collect_set(F.shiftleft("seed", 1) + F.col("hot").cast("int")).alias("marks"))
    marked = keyed.select("k", "t", "text").join(marks, ["k", "t"])
    rows = materialise(_stretches(marked), "stretches")
    located = rows.where("NOT hot").select("seed", "k", "t", "start", "words").repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(tidy(_shard), "k bigint, t bigint, a int, z int")
    warm = rows.where("hot").select("seed", "words", "k", "t", "start")
    if not warm.isEmpty():
        located = located.unionByName(_hot_spans(warm, hot, most, parts))
    return located.groupBy("k", "t").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def _kept(data: bytes, spans) -> tuple[int, int, bytes]:
    words = data.split()
    if spans is None:
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["a"] : s["z"]] = False
    left = list(compress(words, keep.tolist()))
    return len(words), len(words) - len(left), b" ".join(left)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most: int = MOST, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, n_words, n_removed, text)`` of every row; the text as it was if nothing went, else the kept words joined by blanks.

    digest: ``kept_sha256`` of the kept words instead of the text.
    """
    keyed = _keyed(df, id_col, text_col, keep)
    # rows of one id and one text share their spans, which hold for each of them
    joined = keyed.join(repeated_spans(keyed.select("id", "text", "k", "t"), hot, most), ["k", "t"], "left").select("id", "text", "spans", *(f"keep_{c}" for c in keep))
    last = "kept_sha256" if digest else "text"

    def each(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                n, gone, left = _kept(text.encode("utf-8", "surrogatepass"), spans)
                out.append((n, gone, hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass") if gone else text))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(f"keep_{c}") for c in keep), pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.string())], ["id", *keep, "n_words", "n_removed", last])

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(tidy(each), f"id {keyed.schema['id'].dataType.simpleString()}{kept}, n_words bigint, n_removed bigint, {last} string")
