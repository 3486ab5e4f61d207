"""Packing token sequences into windows by non-negative least squares over length combinations.

Each document's ids are cut into whole windows, one part of whole blocks (128 tokens) and a remainder.  Parts of 1
to 31 blocks are combined: all shallow combinations that fill a window of 32 blocks are enumerated, non-negative
least squares finds how often each must be used to meet the histogram of lengths, and the counts are rounded down.
Remainders are combined the same way into blocks (32 units of 4 tokens), which then count as parts of one block.
What rounding leaves is packed greedily, largest first; left parts are first cut into powers of two blocks, which
fill windows exactly whatever the histogram was.

Only histograms (at most 65 numbers) come to the driver.  Pieces are ranked within their length class by task-local
counters plus offsets of task totals, so no class is gathered in one task, and a rank decides the place by interval
lookup.  The pieces are written once to the shared folder, because ranks must not change when a task runs again.

Tokens are the library's.  Words of up to 64 Latin characters are cut by the tokenizer's own pattern and remembered; words
with other letters, special strings, more characters, white space beyond ASCII or the separators 0x1C to 0x1F are encoded by
the library as they stand, with the same ids.  A long text takes memory in proportion to its bytes.

A null text is empty (it still has the end id).  Rows with one id twice are packed as two documents.  An empty
table packs into nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm.common import Memo, texts, tidy, tokenizer_path
from recordloom.llm.token_counts import byte_chars
from recordloom.state.shared import materialise

WINDOW, BLOCK, UNIT, SLOTS, DEPTH, END, LONG = 4096, 128, 4, 32, 8, 2, 64
#: Fixed value: the pre-token pattern of the word-level tokenizer.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")  # and what parts words
#: Letters whose case rules differ, white space beyond what parts words and what is such only here, special strings.
ODD = re.compile("[^\x00-\u024f]|[\x0b\x0c\x1c-\x1f\x85\xa0]|<[|]")
MARK, GROUP = b"\xff" * 4, 4 << 20
MARK, GROUP = b"\xff" * 4, 1 << 20
REMAINDER = 100  # class of a remainder of u units: REMAINDER + u; whole windows have class 0, parts their blocks


class Words:
    """Ids as the tokenizer library gives them; each word (no white space in it) is encoded by itself and remembered.

    Texts go in groups of about ``GROUP`` bytes: Arrow cuts them at ASCII white space and numbers the different words, and their
    ids are put in place by number.  Words that aren't known yet are encoded together: a line break parts them, which the
    pattern keeps as a match, and their ids by four bytes 255, which no id has.
    """

    made: dict[str, Words] = {}

    def __init__(self, path: str, memo: int = 400_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model, self.most = self.tok.model, memo
        self.write = {b: c for c, b in byte_chars().items()}
        self.pretoken = Memo(self._pretoken, memo)
        self.word: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> Words:
        if name not in cls.made:
            cls.made[name] = cls(tokenizer_path(name))
        return cls.made[name]

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, x: str) -> bytes:
        if x == "\n":
            return MARK
        if not (x.isascii() and x.isalpha()):  # letters are written as they are
            x = x.encode().decode("latin-1").translate(self.write)
        return array("I", [t.id for t in self.model.tokenize(x)]).tobytes()

    def _learn(self, words: list[str]) -> list[str]:
        """Put the ids of ``words`` into ``word``; those too long to be remembered."""
        long = [w for w in words if len(w) > LONG]
        joined = "\n".join(words)
        if long or ODD.search(joined):
            odd = [w for w in words if len(w) > LONG or ODD.search(w)]
            self.word.update((w, self.library(w)) for w in odd)
            words = [w for w in words if w not in self.word]
            joined = "\n".join(words)
        if words:
            found = WORD_PATTERN.findall(unicodedata.normalize("NFC", joined).lower())
            self.word.update(zip(words, b"".join(map(self.pretoken.__getitem__, found)).split(MARK), strict=True))
        return long

    def _group(self, texts: pa.Array) -> list[bytes]:
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in seen if w not in self.word]
        if len(self.word) + len(new) > self.most:  # forget what this group doesn't have
            self.word = {w: self.word[w] for w in seen if w in self.word}
        long = self._learn(new)
        known = [self.word[w] for w in seen]
        for w in long:  # long words are encoded, but not remembered
            del self.word[w]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), np.uint32)[np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(n.sum())]
        last = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))].tolist()
        return [ids[a:z].tobytes() for a, z in pairwise(last)]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in turn."""
        groups = np.cumsum(pc.binary_length(texts).to_numpy()) // GROUP
        starts = np.flatnonzero(np.diff(groups, prepend=-1)).tolist()
        for a, z in pairwise([*starts, len(texts)]):
            yield from self._group(texts.slice(a, z - a))

    def encode(self, text: str) -> bytes:
        return self._group(pa.array([text]))[0]


@lru_cache
def combinations(total: int = SLOTS, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` parts that sum to ``total``, and each part repeated alone; one column each."""
    out: list[list[int]] = []

    def grow(parts: list[int], rest: int, most: int) -> None:
        if not rest:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(min(most, rest), 0, -1):
                if p * (depth - len(parts)) < rest:
                    break
                grow([*parts, p], rest - p, p)

    grow([], total, total)
    out += [[p] * (total // p) for p in range(1, total) if total // p > depth]
    table = np.zeros((total + 1, len(out)))
    for j, parts in enumerate(out):
        for p in parts:
            table[p, j] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Active-set non-negative least squares of ``a x = b``."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12 * scale)
            if not low.any():
                x = s
                break
            ratio = x[low] / np.maximum(x[low] - s[low], 1e-300)
            x = x + ratio.min() * (s - x)
            drop = active & (x <= 1e-12 * scale)
            if not drop.any():
                drop = low & (x - s == (x - s)[low].max())
            x[drop] = 0
            active &= ~drop
            if not active.any():
                break
    return x


@dataclass
class Plan:
    """Templates with repeat counts; for each class, the rank intervals that fill a template's slots."""

    bins: int = 0
    rows: dict[int, list[tuple[int, int, list[int]]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def add(self, parts: list[int], times: int) -> None:
        """``times`` bins that hold ``parts``, largest first."""
        at: dict[int, list[int]] = {}
        place = 0
        for p in sorted(parts, reverse=True):
            at.setdefault(p, []).append(place)
            place += p
        for p, places in at.items():
            self.rows.setdefault(p, []).append((self.used.get(p, 0), self.bins, places))
            self.used[p] = self.used.get(p, 0) + times * len(places)
        self.bins += times

    def place(self, part: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and slot of the pieces of a class by their ranks."""
        rows = self.rows[part]
        i = np.searchsorted([r[0] for r in rows], rank, side="right") - 1
        bins, slots = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for k in np.unique(i):
            start, base, places = rows[k]
            pick = i == k
            rest = rank[pick] - start
            bins[pick], slots[pick] = base + rest // len(places), np.array(places)[rest % len(places)]
        return bins, slots


def solve(hist: dict[int, int], plan: Plan, total: int = SLOTS) -> dict[int, int]:
    """Fill ``plan`` with exact combinations; what rounding leaves of the histogram."""
    left = np.array([hist.get(p, 0) for p in range(total + 1)], np.int64)
    if left[1:].any():
        a = combinations(total)
        times = np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64)
        while ((over := (a @ times).astype(np.int64) - left) > 0).any():
            p = int(over.argmax())
            j = max(np.flatnonzero((a[p] > 0) & (times > 0)), key=lambda k: times[k])
            times[j] = max(0, times[j] - -(-int(over[p]) // int(a[p, j])))
        for j in np.flatnonzero(times):
            plan.add([p for p in range(1, total + 1) for _ in range(int(a[p, j]))], int(times[j]))
        left = left - (a @ times).astype(np.int64)
    return {p: int(n) for p, n in enumerate(left) if p and n}


def greedy(hist: dict[int, int], plan: Plan, total: int = SLOTS) -> None:
    """Pack all of ``hist`` largest first; a mix that can be had several times is added as often."""
    left = dict(hist)
    while left:
        room, parts = total, []
        for p in sorted(left, reverse=True):
            n = min(left[p], room // p)
            parts += [p] * n
            room -= p * n
        times = min(left[p] // parts.count(p) for p in set(parts))
        plan.add(parts, times)
        for p in set(parts):
            left[p] -= times * parts.count(p)
        left = {p: n for p, n in left.items() if n}


def powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


@dataclass
class Layout:
    """Where every piece goes, by class and rank."""

    windows: int
    parts: Plan
    rest: Plan
    blocks: Plan
    real_ones: int
    exact: dict[int, int]
    shift: dict[tuple[int, int], int]

    @classmethod
    def of(cls, hist: dict[int, int]) -> Layout:
        blocks = Plan()
        greedy(solve({c - REMAINDER: n for c, n in hist.items() if c > REMAINDER}, blocks), blocks)
        counts = {c: n for c, n in hist.items() if 0 < c < SLOTS}
        ones = counts.get(1, 0)
        if blocks.bins:
            counts[1] = ones + blocks.bins
        parts, rest = Plan(), Plan()
        left = solve(counts, parts)
        shift, cut = {}, {}
        for p in sorted(left):
            for b in powers(p):
                shift[p, b] = cut.get(b, 0)
                cut[b] = cut.get(b, 0) + left[p]
        greedy(cut, rest)
        return cls(hist.get(0, 0), parts, rest, blocks, ones, dict(parts.used), shift)

    def part(self, p: int, rank: np.ndarray) -> list[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
        """Of parts of ``p`` blocks: (which rows, blocks before in the part, blocks, sequence, slot)."""
        whole = rank < self.exact.get(p, 0)
        out = []
        if whole.any():
            out.append((np.flatnonzero(whole), 0, p, *self._sequence(self.parts.place(p, rank[whole]), self.windows)))
        if not whole.all():
            before = 0
            for b in powers(p):
                where = self.rest.place(b, self.shift[p, b] + rank[~whole] - self.exact.get(p, 0))
                out.append((np.flatnonzero(~whole), before, b, *self._sequence(where, self.windows + self.parts.bins)))
                before += b
        return out

    @staticmethod
    def _sequence(where: tuple[np.ndarray, np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
        return where[0] + base, where[1] * SLOTS

    def remainder(self, u: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order of remainders: their block's place as a part of one block, and their slot in the block."""
        block, slot = self.blocks.place(u, rank)
        sequence, order = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for rows, _, _, s, o in self.part(1, self.real_ones + block):
            sequence[rows], order[rows] = s, o
        return sequence, order + slot


def pieces(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Each document's pieces with class, task and rank within both; ``alt``: checksums of a part's cut into powers of two."""
    src = texts(docs)

    def each(batches):
        words = Words.of(tokenizer)
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        end = END.to_bytes(4, "little")
        for b in batches:
            rows = []
            for i, ids in enumerate(words.encode_all(b.column("text"))):
                ids += end
                n = len(ids) // 4
                cuts = [(s, WINDOW, 0) for s in range(0, n - WINDOW + 1, WINDOW)]
                at = n - n % WINDOW
                if k := (n - at) // BLOCK:
                    cuts.append((at, k * BLOCK, k))
                    at += k * BLOCK
                if r := n - at:
                    cuts.append((at, r, REMAINDER - (-r // UNIT)))
                for s, m, c in cuts:
                    rank = ranks[c] = ranks.get(c, -1) + 1
                    alt, p = [], s
                    if 0 < c < REMAINDER and c & c - 1:
                        for x in powers(c):
                            alt.append(zlib.crc32(ids[4 * p : 4 * (p + x * BLOCK)]))
                            p += x * BLOCK
                    rows.append((i, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, c, task, rank, alt, ids[4 * s : 4 * (s + m)] if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(list(cols[0]), pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols[1:], kinds, strict=True))], ["id", "start", "length", "crc", "doc_tokens", "cls", "task", "rank", "alt", "ids"])

    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}, start bigint, length bigint, crc bigint, doc_tokens bigint, cls int, task int, rank bigint, alt array<bigint>, ids binary")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece; keep_ids: and its ids."""
    cut = materialise(pieces(docs, tokenizer, keep_ids), "pieces")
    per_task = cut.groupBy("cls", "task").agg(F.count("*").alias("n"))
    hist = {r["cls"]: r["n"] for r in per_task.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    layout = Layout.of(hist)
    before = per_task.select("cls", "task", (F.sum("n").over(Window.partitionBy("cls").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["cls", "task"]).select("id", "start", "length", "crc", "doc_tokens", "cls", (F.col("rank") + F.col("before")).alias("rank"), "alt", "ids")

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            start, length, crc = (b.column(c).to_numpy() for c in ("start", "length", "crc"))
            alt, ids = b.column("alt"), b.column("ids")
            out: list[tuple] = []  # rows, start, length, crc, sequence, order, ids
            for c in np.unique(cls):
                rows = np.flatnonzero(cls == c)
                if c == 0:
                    found = [(rows, start[rows], length[rows], crc[rows], rank[rows], np.zeros(len(rows), np.int64))]
                elif c > REMAINDER:
                    found = [(rows, start[rows], length[rows], crc[rows], *layout.remainder(int(c) - REMAINDER, rank[rows]))]
                else:
                    found = []
                    for pick, gone, size, sequence, order in layout.part(int(c), rank[rows]):
                        at = rows[pick]
                        code = crc[at]
                        if size != c:
                            k = powers(int(c)).index(size)
                            code = np.array([alt[int(i)].as_py()[k] for i in at], np.int64)
                        found.append((at, start[at] + gone * BLOCK, np.full(len(at), size * BLOCK), code, sequence, order))
                out += found
            rows, s, n, code, sequence, order = (np.concatenate(x) for x in zip(*out, strict=True))
            kept = [None] * len(rows)
            if keep_ids:
                kept = [ids[int(i)].as_py()[4 * int(a - start[i]) : 4 * int(a - start[i] + m)] for i, a, m in zip(rows, s, n, strict=True)]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), pa.array(s), pa.array(n), pa.array(code), b.column("doc_tokens").take(take), pa.array(sequence), pa.array(order), pa.array(kept, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", "ids"])

    kind = ranked.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(tidy(each), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint, ids binary")
    # a sequence holds at most 32 * 32 pieces
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    out = placed.withColumn("offset", offset)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
