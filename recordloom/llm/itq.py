"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

:func:`fit` learns a PCA projection and a rotation that makes its sign bits balanced, from at most ``sample``
vectors (by a hash of their ids).  Every vector gets a code of up to 64 bits.  The code is cut into tables of ``s``
bits; two vectors meet in a table where their parts differ in at most ``r`` bits.  ``r`` is the least that finds 0.9
or more of pairs at the threshold, and ``s`` the cheapest for the number of vectors: more bits mean smaller buckets and
more probes.  How many pairs are found is measured on codes, so it holds whatever the mean takes from the vectors:
:func:`trials` makes partners at the threshold for vectors of the sample and takes its own near pairs (nearer pairs are
found more surely).  Where tables would hold all pairs anyway, and for lengths that the sample lacks, all are compared.
Met pairs are reranked by the cosine of the original vectors in double precision; a pair counts in the first table
where it meets.

A bucket of more than ``block`` vectors is dealt over several tasks: each keeps a block of it and sees all queries
of the bucket as a stream.  Links are counted where they are found and never written as pairs; what leaves a task
are counts and a spanning forest.

Equal vectors go as one with their number, so copies cost no comparisons; a vector's links count all copies of those it
links with, and its own other copies.

Vectors that are null, zero, or hold a null, NaN or infinite component link with nothing, and so do those with a null id.
Vectors of different lengths are not compared.  Rows of one id count as one vector seen again: they don't link with each
other, and each gets the id's result; if they differ, the least of the id's vectors counts.  Extra columns go, so names
can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidy
from recordloom.operators.components import connected_components
from recordloom.state.shared import materialise

SAMPLE, BLOCK, THRESHOLD, FOUND = 20_000, 4096, 0.9, 0.9


@dataclass
class Quantiser:
    """Mean and projection (with the rotation) for vectors of one length."""

    mean: np.ndarray
    turn: np.ndarray
    plan: tuple[int, int, int] = (0, 1, 0)

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        on = (unit - self.mean) @ self.turn > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def learn(unit: np.ndarray, rounds: int = 30, seed: int = 3) -> Quantiser:
    """Iterative quantisation: alternate between sign codes and the rotation nearest to them."""
    mean = unit.mean(0)
    x = unit - mean
    dim = x.shape[1]
    bits = min(64, dim)
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(dim))
    v = x @ (axes := axes[:, ::-1][:, :bits])
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        b = np.where(v @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        r = (left @ right).T
    return Quantiser(mean, axes @ r)


#: Seconds to move a row and to compare two codes, as measured; only their ratio matters.
ROW_S, PAIR_S = 2e-6, 5e-9


#: Pairs of a kind that recall is measured on, and how many real ones are enough to count.
TRIALS, REAL = 4096, 200


def trials(unit: np.ndarray, q: Quantiser, threshold: float = THRESHOLD, seed: int = 5) -> list[np.ndarray]:
    """Bits that differ in the codes of pairs at the threshold, by kind: a step any way, a step toward another vector, real pairs."""
    rng = np.random.default_rng(seed)
    x = unit[np.arange(TRIALS) % len(unit)]
    toward = unit[rng.integers(0, len(unit), TRIALS)]
    out = []
    for step in (rng.normal(size=x.shape), toward):
        step = step - (step * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(step, axis=1)
        ok = size > 1e-6
        if ok.any():
            y = threshold * x[ok] + math.sqrt(1 - threshold**2) * step[ok] / size[ok, None]
            out.append(q.codes(x[ok]) ^ q.codes(y))
    code = q.codes(unit)
    real = []
    for i in range(0, min(TRIALS, len(unit)), 256):
        near = unit[i : i + 256] @ unit.T
        a, b = np.nonzero((near >= threshold) & (near < threshold + 0.03))
        real.append(code[i + a] ^ code[b])
    real = np.concatenate(real)
    if len(real) >= REAL:
        out.append(real)
    return out


def tables(n: int, bits: int, pairs: list[np.ndarray], found: float = FOUND) -> tuple[int, int, int]:
    """Bits of a table, number of tables and radius for ``n`` vectors: the cheapest that find enough of all kinds of pairs.

    ``(0, 1, 0)``, one table of one bucket, where no tables leave out pairs.
    """
    best = None
    for s in range(1, min(24, bits) + 1):
        m = bits // s
        mask = np.uint64((1 << s) - 1)
        least = [np.min([np.bitwise_count(x >> np.uint64(t * s) & mask) for t in range(m)], axis=0) for x in pairs]
        for r in range(s + 1):
            # two standard errors more than asked for
            if all((x <= r).mean() >= min(1.0, found + 2 * math.sqrt(found * (1 - found) / len(x))) for x in least):
                break
        probes = sum(math.comb(s, i) for i in range(r + 1))
        cost = n * m * probes * ROW_S + n * n * m * probes / 2**s * PAIR_S
        if m * probes < 2**s and (best is None or cost < best[0]):
            best = cost, (s, m, r)
    return best[1] if best and pairs else (0, 1, 0)


def flips(s: int, r: int) -> np.ndarray:
    """All masks of at most ``r`` of ``s`` bits."""
    out = [0]
    last = [0]
    for _ in range(r):
        last = sorted({x | 1 << i for x in last for i in range(s)} - set(out))
        out += last
    return np.array(out, np.uint64)


def _usable(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length: which of a list column's vectors are finite and not zero, and these as rows."""
    size = np.diff(vectors.offsets.to_numpy())
    size[~vectors.is_valid().to_numpy(zero_copy_only=False)] = 0
    flat, begin, out = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1], []
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = flat[begin[at][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            n = np.linalg.norm(x, axis=1)
        ok = np.isfinite(n) & (n > 0)
        out.append((at[ok], x[ok]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, threshold: float = THRESHOLD) -> dict[int, Quantiser]:
    """A quantiser for each vector length in a sample of the ``n`` rows of ``(id, v)``."""
    if n > 2 * sample:
        vectors = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil((1 << 40) * 1.5 * sample / n))
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    out = {}
    for _, x in _usable(got) if len(got) else []:
        if not len(x):
            continue
        x = _unit(x)
        out[x.shape[1]] = q = learn(x)
        q.plan = tables(n, q.bits, trials(x, q, threshold))
    return out


def _keyed(vectors: DataFrame, quantisers: dict[int, Quantiser], kind: str) -> DataFrame:
    """``(key, role, id, copies, code, raw)``: role 0 for the bucket a vector lies in, 1 for others that its queries look into."""

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for at, x in _usable(b.column("v")):
                d = x.shape[1]
                q = quantisers.get(d)
                if q is None:  # a length the sample lacks: few vectors, of which all pairs are compared
                    q = Quantiser(np.zeros(d), np.eye(d)[:, : min(64, d)])
                s, m, r = q.plan
                code = q.codes(_unit(x))
                names, copies = b.column("id").take(pa.array(at)), b.column("copies").take(pa.array(at))
                wide = np.ascontiguousarray(x.astype(kind))
                raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * wide.itemsize * d).astype(np.int32)), pa.py_buffer(wide)])
                for t in range(m):
                    part = code >> np.uint64(t * s) & np.uint64((1 << s) - 1)
                    base = np.uint64((d << 6 | t) << 32)
                    for mask in flips(s, r):
                        yield pa.RecordBatch.from_arrays([pa.array((base | part ^ mask).astype(np.int64)), pa.array(np.full(len(x), int(mask != 0), np.int32)), names, copies, pa.array(code.astype(np.int64)), raw], ["key", "role", "id", "copies", "code", "raw"])

    return vectors.mapInArrow(tidy(each), f"key bigint, role int, id {vectors.schema['id'].dataType.simpleString()}, copies bigint, code bigint, raw binary")


class Bucket:
    """The vectors a task holds of one bucket, or of a block of it."""

    def __init__(self, key: int, plans: dict[int, tuple[int, int, int]], threshold: float):
        d = key >> 38
        self.table = key >> 32 & 63
        s, _, self.radius = plans.get(d, (0, 1, 0))
        self.s, self.mask, self.threshold = s, np.uint64((1 << s) - 1), threshold
        self.ids: list = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def close(self) -> None:
        self.code, self.unit, self.copies = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.label, self.ready = np.arange(len(self.ids)), True

    def ask(self, ids: list, code: np.ndarray, unit: np.ndarray, out: list[tuple]) -> None:
        """Links of the queries with what is held: ``(id, links, a, b)`` rows, of which a and b are forest edges."""
        for i in range(0, len(ids), 512):
            diff = code[i : i + 512, None] ^ self.code[None]
            met = np.bitwise_count(diff >> np.uint64(self.table * self.s) & self.mask) <= self.radius
            for t in range(self.table):  # these have met before
                met &= np.bitwise_count(diff >> np.uint64(t * self.s) & self.mask) > self.radius
            q, k = np.nonzero(met)
            for j in range(0, len(q), 65536):
                near = np.einsum("ij,ij->i", unit[i + q[j : j + 65536]], self.unit[k[j : j + 65536]]) >= self.threshold
                self._link(ids, i + q[j : j + 65536][near], k[j : j + 65536][near], out)

    def _link(self, ids: list, q: np.ndarray, k: np.ndarray, out: list[tuple]) -> None:
        if not len(q):
            return
        cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        for a, z in zip(cut, [*cut[1:], len(q)], strict=True):
            own = ids[q[a]]
            hits = [h for h in k[a:z].tolist() if self.ids[h] != own]
            if not hits:
                continue
            out.append((own, int(self.copies[hits].sum()), own, self.ids[hits[0]]))
            kinds = np.unique(self.label[hits])
            for other in kinds[1:]:
                out.append((None, 0, self.ids[other], self.ids[kinds[0]]))
                self.label[self.label == other] = kinds[0]


def _linker(plans: dict[int, tuple[int, int, int]], threshold: float, kind: str):
    """Per-task search: rows come sorted by key, block and role."""

    def each(batches):
        group, bucket = None, None
        out: list[tuple] = []
        id_type = None

        def finish():
            if bucket is not None and not bucket.ready and bucket.ids:
                bucket.close()
                bucket.ask(bucket.ids, bucket.code, bucket.unit, out)

        def batch():
            cols = list(zip(*out, strict=True)) or [[]] * 4
            got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (id_type, pa.int64(), id_type, id_type), strict=True)], ["id", "n", "a", "b"])
            out.clear()
            return got

        for b in batches:
            if not b.num_rows:
                continue
            id_type = b.column("id").type
            key, block, role, copies = (b.column(c).to_numpy() for c in ("key", "block", "role", "copies"))
            code = b.column("code").to_numpy().astype(np.uint64)
            name, raw = b.column("id").to_pylist(), b.column("raw").to_pylist()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])])
            for a, z in zip(cut, [*cut[1:], len(key)], strict=True):
                if (key[a], block[a]) != group:
                    finish()
                    group, bucket = (key[a], block[a]), Bucket(int(key[a]), plans, threshold)
                x = np.frombuffer(b"".join(raw[a:z]), kind).astype(np.float64).reshape(z - a, -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if role[a] == 0:
                    bucket.ids += name[a:z]
                    bucket.parts.append((code[a:z], x, copies[a:z]))
                    continue
                finish()
                if bucket.ready:
                    bucket.ask(name[a:z], code[a:z], x, out)
            if len(out) > 10_000:
                yield batch()
        finish()
        if out:
            yield batch()

    return each


def _links(v: Column) -> Column:
    """Whether a vector can link: not empty, its components finite, and not all zero."""
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return size.isNotNull() & ~F.isnan(size) & (size > 0) & (size < float("inf"))


def links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row."""
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n = src.count()
    one = src.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    own = one.select("id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("t"), "v")
    # equal vectors as one: the least id stands for its copies
    usable = materialise(own.groupBy("h", "t").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    quantisers = fit(usable, n, sample, threshold)
    wide_type = "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    keyed = _keyed(usable, quantisers, wide_type)
    wide = keyed.where("role = 0").groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # a vector is held in one block of its bucket and asks all of them
    every = F.explode(F.expr("transform(sequence(0, blocks - 1), x -> named_struct('block', x, 'role', IF(role = 0 AND x = pmod(xxhash64(id), blocks), 0, 1)))"))
    dealt = keyed.join(wide, "key").select("key", "id", "copies", "code", "raw", every.alias("at")).select("key", "at.*", "id", "copies", "code", "raw")
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = src.schema["id"].dataType.simpleString()
    plans = {d: q.plan for d, q in quantisers.items()}
    found = materialise(dealt.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "role").mapInArrow(tidy(_linker(plans, threshold, wide_type)), f"id {kind}, n bigint, a {kind}, b {kind}"), "links")
    count = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n_links"))
    comp = connected_components(found.select("a", "b")).select(F.col("node").alias("id"), "component")
    # what holds for a vector holds for its copies; those that can't link with anything have none
    linked = usable.where(_links(F.col("v"))).select("h", "t", F.col("id").alias("rep"), "copies").join(count.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("h", "t", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = own.select("id", "h", "t").join(linked, ["h", "t"]).select("id", "n_links", "component")
    out = src.select("id").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
