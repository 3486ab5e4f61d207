"""Language ID: a byte convolutional network trained in numpy.

Bytes are folded only where nothing is lost for a language (case of A to Z, blanks, digits, zero is padding); filters of widths 2, 3 and 4 run over fixed-length windows, their responses are
max-pooled over the window, and a softmax layer gives the languages.  A text's probabilities are the mean over all
its windows, weighted by their bytes; nothing of a text is left out.  After training, each filter's response is
tabulated for all class pairs (width 2), pairs and single classes (3) and two pairs (4), which gives the same sums by one
or two lookups.

Training reads a bounded sample: at most ``docs_per_lang`` labelled texts of each language, chosen by a hash of the
id, and ``windows_per_doc`` evenly spaced windows of each.  Prediction is per-row work in Arrow batches; the model
(a few KB) travels with the function.

Extra columns go unless kept, so names can't clash.  A long text takes about 30 bytes of memory a byte.  A null text, or one
without a letter, gets ``und`` with score 0; so does every text if there is nothing to learn
from.  Rows with a null label or id are not learned from.  Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import small_batches, texts, tidy

WINDOW, WIDTHS, FILTERS, DIM, CLASSES = 128, (2, 3, 4), 8, 8, 256
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 16


def byte_classes() -> np.ndarray:
    """Class of each byte: itself, but for the case of A to Z, blanks and digits."""
    c = np.arange(256, dtype=np.uint8)
    c[65:91] += 32
    c[[9, 10, 11, 12, 13]] = 32
    c[48:58] = 48
    return c


BYTE_CLASS = byte_classes()


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All of ``data`` as rows of ``size`` classes, the last one padded."""
    n = -(-len(data) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = BYTE_CLASS[np.frombuffer(data, np.uint8)]
    return out.reshape(n, size)


@dataclass
class Net:
    langs: list[str]
    emb: np.ndarray
    filters: list[np.ndarray]  # width x dim x filters
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self) -> list[list[np.ndarray]]:
        """For each width, each offset's share of the response by class."""
        return [[self.emb @ w[j] for j in range(len(w))] for w in self.filters]

    def tables(self) -> tuple[np.ndarray, ...]:
        two, three, four = self.responses()
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        t2 = pair(*two).astype(np.float32)
        return t2, pair(three[0], three[1]).astype(np.float32), three[2].astype(np.float32), pair(four[0], four[1]).astype(np.float32), pair(four[2], four[3]).astype(np.float32)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, rows: np.ndarray, tables: tuple[np.ndarray, ...], block: int = 256) -> np.ndarray:
        """Probabilities of each window."""
        t2, t3a, t3b, t4a, t4b = tables
        out = np.empty((len(rows), len(self.langs)))
        for i in range(0, len(rows), block):
            c = np.ascontiguousarray(rows[i : i + block].T).astype(np.int32)
            pair = (c[:-1] << 8) + c[1:]
            three = t3a.take(pair[:-1], axis=0)
            three += t3b.take(c[2:], axis=0)
            four = t4a.take(pair[:-2], axis=0)
            four += t4b.take(pair[2:], axis=0)
            out[i : i + block] = self.head(np.concatenate([t2.take(pair, axis=0).max(0), three.max(0), four.max(0)], 1))
        return out


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the cross-entropy; a third of the windows is shortened each epoch, as texts may be short."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    net = Net(langs, rng.normal(0, 0.5, (CLASSES, DIM)), [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, k)), np.zeros(k))
    params = [net.emb, *net.filters, net.bias, net.dense, net.dense_bias]
    mean, var, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        data = rows.copy()
        for i in rng.choice(len(data), len(data) // 3, replace=False):
            data[i, rng.integers(6, WINDOW) :] = 0
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            c, y = data[pick], labels[pick]
            n = len(pick)
            shares, pooled, places = net.responses(), [], []
            for parts in shares:
                span = WINDOW - len(parts) + 1
                r = sum(p[c[:, j : j + span]] for j, p in enumerate(parts))
                places.append(r.argmax(1))
                pooled.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0])
            x = np.concatenate(pooled, 1)
            act = np.maximum(x + net.bias, 0)
            prob = net.head(x)
            prob[np.arange(n), y] -= 1
            dz = prob / n
            dx = (dz @ net.dense.T) * (act > 0)
            d_emb, d_filters = np.zeros_like(net.emb), []
            for f, (w, place) in enumerate(zip(net.filters, places, strict=True)):
                g, dw = dx[:, f * FILTERS : (f + 1) * FILTERS], np.zeros_like(w)
                for j in range(len(w)):
                    hit = c[np.arange(n)[:, None], place + j]
                    share = np.zeros((CLASSES, FILTERS))
                    np.add.at(share, (hit, np.arange(FILTERS)[None].repeat(n, 0)), g)
                    dw[j] = net.emb.T @ share
                    d_emb += share @ w[j].T
                d_filters.append(dw)
            step += 1
            for p, g, m, v in zip(params, [d_emb, *d_filters, dx.sum(0), act.T @ dz, dz.sum(0)], mean, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def sample(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of a bounded sample; at most ``docs_per_lang`` texts of each language come together."""
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null and text <> ''")
    rate = src.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not rate:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    keep = F.lit(0.0)
    for r in rate:
        keep = F.when(F.col("lang") == r["lang"], min(1.0, 1.5 * docs_per_lang / r["n"])).otherwise(keep)
    key = F.xxhash64("id")
    thin = src.where(F.pmod(key, F.lit(1_000_003)) < keep * 1_000_003).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(key, "text"))).where(F.col("r") <= docs_per_lang)

    def each(batches):
        for b in batches:
            langs, data = [], []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                w = windows(text.encode("utf-8", "surrogatepass"))
                for i in np.unique(np.linspace(0, len(w) - 1, windows_per_doc).astype(int)):
                    langs.append(lang)
                    data.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "w"])

    got = thin.select("text", "lang").mapInArrow(tidy(each), "lang string, w binary").orderBy("lang", "w").toArrow()
    langs = sorted({x for x in got["lang"].to_pylist()})
    rows = np.frombuffer(b"".join(got["w"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return rows, np.array([langs.index(x) for x in got["lang"].to_pylist()], int), langs


_TABLES: dict[bytes, tuple] = {}


def _probabilities(net: Net, tables: tuple[np.ndarray, ...], data: list[bytes]) -> np.ndarray:
    """Of each text, the mean of its windows' probabilities, weighted by their bytes."""
    sizes = np.array([len(x) for x in data])
    counts = -(-sizes // WINDOW)
    starts = np.cumsum(counts) - counts
    p = net.predict(np.concatenate([windows(x) for x in data]), tables)
    weight = np.full(len(p), float(WINDOW))
    weight[starts + counts - 1] = sizes - WINDOW * (counts - 1)
    return np.add.reduceat(p * weight[:, None], starts) / sizes[:, None]


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), unlearned: str | None = "und") -> DataFrame:
    """``(id, *keep, lang_pred, score)`` of every whole text; ``unlearned`` for those with a letter if there is no net."""
    small_batches(docs.sparkSession)
    src = texts(docs, id_col, text_col) if not keep else docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))

    def each(batches):
        tables = None
        if net is not None:
            key = net.dense.tobytes() + net.emb.tobytes()
            tables = _TABLES.setdefault(key, None) or _TABLES.__setitem__(key, net.tables()) or _TABLES[key]
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            wait: list[tuple[int, bytes]] = []
            held = 0
            col = b.column("text").to_pylist()
            for i, text in enumerate(col):
                lettered = any(map(str.isalpha, text))
                if net is None and lettered:
                    langs[i] = unlearned
                elif lettered:
                    wait.append((i, text.encode("utf-8", "surrogatepass")))
                    held += len(wait[-1][1])
                if wait and (held > 1 << 20 or i + 1 == len(col)):
                    for j, p in zip([x[0] for x in wait], _probabilities(net, tables, [x[1] for x in wait]), strict=True):
                        langs[j], scores[j] = net.langs[int(p.argmax())], float(min(1.0, p.max()))
                    wait, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(f"keep_{c}") for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", *keep, "lang_pred", "score"])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}{kept}, lang_pred string, score double")


def fit(labelled: DataFrame, **sizes) -> Net | None:
    rows, labels, langs = sample(labelled, **sizes)
    return train(rows, labels, langs) if langs else None


def held_out(id_col: str = "doc_id"):
    """True for documents kept from training: a third of the ids, by their checksum."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled two thirds of ``docs`` and predict all of it."""
    net = fit(docs.where(~held_out()))
    return predict(docs, net).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
