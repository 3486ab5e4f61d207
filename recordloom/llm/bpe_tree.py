"""Byte-level BPE encoding and decoding by tree reduction.

Encoding is a monoid on token sequences: a piece is cut in halves down to single bytes, and neighbours are joined.
:meth:`Codec.join` re-encodes a window around the boundary and widens it until
the tokens outside provably stay: a sequence is the encoding of its bytes exactly if each two neighbours, taken
alone, encode to themselves, so it is enough that the pairs across both edges of the window do.  Decoding joins
byte strings up the same tree.

Subtrees of up to four bytes are remembered, as they come again and again, and so are whole short pieces.  Rows are
independent, so this is Arrow-batched work without a shuffle; a worker remembers ``memo`` pieces of 64 characters at
most, and a long piece takes memory in proportion to its bytes.  A null text is empty: no ids, an empty decoding.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from recordloom.llm import pretokens
from recordloom.llm.common import Memo, texts, tidy, tokenizer_path

NONE = 1 << 62  # rank of what the file lacks
SHORT = 4  # bytes of a subtree that is remembered


def tree(items: Sequence, join: Callable, empty):
    """Join items up a balanced tree."""
    if not items:
        return empty
    while len(items) > 1:
        items = [join(items[i], items[i + 1]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


class Codec:
    """Ranks of one file.  Tokens are ids; bytes of an id are in ``bytes_of``."""

    made: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], memo: int = 200_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.subtree = Memo(self._halves, memo)
        self.words = Memo(self._match, memo)
        self.window = Memo(lambda ab: self.merge(self.bytes_of[ab[0]] + self.bytes_of[ab[1]]), memo)
        self.first = Memo(self._piece, memo)
        self.later = Memo(lambda x: self._piece(" " + x), memo)

    @classmethod
    def of(cls, name: str) -> Codec:
        if name not in cls.made:
            with open(tokenizer_path(name), "rb") as f:
                cls.made[name] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        return cls.made[name]

    def merge(self, data: bytes) -> list[int]:
        """The ids of a window's bytes: the adjacent parts of least rank, the first of equals, are joined until none is in the file."""
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        rank = [get(x + y, NONE) for x, y in zip(parts, parts[1:])]  # noqa: B905
        while rank:
            least = min(rank)
            if least == NONE:
                break
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return [self.ranks[x] for x in parts]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        pairs, a = self.window, left[-1]
        window = pairs[a, right[0]]
        if window[0] == a and len(window) == 2:
            return left + right
        k, n, m = 1, len(left), len(right)
        while True:
            i, j = n - k if k < n else 0, k if k < m else m
            if k > 1:
                window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            # the tokens outside stay if the pairs across both edges, taken alone, encode to themselves
            out = pairs[left[i - 1], window[0]] if i else None
            if out is None or out[0] == left[i - 1] and len(out) == 2:
                out = pairs[window[-1], right[j]] if j < m else None
                if out is None or out[0] == window[-1] and len(out) == 2:
                    return left[:i] + window + right[j:]
            k *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one match: its halves', joined; the left one has a power of two of bytes, so subtrees come again."""
        return self.subtree[data] if len(data) <= SHORT else self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        size = len(data)
        if size < 2:
            return [self.ranks[data]] if data else []
        half = 1 << (size - 1).bit_length() - 1
        if half <= SHORT:
            return self.join(self.subtree[data[:half]], self.subtree[data[half:]])
        return self.join(self._halves(data[:half]), self.encode_bytes(data[half:]))

    def _match(self, match: str) -> bytes:
        return array("I", self.encode_bytes(match.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.words[m] if len(m) <= 64 else self._match(m) for m in pretokens.matches(piece)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if "  " in text:
            return b"".join(map(self._long, pretokens.pieces(text)))
        head, *rest = text.split(" ")
        if max(map(len, rest), default=0) > 64 or len(head) > 64:
            return b"".join(map(self._long, pretokens.pieces(text)))
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))

    def _long(self, piece: str) -> bytes:
        return self.first[piece] if len(piece) <= 65 else self._piece(piece)

    def decode(self, ids: bytes, span: int = 4096) -> bytes:
        """The bytes of ids: spans of them at the leaves, joined up the tree."""
        seq = memoryview(ids).cast("I").tolist()
        table = self.bytes_of
        return tree([b"".join(map(table.__getitem__, seq[i : i + span])) for i in range(0, len(seq), span)], bytes.__add__, b"")


def encode(df: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: every text's ids as a binary of little-endian unsigned 32-bit integers."""
    src = texts(df, id_col, text_col)

    def each(batches):
        enc = Codec.of(ranks).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([enc(x) for x in b.column("text").to_pylist()], pa.binary())], ["id", "ids"])

    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", ids_col: str = "ids", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``(*keep, decoded)``: the bytes of an ids column."""
    src = df.select(*keep, ids_col)

    def each(batches):
        dec = Codec.of(ranks).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([None if x is None else dec(x) for x in b.column(ids_col).to_pylist()], pa.binary())], [*keep, "decoded"])

    return src.mapInArrow(tidy(each), ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep) + ", decoded binary")


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Digests of every text's ids and of their decoding."""
    src = texts(docs)

    def each(batches):
        c = Codec.of(ranks)
        sha = hashlib.sha256
        for b in batches:
            ids = [c.encode(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(c.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return src.mapInArrow(tidy(each), f"doc_id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
