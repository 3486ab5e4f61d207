"""Token counts: whole-token shortcut over byte-level BPE.

:func:`prove` shows once, before any text is read, which vocabulary strings the merges turn into one token when
they stand alone.  A pre-token that is one of them counts 1 by a set lookup; only the others go through the
merges.  Counting is per-row work in Arrow batches without a shuffle; what a worker remembers is bounded by
``memo`` entries of 64 characters at most.  A long text takes memory in proportion to its bytes.

A null text counts as empty (0 tokens).  Special strings inside a text are special tokens, as is the library's
default.  Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from recordloom.llm import pretokens
from recordloom.llm.common import Memo, texts, tidy, tokenizer_path

LIMIT, LONG = 1024, 64


def byte_chars() -> dict[str, int]:
    """The characters by which byte-level tokenizers write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def prove(tok: Tokenizer) -> set[str]:
    """Strings of the vocabulary that the merges make one token of; strings that aren't UTF-8 can't be a pre-token."""
    chars = byte_chars()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    model, out = tok.model, set()
    for s in tok.get_vocab():
        if s in special:
            continue
        try:
            text = bytes(chars[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(model.tokenize(s)) == 1:
            out.add(text)
    return out


class Counter:
    """Counts as the library does, by the shortcut.  One for each worker and file."""

    made: dict[str, Counter] = {}

    def __init__(self, path: str, memo: int = 300_000):
        self.tok = Tokenizer.from_file(path)
        self.whole = prove(self.tok)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.write = {b: c for c, b in byte_chars().items()}
        self.words = Memo(self.merged, memo)
        self.first = Memo(self._piece, memo)
        self.later = Memo(lambda x: self._piece(" " + x), memo)

    @classmethod
    def of(cls, name: str) -> Counter:
        if name not in cls.made:
            cls.made[name] = cls(tokenizer_path(name))
        return cls.made[name]

    def merged(self, pretoken: str) -> int:
        return len(self.model.tokenize("".join(map(self.write.__getitem__, pretoken.encode()))))

    def _piece(self, piece: str) -> int:
        return sum([1 if x in self.whole else self.words[x] if len(x) <= LONG else self.merged(x) for x in pretokens.matches(piece)])

    def plain(self, text: str) -> int:
        if "  " in text:
            return sum(map(self._any, pretokens.pieces(text)))
        head, *rest = text.split(" ")
        if len(head) > LONG or max(map(len, rest), default=0) > LONG:
            return sum(map(self._any, pretokens.pieces(text)))
        return (self.first[head] if head else 0) + sum(map(self.later.__getitem__, rest))

    def _any(self, piece: str) -> int:
        """Long pieces are counted, but not remembered."""
        return self.first[piece] if len(piece) <= LONG else self._piece(piece)

    def count(self, text: str) -> int:
        parts = [text]
        n = 0
        for s in self.special:
            if any(s in x for x in parts):
                cut = [x.split(s) for x in parts]
                n += sum(len(x) - 1 for x in cut)
                parts = [y for x in cut for y in x]
        return n + sum(map(self.plain, parts))


def token_counts(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every text."""
    src = texts(df, id_col, text_col)

    def each(batches):
        count = Counter.of(tokenizer).count
        for b in batches:
            col = b.column("text")
            n = [count(x) for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.compute.binary_length(col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    return src.mapInArrow(tidy(each), f"id {src.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
