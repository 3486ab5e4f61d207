"""Token counts, BPE tree, Matroska and packing against the libraries and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from recordloom.llm import bpe_tree, matroska, packing, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n_tokens int"
TEXTS = [None, "", " ", "a", "two  words\n\n here", "don't we'll", "é ü ß 漢字 \u200b", "<|endoftext|> in <|endoftext|>text", "x" * 3000, "tab\tand\x1cseparator", "the same", "the same", "A" * 64, "ab" * 70 + " " + "word " * 900]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, None, None, "clash", 7) for i, t in enumerate(texts)], SCHEMA)


def fuzz(n, seed=5):
    rng = random.Random(seed)
    alphabet = "abcdeéß  \n\t  'sStT12.,!$漢x"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_match_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + fuzz(300)
    for r in token_counts.token_counts(frame(spark, texts)).collect():
        t = texts[r["id"]] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)


def test_whole_tokens_are_proved():
    c = token_counts.Counter.of("byte_bpe_50k.json")
    assert " the" in c.whole and "<|endoftext|>" not in c.whole
    rng = random.Random(1)
    for s in rng.sample(sorted(c.whole), 300):
        assert len(c.tok.model.tokenize("".join(c.write[b] for b in s.encode()))) == 1


def test_tree_equals_tiktoken():
    c = bpe_tree.Codec.of("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    long = ["".join(rng.choice("thenionßé") for _ in range(rng.randint(50, 400))) for _ in range(40)]
    for t in [x or "" for x in TEXTS] + fuzz(400, 1) + long:
        ids = c.encode(t)
        assert memoryview(ids).cast("I").tolist() == lib.encode_ordinary(t)
        assert c.decode(ids, span=3) == t.encode()


def test_windows_are_merged_by_rank_and_the_tree_joins_them():
    c = bpe_tree.Codec.of("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(500):
        data = "".join(rng.choice("thenionßéa ") for _ in range(rng.randint(1, 40)))
        want = lib.encode_ordinary(data)
        assert c.merge(data.encode()) == want == c.encode_bytes(data.encode())
        cut = rng.randrange(len(data.encode()) + 1)
        a, b = data.encode()[:cut], data.encode()[cut:]
        assert c.join(c.encode_bytes(a), c.encode_bytes(b)) == want


def test_long_words_are_not_remembered():
    long = "x" * 100_000 + " " + "é" * 500 + "  " + "y" * 65
    counter = token_counts.Counter.of("byte_bpe_50k.json")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.count(long) == len(tok.encode(long, add_special_tokens=False).ids)
    words = packing.Words.of("word_bpe_49k.json")
    assert words.encode(long) == words.library(long)
    codec = bpe_tree.Codec.of("byte_bpe_multi_50k.tiktoken")
    assert codec.decode(codec.encode(long)) == long.encode()
    for held in (counter.words, counter.first, counter.later, words.word, words.pretoken, codec.words, codec.first, codec.later):
        assert all(len(k) <= 66 for k in held)


def test_words_fuzz_equals_the_library():
    words = packing.Words.of("word_bpe_49k.json")
    rng = random.Random(17)
    alphabet = "aAzZéÉßöÖñ'stS09.,!-_漢İıſ\u0301\u200b\u00a0\u2028\x1c\t\n  <|>"
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert words.encode(t) == words.library(t), t


def test_words_of_many_texts_are_encoded_together(monkeypatch):
    """One cut by the pattern and one lookup of each different word a group; before, each text and each unknown word had its own."""
    rng = random.Random(23)
    pieces = ["the", "Ungeinein", "laèierenon.", "a'sb", "ouletre%%%", "漢字", "İıſ", "\x1cx", "\x0b", "\u00a0", "<|endoftext|>", "x" * 70, "", "\x7f\x00", "Ⱥñ", "9½"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "\t ", "\r\n", "\x0c", ""]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    calls = []

    class Pattern:
        def findall(self, text):
            calls.append(text)
            return pattern.findall(text)

    pattern = packing.WORD_PATTERN
    monkeypatch.setattr(packing, "WORD_PATTERN", Pattern())
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    want = [words.library(t) for t in texts]
    sliced = pa.array(["left out", *texts]).slice(1)
    assert list(words.encode_all(sliced)) == want and len(calls) == 1
    assert list(words.encode_all(sliced)) == want and len(calls) == 1
    assert list(words.encode_all(pa.array([], pa.string()))) == []
    monkeypatch.setattr(packing, "GROUP", 100)
    small = packing.Words(public_tokenizers.path("word_bpe_49k.json"), memo=5)
    assert list(small.encode_all(sliced)) == want
    assert max(map(len, small.word)) <= packing.LONG


def test_round_trip_digests(spark):
    for r in bpe_tree.round_trip(frame(spark)).collect():
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()


def test_encode_decode_columns(spark):
    out = bpe_tree.decode(bpe_tree.encode(frame(spark))).collect()
    assert {r["id"]: bytes(r["decoded"]) for r in out} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("lacing", ["auto", "xiph", "ebml", "none"])
def test_matroska_round_trip(lacing):
    rng = random.Random(2)
    for n in (64, 512, 576, 4096, 4160, 40000, 64 * 600):
        data = bytes(rng.randrange(256) for _ in range(n))
        if lacing == "none" and n > 512:
            continue
        file = matroska.mux(data, lacing)
        m = matroska.parse(file)
        assert b"".join(file[p[6] : p[6] + p[7]] for p in m.packets) == data
        assert [p[1] for p in m.packets] == [i * 64_000_000 for i in range(len(m.packets))]
        assert all(file[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in m.cues) and len(m.cues) == m.clusters


def test_matroska_unknown_sizes_groups_and_damage():
    block = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00abc") + matroska.number(matroska.REFERENCE, 1))
    body = matroska.TRACK + b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + matroska.number(matroska.CLUSTER_TIME, 7) + block
    file = matroska.HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + body
    (p,) = matroska.parse(file).packets
    assert (p[0], p[1], p[2], p[7]) == (1, 12_000_000, False, 3)
    for bad in (b"", b"\x00", file[:30], matroska.HEAD):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def damaged():
    """A float of three bytes, a cluster time beyond 64 bits, a rate that gives no time."""
    head = matroska.HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff"
    duration = matroska.element(matroska.INFO, matroska.element(matroska.DURATION, b"\x01\x02\x03"))
    cluster = lambda time: b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + matroska.element(matroska.CLUSTER_TIME, time) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x00abc")
    return [head + duration, head + cluster(b"\xff" * 8), head + cluster(b"\x7f" * 9)]


def test_malformed_files_stay_in_their_row(spark):
    rows = [(i, bytearray(x)) for i, x in enumerate([*damaged(), matroska.mux(bytes(64))])]
    df = spark.createDataFrame(rows, "id bigint, media binary")
    assert {r["id"]: r["error"] is None for r in matroska.read_back(df).collect()} == {0: False, 1: False, 2: False, 3: True}
    assert {r["id"]: r["error"] is None for r in matroska.packets(df).collect()} == {0: False, 1: False, 2: False, 3: True}
    rng = random.Random(23)
    good = matroska.mux(bytes(range(256)) * 20)
    for _ in range(3000):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            m = matroska.parse(bytes(bad))
            assert all(abs(x) < 1 << 63 for p in m.packets for x in (p[1], p[6], p[7]))
        except ValueError:
            pass


def test_matroska_tables_and_digest(spark):
    stored = matroska.store(frame(spark))
    rows = matroska.packets(stored).groupBy("id").sum("byte_size").collect()
    want = {i: len(matroska.padded((t or "").encode())) for i, t in enumerate(TEXTS)}
    assert {r[0]: r[1] for r in rows} == want
    assert matroska.cues(stored).count() >= len(TEXTS)
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id bigint, media binary")
    assert [r["error"] is None for r in matroska.packets(broken).collect()] == [False]
    for r in matroska.digest(frame(spark)).collect():
        data = matroska.padded((TEXTS[r["doc_id"]] or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["payload_bytes"] == len(data) == want[r["doc_id"]]
        assert r["tail_crc32"] == zlib.crc32(data[-64:]) and r["media_sha256"] == hashlib.sha256(matroska.mux(data)).hexdigest()


def check_packing(rows, texts, least_full=None):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return sum(r["length"] for r in rows) / (4096 * len(sequences))


def test_packing_is_exact_and_tight(spark):
    rng = random.Random(9)
    texts = TEXTS + ["w " * rng.randint(1, 9000) for _ in range(150)]
    assert check_packing(packing.pack(frame(spark, texts)).collect(), texts) > 0.9


def test_packing_equal_lengths_waste_little(spark):
    texts = ["w " * 2559] * 40  # all parts of 20 blocks: no combination fills a window
    assert check_packing(packing.pack(frame(spark, texts)).collect(), texts) > 0.95


def test_packing_keeps_ids_and_empty_tables(spark):
    rows = packing.pack(frame(spark), keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    for made in (packing.pack(frame(spark, [])), token_counts.token_counts(frame(spark, [])), bpe_tree.round_trip(frame(spark, [])), matroska.digest(frame(spark, []))):
        assert made.count() == 0


def test_nnls_meets_kkt():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.random(8)
        x = packing.nnls(a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and w.max() < 1e-6 and abs(w[x > 1e-9]).max(initial=0) < 1e-6
