"""The corpus pipeline's stages against plain versions, and the registered queries of this subpackage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import queries
from test_corpus_ops import corpus, prose


def docs(spark, texts, langs="xy"):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages_take_effect_and_keep_clean_documents(spark):
    rng = random.Random(12)
    clean = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 70)
    texts = [*clean, clean[0], clean[1] + " tail", None, "12 34", f"{prose(rng, 200)} {shared}", f"{prose(rng, 200)} {shared} end", f"{prose(rng, 40)} token = \"0123456789abcdef0123\" ok"]
    out = docs(spark, texts)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "").cache()
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        kept.append({r["doc_id"]: r["text"] for r in out.collect()})
    first, second, third, fourth = kept
    assert set(first) == set(range(13)) - {8, 9}
    assert set(second) == set(first) - {6, 7}
    assert all(third[i] == texts[i] for i in (0, 1, 2, 3, 4, 5, 12))
    assert all(shared not in third[i] and third[i] for i in (10, 11))
    assert all(fourth[i] == third[i] for i in range(12) if i in third) and "[secret]" in fourth[12] and "abcdef" not in fourth[12]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
    rows = corpus_pipeline.packed(spark, out, "").collect()
    assert {r["doc_id"] for r in rows} == set(fourth)


def test_odd_input(spark):
    rows = docs(spark, [None, "", "a", "a", *corpus(3)[:12]])
    out = rows.union(rows.limit(3)).union(spark.createDataFrame([(None, "null id text here", None, None, None)], rows.schema))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.count() > 0


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(21)
    a, b, c, d, e, f = (prose(rng, 150) for _ in range(6))
    shared = prose(rng, 50)
    p, q = f"{prose(rng, 90)} {shared}", f"{prose(rng, 90)} {shared}"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, a), (None, b), (None, b), (None, b + " tail"), (7, c), (7, d), (7, d), (9, d + " tail"), (3, e), (None, e), (7, e), (5, f), (None, p), (7, q), (8, "12 34"), (8, None)]
    made = spark.createDataFrame([(i, t, "x", "s", len(t or "")) for i, t in rows], schema)
    out = corpus_pipeline.identified(spark, made, "")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, rows[:-2]))
    out = corpus_pipeline.distinct_documents(spark, out, "").cache()
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    b_row = [x for x in got if x[1] in (b, b + " tail")]
    assert len(b_row) == 1 and b_row[0][0] is None
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, a), b_row[0], (7, c), (7, d), (3, e), (5, f), (None, p), (7, q)]))
    out = corpus_pipeline.without_repeats(spark, out, "").cache()
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [(None, a), b_row[0], (7, c), (7, d), (3, e), (5, f), (None, p.removesuffix(" " + shared)), (7, q.removesuffix(" " + shared))]))
    out = corpus_pipeline.without_secrets(spark, out, "").cache()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, left))
    packed = corpus_pipeline.packed(spark, out, "").collect()
    assert sum(r["start"] == 0 for r in packed) == len(left)


def test_language_id_without_labels_keeps_texts_with_letters(spark):
    texts = ["the thing", None, "12 34", "", "żółć", "x1"]
    out = corpus_pipeline.identified(spark, docs(spark, texts).withColumn("lang", F.lit(None).cast("string")), "")
    assert {(r["doc_id"], r["text"], r["lang"]) for r in out.collect()} == {(i, texts[i], None) for i in (0, 4, 5)}
    assert out.columns == list(corpus_pipeline.COLUMNS)


def test_empty_table(spark):
    out = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}
