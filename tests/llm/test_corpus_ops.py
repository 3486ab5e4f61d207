"""Language ID, Jaccard join, substring dedup, ITQ, URL filter and secrets against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import itq, jaccard_join, language_id, secrets, substring_dedup, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, c int"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, None, None, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n, words="the of and in to thing ation stly heat wh ound".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, repeats inside a text, short and odd texts."""
    rng = random.Random(seed)
    out = [None, "", "  ", "one", "one", "One two three four", "one two three FOUR", "a " * 200, "ab cd " * 60]
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.randint(40, 300)).split()
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            near = list(base)
            for _ in range(rng.randint(0, 6)):
                near[rng.randrange(len(near))] = "edit%d" % rng.randrange(9)
            out.append("  ".join(near))
        out.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, 30))
    return out


def spans_of(text):
    kinds = ((r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), (r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16))
    out = []
    for k, (p, least) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group(2 if k == 0 else 0)) >= least]
    return sorted(out)


def test_jaccard_components_equal_brute_force(spark):
    texts = corpus()
    low = {a: a + 32 for a in range(65, 91)}
    words = [(t or "").translate(low).encode().split() for t in texts]
    sets = [frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]) for w in words]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for most in (2000, 2):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(frame(spark, texts), group_most=most).collect()}
        assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_divide_skip_equals_counting():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 12))]
        t = rng.randint(1, 8)
        want = sorted((d, n) for d, n in Counter(x for y in lists for x in y).items() if n >= t)
        assert jaccard_join.divide_skip(lists, t) == want
        lists = lists * rng.randint(1, 3)
        want = sorted((d, n) for d, n in Counter(x for y in lists for x in y).items() if n >= t)
        begin = np.cumsum([0, *map(len, lists[:-1])])
        assert jaccard_join.divide_skip(*jaccard_join.merged(np.array([x for y in lists for x in y]), begin)[:1], t, jaccard_join.merged(np.array([x for y in lists for x in y]), begin)[1]) == want


@pytest.mark.parametrize(("hot", "most"), [(2_000, 20_000), (1, 20_000), (3, 2)])
def test_substring_dedup_equals_brute_force(spark, hot, most):
    texts = corpus(2)
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = {r["id"]: r for r in substring_dedup.dedup(frame(spark, texts), hot=hot, most=most, digest=True).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(words):
        keep = [True] * len(w)
        for a in range(len(w) - 34):
            if seen[tuple(w[a : a + 35])] > 1:
                keep[a : a + 35] = [False] * 35
        left = [x for x, k in zip(w, keep, strict=True) if k]
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())


def test_substring_dedup_keeps_clean_texts_as_they_are(spark):
    texts = ["a  b\nc", None, prose(random.Random(3), 100)]
    assert {r["id"]: r["text"] for r in substring_dedup.dedup(frame(spark, texts)).collect()} == {0: texts[0], 1: "", 2: texts[2]}


def test_language_id_learns_and_leaves_out(spark):
    rng = random.Random(6)
    kinds = {"aa": "the of and thing wh".split(), "bb": "der die ung keit sch".split(), "cc": "él que ción ñue los".split()}
    langs = [rng.choice(sorted(kinds)) for _ in range(300)]
    texts = [prose(rng, rng.randint(3, 200), kinds[x]) for x in langs]
    df = frame(spark, [*texts, None, "", "12 34 !?"], [*langs, "aa", "bb", None])
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert 60 < len(held) < 140
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (300, 301, 302))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_tables_equal_plain_convolution():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (300, language_id.WINDOW)).astype(np.uint8)
    net = language_id.train(rows, rng.integers(0, 2, 300), ["a", "b"], epochs=1)
    pooled = []
    for parts in net.responses():
        span = language_id.WINDOW - len(parts) + 1
        pooled.append(sum(p[rows[:, j : j + span]] for j, p in enumerate(parts)).max(1))
    assert np.allclose(net.head(np.concatenate(pooled, 1)), net.predict(rows, net.tables()), atol=1e-4)


def test_language_id_without_labels(spark):
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, ["abc", None])).collect()} == {"und"}


def test_itq_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    rows = [*base, *(base[:60] + rng.normal(scale=0.05, size=(60, 16))), *(np.repeat(base[:1], 30, 0) + rng.normal(scale=0.02, size=(30, 16)))]
    vectors = [list(map(float, v)) for v in rows] + [None, [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [], vectors0 := list(map(float, base[0])), list(map(float, base[0])), [0.0] * 16]
    assert vectors0
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")
    want, comp = [0] * len(vectors), list(range(len(vectors)))
    unit = {}
    for i, v in enumerate(vectors):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    pairs = [(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    for _ in range(5):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    for i, _ in pairs:
        want[i] += 1
    for block in (4096, 7):
        got = {r["id"]: r for r in itq.links(df, block=block).collect()}
        assert len(got) == len(vectors)
        assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(want)
        assert all(r["n_links"] <= want[i] and r["kept"] == (r["id"] == r["component_id"]) for i, r in got.items())
        assert np.mean([got[i]["component_id"] == comp[i] for i in got]) > 0.97


@pytest.mark.parametrize("size", [0.0, 0.7, 0.8, 0.9])
def test_itq_tables_find_pairs_of_vectors_with_a_common_mean(size):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    common = np.eye(64)[0] * size
    x = unit(common + np.sqrt(1 - size**2) * unit(rng.normal(size=(5000, 64)) * (np.arange(64) > 0)))
    q = itq.learn(x[:3000])
    for n in (50_000, 1_000_000):
        s, m, r = itq.tables(n, q.bits, itq.trials(x[:3000], q))
        # partners of vectors that were not learned from
        step = unit(rng.normal(size=(2000, 64)))
        step = unit(step - (step * x[3000:]).sum(1, keepdims=True) * x[3000:])
        near = rng.uniform(0.9, 0.93, (2000, 1))
        code, other = q.codes(x[3000:]), q.codes(near * x[3000:] + np.sqrt(1 - near**2) * step)
        parts = [np.bitwise_count((code ^ other) >> np.uint64(t * s) & np.uint64((1 << s) - 1)) for t in range(m)]
        assert np.mean(np.min(parts, axis=0) <= r) >= 0.9, (n, s, m, r)


def test_itq_links_of_vectors_with_a_common_mean(spark):
    rng = np.random.default_rng(9)
    x = np.c_[np.full(400, 1.9), rng.normal(size=(400, 63)) * 1.4 / 63**0.5]
    x = np.r_[x, x[:300] + rng.normal(size=(300, 64)) * 0.13]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum() - len(x)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = itq.links(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


def test_url_rules_and_model(spark):
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "https://a.example.com/en/70", "ftp://example.com/en/6", "http://com/en/", "http://xcom/en/", "http://x.net/de", "http://x.net/de/1#f", "http://Ä.ORG/es/", "a://b://c/d?e"]
    urls += [f"http://{rng.choice(['good', 'fine'])}{rng.randrange(99)}.example.com/en/7{rng.randrange(99)}" for _ in range(80)]
    urls += [f"http://spam{rng.randrange(99)}.other.com/en/{rng.randrange(99)}" for _ in range(80)]
    urls += ["http://spam7.other.io/en/9", "http://good3.example.io/en/73"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for v, r in url_filter.RULES for n, p in [r.split("/", 1)] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fit)[1] if fit else None)
        assert got[i]["verdict"] == max(fit)[2] if fit else got[i]["verdict"] in ("allow", "block")
    assert got[len(urls) - 2]["verdict"] == "block" and got[len(urls) - 1]["verdict"] == "allow"


def test_url_rules_are_those_of_the_contract(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = {f"http://{'x.' * n}{rule}{tail}": rule for rule in want for n in (0, 1) for tail in ("", "1?q")}
    urls |= {"http://example.net/de/7": "net/de/", "http://a.example.net/de/80": "example.net/de/8", "http://example.com/en/8": "com/en/", "http://example.net/en/8": None}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    for i, rule in enumerate(urls.values()):
        assert got[i][0] == rule
        assert rule is None or got[i][1] == want[rule]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (15, 16, 40)]
    texts = [None, "", "plain words only", f"é token = \"{hexes[2]}\" end", f"Password:{hexes[0]}xyz and secret=short", "token=secret:abcdefghijklmnop", "AKIA" + "A1" * 8 + " AKIA12", f"x{hexes[1]}g {hexes[0]} {hexes[1]}", "api_key='ABCDEFGHIJKL' apikey: ..............", "key " + "a3X0f9Y2c8Z1b7X5e4Y6d0Z2" + " heat", "𝒳 token=abcdefabcdefabcdef0123" * 3, "thething" * 4]
    texts += [f"token = \"{''.join(rng.choice('0123456789abcdefXYZ') for _ in range(30))}\" " + prose(rng, 50) for _ in range(40)]
    got = {r["doc_id"]: r for r in secrets.digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = spans_of(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert "random" in got[9]["spans"] and got[11]["spans"] == ""


def test_secrets_are_redacted(spark):
    out = {r["id"]: r for r in secrets.redact(frame(spark, ["é token=abcdefabcdefabcdef01 end", "clean", None]), keep=("lang",)).collect()}
    assert (out[0]["text"], out[0]["changed"]) == ("é [secret] end", True)
    assert (out[1]["text"], out[2]["text"]) == ("clean", "")


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_join.components(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert secrets.digest(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert itq.links(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_passages_hold_every_recurring_window_once_and_automata_find_the_places(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(150)]
        texts = []
        for _ in range(rng.randint(1, 8)):
            t = []
            while len(t) < rng.choice([20, 36, 80, 120]):
                a = rng.randrange(150)
                t += words[a : a + rng.randrange(1, 90)]
            texts.append(b" ".join(t))
        split = [t.split() for t in texts]
        seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
        kinds = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        found = substring_dedup.passages(list(kinds), np.bincount([kinds[t] for t in texts]))
        held = Counter(tuple(p[i : i + 35]) for p in found for i in range(len(p) - 34))
        assert held == Counter({w: 1 for w, n in seen.items() if n > 1})
        for w, spans in zip(split, substring_dedup.locate(texts), strict=True):
            covered = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
            assert covered == {j for a, z in spans for j in range(a, z)}
    monkeypatch.setattr(substring_dedup.Machine, "places", lambda self, words: [])
    assert not any(substring_dedup.locate(texts * 2))


def test_url_scores_equal_plain_markov_models(spark):
    rng = random.Random(31)
    urls = [f"http://{rng.choice(['good', 'fine'])}{rng.randrange(99)}.example.com/en/7{rng.randrange(99)}" for _ in range(60)]
    urls += [f"http://spam{rng.randrange(99)}.other.com/en/{rng.randrange(99)}é" for _ in range(60)]
    urls += ["http://unknown.org/x", "", "ab", urls[0], urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    held = {r["url"]: r["held"] for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held")).collect()}
    got = {r["id"]: r for r in url_filter.judge(df).collect()}
    counts = [Counter(), Counter()]
    for i, u in enumerate(urls):
        if got[i]["rule"] and not held[u]:
            x = bytes(4) + u.encode()
            for j in range(4, len(x)):
                for k in range(5):
                    counts[got[i]["verdict"] == "block"].update([(k, x[j - k : j + 1]), (k, "in", x[j - k : j])])
    for i, u in enumerate(urls):
        x, total = bytes(4) + u.encode(), 0.0
        for j in range(4, len(x)):
            for c, sign in ((counts[0], 1), (counts[1], -1)):
                p = 1 / 256
                for k in range(5):
                    p = (c[k, x[j - k : j + 1]] + 2 * p) / (c[k, "in", x[j - k : j]] + 2)
                total += sign * np.log(p)
        assert abs(got[i]["score"] - total / max(1, len(u.encode()))) < 1e-8
    free = [r for r in got.values() if r["rule"] is None]
    assert len({(r["score"] >= 0, r["verdict"]) for r in free if abs(r["score"]) > 1}) <= 2


def test_language_id_predicts_whole_texts_as_a_plain_network_does(spark):
    rng = random.Random(41)
    kinds = {"aa": "the of and thing wh".split(), "bb": "der die ung keit sch".split()}
    langs = [rng.choice(sorted(kinds)) for _ in range(120)]
    texts = [prose(rng, rng.randint(1, 900), kinds[x]) for x in langs]
    df = frame(spark, [*texts, texts[0], None, "żółć ąę", "12"], [*langs, langs[0], None, None, "aa"])
    net = language_id.fit(df.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    for i, t in enumerate([*texts, texts[0]]):
        rows = language_id.windows(t.encode())
        pooled = []
        for parts in net.responses():
            span = language_id.WINDOW - len(parts) + 1
            pooled.append(sum(p[rows[:, j : j + span]] for j, p in enumerate(parts)).max(1))
        weight = np.full(len(rows), language_id.WINDOW)
        weight[-1] = len(t.encode()) - language_id.WINDOW * (len(rows) - 1)
        p = weight @ net.head(np.concatenate(pooled, 1)) / weight.sum()
        assert got[i]["lang_pred"] == net.langs[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-3
    assert (got[0]["lang_pred"], got[0]["score"]) == (got[120]["lang_pred"], got[120]["score"])
    assert [got[i]["lang_pred"] == "und" for i in (121, 122, 123)] == [True, False, True]


def test_added_secrets_equal_plain_markov_models(spark):
    rng = random.Random(43)
    token = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789+/") for _ in range(n))
    texts = [None, ""] + [f"{prose(rng, 20)} token = {token(24)} {prose(rng, 5)} {token(rng.randint(10, 40))} thethingofandstly_wh {token(18)}" for _ in range(60)]
    docs = frame(spark, [*texts, texts[5], texts[5]])
    pairs, single = {k: Counter() for k in ("random", "ordinary")}, {}
    for t in [*texts, texts[5], texts[5]]:
        t = t or ""
        base = [m[2] for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        base += [m[0] for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [m[0] for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        words = [w for w in re.findall("[A-Za-z][A-Za-z0-9_]{7,}", t) if sum(c.isdigit() for c in w) <= 2 and not any(w in s for s in base)]
        for label, values in (("random", [b for b in base if re.fullmatch("[A-Za-z0-9+/_=.-]{2,}", b)]), ("ordinary", words)):
            for v in values:
                pairs[label].update(zip(v, v[1:]))  # noqa: B905
    logs = {}
    for label, n in pairs.items():
        code = [chr(43 + i) for i in range(80)]
        second, firsts = Counter(), Counter()
        for (a, b), k in n.items():
            second[b] += k
            firsts[a] += k
        total = sum(second.values()) + 0.5 * 80
        logs[label] = {(a, b): np.log((n[a, b] + 10 * (second[b] + 0.5) / total) / (firsts[a] + 10)) for a in code for b in code}
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(docs).collect()}
    added = 0
    for i, t in enumerate(texts):
        taken = [(a, z) for a, _, z in spans_of(t or "")]
        want = set()
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t or ""):
            ratio = sum(logs["random"][p] - logs["ordinary"][p] for p in zip(m[0], m[0][1:]))  # noqa: B905
            if abs(ratio - np.log(1000)) < 1e-2:
                want = None
                break
            if ratio > np.log(1000) and not any(a < m.end() and m.start() < z for a, z in taken):
                want.add(f"random:{m.start()}:{m.end()}")
        if want is not None:
            assert {x for x in got[i].split(",") if x.startswith("random")} == want
            added += len(want)
    assert added > 50 and got[len(texts)] == got[5]
