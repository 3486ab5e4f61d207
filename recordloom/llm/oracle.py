"""DuckDB text for the operators that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w[i:i+34]) AS n FROM d, unnest(range(1, len(w) - 33)) t(i)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win, unnest(range(0, 35)) u(j) WHERE n > 1),
kept AS (
  SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.p) AS t, count(*) AS n
  FROM (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) s(p)) a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p
  GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) t(i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ITQ = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.x = v.vec_id"""

ORACLE = {"op5_substring_dedup": SUBSTRING_DEDUP, "op8_jaccard_join": JACCARD_JOIN, "op9_itq": ITQ}
