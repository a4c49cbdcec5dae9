"""DuckDB SQL for the operators whose rows SQL can express."""

from __future__ import annotations

#: A-Z lower-cased and nothing else.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
),
bt AS (SELECT item, g, string_split(g, ' ') AS t FROM bw),
v AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(t) AS word FROM bt)),
bi AS (SELECT item, g, list(DISTINCT id) AS ids, min(id) FILTER (word = t[1]) AS first FROM (SELECT item, g, t, unnest(t) AS word FROM bt) JOIN v USING (word) GROUP BY item, g),
dl AS (SELECT doc_id, p, coalesce(id, 0) AS id FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN v USING (word)),
ds AS (SELECT doc_id, list(id ORDER BY p) AS ws, list(DISTINCT id) AS own FROM dl GROUP BY doc_id),
pairs AS (SELECT doc_id, ws, item, first, ids FROM ds JOIN bi ON list_has_all(own, ids)),
near AS (
  SELECT doc_id, count(DISTINCT p) AS n_near, count(DISTINCT item) AS n_near_items
  FROM pairs JOIN dl USING (doc_id) WHERE id = first AND list_has_all(ws[greatest(p - 20, 1) : p + 20], ids) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(hits.n_hit, 0) > 0 AS contaminated, CAST(coalesce(near.n_near, 0) AS BIGINT) AS n_near,
  CAST(coalesce(near.n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT g.doc_id, g.i FROM g JOIN f ON g.g = f.g WHERE g.doc_id > f.first)
),
kept AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) k
  LEFT JOIN hit ON k.doc_id = hit.doc_id AND k.p = hit.p WHERE hit.p IS NULL GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_KEY = _LOWER.format(r"trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

LINES = f"""
WITH l AS (
  SELECT doc_id, p, line, {_KEY} AS k
  FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS p, unnest(t) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))
),
c AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
f AS (SELECT l.doc_id, l.p, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.x, c.x) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM s) WHERE r <= 10
"""

INNER = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(q.x, c.x) AS BIGINT)) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

#: CRC-32 of a decimal number: each byte is mixed in before the first of eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, 8 * strlen({0})),
  lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({0}, i // 8 + 1, 1)) ELSE 0 END)),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT *, sha256({" || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    sha256({" || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_PART.format(_LOWER.format("text"))}) AS other,
    coalesce({_CRC.format("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS tampered
  FROM documents
),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size
  FROM d
),
t AS (
  SELECT 0 AS level, source, place AS idx, size, leaf AS digest FROM l
  UNION ALL
  SELECT level + 1, source, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE size > 1
  GROUP BY level, source, idx // 16, size
),
s AS (SELECT source, digest, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM t WHERE size = 1),
u AS (
  SELECT 0 AS level, place AS idx, size, digest FROM s
  UNION ALL
  SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE size > 1 GROUP BY level, idx // 16, size
),
tw AS (
  SELECT a.level, a.source, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lt,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rt
  FROM t a JOIN t b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.idx // 16 = b.idx // 16
  WHERE a.size > 1 GROUP BY a.level, a.source, a.idx
),
uw AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lt,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rt
  FROM u a JOIN u b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY a.level, a.idx
),
steps AS (
  SELECT l.source, l.place, tw.level AS step, lt, rt FROM l JOIN tw ON l.source IS NOT DISTINCT FROM tw.source AND l.place // CAST(power(16, tw.level) AS BIGINT) = tw.idx
  UNION ALL
  SELECT l.source, l.place, 100 + uw.level, lt, rt
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN uw ON s.place // CAST(power(16, uw.level) AS BIGINT) = uw.idx
),
p AS (SELECT source, place, string_agg(lt || rt, '' ORDER BY step) AS proof, list(lt || ',' || rt ORDER BY step) AS way FROM steps GROUP BY source, place),
f AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM u WHERE size = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_concat([CASE WHEN tampered THEN other ELSE leaf END], coalesce(p.way, [])),
      lambda node, w: sha256(split_part(w, ',', 1) || node || split_part(w, ',', 2))) AS folded_root
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.place = p.place
)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op3_substring_dedup": SUBSTRINGS,
    "op6_line_dedup": LINES,
    "op11_mtree": INNER,
    "op13_merkle": MERKLE,
}
