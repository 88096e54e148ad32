"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The component of each id: the least id it reaches over links (a, b), both directions given.
_REACH = "reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)"

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::double[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM h JOIN m USING (k), range(50) t(j) WHERE first < doc_id),
a AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, (len(ws) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {WORDS} AS ws FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), g AS (SELECT doc_id, md5(g) AS g, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT doc_id, sum(n) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * common >= 4 * (x.n + y.n - common)
  UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.text = b.text AND a.doc_id <> b.doc_id
), {_REACH}, c AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM documents LEFT JOIN c ON doc_id = c.id
"""

_PART = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_PART, ["doc_id", "source", "lang", "n_chars", text])) + ")"
#: CRC-32 by its definition, a bit at a time.
_BITS = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
_CRC = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, x: {_BITS}), 4294967295)"
#: The levels of a forest whose leaves are (tree, idx, digest, n).
_RISE = lambda name, leaves: f"{name} AS (SELECT tree, 0 AS lv, idx, digest, n FROM {leaves} UNION ALL SELECT tree, lv + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, lv, idx // 8, n)"
_RUNS = lambda name, nodes: f"{name} AS (SELECT tree, lv, idx // 8 AS run, list(digest ORDER BY idx) AS ds FROM {nodes} WHERE n > 1 GROUP BY ALL)"
_CLIMB = lambda name, start, runs: f"""{name} AS (SELECT row, tree, 0 AS lv, idx, node, proof FROM {start}
  UNION ALL SELECT c.row, c.tree, c.lv + 1, c.idx // 8, sha256(array_to_string(ds[: c.idx % 8] || [c.node] || ds[c.idx % 8 + 2 :], '')), c.proof || array_to_string(ds[: c.idx % 8] || ds[c.idx % 8 + 2 :], '')
  FROM {name} c JOIN {runs} r ON r.tree = c.tree AND r.lv = c.lv AND r.run = c.idx // 8)"""  # noqa: E731

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n, {_LEAF("text")} AS leaf,
    {_LEAF("CASE WHEN " + _CRC + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS changed FROM documents
), l AS MATERIALIZED (SELECT row, doc_id, tree, n, leaf AS digest, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
{_RISE("up", "l")}, s AS MATERIALIZED (SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS n FROM up WHERE n = 1), {_RISE("above", "s")}, {_RUNS("r", "up")}, {_RUNS("t", "above")},
b AS (SELECT row, tree, idx, coalesce(changed, digest) AS node, '' AS proof FROM l), {_CLIMB("c", "b", "r")},
e AS (SELECT row, arg_max(tree, lv) AS tree, arg_max(node, lv) AS node, arg_max(proof, lv) AS proof FROM c GROUP BY row), f AS (SELECT row, 0 AS tree, tree AS idx, node, proof FROM e), {_CLIMB("g", "f", "t")},
z AS (SELECT row, arg_max(node, lv) AS folded_root, sha256(arg_max(proof, lv)) AS proof_sha256 FROM g GROUP BY row)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM above WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT digest FROM above WHERE n = 1) AS verified
FROM l JOIN s ON s.idx = l.tree JOIN z USING (row)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::bigint AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::int AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
