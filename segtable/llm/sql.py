"""SQL of the queries that SQL can express, over whole tables; DuckDB's dialect."""

_SPACES = r"[\x20\x09-\x0D]+"

_WORDS = f"list_filter(string_split_regex({{0}}, '{_SPACES}'), lambda x: x <> '')"

#: Ends of links to the least id reachable, by a closure over the links of both directions.
_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM vectors),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sized x JOIN sized y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.98
),
{_COMPONENTS},
degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.id LEFT JOIN degree d ON e.vec_id = d.id
"""

MINHASH_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(component, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(component, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM words, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
places AS (SELECT doc_id, j, w[j] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(j)),
last AS (
  SELECT p.doc_id, p.j, p.word, last_value(r.i IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start
  FROM places p LEFT JOIN repeated r ON p.doc_id = r.doc_id AND p.j = r.i
),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE coalesce(start >= j - 34, false)) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT coalesce(start >= j - 34, false)) AS left_words
  FROM last GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_words, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

ORACLES = {
    "op4_embedding_dedup": EMBEDDING_DEDUP,
    "op8_minhash_dedup": MINHASH_DEDUP,
    "op10_substring_dedup": SUBSTRING_DEDUP,
}
