"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat, hilbert, licences, packing, periodic, quality, quantised, resampling, secrets, simhash, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.query,
    "op2_simhash": simhash.query,
    "op3_substrings": substrings.query,
    "op4_chat": chat.query,
    "op5_quantised": quantised.query,
    "op6_packing": packing.query,
    "op7_licences": licences.query,
    "op8_bpe": bpe.query,
    "op9_hilbert": hilbert.query,
    "op10_quality": quality.query,
    "op11_topk": topk.query,
    "op12_resampling": resampling.query,
    "op13_runs": periodic.query,
}

SQL: dict[str, str] = {
    "op3_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 windows AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 19), ' ') AS said FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM d)),
 again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY said ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM again),
 kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS rest FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(14 + length(role) + length(text) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS formatted FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c""",
    "op5_quantised": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e]) THEN e END AS e
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
 links AS (SELECT a.k, b.k AS other FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.95),
 reach AS (SELECT k, k AS other FROM v UNION SELECT r.k, l.other FROM reach r JOIN links l ON l.k = r.other),
 component AS (SELECT r.k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.other GROUP BY r.k),
 counts AS (SELECT k, count(*) AS n FROM links GROUP BY k)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN component USING (k) LEFT JOIN counts USING (k)""",
    "op11_topk": """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
 pairs AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = len(c.e) THEN list_dot_product(q.e, c.e) END AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.k <> c.k AND len(q.e) = len(c.e)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5""",
    "op12_resampling": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
 b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
 o AS (SELECT doc_id, row_number() OVER () AS k, words FROM d),
 w AS (SELECT k, unnest(words) AS word FROM o),
 distinct_words AS (SELECT word, [CAST('0x' || substr(hex(encode(word)), 2 * CAST(i AS INTEGER) + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode(word)))] AS bytes FROM (SELECT word FROM w UNION SELECT word FROM b)),
 crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda r, _: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 10000 AS bucket FROM distinct_words),
 corpus AS (SELECT bucket, count(*) AS s FROM w JOIN crc USING (word) GROUP BY bucket),
 target AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
 gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * ((SELECT count(*) FROM w) + 10000) / ((coalesce(s, 0) + 1.0)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g FROM corpus FULL JOIN target USING (bucket)),
 weight AS (SELECT k, sum(g) AS weight FROM w JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY k),
 scored AS (SELECT doc_id, k, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o LEFT JOIN weight USING (k)),
 placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN n <= 10 * (SELECT count(*) FROM placed) // 100 THEN n END AS rank FROM scored s LEFT JOIN placed p USING (k)""",
}
