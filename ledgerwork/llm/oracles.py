"""DuckDB SQL of the queries that SQL can express, written from what they return and not from the Spark code."""

from __future__ import annotations

_REACHED = """reached(id, other) AS (
    SELECT {id}, {id} FROM {table} UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other)"""

COSINE = f"""WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings
    WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
edges AS (
    SELECT a.vec_id a, b.vec_id b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.95),
{_REACHED.format(id="vec_id", table="embeddings")}
SELECT vec_id, (SELECT COUNT(*) FROM edges WHERE a = vec_id) n_links, component_id, vec_id = component_id kept
FROM (SELECT id vec_id, MIN(other) component_id FROM reached GROUP BY 1) c"""

CHATS = r"""WITH turns AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, COUNT(*) n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
    CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
    CAST(SUM(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>#]', '', 'g'))) AS BIGINT) formatted_chars
FROM turns GROUP BY 1"""

NEAR = f"""WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) s FROM words),
sizes AS (SELECT doc_id, COUNT(*) n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id a, b.doc_id b, COUNT(*) n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM shared c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_REACHED.format(id="doc_id", table="documents")}
SELECT c.doc_id, COALESCE(n, 0) n_shingles, component_id, c.doc_id = component_id kept
FROM (SELECT id doc_id, MIN(other) component_id FROM reached GROUP BY 1) c LEFT JOIN sizes z ON z.doc_id = c.doc_id"""

SQL = {"op1_itq_near_dedup": COSINE, "op4_chat_format": CHATS, "op10_superminhash": NEAR}
