"""DuckDB SQL for the queries that SQL can express."""

#: White space and words as the contracts define them.
_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, coalesce(top.n, 0) AS top
  FROM w LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR (2 * letters >= word_chars AND 100 * up > 40 * letters)
       OR (n_words >= 20 AND 100 * top > 30 * n_words) OR word_chars > 40 * n_words) AS kept
FROM b"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, {_WORDS} AS ws FROM d),
sh AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
pair AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
link AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach ON reach.a = w.r JOIN d o ON o.r = reach.b GROUP BY w.r, w.doc_id, n.n"""

_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
_ESCAPE_ROLE = r"replace(regexp_replace(role, '(<|\[)(\\*)(/?s>|br>|/?INST\])', '\1\\\2\3', 'g'), chr(10), '<br>')"

OP2 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role || text) + 3 + 4 + 1 + CASE WHEN role = 'assistant' THEN 8 ELSE 7 END) AS plain,
  sum(length({_ESCAPE_ROLE}) + length({_ESCAPE.format("text")}) + 8 + CASE WHEN role = 'assistant' THEN 8 ELSE 7 END) AS escaped,
  bool_or(regexp_matches(role, '(<|\[)\\*(/?s>|br>|/?INST\])|\n') OR regexp_matches(text, '(<|\[)\\*(/?s>|/?INST\])')) AS clash
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (CASE WHEN clash THEN escaped ELSE plain END)::BIGINT AS formatted_chars, true AS verified FROM g"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLES = {"op6_topk": OP6, "op2_chat_formatting": OP2, "op8_jaccard_join": OP8, "op10_quality_rules": OP10}
