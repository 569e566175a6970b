"""DuckDB SQL for the results of the queries, where SQL expresses them."""

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[p : p + k - 1], ' ') for p in range(1, len(w) - k + 2)]) AS g FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
k AS (SELECT DISTINCT k FROM i),
x AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[p : p + k - 1], ' ') for p in range(1, len(w) - k + 2)]) AS g FROM d, k WHERE len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM x JOIN s USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item::DOUBLE, 6) AS containment
FROM c JOIN n USING (item_id) WHERE n_shared * 10 >= n_item * 8
"""

TOOL_CALLS = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c0 AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'chat.reply' WHEN 'system' THEN 'chat.configure' END AS name, text FROM t WHERE role IN ('user', 'system')),
c AS (SELECT conv_id, turn, min(name) AS name, min_by(text, (name, text)) AS text FROM c0 GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS output FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
g AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM g)
SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS call_turn,
  CASE WHEN l.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
  name, level, CASE WHEN l.conv_id IS NULL THEN NULL WHEN level = 0 THEN 1 ELSE 0 END AS n_missing,
  l.conv_id IS NOT NULL AND text IS NOT NULL AS valid,
  CASE WHEN l.conv_id IS NOT NULL THEN CASE WHEN text IS NULL THEN 'missing text' ELSE '' END END AS problems,
  sha256('{"arguments":' || CASE WHEN l.conv_id IS NULL THEN 'null' WHEN text IS NULL THEN json_object('turn', l.turn)::VARCHAR ELSE json_object('text', text, 'turn', l.turn)::VARCHAR END
    || ',"name":' || json_array(name)::VARCHAR || ',"output":' || json_array(output)::VARCHAR || '}') AS canonical_sha256,
  length(output) AS output_chars
FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn
"""

JACCARD = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[p : p + 2], ' ') for p in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT DISTINCT a AS node, a AS to_node FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(to_node) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""

COLLOCATIONS = """
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
x AS (SELECT lang, m, unnest([w[i : i + m - 1] for i in range(1, len(w) - m + 2)]) AS g FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*)::HUGEINT AS f FROM x GROUP BY ALL HAVING count(*) >= 100),
i AS (SELECT lang, g AS q, f AS fq, unnest(list_concat([g[1 : m - 1]], [g[2 : m]])) AS g FROM f WHERE m > 2),
c AS (SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.lang = f.lang AND i.g = f.g AND fq >= f.f)),
k AS (SELECT c.lang, c.m, c.g, c.f, unnest(range(1, c.m)) AS k FROM c),
s AS (SELECT k.lang, k.g, k.f AS a, k.k, l.f AS l, r.f AS r, n.n, (1000 * k.f * n.n) // (l.f * r.f) AS score
  FROM k JOIN n USING (lang) JOIN f l ON l.lang = k.lang AND l.g = k.g[1 : k.k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.k + 1 : k.m]),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, min_by(struct_pack(l := l, r := r, n := n, score := score), (score, k)) AS c FROM s GROUP BY lang, g, a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase) AS rank, phrase, a, c.l AS l, c.r AS r, c.n AS n, c.score AS score FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""

REPEATS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM v),
f AS (SELECT g, min(doc_id) AS f FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM x JOIN f USING (g) WHERE f < doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

ORACLES: dict[str, str] = {"op1_tool_call_linking": TOOL_CALLS, "op3_benchmark_decontamination": DECONTAMINATION, "op9_ngram_jaccard_join": JACCARD, "op11_phrase_collocations": COLLOCATIONS, "op12_substring_dedup": REPEATS}
