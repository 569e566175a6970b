"""DuckDB SQL for the queries, by the same names."""

from __future__ import annotations

from notewright.operators import notes

_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda w: w <> '')"


_FILES = "files AS (SELECT '/vault/' || source || '/' || doc_id || '.md' AS source, text AS content, doc_id FROM documents)"
_HEADED = "headed AS (SELECT source, '---' || chr(10) || 't: x' || chr(10) || '---' || chr(10) || replace(content, chr(10), chr(10) || '## ') AS content FROM files)"
_HASHES = """hashes AS (
  SELECT source, CASE WHEN doc_id % 10 = 1 THEN md5('old') ELSE md5(content) END AS hash FROM files WHERE doc_id % 10 <> 0
  UNION ALL SELECT '/vault/gone/' || doc_id || '.md', md5(content) FROM files WHERE doc_id % 10 = 2)"""
_CHANGED = "changed AS (SELECT source, content, doc_id, md5(content) AS content_hash, CASE WHEN hash IS NULL THEN 'new' ELSE 'changed' END AS change FROM files LEFT JOIN hashes USING (source) WHERE md5(content) IS DISTINCT FROM hash)"


def _body(table: str, mark: str = "") -> str:
    return f"body{mark} AS (SELECT source, CASE WHEN starts_with(content, '---') AND len(string_split(content, '---')) >= 3 THEN array_to_string(string_split(content, '---')[3:], '---') ELSE content END AS body FROM {table})"


def _sections(table: str, mark: str = "") -> str:
    """CTEs body, parts and sections of a table, their names with a mark."""
    return f"""{_body(table, mark)},
parts{mark} AS (SELECT source, unnest(string_split(body, chr(10) || '## ')) AS part, unnest(range(len(string_split(body, chr(10) || '## ')))) AS section FROM body{mark} WHERE body IS NOT NULL),
sections{mark} AS (SELECT source, section, text FROM (SELECT source, section, CASE WHEN section = 0 THEN '' ELSE '## ' END || {_strip('part')} AS text FROM parts{mark}) WHERE text <> '')"""


def _chunks(size: int, keep: int = 16) -> str:
    """Windows by following, for each long section, from one window to the next over running totals."""
    return f"""{_FILES}, {_sections('files')},
long AS (SELECT source, section, {_words('text')} AS words FROM sections WHERE length(text) > {2 * size}),
each AS (SELECT source, section, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM long),
running AS (SELECT source, section, i, sum(length(word) + 1) OVER (PARTITION BY source, section ORDER BY i) AS total FROM each),
totals AS MATERIALIZED (SELECT source, section, words, c, len(words) AS n FROM long JOIN (SELECT source, section, list(total ORDER BY i) AS c FROM running GROUP BY source, section) USING (source, section)),
win AS (
  SELECT source, section, 0 AS w, 0 AS a, greatest(1, 1 + len(list_filter(c, lambda x: x < {size}))) AS e, n FROM totals
  UNION ALL
  SELECT t.source, t.section, w + 1, s, greatest(win.e + 1, 1 + len(list_filter(c, lambda x: x < base + {size}))), t.n
  FROM (SELECT *, greatest(a, e - {keep}) AS s FROM win WHERE e <= n) win JOIN totals t ON t.source = win.source AND t.section = win.section, LATERAL (SELECT CASE WHEN s = 0 THEN 0 ELSE c[s] END AS base)),
chunks AS (
  SELECT source, section, 0 AS w, text FROM sections WHERE length(text) <= {2 * size}
  UNION ALL SELECT win.source, win.section, w, array_to_string(words[a + 1 : least(e, win.n)], ' ') FROM win JOIN totals t ON t.source = win.source AND t.section = win.section)"""


_RECURSIVE = "WITH RECURSIVE " + _chunks(512)

_EVENTS = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS micros, event_type = 'error' AS failed FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_DEBOUNCE = f"""
WITH RECURSIVE {_EVENTS},
jump AS (SELECT user_id, micros, min(event_id) AS event_id, min(micros) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 21600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM ev GROUP BY user_id, micros),
kept AS (SELECT * FROM jump WHERE micros = (SELECT min(micros) FROM ev WHERE ev.user_id = jump.user_id)
  UNION ALL SELECT j.* FROM kept JOIN jump j ON j.user_id = kept.user_id AND j.micros = kept.next)
SELECT event_id, user_id, micros FROM kept
"""


def _hits(metric: str, ids: str, k: int = 5) -> str:
    a, b = "e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]"
    distance = {"l2": f"pow(list_distance({a}, {b}), 2)", "cosine": f"1 - list_cosine_similarity({a}, {b})", "dot": f"1 - list_inner_product({a}, {b})"}[metric]
    return f"""hits AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {distance} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id IN ({ids}) QUALIFY rank <= {k})"""


_TOP = "SELECT query_id, rank, vec_id, label, round(distance, 6) + 0.0 AS distance FROM hits"  # no negative zero

_NOTES = """notes AS (
  SELECT '/vault/' || source || '/' || CASE WHEN i % 11 = 0 THEN 'Note ' ELSE 'note-' END || i || '.md' AS source,
    CASE WHEN i % 7 = 0 THEN '# No front' || chr(10) ELSE '---' || chr(10) || 'type: ' || ['error', 'decision', 'research', 'project', 'moc', 'idea'][i % 6 + 1] || chr(10) || CASE WHEN i % 5 = 0 THEN '' ELSE 'status: active' || chr(10) END
      || 'date: 2024-' || lpad((i % 14 + 1)::VARCHAR, 2, '0') || '-03' || chr(10) || 'tags: [' || lang || CASE WHEN i % 3 = 0 THEN '' ELSE ', status/active, topic-' || (i % 4) END || ']' || chr(10) || '---' || chr(10) END
    || 'Body ' || i || ' ' || coalesce(text, '') || ' [[missing-' || (i % 9) || ']]' || CASE WHEN i % 4 = 0 THEN '' ELSE chr(10) || '## Related' || chr(10) || '[[note-' || (i + 1) || ']] [[note-' || (i * 3 % 500) || '|see also]]' || chr(10) END AS content
  FROM (SELECT doc_id AS i, source, lang, text FROM documents WHERE doc_id IS NOT NULL))"""
_FIELDS = """fields AS (
  SELECT source, content, fm IS NULL AS bare, nullif(trim(regexp_extract(fm, '(?m)^type:[ \\t]*([^\\n]*)$', 1)), '') AS type, nullif(trim(regexp_extract(fm, '(?m)^status:[ \\t]*([^\\n]*)$', 1)), '') AS status,
    nullif(trim(regexp_extract(fm, '(?m)^date:[ \\t]*([^\\n]*)$', 1)), '') AS date,
    coalesce(list_filter(string_split(regexp_replace(nullif(trim(regexp_extract(fm, '(?m)^tags:[ \\t]*([^\\n]*)$', 1)), ''), '^\\[|\\]$|\\s', '', 'g'), ','), lambda x: x <> ''), []) AS tags
  FROM (SELECT *, CASE WHEN starts_with(content, '---' || chr(10)) THEN string_split(content, '---' || chr(10))[2] END AS fm FROM notes))"""
_LINKS = """links AS (SELECT source, trim(string_split(link, '|')[1]) AS target, CASE WHEN contains(link, '|') THEN trim(array_to_string(string_split(link, '|')[2:], '|')) ELSE trim(string_split(link, '|')[1]) END AS display
  FROM (SELECT source, unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)) AS link FROM notes)),
names AS (SELECT regexp_replace(string_split(source, '/')[-1], '\\.md$', '') AS target, min(source) AS resolved FROM notes GROUP BY 1),
resolved AS (SELECT links.source, links.target, display, resolved FROM links LEFT JOIN names USING (target))"""


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ROUTES = ", ".join(f"('{t}', '{f}')" for t, f in notes.ROUTES)
_CATEGORIES = ", ".join(f"('{c}', '{f}', [{_in(w)}])" for c, f, w in notes.CATEGORIES)


def _scan(turns: str) -> str:
    return f"""cats(category, folder, cues) AS (VALUES {_CATEGORIES}),
turns AS ({turns}),
scan AS (SELECT conv_id, category, folder, count(*) AS n_turns FROM turns, cats WHERE text IS NOT NULL AND list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), cues) AND NOT (category = '{notes.CATEGORIES[0][0]}' AND regexp_matches(lower(text), '{notes.LOOKS_AROUND}')) GROUP BY 1, 2, 3)"""


ORACLES = {
    "scan_filter": f"WITH {_FILES} SELECT source, length(content) AS size FROM files WHERE doc_id % 6 <> 0 AND NOT contains(source, '/src1') AND NOT contains(source, '.git') AND content IS NOT NULL",
    "scan_by_component": f"WITH {_FILES} SELECT source FROM files WHERE NOT list_has_any(string_split(source, '/'), ['src1', '.git']) AND content IS NOT NULL",
    "file_hash": f"WITH {_FILES} SELECT source, md5(content) AS content_hash FROM files",
    "decode_text": f"WITH {_FILES} SELECT source, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE md5(content) END AS content_hash FROM files",
    "blank_filter": f"WITH {_FILES} SELECT source, length({_strip('content')}) AS size FROM files WHERE doc_id % 8 <> 0 AND {_strip('content')} <> ''",
    "read_file": f"WITH {_FILES} SELECT source, content, length(content) AS size FROM files WHERE source LIKE '%/42.md'",
    "changed_files": f"WITH {_FILES}, {_HASHES}, {_CHANGED} SELECT source, content_hash, change FROM changed",
    "deleted_files": f"WITH {_FILES}, {_HASHES} SELECT source FROM hashes WHERE source NOT IN (SELECT source FROM files)",
    "delete_by_source": f"{_RECURSIVE} SELECT source, count(*) AS chunks FROM chunks WHERE source NOT IN (SELECT source FROM files WHERE doc_id % 10 = 3) GROUP BY source",
    "upsert_replace": f"WITH {_FILES}, {_HEADED}, {_sections('headed')}, {_HASHES}, {_CHANGED}, {_sections('files', '_new')} SELECT source, section, md5(text) AS chunk_id FROM sections WHERE source NOT IN (SELECT source FROM changed) UNION ALL SELECT source, section, md5(text) FROM sections_new WHERE source IN (SELECT source FROM changed)",
    "hashes_after_run": f"WITH {_FILES}, {_HASHES}, {_CHANGED} SELECT source, hash FROM hashes WHERE source NOT IN (SELECT source FROM changed) UNION ALL SELECT source, content_hash FROM changed WHERE doc_id % 20 <> 1 AND {_strip('content')} <> ''",
    "front_matter_strip": f"WITH {_FILES}, {_HEADED}, {_body('headed')} SELECT source, md5(body) AS body_md5 FROM body",
    "section_split": f"WITH {_FILES}, {_HEADED}, {_sections('headed')} SELECT source, section, md5(text) AS text_md5, length(text) AS size FROM sections",
    "chunk_windows": f'{_RECURSIVE} SELECT source, section, w AS "window", md5(text) AS chunk_id, length(text) AS size FROM chunks',
    "chunk_truncate": f'WITH RECURSIVE {_chunks(1500)} SELECT source, w AS "window", md5(text) AS chunk_id, md5(substring(text, 1, 1024)) AS stored_md5, least(length(text), 1024) AS size FROM chunks',
    "duplicate_chunk_ids": f"{_RECURSIVE} SELECT md5(text) AS chunk_id, count(*) AS n, count(DISTINCT source) AS sources FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "overlap_lengths": f"WITH {_FILES} SELECT source, coalesce(list_sum(list_transform({_words('content')}[-16:], lambda w: length(w) + 1)), 0)::BIGINT AS overlap FROM files",
    "embed_batches": f'{_RECURSIVE} SELECT source, batch, count(*) AS chunks FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY section, w) - 1) // 50 AS batch FROM chunks) GROUP BY source, batch',
    "hash_embedder": "WITH w AS (SELECT conv_id, turn, md5(unnest(string_split(coalesce(text, ''), ' '))) AS h FROM conversations), p AS (SELECT conv_id, turn, ('0x' || substring(h, 1, 7))::BIGINT % 16 AS place, CASE WHEN ('0x' || substring(h, 8, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS sign FROM w), "
    + "s AS (SELECT conv_id, turn, place, sum(sign)::DOUBLE AS v FROM p GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL) "
    + "SELECT n.conv_id, n.turn, " + ", ".join(f"round(coalesce(max(v / nullif(norm, 0)) FILTER (place = {i}), 0)::FLOAT::DOUBLE, 5) AS v{i}" for i in range(8)) + " FROM n LEFT JOIN s USING (conv_id, turn) GROUP BY n.conv_id, n.turn",
    "search_topk_l2": f"WITH {_hits('l2', '0')} {_TOP}",
    "search_topk_cosine": f"WITH {_hits('cosine', '0')} {_TOP}",
    "search_topk_dot": f"WITH {_hits('dot', '0')} {_TOP}",
    "search_multi_query": f"WITH {_hits('l2', '0, 7, 42')} {_TOP}",
    "search_threshold": f"WITH {_hits('cosine', '0, 7, 42', 20)} SELECT query_id, vec_id, round(1 - distance, 6) AS similarity FROM hits WHERE 1 - distance >= 0.5",
    "search_snippet": f"WITH {_hits('l2', '7')} SELECT rank, vec_id, substring(text, 1, 300) AS text FROM hits JOIN documents ON doc_id = vec_id",
    "search_whole_files": f"WITH {_FILES}, {_hits('l2', '0')} SELECT rank, source, length(content) AS size FROM hits JOIN files ON doc_id = vec_id",
    "search_query_table": f"WITH {_hits('l2', 'SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0')} {_TOP}",
    "search_cells": f"WITH {_hits('l2', '0')} {_TOP}",
    "chunk_table_function": f'{_RECURSIVE} SELECT source, section, w AS "window", md5(text) AS chunk_id, length(text) AS size FROM chunks',
    "store_after_runs": _RECURSIVE.replace("FROM documents", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 25 = 3 THEN text || chr(10) || '## Added' || chr(10) || 'later' ELSE text END AS text) FROM documents WHERE doc_id % 40 <> 7)") + " SELECT source, count(*) AS chunks, max(section) AS last_section FROM chunks GROUP BY source",
    "get_chunks": f'{_RECURSIVE} SELECT source, section, w AS "window", md5(text) AS chunk_id FROM chunks WHERE source = \'/vault/src2/42.md\' ORDER BY section, w LIMIT 50',
    "vault_stats": f"{_RECURSIVE} SELECT count(*) AS total_chunks, count(DISTINCT source) AS unique_files FROM chunks",
    "top_files": f"{_RECURSIVE} SELECT source, count(*) AS chunks FROM chunks GROUP BY source ORDER BY chunks DESC, source LIMIT 15",
    "stats_envelope": f"{_RECURSIVE}, top AS (SELECT source, count(*) AS n FROM chunks GROUP BY source ORDER BY n DESC, source LIMIT 15) SELECT (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(DISTINCT source) FROM chunks) AS unique_files, 'store' AS db_path, 'hashed-words' AS embed_model, (SELECT string_agg(source || ':' || n, ',' ORDER BY n DESC, source) FROM top) AS top_files",
    "index_stats": f"WITH {_FILES}, {_HASHES} SELECT (SELECT count(*) FROM hashes) AS indexed_files, (SELECT count(*) FROM files WHERE source LIKE '%.md') AS total_md_files",
    "backup_retention": "SELECT kind, name FROM (SELECT o_orderpriority AS kind, 'backup_' || lpad(o_orderkey::VARCHAR, 9, '0') AS name FROM orders) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY name DESC) <= 2",
    "debounce": _DEBOUNCE,
    "watch_stream": _DEBOUNCE,
    "circuit_breaker": f"""
WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY micros, event_id) AS n FROM ev),
s AS (
  SELECT user_id, n, event_id, CASE WHEN failed THEN 1 ELSE 0 END::BIGINT AS failures, NULL::BIGINT AS until, 'passed' AS state FROM o WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN closed THEN f ELSE failures END, CASE WHEN closed THEN CASE WHEN f >= 2 THEN micros + 172800000000 END ELSE until END, CASE WHEN NOT closed THEN 'rejected' WHEN f >= 2 THEN 'opened' ELSE 'passed' END
  FROM (SELECT o.user_id, o.n, o.event_id, o.micros, s.failures, s.until, s.until IS NULL OR o.micros >= s.until AS closed, CASE WHEN o.failed THEN CASE WHEN s.until IS NULL THEN s.failures ELSE 0 END + 1 ELSE 0 END AS f FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
SELECT event_id, state, failures FROM s""",
    "front_matter_fields": f"WITH {_NOTES}, {_FIELDS} SELECT source, type, status, date, array_to_string(tags, ',') AS tags FROM fields",
    "tags_explode": f"WITH {_NOTES}, {_FIELDS}, t AS (SELECT source, unnest(list_distinct(tags)) AS tag FROM fields) SELECT CASE WHEN contains(tag, '/') THEN string_split(tag, '/')[1] ELSE '' END AS prefix, tag, count(*) AS notes FROM t GROUP BY 1, 2",
    "wikilinks": f"WITH {_NOTES}, {_LINKS} SELECT source, target, display FROM links",
    "backlinks": f"WITH {_NOTES}, {_LINKS} SELECT resolved, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM resolved WHERE resolved IS NOT NULL GROUP BY 1",
    "broken_links": f"WITH {_NOTES}, {_LINKS} SELECT DISTINCT source, target FROM resolved WHERE resolved IS NULL",
    "note_lint": f"""
WITH {_NOTES}, {_FIELDS}, l AS (SELECT source, concat_ws(',', CASE WHEN bare THEN 'no-front-matter' END, CASE WHEN type IS NULL THEN 'no-type' END, CASE WHEN type NOT IN ({_in(notes.TYPES)}) THEN 'unknown-type' END,
  CASE WHEN coalesce(status, '') NOT IN ({_in(notes.STATUSES)}) THEN 'unknown-status' END, CASE WHEN try_strptime(date, '%Y-%m-%d') IS NULL THEN 'bad-date' END, CASE WHEN len(tags) NOT BETWEEN 2 AND 5 THEN 'tag-count' END,
  CASE WHEN len(list_filter(tags, lambda t: NOT regexp_full_match(t, '[a-z0-9/-]+'))) > 0 THEN 'tag-form' END,
  CASE WHEN NOT regexp_full_match(regexp_replace(string_split(source, '/')[-1], '\\.md$', ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:-[a-z0-9-]+)?|MOC-[a-z0-9-]+|[a-z0-9]+(?:-[a-z0-9]+)*') THEN 'file-name' END,
  CASE WHEN NOT regexp_matches(content, '(?:^|\\n)## Related\\n[^#]*\\[\\[') THEN 'no-related' END) AS problems FROM fields)
SELECT source, problems FROM l WHERE problems <> ''""",
    "moc_candidates": f"WITH {_NOTES}, {_FIELDS}, f AS (SELECT *, regexp_replace(source, '/[^/]*$', '') AS folder FROM fields), t AS (SELECT DISTINCT folder, unnest(tags) AS name FROM f) SELECT 'folder' AS kind, folder AS name, count(*) AS n FROM f GROUP BY 2 HAVING count(*) >= 50 UNION ALL SELECT 'topic', name, count(*) FROM t WHERE NOT contains(name, '/') GROUP BY 2 HAVING count(*) >= 3",
    "route_notes": f"WITH {_NOTES}, {_FIELDS}, routes(type, folder) AS (VALUES {_ROUTES}), p AS (SELECT source, fields.type, coalesce(folder, '{notes.UNROUTED}') AS folder, regexp_replace(string_split(source, '/')[-1], '\\.md$', '') AS name FROM fields LEFT JOIN routes USING (type)), n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY source) AS k FROM p) SELECT source, type, folder || name || CASE WHEN k > 1 THEN '-v' || k ELSE '' END || '.md' AS destination, CASE WHEN folder = '{notes.UNROUTED}' THEN '{notes.NEEDS_ROUTING}' ELSE '' END AS tag FROM n",
    "moc_lint": f"""
WITH m AS (SELECT '/vault/07-INDEX/' || CASE WHEN i % 18 = 0 THEN 'MOC-' ELSE 'map-' END || i || '.md' AS source, i % 9 <> 0 OR i % 18 = 0 AS is_map, i,
  '## Entries' || chr(10) || '- ' || CASE WHEN i % 3 = 0 THEN 'plain' ELSE '[[' || CASE WHEN i % 5 = 0 THEN '06-SYSTEM/rules/' ELSE '' END || 'note-' || i || ']]' END || CASE WHEN i % 4 = 0 THEN '' ELSE ' about it' END || chr(10) || coalesce(text, '')
  || chr(10) || '## Related MOCs' || chr(10) || CASE WHEN i % 7 = 0 THEN '' ELSE '- [[MOC-other]] more' || chr(10) END || CASE WHEN i % 2 = 0 THEN '' ELSE chr(10) || '## Recent Updates' || chr(10) || '2024-05-06 made' || chr(10) END AS content
  FROM (SELECT doc_id AS i, text FROM documents WHERE doc_id IS NOT NULL)),
e AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '- ')) AS entries FROM m WHERE is_map),
l AS (SELECT source, concat_ws(',', CASE WHEN len(list_filter(entries, lambda x: NOT regexp_matches(x, '\\[\\[[^\\[\\]]+\\]\\]'))) > 0 THEN 'bare-entry' END,
  CASE WHEN len(list_filter(entries, lambda x: regexp_matches(x, '\\[\\[[^\\[\\]]+\\]\\]\\s*$'))) > 0 THEN 'no-description' END,
  CASE WHEN regexp_matches(content, '(?:^|\\n)## [^\\n]*\\n\\s*(?:\\n## |$)') THEN 'empty-section' END,
  CASE WHEN regexp_matches(content, '\\[\\[(?:[^\\[\\]]*/)?(?:templates|rules)/') THEN 'links-rules' END,
  CASE WHEN NOT regexp_matches(content, '(?:^|\\n)## Related MOCs\\n[^#]*\\[\\[MOC-') THEN 'no-related-maps' END,
  CASE WHEN NOT regexp_matches(content, '(?:^|\\n)## Recent Updates\\n[^#]*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'no-recent-updates' END) AS problems FROM e)
SELECT source, problems FROM l WHERE problems <> ''""",
    "session_scan": f"WITH {_scan('''SELECT source AS conv_id, CASE WHEN doc_id % 3 = 0 THEN 'a bug and a decision. ' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN 'grep x: exit code 1' || chr(10) ELSE '' END || text AS text FROM documents''')} SELECT * FROM scan",
    "session_reports": f"""WITH {_scan("SELECT conv_id, CASE WHEN turn % 4 = 1 THEN 'A lesson: the project is stuck' ELSE text END AS text FROM conversations")}, sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), items AS (SELECT conv_id, string_agg(category || ':' || n_turns, ', ' ORDER BY category || ':' || n_turns) AS items FROM scan GROUP BY 1) SELECT conv_id, coalesce(items, '') AS items, n > 10 AS complex FROM sizes LEFT JOIN items USING (conv_id)""",
    "chronological_notes": f"WITH {_EVENTS} SELECT event_id, user_id FROM (SELECT *, lag(micros) OVER (PARTITION BY user_id ORDER BY event_id % 50, event_id) AS before FROM ev) WHERE micros < before",
}
