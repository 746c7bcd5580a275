"""SQL for queries whose rules take more than a line: chunkers, patterns, name rules, paths, lists of a graph.

The SQL states the rules a second time, by DuckDB's own regular expressions, lists and recursion; it shares nothing with
the operators but their fixed patterns and word lists.
"""

from __future__ import annotations

import re

from tessella import schema
from tessella.operators import evaluation, extraction
from tessella.plans.corpus import CHUNKS, EMBEDDED, WORDS
from tessella.plans.fixtures import cte
from tessella.plans.graph import EDGES, KIND, LINKS, STAR_SQL

assert WORDS == "the of" and STAR_SQL

WORD = r"\p{L}\p{N}_"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


def re2(pattern: str, flags: str = "") -> str:
    """A pattern for DuckDB: unicode word characters are spelled out, flags that it doesn't know are left out."""
    given = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    flags += "".join(f for f in (given[1] if given else "") if f in "sim")
    body, out, inside, i = pattern[given.end() :] if given else pattern, "", False, 0
    while i < len(body):
        two = body[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            out += (WORD if inside else f"[{WORD}]") if two == r"\w" else two
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out += two[0]
        i += 1
    return quoted((f"(?{flags})" if flags else "") + out)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_digest = "SELECT doc_id, chunk_index, start, length(x) // 4 + 1 AS token_count, md5(x) AS digest FROM "
_lines = "ln AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE trim(text) <> ''))"

# lines to chunks one after another: a heading begins one, and so does the line after one that is full
MARKDOWN = rf"""WITH RECURSIVE {_lines}, hd AS (SELECT *, regexp_matches(l, '^#{{2,3}}\s') AS h FROM ln),
st AS (SELECT doc_id, i, 0 AS c, CASE WHEN h THEN length(l) ELSE length(l) + 1 END AS size FROM hd WHERE i = 0
 UNION ALL SELECT n.doc_id, n.i, CASE WHEN n.h OR st.size >= 2000 THEN st.c + 1 ELSE st.c END, CASE WHEN n.h THEN length(n.l) WHEN st.size >= 2000 THEN length(n.l) + 1 ELSE st.size + length(n.l) + 1 END FROM st JOIN hd n ON n.doc_id = st.doc_id AND n.i = st.i + 1),
ck AS (SELECT doc_id, c, min(i) AS start, {STRIP.format("string_agg(l, chr(10) ORDER BY i)")} AS x FROM st JOIN ln USING (doc_id, i) GROUP BY doc_id, c)
{_digest}(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS chunk_index, start, x FROM ck WHERE x <> '')"""

# imports and blank lines in front go to the first chunk; a definition begins one, and so does the line after one that
# is full; a short last chunk goes to the one before it
CODE = rf"""WITH RECURSIVE {_lines}, fs AS (SELECT doc_id, coalesce(min(i) FILTER (WHERE trim(l) <> '' AND NOT regexp_matches(l, '^(import|from)\s')), max(i) + 1) AS n FROM ln GROUP BY doc_id),
df AS (SELECT *, regexp_matches(l, '^(async\s+)?(def|class)\s+[{WORD}]+') AS d FROM ln),
st AS (SELECT doc_id, i, 0 AS c, 1 AS held, length(l) + 1 AS size FROM df JOIN fs USING (doc_id) WHERE i = n
 UNION ALL SELECT n.doc_id, n.i, CASE WHEN n.d OR st.held > 2 AND st.size >= 2000 THEN st.c + 1 ELSE st.c END, CASE WHEN n.d OR st.held > 2 AND st.size >= 2000 THEN 1 ELSE st.held + 1 END, CASE WHEN n.d OR st.held > 2 AND st.size >= 2000 THEN length(n.l) + 1 ELSE st.size + length(n.l) + 1 END FROM st JOIN df n ON n.doc_id = st.doc_id AND n.i = st.i + 1),
al AS (SELECT doc_id, i, c, true AS own FROM st UNION ALL SELECT doc_id, i, 0, false FROM ln JOIN fs USING (doc_id) WHERE i < n),
ck AS (SELECT doc_id, c, min(i) FILTER (WHERE own) AS start, {STRIP.format("string_agg(l, chr(10) ORDER BY i)")} AS x FROM al JOIN ln USING (doc_id, i) GROUP BY doc_id, c),
nm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS many FROM ck WHERE x <> ''),
mg AS (SELECT doc_id, k - CASE WHEN k > 0 AND k = many - 1 AND length(x) < 100 THEN 1 ELSE 0 END AS k, k AS was, start, x FROM nm)
{_digest}(SELECT doc_id, k AS chunk_index, arg_min(start, was) AS start, string_agg(x, chr(10) ORDER BY was) AS x FROM mg GROUP BY doc_id, k)"""

# windows of 2,000 that end after the last paragraph, else sentence, of their second half; the next one begins 100 before
PLAIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE trim(text) <> ''),
w(doc_id, start, stop) AS (SELECT doc_id, 0::BIGINT, NULL::BIGINT FROM d WHERE n > 2000
 UNION ALL SELECT doc_id, stop2 - 100, stop2 FROM (SELECT w.doc_id, n, CASE WHEN w.start + 2000 >= n THEN w.start + 2000 WHEN strpos(half, chr(10) || chr(10)) > 0 THEN w.start + 1000 + 999 - strpos(half, chr(10) || chr(10)) + 1 WHEN strpos(half, ' .') > 0 THEN w.start + 1000 + 999 - strpos(half, ' .') + 1 ELSE w.start + 2000 END AS stop2 FROM (SELECT w.*, n, reverse(substr(text, w.start + 1001, 1000)) AS half FROM w JOIN d USING (doc_id)) w) WHERE stop2 - 100 < n),
win AS (SELECT doc_id, start, lead(stop) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM w),
ck AS (SELECT doc_id, start, {STRIP.format("substr(text, start + 1, coalesce(stop, start + 2000) - start)")} AS x FROM win JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, {STRIP.format("text")} FROM d WHERE n <= 2000)
{_digest}(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start, x FROM ck WHERE x <> '')"""

STRATEGY = "CASE " + " ".join(f"WHEN ext IN {listed(v)} THEN '{k}'" for k, v in schema.STRATEGIES.items()) + " ELSE 'plain' END"
_fx = f"{cte('fx_code')}, fx AS (SELECT *, {STRATEGY} AS strategy, CASE WHEN {STRATEGY} = 'code' THEN regexp_replace({STRIP.format('text')}, '\\n\\nclass ', chr(10) || 'class ') ELSE {STRIP.format('text')} END AS x, string_split(text, chr(10)) AS a FROM fx_code WHERE trim(text) <> '')"


def wing_room(path: str) -> str:
    """(wing, room) columns by the rules, the first that fits."""
    top, second = f"split_part({path}, '/', 1)", f"split_part({path}, '/', 2)"
    rules = (
        (f"{path} = ''", "'uncategorized'", "'uncategorized'"), (f"regexp_matches({path}, '^agent-[a-f0-9]+')", "'agent'", "'conversations'"), (f"strpos({path}, '/') = 0", "'workspace'", "'files'"),
        (f"{top} = 'skills'", "'skills'", second), (f"regexp_matches({top}, '^[0-9]{{2}}-')", "'workspace'", f"substr({top}, 1, 2)"),
        (f"{top} IN ('memory', 'tasks', 'docs', 'audits', 'guides', 'archives')", "'workspace'", top), (f"{top} IN ('knowledge', 'learning')", "'knowledge'", top),
    )
    case = lambda at, last: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[at]}" for r in rules) + f" ELSE {last} END"
    return f"{case(1, top)} AS wing, {case(2, second)} AS room"


# names
_split = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '|', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1|\\2', 'g'), '([a-z])([A-Z])', '\\1|\\2', 'g'), '([A-Za-z])([0-9])', '\\1|\\2', 'g'), '([0-9])([A-Za-z])', '\\1|\\2', 'g')"
PARTS = f"prt AS (SELECT *, list_filter(string_split({_split}, '|'), lambda x: x <> '' AND lower(x) NOT IN {listed(schema.CAMEL_STOP)}) AS parts FROM fx_names)"
_alias = lambda x: f"CASE {x} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(c)}" for a, c in schema.ALIASES.items()) + " END"
RESOLVED = f"""{cte("fx_names")}, {PARTS}, als AS (SELECT *, {_alias("lower(name)")} AS known, CASE WHEN len(parts) >= 2 THEN {_alias("lower(array_to_string(list_transform(parts, lambda x: x[1]), ''))")} END AS short FROM prt),
res AS (SELECT name, CASE WHEN length(name) < 2 OR known = lower(name) THEN name ELSE coalesce(known, short, name) END AS resolved FROM als)"""
_cut = "CASE " + " ".join(f"WHEN lower(resolved) LIKE '%{s}' AND length(resolved) >= {len(s) + 3} THEN left(resolved, length(resolved) - {len(s)})" for s in schema.SUFFIXES) + " ELSE resolved END"
_any = lambda ps: re2("|".join(f"(?:{p})" for p in ps))

# patterns
_found = " UNION ALL ".join(f"SELECT chunk_id, {n} AS n, generate_subscripts(m, 1) AS nth, unnest(m) AS name, '{t}' AS type FROM (SELECT chunk_id, regexp_extract_all(text, {re2(p)}, 1) AS m FROM fx_code)" for n, (t, p) in enumerate(extraction.ENTITY_PATTERNS))
_marks = lambda ps: " + ".join(f"regexp_matches(x, {re2(p, 'i')})::INT" for p in ps)


def kind(source: str, text: str, ext: str, key: str) -> str:
    """Rows (key, kind) of a source's texts: the class by suffix, else by marks."""
    by = schema.CLASS_EXTENSIONS
    return f"""SELECT {key}, CASE WHEN e IN {listed(by["skip"])} THEN 'skip' WHEN e IN {listed(by["code"])} THEN 'code' WHEN e IN {listed(by["log"])} THEN 'log'
 WHEN {STRIP.format("x")} = '' THEN 'skip' WHEN logs * 2 > len(r) THEN 'log' WHEN code >= 3 THEN 'code' WHEN config >= 1 THEN 'config' WHEN e IN {listed(by["docs"])} OR heads > 0 OR paragraphs >= 2 THEN 'docs' WHEN code >= 1 THEN 'code' ELSE 'docs' END AS kind
 FROM (SELECT *, len(list_filter(r, lambda l: {" OR ".join(f"regexp_matches(l, {re2(p)})" for p in extraction.LOG_MARKS)})) AS logs, len(list_filter(r, lambda l: regexp_matches(l, '^#{{1,6}}\\s'))) AS heads,
 len(list_filter(r, lambda l: length(l) > 60 AND regexp_matches(l, '[一-鿿]'))) + len(list_filter(r, lambda l: length(l) > 80 AND regexp_matches(l, '[a-zA-Z]{{3,}}') AND NOT regexp_matches(l, '[{{}}().*]'))) AS paragraphs, {_marks(extraction.CODE_MARKS)} AS code, {_marks(extraction.CONFIG_MARKS)} AS config
 FROM (SELECT *, {text} AS x, lower({ext}) AS e, string_split({STRIP.format(text)}, chr(10)) AS r FROM {source}))"""


_calls = "calls AS (SELECT user_id::VARCHAR AS model, event_id AS seq, value AS latency_ms, event_type <> 'error' AS success, (event_id % 7)::DOUBLE AS entities FROM events)"
_json = "TRY_CAST(nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') AS JSON)"

ORACLES = {
    "chunk_markdown": MARKDOWN,
    "chunk_code": CODE,
    "chunk_plain": PLAIN,
    # each of these texts is one chunk; a definition too short for one of its own follows the one before on the next line
    "chunk_dispatch": f"WITH {_fx} SELECT chunk_id AS doc_id, 0::BIGINT AS chunk_index, CASE strategy WHEN 'lines' THEN 1 WHEN 'code' THEN list_position(list_transform(a, lambda l: trim(l) <> '' AND NOT regexp_matches(l, '^(import|from)\\s')), true) - 1 ELSE 0 END::BIGINT AS start, length(x) // 4 + 1 AS token_count, md5(x) AS digest FROM fx",
    "mine_inline": f"WITH {_fx} SELECT 'src/f' || chunk_id || ext AS path, strategy, 'f' || chunk_id AS slug, 0::BIGINT AS chunk_index, length(x) // 4 + 1 AS token_count FROM fx",
    "path_parts": f"WITH {cte('fx_paths')}, b AS (SELECT path, regexp_extract(path, '[^/]*$') AS base FROM fx_paths), s AS (SELECT *, regexp_extract(base, '^.+(\\.[^.]+)$', 1) AS suf FROM b) SELECT path, lower(suf) AS suffix, left(base, length(base) - length(suf)) AS stem, {wing_room('path')} FROM s",
    "migrated_pages": f"SELECT wing, room, count(*) AS pages FROM (SELECT {wing_room('p')} FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)) GROUP BY wing, room",
    "vector_ivf": f"WITH {EMBEDDED} SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.chunk_id) AS place FROM embeddings q JOIN emb e ON q.vec_id % 100 = 0) WHERE place <= 20",
    "name_class": f"WITH {cte('fx_names')} SELECT name, CASE WHEN regexp_matches(name, {_any(evaluation.NOISE)}) THEN 'noise' WHEN name IN {listed(evaluation.VALID_NAMES)} OR regexp_matches(name, {_any(evaluation.KEYWORDS)}) OR regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9]{{2,}}$') OR length(name) BETWEEN 2 AND 20 AND regexp_matches(name, '[一-鿿]') THEN 'valid' ELSE 'noise' END AS class FROM fx_names",
    "camel_parts": f"WITH {cte('fx_names')}, {PARTS} SELECT name, array_to_string(parts, '|') AS parts FROM prt",
    "resolve_alias": f"WITH {RESOLVED} SELECT name, resolved, resolved <> name AS changed FROM res",
    "canonicalize": f"WITH {RESOLVED} SELECT name, {_cut} AS canonical FROM res",
    "hybrid_extraction": f"WITH {cte('fx_existing', 'fx_detections')} SELECT name, type FROM fx_existing UNION ALL SELECT DISTINCT name, type FROM fx_detections WHERE type IN ('concept', 'api') AND name NOT IN (SELECT name FROM fx_existing)",
    "bulk_import": f"WITH {cte('fx_entities', 'fx_relations')} SELECT e.name AS source, 'order' AS target, r.type, r.weight FROM fx_relations r JOIN fx_entities e ON e.id = r.source_id WHERE target_id = 3",
    "score_parse": f"WITH {cte('fx_scores')}, j AS (SELECT id, n, coalesce(list_transform(from_json({_json}->'$.scores', '[\"DOUBLE\"]'), lambda x: x / 10), []::DOUBLE[]) AS s FROM fx_scores) SELECT id, unnest(range(0, n)) AS place, unnest(list_concat(s, list_transform(range(0, n), lambda i: 1.0::DOUBLE))[1:n]) AS score FROM j",
    "llm_json_relations": f"WITH {cte('fx_answers')}, j AS (SELECT id, {_json} AS j FROM fx_answers), r AS (SELECT id, unnest(from_json(j->'$.relations', '[{{\"source\":\"VARCHAR\",\"target\":\"VARCHAR\",\"type\":\"VARCHAR\"}}]')) AS r FROM j WHERE j IS NOT NULL) SELECT id, r.source AS source, r.target AS target, r.type AS type FROM r WHERE r.source IS NOT NULL AND r.target IS NOT NULL",
    "extract_regex": f"WITH {cte('fx_code')}, f AS ({_found}) SELECT chunk_id, name, arg_min(type, n * 1000 + nth) AS type FROM f WHERE length(name) >= 2 AND lower(name) NOT IN {listed(schema.RESERVED)} GROUP BY chunk_id, name",
    "extract_imports": f"WITH {cte('fx_code')}, j AS (SELECT chunk_id, string_split(unnest(regexp_extract_all(text, {re2(extraction.JAVA_IMPORT)}, 1)), '.') AS p FROM fx_code), q AS (SELECT chunk_id, {', '.join(f'unnest(regexp_extract_all(text, {re2(extraction.QUOTED_IMPORT)}, {g})) AS g{g}' for g in (1, 2, 3, 4))} FROM fx_code), n AS (SELECT chunk_id, list_last(string_split(coalesce(nullif(g1, ''), g4), '/')) AS module, coalesce(nullif(g2, ''), g3) AS name FROM q), o AS (SELECT chunk_id, unnest(list_filter(p, lambda x: regexp_matches(x, '^[A-Z]'))) AS name, 'class' AS type FROM j UNION ALL SELECT chunk_id, p[len(p) - 1], 'module' FROM j WHERE len(p) >= 2 UNION ALL SELECT chunk_id, module, 'module' FROM n UNION ALL SELECT chunk_id, name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'class' ELSE 'function' END FROM n) SELECT * FROM o WHERE name <> ''",
    "classify_chunk": f"WITH {cte('fx_code')}, k AS ({kind('fx_code', 'text', 'ext', 'chunk_id')}) SELECT chunk_id, kind, CASE kind WHEN 'code' THEN 'regex' WHEN 'config' THEN '1.5b' WHEN 'docs' THEN 'hybrid-7b' ELSE '' END AS mode FROM k",
    "classify_corpus": f"WITH {CHUNKS}, k AS ({kind('chunks', 'chunk_text', quoted(''), 'wing')}) SELECT wing, kind, count(*) AS chunks FROM k GROUP BY wing, kind",
    "entity_detail": f"WITH {CHUNKS}, {LINKS}, {EDGES}, me AS (SELECT id AS name FROM (SELECT source AS id FROM edg UNION ALL SELECT target FROM edg WHERE source <> target) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1) SELECT 'entity' AS part, name AS text, {KIND} AS value FROM me UNION ALL SELECT 'relation', CASE WHEN source = name THEN '→ ' || target ELSE '← ' || source END, weight::VARCHAR FROM edg JOIN me ON source = name OR target = name UNION ALL SELECT 'chunk', translate(substr(chunk_text, 1, 150), chr(10), ' '), chunk_id::VARCHAR FROM (SELECT chunk_id FROM lnk JOIN me USING (name) ORDER BY relevance DESC, chunk_id LIMIT 5) JOIN chunks USING (chunk_id)",
    "enrich_describe": f"WITH {CHUNKS}, {LINKS}, best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY relevance DESC, chunk_id) AS place FROM lnk QUALIFY place <= 3) SELECT name, name || ' in ' || length(substr(string_agg(substr(chunk_text, 1, 500), chr(10) || '---' || chr(10) ORDER BY place), 1, 1500)) || ' characters' AS description FROM best JOIN chunks USING (chunk_id) GROUP BY name",
    "subgraph_json": """SELECT '{"center":"r1","nodes":[{"depth":0,"id":"r1"}' || string_agg(',{"depth":1,"id":"n' || k || '"}', '' ORDER BY 'n' || k) || '],"edges":[' || string_agg('{"source":"n' || k || '","target":"r1","type":"part_of"}', ',' ORDER BY 'n' || k) || ']}' AS json FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1)""",
    "stream_observer": f"WITH {_calls}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS back FROM calls) SELECT model, count(*) FILTER (NOT success) AS errors, round(list_reduce(list_prepend(0.0::DOUBLE, list(entities ORDER BY seq)), lambda s, x: s * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS ewma, round(avg(latency_ms) FILTER (back <= 5), 6) AS recent_ms, count(*) AS calls FROM r GROUP BY model",
}
