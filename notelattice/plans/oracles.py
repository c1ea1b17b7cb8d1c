"""The same queries in DuckDB's SQL, written apart from the operators."""

from __future__ import annotations

PATH = "source || '/' || lang || '/doc-' || doc_id || '.md'"
LINK = "source || '/' || lang || '/doc-' || doc_id"
UPDATED = "make_timestamp(1700000000000000 + doc_id * 3600000000)"


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({column}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


def _fts(counts: dict[str, str], condition: str, legs: tuple[str, ...] = ("title", "stems", "snippet"), limit: int | None = 25) -> str:
    """counts: name -> occurrences in a token list {t}; condition over the names."""
    f = ", ".join(f"{sql.format(t='t_' + leg)} AS {name}_{leg}" for name, sql in counts.items() for leg in legs)
    n = ", ".join(f"count(*) FILTER (WHERE {name}_{leg} > 0) AS n_{name}_{leg}" for name in counts for leg in legs)

    def holds(leg: str) -> str:
        return condition.format(**{name: f"{name}_{leg} > 0" for name in counts})

    def score(leg: str) -> str:
        terms = []
        for name in counts:
            raw = f"ln((n_rows - n_{name}_{leg} + 0.5) / (n_{name}_{leg} + 0.5))"
            terms.append(f"(CASE WHEN {raw} > 0 THEN {raw} ELSE 1e-6 END) * {name}_{leg} * 2.2 / ({name}_{leg} + 1.2 * (0.25 + 0.75 * d / avg_d))")
        return "-(" + " + ".join(terms) + ")"

    column = {"title": "title", "stems": "content_stems", "snippet": "content_snippet"}
    leg = "CASE " + " ".join(f"WHEN {holds(x)} THEN '{column[x]}'" for x in legs) + " END"
    value = "CASE " + " ".join(f"WHEN {holds(x)} THEN {score(x)}" for x in legs) + " END"
    return f"""
WITH tok AS (SELECT doc_id AS id, {_tokens("'Doc ' || doc_id")} AS t_title, {_tokens("text")} AS t_stems, {_tokens("text")} AS t_snippet, {_tokens(LINK)} AS t_link FROM documents),
f AS (SELECT id, len(t_title) + len(t_stems) + len(t_snippet) + len(t_link) AS d, {f} FROM tok),
s AS (SELECT count(*) AS n_rows, avg(d) AS avg_d, {n} FROM f)
SELECT 'entity' AS type, id, {leg} AS leg, round({value}, 6) AS score FROM f, s WHERE {leg} IS NOT NULL ORDER BY score, id {f'LIMIT {limit}' if limit else ''}
"""


def _prefix(p: str) -> str:
    return f"len(list_filter({{t}}, lambda x: starts_with(x, '{p}')))"


def _word(w: str) -> str:
    return f"len(list_filter({{t}}, lambda x: x = '{w}'))"


def _pair(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len({{t}})), lambda i: {{t}}[i] = '{a}' AND {{t}}[i + 1] = '{b}'))"


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"
QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
HERED = _fts({"a": _prefix("therea")}, "{a}", limit=None)

GRAPH = """
nodes AS (
  SELECT CAST(r_regionkey + 2000 AS BIGINT) AS id, r_name AS title, '2024-01-01 00:00:00.000000' AS created_at FROM region
  UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), n_name, '2024-01-01 00:00:00.000000' FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_name, '2024-01-01 00:00:00.000000' FROM customer
  UNION ALL SELECT o_orderkey + 100000000, 'order ' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') FROM orders),
rels AS (
  SELECT CAST(n_nationkey + 1000 AS BIGINT) AS id, CAST(n_nationkey + 1000 AS BIGINT) AS from_id, CAST(n_regionkey + 2000 AS BIGINT) AS to_id, 'in_region' AS kind FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_custkey + 1000000, CAST(c_nationkey + 1000 AS BIGINT), 'in_nation' FROM customer
  UNION ALL SELECT o_orderkey + 100000000, o_orderkey + 100000000, CASE WHEN o_totalprice <= 300000 THEN o_custkey + 1000000 END, 'placed_by' FROM orders),
edges AS (SELECT id, kind, from_id AS node, to_id AS other FROM rels UNION ALL SELECT id, kind, to_id, from_id FROM rels WHERE to_id IS NOT NULL)"""


def _walk(seeds: list[int] | str, depth: int, since: str | None = None) -> str:
    where = f" WHERE created_at >= '{since}'" if since else ""
    ids = seeds if isinstance(seeds, str) else ", ".join(f"({i})" for i in seeds)
    return f"""
WITH RECURSIVE {GRAPH},
ok AS (SELECT * FROM nodes{where}),
use AS (SELECT e.* FROM edges e JOIN rels r ON r.id = e.id AND r.kind = e.kind JOIN ok ON ok.id = r.from_id),
walk(root_id, node, path, hops) AS (
  SELECT s.id, s.id, [s.id], 0 FROM (VALUES {ids}) s(id) JOIN ok ON ok.id = s.id
  UNION ALL
  SELECT w.root_id, u.other, list_append(w.path, u.other), w.hops + 1 FROM walk w JOIN use u ON u.node = w.node JOIN ok ON ok.id = u.other
  WHERE w.hops < {depth} AND NOT list_contains(w.path, u.other)),
found AS (
  SELECT w.root_id, 'relation' AS type, u.id, u.kind AS title, 2 * w.hops + 1 AS depth FROM walk w JOIN use u ON u.node = w.node WHERE w.hops < {depth}
  UNION ALL SELECT w.root_id, 'entity', w.node, ok.title, 2 * w.hops FROM walk w JOIN ok ON ok.id = w.node WHERE w.hops > 0),
related AS (SELECT root_id, type, id, title, CAST(min(depth) AS BIGINT) AS depth FROM found GROUP BY ALL)"""


ISLANDS = """
WITH ev AS (SELECT 'u/' || user_id || '.md' AS path, event_type AS kind, ts, event_id FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(start) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM g)
"""

WINDOWS = "SELECT doc_id, k // 780 AS chunk, substr(text, k + 1, 900) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 121) + 1, 780)) AS k FROM documents WHERE length(text) > 0)"

HASH_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


def _permalink(path: str) -> str:
    """For paths without CJK."""
    sql = f"regexp_replace(replace({path}, '\\', '/'), '(?i)\\.(md|markdown|mdx|txt|json|yaml|yml|toml|csv|png|jpg|jpeg|gif|svg|pdf)$', '')"
    sql = f"regexp_replace(regexp_replace({sql}, '[^A-Za-z0-9/.\\-_\\s]', '', 'g'), '[_\\s]+', '-', 'g')"
    sql = f"regexp_replace(regexp_replace(regexp_replace(lower({sql}), '-+', '-', 'g'), '-*/-*', '/', 'g'), '^-+|-+$', '', 'g')"
    return f"regexp_replace({sql}, '^/+|/+$', '', 'g')"


ORACLES: dict[str, str] = {
    "fts_prefix_bm25": _fts({"a": _prefix("therea")}, "{a}"),
    "fts_after_update": _fts({"a": _prefix("therea")}, "{a}").replace("FROM documents", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 7 = 3 THEN text || ' therea renewed' ELSE text END AS text) FROM documents WHERE doc_id % 11 <> 4) documents"),
    "fts_and_terms": _fts({"a": _prefix("whst"), "b": _prefix("erea")}, "{a} AND {b}"),
    "fts_or_not": _fts({"a": _prefix("therea"), "b": _prefix("ereres"), "c": _prefix("license")}, "({a} OR ({b} AND NOT {c}))"),
    "fts_phrase": _fts({"a": _pair("under", "the")}, "{a}"),
    "fts_title": _fts({"a": _word("doc"), "b": _word("7")}, "{a} AND {b}", legs=("title",)),
    "fts_scopes": f"""
WITH tok AS (SELECT doc_id AS id, {_tokens("'Doc ' || doc_id")} AS t_title, {_tokens("text")} AS t_text, {_tokens(LINK)} AS t_link FROM documents),
f AS (SELECT id, len(t_title) + 2 * len(t_text) + len(t_link) AS d, {_prefix("therea").format(t="t_title")} + 2 * {_prefix("therea").format(t="t_text")} AS a, {_word("doc").format(t="t_title")} AS b, {_word("en").format(t="t_link")} AS c FROM tok),
s AS (SELECT count(*) AS n_rows, avg(d) AS avg_d, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb, count(*) FILTER (WHERE c > 0) AS nc FROM f),
w AS (SELECT id, d, avg_d, unnest([a, b, c]) AS tf, unnest([na, nb, nc]) AS n, n_rows FROM f, s WHERE a > 0 AND b > 0 AND c > 0)
SELECT 'entity' AS type, id, round(-sum((CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / avg_d))), 6) AS score FROM w GROUP BY id
""",
    "schema_findings": """
SELECT c_custkey AS note, 'status' AS field, 'Missing required field: status (expected [status] observation)' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'boss', 'Missing required field: boss (no ''boss [[...]]'' relation found)' FROM customer
UNION ALL SELECT o_custkey, 'status', 'Field ''status'' has invalid value(s): ' || string_agg(o_orderstatus, ', ' ORDER BY o_orderkey) || ' (allowed: F, O)' FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
""",
    "schema_unmatched": "SELECT conv_id AS note, role AS field, count(*) AS n FROM conversations WHERE role IS DISTINCT FROM 'user' GROUP BY ALL",
    "fts_relaxed_or": _fts({"a": _prefix("qqqzz"), "b": _prefix("therea"), "c": _prefix("zzqqq")}, "({a} OR {b} OR {c})"),
    "fts_query_batch": f"""
WITH tok AS (SELECT doc_id AS id, {_tokens("'Doc ' || doc_id")} AS t1, {_tokens("text")} AS t2, {_tokens(LINK)} AS t4 FROM documents),
f AS (SELECT id, len(t1) + 2 * len(t2) + len(t4) AS d, t1, t2 FROM tok),
s AS (SELECT count(*) AS n_rows, avg(d) AS avg_d FROM f),
asked AS (SELECT DISTINCT item_id, unnest({_tokens("text")}) AS term FROM benchmark),
words AS (SELECT id, d, 0 AS leg, unnest(t1) AS term FROM f UNION ALL SELECT id, d, 1, unnest(t2) FROM f),
tf AS (SELECT term, leg, id, d, count(*) AS f FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, leg, count(*) AS n FROM tf GROUP BY ALL),
scored AS (SELECT term, id, leg, -(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_d)) AS score FROM tf JOIN df USING (term, leg), s),
best AS (SELECT term, id, arg_min(score, leg) AS score FROM scored GROUP BY ALL),
sums AS (SELECT term, count(*) AS n_found, round(sum(score), 4) AS sum_score FROM best GROUP BY ALL)
SELECT item_id, term, n_found, sum_score FROM asked JOIN sums USING (term)""",
    "posting_counts": f"""
WITH w AS (SELECT doc_id, unnest(list_concat(list_concat({_tokens("'Doc ' || doc_id")}, {_tokens("text")}), list_concat({_tokens("text")}, {_tokens(LINK)}))) AS term FROM documents)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_rows FROM w GROUP BY term""",
    "filter_note_type": f"SELECT doc_id AS id, {LINK} AS permalink FROM documents WHERE lower(source) IN ('src3', 'src7')",
    "filter_metadata_json": "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "filter_permalink_glob": f"SELECT doc_id AS id, {LINK} AS permalink FROM documents WHERE {LINK} GLOB 'src1*/en/doc-?[0-4]*'",
    "filter_permalink_token": f"SELECT doc_id AS id, {LINK} AS permalink FROM documents WHERE doc_id = 77",
    "filter_after_date": f"SELECT doc_id AS id, {UPDATED} AS updated_at FROM documents WHERE date_trunc('second', {UPDATED}) > TIMESTAMP '2023-12-01 00:00:00'",
    "filter_owner_semi": f"SELECT doc_id AS id, {LINK} AS permalink FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src2')",
    "filter_first_tag": f"SELECT doc_id AS id, {LINK} AS permalink FROM documents WHERE lang = 'de'",
    "page_with_total": "SELECT doc_id AS id, (SELECT count(*) FROM documents WHERE source = 'src4') AS total FROM documents WHERE source = 'src4' ORDER BY doc_id DESC LIMIT 25 OFFSET 25",
    "all_projects_merge": """
WITH r AS (SELECT source, doc_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS pos FROM documents)
SELECT source, doc_id, score, pos FROM r WHERE pos <= 50 ORDER BY score DESC, source, pos LIMIT 25 OFFSET 25""",
    "permalink_generate": f"SELECT c_custkey, {_permalink("'People & Places' || chr(92) || c_mktsegment || '/' || c_name || '__v1.MD'")} AS permalink FROM customer",
    "note_type_normalize": r"""
SELECT p_partkey, lower(regexp_replace(regexp_replace('My' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-' || p_brand || '.x', '[\s\-\\.]', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS note_type FROM part""",
    "text_variants": """
WITH t AS (SELECT c_custkey, c_mktsegment || '/' || c_name || ' Note' AS s, c_mktsegment AS a, c_name || ' Note' AS b FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat([s, lower(s), a, b], list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda w: w <> '')))), chr(10)) AS stems FROM t""",
    "external_id": f"SELECT c_custkey, {HASH_UUID} AS external_id FROM (SELECT c_custkey, sha256('project:' || c_name) AS h FROM customer)",
    "observation_permalinks": f"""
SELECT conv_id, turn, {_permalink("'conv-' || conv_id || '/observations/' || role || '/' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '-' || substr(sha256(text), 1, 12) ELSE text END")} AS permalink FROM conversations""",
    "relation_titles": f"""
SELECT c_custkey, CASE WHEN n_name IS NULL THEN c_name ELSE c_name || ' -> ' || n_name END AS title, {_permalink("lower(c_name) || '/lives in/' || coalesce(lower(n_name), 'nowhere')")} AS permalink
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20""",
    "entity_search_rows": f"""
WITH v AS (SELECT doc_id, source, text, lang, 'Doc ' || doc_id AS title, {LINK} AS link, {PATH} AS path FROM documents),
s AS (SELECT *, substr(array_to_string(list_filter(list_concat(list_concat(list_sort(list_distinct([title, lower(title), 'doc', doc_id::VARCHAR])), CASE WHEN text <> '' THEN [text] ELSE [] END), list_concat(list_concat(list_sort(list_distinct([link, source, lang, 'doc-' || doc_id])), list_sort(list_distinct([path, source, lang, 'doc-' || doc_id || '.md']))), [lang])), lambda p: trim(p, ' ') <> ''), chr(10)), 1, 6000) AS stems FROM v)
SELECT doc_id AS id, 'entity' AS type, link AS permalink, length(stems) AS n_stems, sha256(stems) AS stems_hash, '{{"note_type":"' || source || '"}}' AS metadata FROM s""",
    "chunk_windows": f"SELECT doc_id, chunk, length(t) AS n_chars, sha256(t) AS source_hash FROM ({WINDOWS})",
    "entity_fingerprint": f"""
WITH c AS (SELECT doc_id, '["entity:' || doc_id || ':' || chunk || '","' || sha256(t) || '"]' AS pair FROM ({WINDOWS}))
SELECT doc_id, sha256('[' || string_agg(pair, ',' ORDER BY pair) || ']') AS entity_fingerprint FROM c GROUP BY doc_id""",
    "vector_reuse": "SELECT doc_id, (doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS reused FROM documents",
    "knn_topk": f"SELECT vec_id, round({DOT}, 6) AS similarity FROM embeddings e, {QUERY_VECTOR} ORDER BY {DOT} DESC, vec_id LIMIT 25",
    "knn_query_batch": f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {DOT} AS x FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(x, 6) AS similarity, rank FROM r WHERE rank <= 5""",
    "knn_best_per_row": f"""
WITH s AS (SELECT label, vec_id, {DOT} AS x FROM embeddings e, {QUERY_VECTOR}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS n FROM s)
SELECT label, round(max(x), 6) AS score, string_agg(vec_id::VARCHAR, ',' ORDER BY n) AS chunks FROM r WHERE n <= 5 GROUP BY label HAVING max(x) >= 0.2""",
    "hybrid_fusion": f"""
WITH fts AS ({_fts({"a": _prefix("therea")}, "{a}", limit=None).replace("round(", "(", 1).replace(", 6) AS score", ") AS score")}),
f AS (SELECT id, abs(score) / max(abs(score)) OVER () AS f FROM fts),
v AS (SELECT * FROM (SELECT vec_id AS id, {DOT} AS v FROM embeddings e, {QUERY_VECTOR}) WHERE v >= 0.1)
SELECT id, round(coalesce(f, 0), 6) AS text_score, round(coalesce(v, 0), 6) AS vector_score, round(greatest(coalesce(f, 0), coalesce(v, 0)) + 0.3 * least(coalesce(f, 0), coalesce(v, 0)), 6) AS score FROM f FULL JOIN v USING (id)""",
    "rerank_tail": f"""
WITH v AS (SELECT * FROM (SELECT vec_id AS id, {DOT} AS v FROM embeddings e, {QUERY_VECTOR}) WHERE v >= 0.1),
r AS (SELECT id, row_number() OVER (ORDER BY v DESC, id) AS pos FROM v),
h AS (SELECT id, pos, (pos * 7) % 20 / 20.0 AS s FROM r WHERE pos <= 20)
SELECT id, pos, round(s, 6) AS score FROM h UNION ALL SELECT id, pos, round((SELECT min(s) FROM h) / (pos - 19), 6) FROM r WHERE pos > 20""",
    "resolve_links": f"""
SELECT doc_id AS link_id, CASE doc_id % 4 WHEN 0 THEN {LINK} WHEN 1 THEN {PATH} WHEN 2 THEN {LINK} || '|label' ELSE {LINK} || '-gone' END AS to_name, CASE WHEN doc_id % 9 = 0 THEN -7 WHEN doc_id % 4 < 3 AND doc_id % 5 <> 0 THEN doc_id ELSE -1 END AS to_id FROM documents""",
    "graph_depth1": _walk([1_000_007, 1003], 1) + " SELECT * FROM related ORDER BY depth, type, id, root_id LIMIT 40",
    "graph_depth2": _walk([1_000_011], 2) + " SELECT * FROM related",
    "graph_since": _walk([1_000_011, 1_000_012], 1, "1997-01-01T00:00:00") + " SELECT * FROM related",
    "context_counts": _walk([1_000_000 + k for k in range(1, 60)], 1) + """,
seen AS (SELECT DISTINCT root_id, type, id FROM related), notes AS (SELECT l_orderkey + 100000000 AS id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT root_id, count(*) FILTER (WHERE type = 'entity') AS n_entities, count(*) FILTER (WHERE type = 'relation') AS n_relations, CAST(coalesce(sum(n) FILTER (WHERE type = 'entity'), 0) AS BIGINT) AS n_observations
FROM seen LEFT JOIN notes USING (id) GROUP BY root_id""",
    "recent_context_roots": """
WITH nodes AS (
  SELECT r_regionkey + 2000 AS id, r_name AS title, '2024-01-01' AS day FROM region UNION ALL SELECT n_nationkey + 1000, n_name, '2024-01-01' FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_name, '2024-01-01' FROM customer UNION ALL SELECT o_orderkey + 100000000, 'order ' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders),
links AS (
  SELECT n_nationkey + 1000 AS id, n_nationkey + 1000 AS a, n_regionkey + 2000 AS b, 'in_region' AS kind FROM nation UNION ALL SELECT c_custkey + 1000000, c_custkey + 1000000, c_nationkey + 1000, 'in_nation' FROM customer
  UNION ALL SELECT o_orderkey + 100000000, o_orderkey + 100000000, CASE WHEN o_totalprice <= 300000 THEN o_custkey + 1000000 END, 'placed_by' FROM orders),
roots AS (SELECT row_number() OVER (ORDER BY day DESC, id) AS pos, id, title FROM nodes QUALIFY pos <= 1000),
edges AS (SELECT id, kind, a AS node, b AS other FROM links UNION ALL SELECT id, kind, b, a FROM links WHERE b IS NOT NULL AND a <> b),
step AS (SELECT r.id AS root, e.id AS relation, kind, other FROM roots r JOIN edges e ON e.node = r.id),
found AS (
  SELECT DISTINCT root, 'relation' AS type, relation AS id, kind AS title, 1 AS depth FROM step
  UNION ALL SELECT DISTINCT root, 'entity', n.id, n.title, 2 FROM step JOIN nodes n ON n.id = other WHERE other <> root),
cut AS (SELECT * FROM found ORDER BY depth, type, id, root LIMIT 100),
lists AS (SELECT root, string_agg(depth || ':' || type || ':' || id || ':' || title, ',' ORDER BY depth, type, id) AS related, count(*) FILTER (type = 'relation') AS n FROM cut GROUP BY root),
notes AS (SELECT l_orderkey + 100000000 AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT pos, r.id, r.title, coalesce(o.n, 0) AS n_observations, coalesce(l.n, 0) AS n_relations, coalesce(related, '') AS related
FROM roots r LEFT JOIN lists l ON l.root = r.id LEFT JOIN notes o ON o.id = r.id""",
    "resolve_identifiers": f"""
WITH e AS (SELECT doc_id, lang, {PATH} AS path FROM documents),
a AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS n, unnest(['Doc ' || doc_id, regexp_replace(path, '\\.md$', ''), 'memory://' || path, lang || '/doc-' || doc_id, 'no such ' || doc_id]) AS identifier FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, identifier, CASE WHEN n < 4 THEN doc_id END AS id, ['title', 'permalink', 'path', 'end of a permalink', NULL][n + 1] AS kind FROM a""",
    "search_project_totals": f"""
WITH f AS ({_fts({"a": _prefix("therea")}, "{a}", limit=None)}), p AS (SELECT lang, count(*) AS n FROM f JOIN documents d ON d.doc_id = f.id GROUP BY lang)
SELECT count(*) AS n_projects, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, true AS total_is_exact, coalesce(bool_or(n > 25), false) OR coalesce(sum(n), 0) > 25 AS has_more FROM p""",
    "schema_validate_all": """
WITH roles AS (SELECT conv_id AS note, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(role = 'system') AS s FROM conversations GROUP BY 1),
held AS (SELECT *, CASE WHEN note % 5 = 0 THEN 'inline' WHEN note % 5 = 1 THEN 'chat0' WHEN note % 3 < 2 THEN 'chat' || note % 3 END AS schema FROM roles),
n AS (
  SELECT note, schema, CASE schema WHEN 'chat0' THEN (NOT u)::INT + (NOT a)::INT + (note % 5 = 1 OR note % 2 = 1)::INT ELSE (NOT s)::INT END::BIGINT AS n
  FROM held WHERE schema IS NOT NULL)
SELECT note, CASE WHEN schema = 'chat1' THEN 0 ELSE n END AS n_warnings, CASE WHEN schema = 'chat1' THEN n ELSE 0 END AS n_errors, schema <> 'chat1' OR n = 0 AS passed FROM n""",
    "recent_activity": f"SELECT 'entity' AS type, doc_id AS id, {UPDATED} AS updated_at FROM documents WHERE {UPDATED} >= TIMESTAMP '2023-12-01 00:00:00' ORDER BY updated_at DESC, id LIMIT 26 OFFSET 25",
    "directory_listing": """
WITH d AS (SELECT DISTINCT source AS path, source AS name, 1 AS depth FROM documents UNION SELECT DISTINCT source || '/' || lang, lang, 2 FROM documents)
SELECT path, name, 'directory' AS kind, CAST(depth AS BIGINT) AS depth FROM d WHERE name GLOB '*1*'""",
    "directory_page": f"""
WITH f AS (SELECT {PATH} AS path, 'file' AS kind, CAST(2 AS BIGINT) AS depth, lower('Doc ' || doc_id) AS t FROM documents WHERE source = 'src1'),
d AS (SELECT DISTINCT 'src1/' || lang, 'directory', CAST(1 AS BIGINT), lang FROM documents WHERE source = 'src1')
SELECT path, kind, depth FROM (SELECT * FROM f UNION ALL SELECT * FROM d) ORDER BY CASE kind WHEN 'directory' THEN 0 ELSE 1 END DESC, t DESC, lower(path), path LIMIT 25""",
    "reconcile_diff": """
SELECT 'o/' || o_orderkey || '.md' AS file_path, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change
FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 7 = 0)""",
    "move_pairing": """
WITH d AS (SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL),
a AS (SELECT checksum, 'old/' || lpad(doc_id::VARCHAR, 9, '0') AS from_path, row_number() OVER (PARTITION BY checksum ORDER BY doc_id) AS n FROM d WHERE doc_id % 2 = 0),
b AS (SELECT checksum, 'new/' || lpad(doc_id::VARCHAR, 9, '0') AS to_path, row_number() OVER (PARTITION BY checksum ORDER BY doc_id) AS n FROM d WHERE doc_id % 3 = 0)
SELECT checksum, from_path, to_path FROM a JOIN b USING (checksum, n)""",
    "cascade_delete": f"""
WITH {GRAPH}, gone AS (SELECT id FROM nodes WHERE title LIKE '%7')
SELECT kind AS relation_type, count(*) AS n_relations FROM rels WHERE from_id NOT IN (SELECT id FROM gone) AND (to_id IS NULL OR to_id NOT IN (SELECT id FROM gone)) GROUP BY kind""",
    "debounce_islands": ISLANDS + "SELECT path, burst, arg_max(kind, (ts, event_id)) AS kind, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM b GROUP BY path, burst",
    "debounce_sessions": ISLANDS + "SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM b GROUP BY path, burst",
    "ranked_ids": f"SELECT doc_id, row_number() OVER (ORDER BY {PATH}) AS id FROM documents",
    "schema_infer": """
WITH c AS (SELECT role AS field, conv_id, count(*) AS n FROM conversations GROUP BY ALL),
f AS (SELECT field, count(*) AS n_notes, count(*) FILTER (WHERE n > 1) AS n_multi FROM c GROUP BY field),
v AS (SELECT role AS field, text, min((conv_id, turn)) AS place FROM conversations GROUP BY ALL),
k AS (SELECT field, text, row_number() OVER (PARTITION BY field ORDER BY place, text) AS r FROM v),
s AS (SELECT field, sha256(string_agg(text, '|' ORDER BY r)) AS samples_hash FROM k WHERE r <= 5 GROUP BY field),
t AS (SELECT count(DISTINCT conv_id) AS total FROM conversations)
SELECT field, n_notes, total, round(n_notes / total, 6) AS percentage, n_multi > n_notes / 2 AS is_array, samples_hash, CASE WHEN n_notes / total >= 0.95 THEN 'required' WHEN n_notes / total >= 0.25 THEN 'optional' ELSE 'excluded' END AS suggestion FROM f JOIN s USING (field), t""",
    "schema_diff": """
WITH c AS (SELECT role AS field, conv_id, count(*) AS n FROM conversations GROUP BY ALL),
f AS (SELECT field, count(*) / (SELECT count(DISTINCT conv_id) FROM conversations) AS p, count(*) FILTER (WHERE n > 1) > count(*) / 2 AS arr FROM c GROUP BY field),
d(field, darr) AS (VALUES ('user', false), ('summary', false), ('tool', true), ('assistant', false)),
j AS (SELECT field, p, arr, darr FROM f FULL JOIN d USING (field))
SELECT field, 'new' AS change FROM j WHERE darr IS NULL AND p >= 0.25 UNION ALL SELECT field, 'dropped' FROM j WHERE darr IS NOT NULL AND coalesce(p, 0) < 0.1
UNION ALL SELECT field, 'became_array' FROM j WHERE darr = false AND arr UNION ALL SELECT field, 'became_single' FROM j WHERE darr AND arr = false""",
    "schema_validate_enum": """
WITH h AS (SELECT o_custkey AS note, list_distinct(list(o_orderpriority)) AS found FROM orders GROUP BY ALL),
w AS (SELECT c_custkey AS note, found, list_sort(list_filter(found, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) AS wrong FROM customer LEFT JOIN h ON note = c_custkey)
SELECT note, 'priority' AS field, CASE WHEN found IS NULL THEN 'missing' WHEN len(wrong) > 0 THEN 'enum_mismatch' ELSE 'present' END AS status, coalesce(array_to_string(wrong, ','), '') AS wrong FROM w
UNION ALL SELECT c_custkey, 'owner', 'missing', '' FROM customer""",
    "schema_totals": """
WITH h AS (SELECT o_custkey AS note, bool_or(o_orderstatus NOT IN ('F', 'O')) AS bad FROM orders GROUP BY ALL),
r AS (SELECT c_mktsegment AS type, CASE WHEN coalesce(bad, true) THEN 0 ELSE 1 END AS ok FROM customer LEFT JOIN h ON note = c_custkey)
SELECT type, count(*) AS n_notes, CAST(sum(ok) AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_warned, CAST(sum(1 - ok) AS BIGINT) AS n_failed FROM r GROUP BY ROLLUP (type)""",
    "parse_notes": """
SELECT doc_id, 'Doc ' || doc_id AS title, source AS note_type, lang AS tags, 'size' AS category, n_chars || ' characters #size' AS content, 'counted' AS context, 'part_of' AS relation_type, source AS to_name FROM documents""",
    "edit_notes": "SELECT doc_id, sha256('## Intro' || chr(10) || text || chr(10) || '## End' || chr(10) || 'Replaced.') AS hash FROM documents",
}
