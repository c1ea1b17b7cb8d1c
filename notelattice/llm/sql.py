"""The queries' results in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from . import urls

OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
         FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE m > 1),
cuts AS (SELECT lang, phrase, a, words, unnest(range(1, m)) AS k FROM split),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((CAST(c.a AS HUGEINT) * 2000000) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, words, m, unnest(range(2, m)) AS n FROM split WHERE m > 2),
inside AS (SELECT lang, a, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, a, words, n, unnest(range(1, m - n + 2)) AS i FROM inner_parts)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.most IS NULL OR CAST(g.most AS HUGEINT) * 100 < CAST(w.a AS HUGEINT) * 80)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
FROM kept k JOIN sizes s ON s.lang = k.lang
QUALIFY "rank" <= 2000
"""

OP12_SQL = """
WITH worded AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
sized AS (SELECT k, doc_id, words, CAST(len(words) AS BIGINT) AS size FROM worded WHERE len(words) > 0),
total AS (SELECT count(*) AS N, CAST(sum(size) AS BIGINT) AS L FROM sized),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
weighted AS (SELECT item_id, a.term, times * CAST(floor(1000 * ln((2 * N + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked a JOIN df USING (term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * N) // L)))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN sized USING (k), total
  GROUP BY item_id, k, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS "rank", doc_id, score
FROM scored WHERE score > 0
QUALIFY "rank" <= 20
"""

_FOLD = f"'{urls.UPPER}', '{urls.LOWER}'"
_DIGITS = f"'{urls.UPPER}123456789', '{urls.LOWER}000000000'"


def _rules() -> str:
    cases = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{rest}') THEN '{d}/{rest}'" for d, _, rest in (r.partition("/") for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0])))]
    return f"CASE {' '.join(cases)} END"


def _model(k: int) -> str:
    """The n-grams of order k (c), their contexts (s), probabilities (g), log ratios (d) and weights of contexts (b)."""
    mixed = ", ".join(f"CASE WHEN s.n_{x} = 0 THEN p_{x} ELSE (c.{x} + s.t_{x} * p_{x}) / (s.n_{x} + s.t_{x}) END AS q_{x}" for x in "ar")
    below = f"JOIN (SELECT gram AS rest, q_a AS p_a, q_r AS p_r FROM g{k - 1}) b ON substr(c.gram, 2) = b.rest" if k else "CROSS JOIN (SELECT 1.0::DOUBLE / 1114112 AS p_a, 1.0::DOUBLE / 1114112 AS p_r) b"
    left = lambda x: f"CASE WHEN n_{x} = 0 THEN 1.0 ELSE t_{x} / (n_{x} + t_{x}) END"
    return f"""
c{k} AS (SELECT *, substr(gram, 1, {k}) AS context
         FROM (SELECT right(w, {k + 1}) AS gram, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM counted GROUP BY 1) WHERE (a + r) * {urls.SHARE} >= (SELECT sum(a + r) FROM counted)),
s{k} AS (SELECT context, sum(a)::BIGINT AS n_a, sum(r)::BIGINT AS n_r, count(*) FILTER (a > 0) AS t_a, count(*) FILTER (r > 0) AS t_r FROM c{k} GROUP BY 1),
g{k} AS (SELECT c.gram, {mixed} FROM c{k} c JOIN s{k} s ON s.context = c.context {below}),
d{k} AS (SELECT gram, floor(ln(q_a / q_r) * 1000000 + 0.5)::BIGINT AS delta FROM g{k}),
b{k} AS (SELECT context, floor(ln(({left("a")}) / ({left("r")})) * 1000000 + 0.5)::BIGINT AS back FROM s{k}),"""


def _valued(order: int) -> tuple[str, str]:
    value, joins = "(SELECT back FROM b0)", ""
    for k in range(order + 1):
        if k:
            value, joins = f"coalesce(b{k}.back, 0) + {value}", f"{joins} LEFT JOIN b{k} ON b{k}.context = substr(w, {order + 1 - k}, {k})"
        value, joins = f"coalesce(d{k}.delta, {value})", f"{joins} LEFT JOIN d{k} ON d{k}.gram = right(w, {k + 1})"
    return value, joins


def _op13(order: int = urls.ORDER) -> str:
    value, joins = _valued(order)
    blocked = ", ".join(f"'{r}'" for r, verdict in urls.RULES if verdict == "block")
    earlier = "OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH split AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS behind FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(behind, '^[^/?#]*'), {_FOLD}), '') AS host, coalesce(regexp_extract(behind, '^[^/?#]*([^?#]*)', 1), '') AS path,
         translate(coalesce(behind, url, ''), {_DIGITS}) AS text
  FROM split),
ruled AS (SELECT *, {_rules()} AS rule FROM parts),
known AS (SELECT *, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS known FROM ruled),
distinct_urls AS (SELECT DISTINCT text, known = 'allow' AS good, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held FROM known),
chars AS (SELECT *, list_concat(list_transform(range({order}), lambda i: chr(2)), list_filter(string_split(text, ''), lambda c: c <> ''), [chr(3)]) AS c FROM distinct_urls),
windows AS (SELECT text, good, held, unnest(list_transform(range(1, len(c) - {order - 1}), lambda i: array_to_string(c[i:i + {order}], ''))) AS w FROM chars),
counted AS (SELECT w, sum(good::INT)::BIGINT AS a, sum((NOT good)::INT)::BIGINT AS r FROM windows WHERE good IS NOT NULL AND NOT held GROUP BY 1),
{"".join(_model(k) for k in range(order + 1))}
valued AS (SELECT text, good, CASE WHEN (SELECT n_a > 0 AND n_r > 0 FROM s0) THEN {value} ELSE 0 END AS v FROM windows {joins} WHERE good IS NULL OR held),
scored AS (SELECT text, good, floor(sum(v)::DOUBLE / count(*))::BIGINT AS score FROM valued GROUP BY ALL),
bins AS (
  SELECT floor(greatest(-{urls.WIDEST}, least({urls.WIDEST}, score)) / {urls.STEP}.0)::BIGINT AS step, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS r
  FROM scored WHERE good IS NOT NULL GROUP BY 1),
judged AS (SELECT step, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r, coalesce(sum(a) {earlier}, 0) AS lost, coalesce(sum(r) {earlier}, 0) AS caught FROM bins),
least AS (SELECT coalesce((SELECT step * {urls.STEP} FROM judged WHERE all_a > 0 AND all_r > 0 ORDER BY lost * all_r + (all_r - caught) * all_a, abs(step), step LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(known, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN known IS NULL THEN score END AS score
FROM known k LEFT JOIN (SELECT text, score FROM scored WHERE good IS NULL) s USING (text), least
"""


OP13_SQL = _op13()
