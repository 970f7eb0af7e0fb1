"""DuckDB SQL for the training-data queries that SQL can express."""

from .common import WORD
from .jaccard_join import THRESHOLD, WORDS
from .quality_rules import MOST_LINE_CHARS, MOST_NGRAM_CHARS, WINDOW
from .secret_scans import BASE_RULES, RULES
from .topk_search import K
from .url_filters import RULES as URL_RULES
from .vector_codes import ENTRIES, PARTS, ROUNDS


def _spans() -> str:
    """All matches of each rule with their places: the gaps between matches give the starts."""
    parts = []
    for place, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        value = "m" if not r.group else f"regexp_extract(m, '{pattern}', {r.group})"
        parts.append(
            f"""SELECT doc_id, '{r.kind}' AS kind, {place} AS place, s AS a, s + length(m) AS b, {value} AS v FROM (
 SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
  SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
   SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))) WHERE length({value}) >= {r.least}"""
        )
    return "\n UNION ALL ".join(parts)


_KINDS = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans()}),
joined AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
 string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, place) AS spans,
 string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, place) FILTER (WHERE kind IN ({_KINDS})) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)"""

OP9 = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}) AS t(verdict, r_host, r_path)),
f AS (SELECT page_id, r_host || r_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, verdict DESC) AS k
 FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1"""

_T = THRESHOLD
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i:i + {WORDS} - 1], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= {_T} * (len(sa.sh) + len(sb.sh) - n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(min(r), s.doc_id) AS component_id FROM s LEFT JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, sh"""

OP7 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
 FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

OP11 = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS MATERIALIZED (SELECT k, lang, source, unnest(ws) AS term FROM d), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT k) >= 10), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
cells AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS MATERIALIZED (SELECT cells.lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // (sum(n) OVER (PARTITION BY cells.lang, source) + 2 * v) AS BIGINT) AS p FROM cells JOIN v ON v.lang = cells.lang),
a AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (SELECT a.lang, term, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY a.lang) + 2 * v) AS BIGINT) AS q FROM a JOIN v ON v.lang = a.lang),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""

def _grams(n: int) -> str:
    """Windows of n words with their places, how often the text holds each, and which of them it is."""
    return f"""g{n} AS (SELECT *, count(*) OVER (PARTITION BY k, g) AS times, row_number() OVER (PARTITION BY k, g ORDER BY i) AS nth
 FROM (SELECT k, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g FROM d)),
c{n} AS (SELECT k, count(*) AS n, sum(length(ws[j])) AS chars FROM (SELECT DISTINCT k, unnest(range(i, i + {n})) AS j FROM g{n} WHERE {"times" if n == WINDOW else "nth"} > 1) JOIN d USING (k) GROUP BY k)"""


_LENGTHS = [WINDOW, *MOST_NGRAM_CHARS]
OP12 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
{", ".join(map(_grams, _LENGTHS))},
l AS (SELECT k, line, length(line) AS chars, row_number() OVER (PARTITION BY k, line) AS nth FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
w AS (SELECT k, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, CAST(sum(chars) AS BIGINT) AS line_chars, CAST(coalesce(sum(chars) FILTER (WHERE nth > 1), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY k),
r AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c{WINDOW}.n, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars,
 {", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}" for n in MOST_NGRAM_CHARS)} FROM d LEFT JOIN w USING (k) {" ".join(f"LEFT JOIN c{n} USING (k)" for n in _LENGTHS)}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT *, NOT (base_failed OR 100 * dup_line_chars > {MOST_LINE_CHARS} * line_chars OR {" OR ".join(f"100 * dup_{n} > {m} * word_chars" for n, m in MOST_NGRAM_CHARS.items())}) AS kept FROM b"""

def _assigned(k: int) -> str:
    """The nearest entry of each part under the codebooks b<k>."""
    return f"""a{k} AS MATERIALIZED (SELECT r, p, any_value(y) AS y, CAST(min(d) AS BIGINT) AS d, arg_min(k, d * {ENTRIES} + k) AS k FROM (
 SELECT r, e.p, y, b.k, CAST(list_dot_product(y, y) - 2 * list_dot_product(y, c) + list_dot_product(c, c) AS HUGEINT) AS d FROM e JOIN b{k} b ON b.p = e.p) GROUP BY r, p)"""


def _moved(k: int) -> str:
    """The codebooks b<k + 1>: floors of the means, by component."""
    return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, k, list(CAST(floor(s / n) AS DOUBLE) ORDER BY j) AS c FROM (
 SELECT p, k, j, sum(y[j]) AS s, count(*) AS n FROM a{k}, range(1, 1025) t(j) WHERE j <= len(y) GROUP BY ALL) GROUP BY p, k) m ON m.p = b.p AND m.k = b.k)"""


OP13 = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, vec_id, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS y FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, y AS c FROM e) WHERE k < {ENTRIES}),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(ROUNDS))}, {_assigned(ROUNDS)},
o AS (SELECT r, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, k)) AS h FROM (SELECT p, k, array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',') AS t FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN o ON o.r = v.r, h"""

ORACLES = {"op1_secret_scans": OP1, "op4_jaccard_join": OP4, "op7_topk_search": OP7, "op9_url_filters": OP9, "op11_source_audit": OP11, "op12_quality_rules": OP12, "op13_vector_codes": OP13}
