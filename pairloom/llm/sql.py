"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORDS}) AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
cov AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS ln FROM d),
own AS (SELECT *, lower(trim(ln, ' ')) AS line, length(ln) AS chars, len(regexp_extract_all(ln, {_WORDS})) AS n_line FROM raw WHERE regexp_matches(ln, {_WORDS})),
dup AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n, sum(chars) AS chars FROM own GROUP BY doc_id),
often AS (SELECT host, line FROM own WHERE n_line >= 3 GROUP BY host, line HAVING count(DISTINCT text) > 10),
cut AS (SELECT doc_id, sum(chars) AS n FROM own JOIN often USING (host, line) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w)
SELECT m.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words) AND 100 * (coalesce(dup.chars, 0) - coalesce(cut.n, 0)) >= 20 * coalesce(dup.chars, 0) AS kept,
  coalesce(cut.n, 0)::BIGINT AS cut_chars
FROM m LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

_URLS = """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hits AS (SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict FROM p LEFT JOIN hits USING (page_id)
"""



def _vector_codes(rounds: int = 2) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries' new components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT p.vec_id, p.part, b.entry, p.x, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.x)])::BIGINT AS d
         FROM p JOIN b{k} b USING (part)),
a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(entry) FILTER (d = m) AS entry, any_value(m) AS d
         FROM (SELECT *, min(d) OVER (PARTITION BY vec_id, part) AS m FROM d{k}) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n
         FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b{k}.part, b{k}.entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
k AS (SELECT vec_id, unnest(range(16)) AS part, q FROM v),
p AS MATERIALIZED (SELECT vec_id, part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] AS x FROM k),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT part, entry, x FROM f JOIN p USING (vec_id)),{",".join(steps)},
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h
"""


_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(x.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) x USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, g.source, term, c.n IS NOT NULL AS has, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v))::HUGEINT AS p,
      (1 + 1000000000::HUGEINT * (t.n + 1) // (l.n + l.v))::HUGEINT AS q
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT y.lang, y.source, z.source AS item, sum((y.p - z.p) * (y.p - z.p) // z.p) AS value
                 FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY ALL) x
      ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE has AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""

ORACLE: dict[str, str] = {"op6_quality_rules": _QUALITY, "op7_url_filter": _URLS, "op12_vector_codes": _vector_codes(),
    "op13_source_divergence": _DIVERGENCE}
