"""DuckDB SQL for the queries of this folder that SQL can express.

Written from the contracts alone; messages, rules, cutoffs and limits are stated again.
"""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

GROUPS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON l.a = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id FROM reach JOIN n ON n.doc_id = x GROUP BY 1, 2
"""

_CUTOFFS = "[0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]"
RULES = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, {_WORD}) AS w FROM t),
windows AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT t.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_exclamations
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM t) t
  JOIN w ON w.r = t.r LEFT JOIN covered ON covered.r = t.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (
  SELECT r, lang, unnest(['symbols', 'capitals', 'exclamations', 'dup_lines', 'repeats']) AS rate,
         unnest([n_symbols / nullif(word_chars, 0), n_capitals / nullif(word_chars, 0), n_exclamations / nullif(word_chars, 0),
                 n_dup_lines / nullif(n_lines, 0), n_repeat_words / nullif(n_words, 0)]) AS v
  FROM b WHERE NOT base_failed),
good AS (
  SELECT v.lang, v.rate, coalesce(v.v, 0) AS v FROM v JOIN b ON b.r = v.r JOIN labels l ON l.doc_id = b.doc_id
  WHERE l.quality = 1),
lists AS (SELECT lang, rate, count(*) AS n, list(v) AS vs FROM good GROUP BY lang, rate),
tests AS (
  SELECT lang, rate, n, k, {_CUTOFFS}[k] AS cutoff, len(list_filter(vs, lambda y: y > {_CUTOFFS}[k])) AS x
  FROM (SELECT *, unnest(range(1, 14)) AS k FROM lists)),
tails AS (
  SELECT lang, rate, k, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.004) + (n - i) * ln(0.996)))
         AS p
  FROM (SELECT *, unnest(range(0, x + 1)) AS i FROM tests) GROUP BY lang, rate, k, cutoff),
stands AS (
  SELECT *, min(CASE WHEN p > 0.05 / (SELECT count(*) FROM lists) THEN k END) OVER (PARTITION BY lang, rate) AS stop FROM tails),
chosen AS (SELECT lang, rate, min(cutoff) AS cutoff FROM stands WHERE stop IS NULL OR k < stop GROUP BY lang, rate),
rejected AS (
  SELECT DISTINCT v.r FROM v JOIN chosen c ON c.lang IS NOT DISTINCT FROM v.lang AND c.rate = v.rate WHERE v.v > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept
FROM b
"""


def _level(name: str, parent: str, up: str, children: str) -> str:
    """CTE ``name``: posterior mean of each child, its prior's strength kappa, its n."""
    return f"""{name}_in AS (SELECT c.*, p.mean AS m FROM ({children}) c JOIN {parent} p ON p.key = c.{up}),
{name}_k AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0),
                                     0.95), 0.001), 0.95) - 1 AS kappa FROM {name}_in),
{name} AS (SELECT key, n, kappa, (kappa * m + bad) / (kappa + n) AS mean FROM {name}_in, {name}_k)"""


URLS = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_LOWER}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
seen AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
said AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM seen),
h AS (
  SELECT host AS key, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain,
         regexp_extract(host, '[^.]*$') AS suffix, CAST(count(said) AS DOUBLE) AS n,
         CAST(count_if(said = 'block') AS DOUBLE) AS bad FROM said GROUP BY host),
top AS (SELECT 'all' AS key, (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM h),
{_level('sfx', 'top', 'root', "SELECT suffix AS key, 'all' AS root, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix")},
{_level('dom', 'sfx', 'suffix', "SELECT domain AS key, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix")},
{_level('hst', 'dom', 'domain', "SELECT key, domain, n, bad FROM h")}
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (kappa + n + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM said JOIN hst ON hst.key = said.host
"""

ORACLE_SQL = {"op2_exact_top_k": TOP_K, "op3_ngram_jaccard_join": GROUPS, "op6_quality_rules": RULES, "op8_url_filter": URLS}
