"""SQL that gives the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
  win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
  rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN rep USING (k)),
  word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
  kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r),
  lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0))),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
  reach(a, b) AS (SELECT u, v FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
  least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON a = d.doc_id"""


def strength(level: str) -> str:
    return f"""(SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) WHEN rho <= 0 THEN 1000.0 ELSE 10.0 END AS s FROM (
    SELECT (q - b * b / nullif(t, 0) - p * (1 - p) * (g - 1)) / nullif(p * (1 - p) * (t - nn / nullif(t, 0) - (g - 1)), 0) AS rho FROM (
      SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(bad) AS DOUBLE) AS b, sum(CAST(bad AS DOUBLE) * bad / n) AS q, sum(CAST(n AS DOUBLE) * n) AS nn, CAST(sum(bad) AS DOUBLE) / nullif(sum(n), 0) AS p FROM {level} WHERE n > 0)))"""


TWO = "(ac|co|com|ed|edu|go|gob|gov|ltd|me|mil|ne|net|nom|or|org|plc|sch)"
URLS = rf"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  bad AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
  lab AS (SELECT page_id, max(bad) AS bad FROM p JOIN bad ON try_cast(regexp_extract(path, '/([0-9]+)(?:\.[A-Za-z]+)?/?$', 1) AS BIGINT) = doc_id GROUP BY page_id),
  h AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad FROM p LEFT JOIN lab USING (page_id) GROUP BY host),
  hn AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM h),
  hs AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$|^\[') THEN name WHEN regexp_matches(name, '(^|\.){TWO}\.[a-z]{{2}}$') THEN regexp_extract(name, '([^.]*\.[^.]*)$', 1) ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM hn),
  hd AS (SELECT *, substr(name, 1, greatest(length(name) - length(suffix) - 1, 0)) AS head FROM hs),
  hosts AS (SELECT host, n, bad, suffix, CASE WHEN head = '' THEN name ELSE regexp_extract(head, '([^.]*)$', 1) || '.' || suffix END AS domain FROM hd),
  domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM hosts GROUP BY domain, suffix),
  suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM domains GROUP BY suffix),
  ms AS (SELECT suffix, (bad + s * up) / (n + s) AS mean FROM suffixes, {strength('suffixes')}, (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(n), 0), 0.1) AS up FROM suffixes)),
  md AS (SELECT domain, (bad + s * ms.mean) / (n + s) AS mean FROM domains JOIN ms USING (suffix), {strength('domains')}),
  mh AS (SELECT host, n, bad, n + s AS m, (bad + s * md.mean) / (n + s) AS mean FROM hosts JOIN md USING (domain), {strength('hosts')}),
  r AS (SELECT page_id, host, path, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (m + 1)) > 0.3 THEN 'block' ELSE 'allow' END AS verdict, n AS n_labelled, bad AS n_bad FROM r JOIN mh USING (host)"""

ORACLES: dict[str, str] = {"op1_count_min_substrings": SUBSTRINGS, "op7_combination_jaccard": JACCARD, "op10_host_reputation": URLS}
