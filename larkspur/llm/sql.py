"""DuckDB counterparts of the queries that SQL can express over whole tables."""

from __future__ import annotations

from larkspur.llm.licenses import TEMPLATES, THRESHOLD, bigram_sets, bounds
from larkspur.llm.quality import RULES as RULES13
from larkspur.llm.quality import STOP_WORDS, in_case
from larkspur.llm.queries import RULES
from larkspur.llm.url_filter import LOWER, UPPER

OP4 = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (SELECT page_id, split_part(split_part(rest, '?', 1), '#', 1) AS rest FROM urls),
split AS (
  SELECT row_number() OVER () AS n, page_id, translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') AS host,
    substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM parts
),
fits AS (
  SELECT s.n, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS place
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.n = s.n AND f.place = 1
"""


def _texts() -> str:
    rows = []
    for name, pairs in bigram_sets(TEMPLATES):
        low, high = bounds(len(pairs), THRESHOLD)
        rows.append(f"('{name}', [{', '.join(repr(p) for p in pairs)}], {low}, {high})")
    return ", ".join(rows)


OP2 = f"""
WITH templates(name, pairs, low, high) AS (VALUES {_texts()}),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT DISTINCT n, trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit
  FROM (SELECT n, unnest(list_append(string_split(text, chr(10)), text)) AS u FROM docs)
),
words AS (SELECT n, string_split(unit, ' ') AS w FROM units WHERE contains(unit, ' ')),
paired AS (SELECT n, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS pairs FROM words),
found AS (
  SELECT p.n, t.name, 2.0 * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS score
  FROM paired p JOIN templates t ON len(p.pairs) BETWEEN t.low AND t.high
),
best AS (SELECT n, max(score) AS score, count(*) AS n_matches FROM found WHERE score >= {THRESHOLD} GROUP BY n)
SELECT d.doc_id, (SELECT min(f.name) FROM found f WHERE f.n = d.n AND f.score = b.score) AS license,
  round(b.score, 6) AS score, coalesce(b.n_matches, 0) AS n_matches
FROM docs d LEFT JOIN best b ON b.n = d.n
"""


def _rules() -> tuple[str, str]:
    """The failing rules as list entries, and the condition that none fails."""
    fails = []
    for r in RULES13:
        by = r.per or "1"
        sides = [f"{r.measure} < {r.low}::DECIMAL(18, 6) * {by}"] * (r.low is not None) + [f"{r.measure} > {r.high}::DECIMAL(18, 6) * {by}"] * (r.high is not None)
        fails.append((r.name, f"({' OR '.join(sides)})"))
    return ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in fails), " AND ".join(f"NOT {x}" for _, x in fails)


STOPS = ", ".join(f"'{x}'" for x in sorted(set().union(*map(in_case, STOP_WORDS))))
OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT n, unnest(regexp_extract_all(t, '[^ \\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^ \\x09-\\x0D]+'), 1) AS i FROM docs),
lined AS (SELECT n, unnest(string_split(t, chr(10))) AS x FROM docs),
lines AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lined WHERE regexp_matches(x, '[^ \\x09-\\x0D]') GROUP BY n),
windows AS (SELECT n, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY n ORDER BY i)),
counted AS (SELECT n, i, count(*) OVER (PARTITION BY n, w, w2, w3) AS many FROM windows WHERE w3 IS NOT NULL),
covered AS (SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM counted, range(3) AS r(d) WHERE many > 1 GROUP BY n),
sums AS (SELECT n, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (w IN ({STOPS})) AS n_stop_words FROM words GROUP BY n),
every AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words
  FROM docs LEFT JOIN sums USING (n) LEFT JOIN lines USING (n) LEFT JOIN covered USING (n)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{_rules()[0]}], lambda x: x IS NOT NULL) AS failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_rules()[1]} AS kept
FROM every
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": OP2, "op4_url_filter": OP4, "op13_quality_rules": OP13}
