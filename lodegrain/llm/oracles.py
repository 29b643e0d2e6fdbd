"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lodegrain.llm import decontam, licences

_RULE = decontam.Rule()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words: list[str]) -> str:
    return ", ".join(map(_quoted, words))


def _licence_text(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), '\b(?:19|20)\d\d\b ?', '', 'g'), ' ')"


_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_TOLD = f"list_sort(list_distinct(list_filter(w, lambda x: x IN ({_listed(list(licences.TELLING))}))))"

#: Every window of every template's size that begins with a bigram of it, compared in full.
LICENCES = rf"""
WITH t(template, licence, body) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(x)})" for i, (n, x) in enumerate(licences.TEMPLATES))}),
tw AS (SELECT template, licence, string_split({_licence_text("body")}, ' ') AS w FROM t),
tt AS (SELECT template, licence, len(w) AS k, list_distinct({_PAIRS}) AS grams, {_TOLD} AS telling, list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')) AS numbers FROM tw),
te AS (SELECT template, k, unnest(grams) AS gram FROM tt),
d AS (SELECT doc_id, string_split({_licence_text("text")}, ' ') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM (SELECT doc_id, {_PAIRS} AS g FROM d)),
s AS (SELECT doc_id, template, i, count(*) OVER (PARTITION BY doc_id, template ORDER BY i RANGE BETWEEN CURRENT ROW AND 100000 FOLLOWING) AS left_over FROM dg JOIN te USING (gram)),
x AS (SELECT doc_id, template, licence, i, k, grams, telling, numbers, d.w[i : i + k - 1] AS w FROM s JOIN tt USING (template) JOIN d USING (doc_id) WHERE 3 * left_over >= len(grams)
  AND NOT regexp_matches(' ' || array_to_string(d.w[greatest(i - 3, 1) : i - 1], ' '), ' not( ({"|".join(licences.LINKS)})){{0,2}}$')),
y AS (SELECT doc_id, template, licence, i, k, len(list_intersect(list_distinct({_PAIRS}), grams)) AS shared, len(list_distinct({_PAIRS})) + len(grams) AS total FROM x
  WHERE {_TOLD} = telling AND len(list_filter(numbers, lambda x: NOT list_contains(w, x))) = 0),
z AS (SELECT *, 2.0 * shared / total AS dice FROM y WHERE 2.0 * shared / total >= {licences.THRESHOLD}),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY i) AS run FROM (SELECT *, coalesce(CAST(i >= lag(i) OVER (PARTITION BY doc_id, template ORDER BY i) + k AS INT), 1) AS fresh FROM z)),
b AS (SELECT doc_id, licence, k, i, shared, dice FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, template, run ORDER BY shared DESC, dice DESC, i) = 1),
f AS (SELECT *, max((i + k) * 100000 + k) OVER (PARTITION BY doc_id ORDER BY i, k DESC, licence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b),
p AS (SELECT *, sum(coalesce(CAST(2 * (far // 100000 - i) <= least(k, far % 100000) AS INT), 1)) OVER (PARTITION BY doc_id ORDER BY i, k DESC, licence ROWS UNBOUNDED PRECEDING) AS place FROM f),
o AS (SELECT * FROM p QUALIFY rank() OVER (PARTITION BY doc_id, place ORDER BY shared DESC, dice DESC) = 1)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(DISTINCT place) AS units FROM o GROUP BY doc_id, licence"""


def _words(x: str) -> str:
    number = rf"regexp_replace({x}, '(\d)[.,](\d)', '\1\2', 'g')"
    number = rf"regexp_replace({number}, '(\d)[.,](\d)', '\1\2', 'g')"  # again for what the first pass consumed
    plain = rf"trim(regexp_replace({number}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' ')"
    apart = rf"regexp_replace({plain}, '(\d)(\p{{L}})', '\1 \2', 'g')"
    units = "|".join(decontam.UNITS)
    return rf"list_filter(string_split(regexp_replace({apart}, '(\d) ((?i:{units}))( |$)', '\1 @\2\3', 'g'), ' '), lambda x: x <> '')"


_TEMPLATE = f"list_transform(w, lambda x: CASE WHEN substr(x, 1, 1) BETWEEN '0' AND '9' OR lower(x) IN ({_listed(decontam.NUMBERS)}) THEN '#' WHEN substr(x, 1, 1) = '@' THEN '@u' WHEN lower(x) = x OR (upper(x) = x AND len(x) > 1) THEN lower(x) ELSE '@n' END)"
_RUNS = f"list_transform(range(0, len(c) - {_RULE.width - 1}), lambda i: c[i + 1 : i + {_RULE.width}])"

#: For items of a window's words or more, as all of the benchmark's are.
LEAKS = f"""
WITH b AS (SELECT item_id, w, {_TEMPLATE} AS c FROM (SELECT item_id, {_words("coalesce(text, '')")} AS w FROM benchmark)),
d AS (SELECT doc_id, w, {_TEMPLATE} AS c FROM (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents)),
bw0 AS (SELECT item_id, unnest(r) AS run, generate_subscripts(r, 1) AS j FROM (SELECT item_id, {_RUNS} AS r FROM b WHERE len(c) >= {_RULE.width})),
bw AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows FROM bw0 WHERE len(list_filter(run, lambda x: x NOT IN ('#', '@n', '@u'))) >= {_RULE.literals}),
dw AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (SELECT doc_id, {_RUNS} AS r FROM d WHERE len(c) >= {_RULE.width})),
l AS (SELECT doc_id, item_id, n_windows, i - j AS diagonal, count(DISTINCT j) AS matched FROM dw JOIN bw USING (run) GROUP BY ALL HAVING count(DISTINCT j) >= least(n_windows, {_RULE.windows})),
s AS (SELECT l.*, unnest(range(1, len(b.w) + 1)) AS k, b.w AS bw, b.c AS bc, d.w AS dw, d.c AS dc FROM l JOIN b USING (item_id) JOIN d USING (doc_id)),
p AS (SELECT doc_id, item_id, n_windows, diagonal, matched, CASE WHEN bc[k] IN ('#', '@n', '@u') AND k + diagonal >= 1 AND dc[k + diagonal] = bc[k] THEN [lower(bw[k]), lower(dw[k + diagonal])] END AS v FROM s),
q AS (SELECT doc_id, item_id, n_windows, diagonal, matched, count(v) AS n_slots, count(*) FILTER (v[1] <> v[2]) AS n_changed, count(DISTINCT v) - count(DISTINCT v[1]) AS n_conflicts FROM p GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n_windows DESC, n_slots DESC, n_changed) AS place FROM q WHERE n_conflicts <= {_RULE.conflicts} * n_slots)
SELECT doc_id, item_id, matched, n_windows, n_slots, n_changed FROM o WHERE place = 1"""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, url, strlen(body) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(sha1(body), CAST(1 + 10 * (i // 8) AS BIGINT), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest
  FROM p),
o AS (SELECT payload_digest, max(page_id) AS original FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to, url, CAST(NULL AS VARCHAR) AS fault
FROM d JOIN o USING (payload_digest)"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every pair of a query's and a document's equal terms.
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
f AS (SELECT d, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM f),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM f) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT q, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark)),
s AS (SELECT q, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, d) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, d) <= 20
"""

#: Every anchor's product with every row.
NEGATIVES = """
WITH b AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM b a JOIN b r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {"op1_decontamination": LEAKS, "op2_licences": LICENCES, "op10_warc": WARC, "op11_search": SEARCH, "op12_hard_negatives": NEGATIVES}
