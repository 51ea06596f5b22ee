"""SQL that gives the same rows as the queries which SQL can express."""

from __future__ import annotations

import re

from cadentia.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""

URL_FILTER = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(rule, verdict, rule_host, rule_path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
      FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

EXACT_SEARCH = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY 1, 2),
df AS (SELECT x, count(*) AS df FROM t GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
scored AS (SELECT q.doc_id AS query_id, d.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / mean))) AS score
  FROM t q JOIN t d ON q.x = d.x JOIN df ON df.x = q.x JOIN w ON w.doc_id = d.doc_id CROSS JOIN stats WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM scored)
SELECT query_id, CAST(k AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE k <= 10
"""


def _license_scan() -> str:
    phrases = "(VALUES " + ", ".join(f"({[*p.split()]!r}, '{label}')" for p, label in licenses.PHRASES) + ")"
    rows = []
    for number, (label, text, apart, never) in enumerate(licenses.TEMPLATES):
        words = text.split()
        phrase = f"' {text} '" if len(words) < licenses.NOTICE else "NULL"
        lists = ", ".join(f"{sorted(set(x))!r}::VARCHAR[]" for x in (words, apart.split(), never.split()))
        rows.append(f"({number}, '{label}', {lists}, {1 << max(1, 2 * len(words) - 1).bit_length()}, {phrase})")
    return rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases(p, label) AS {phrases},
templates(number, label, t, apart, never, width, phrase) AS (VALUES {', '.join(rows)}),
likely AS (SELECT id, ws FROM w WHERE list_has_any(ws, (SELECT list_distinct(flatten(list(t))) FROM templates))),
places AS (SELECT id, label, i FROM (SELECT id, ws, p, label, unnest(range(1, len(ws) + 1)) AS i FROM likely, phrases) WHERE ws[i] = p[1] AND ws[i : i + len(p) - 1] = p),
base AS (SELECT id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY 1),
windows AS (SELECT id, ws, label, t, apart, never, phrase, list_distinct(ws[first + 1 : first + width]) AS seen
  FROM (SELECT id, ws, label, t, apart, never, width, phrase, unnest(range(0, greatest(1, len(ws) - width // 2), width // 2)) AS first FROM likely, templates WHERE phrase IS NULL)),
blocks AS (SELECT id, label, len(list_intersect(seen, t)) / len(t)::DOUBLE AS share FROM windows
  WHERE len(list_intersect(seen, t)) >= 0.8 * len(t) AND list_has_all(seen, apart) AND NOT list_has_any(seen, never)
  -- a notice that stands word for word lies in one window as a whole
  UNION ALL SELECT id, label, 1 FROM (SELECT id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM likely), templates WHERE phrase IS NOT NULL AND contains(line, phrase)),
found AS (SELECT id, list_distinct(list(label)) AS labels, max(share) AS best FROM blocks GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (id) LEFT JOIN found USING (id)
"""


PHRASE_MINING = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS ws FROM documents),
totals AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY 1),
grams AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, range(1, 6) AS sizes(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, size)) AS k FROM c),
scored AS (SELECT lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts
  JOIN totals USING (lang) JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.phrase = array_to_string(ws[:k], ' ') AND y.phrase = array_to_string(ws[k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (SELECT lang, phrase, max(a) AS cover FROM (SELECT lang, a, unnest([array_to_string(ws[:size - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM c WHERE size > 2) GROUP BY 1, 2),
left_over AS (SELECT best.* FROM best LEFT JOIN covers USING (lang, phrase) WHERE cover IS NULL OR cover < a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

# crc32 is linear over xor: a byte's share depends on the byte and on how many bytes follow it
SPELLING_VARIANTS = """
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
keys AS (SELECT doc_id, run, c, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS hexed FROM runs),
steps(b, k, v) AS (SELECT b, 0, b FROM range(256) AS bytes(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
first AS (SELECT b, v FROM steps WHERE k = 8),
shares(b, after, v) AS (SELECT b, 0, v FROM first UNION ALL SELECT -1, -1, 4294967295 UNION ALL
  SELECT s.b, s.after + 1, xor(s.v >> 8, first.v) FROM shares s JOIN first ON first.b = s.v & 255 WHERE s.after < (SELECT max(length(hexed)) // 2 FROM keys)),
parts AS (SELECT doc_id, run, length(hexed) // 2 AS n, unnest(range(0, length(hexed) // 2)) AS i, hexed FROM keys),
sums AS (SELECT doc_id, run, any_value(n) AS n, bit_xor(v) AS v FROM parts JOIN shares ON b = CAST('0x' || substr(hexed, 2 * i + 1, 2) AS BIGINT) AND after = n - 1 - i GROUP BY 1, 2),
hashed AS (SELECT doc_id, run, xor(xor(sums.v, z.v), 4294967295) AS h FROM sums JOIN shares z ON z.b = -1 AND z.after = n - 1),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM runs LEFT JOIN hashed USING (doc_id, run)),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
holes AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS hole FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
pairs AS (SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b USING (i, hole) WHERE a.word <> b.word UNION SELECT word, hole FROM holes JOIN v USING (word) WHERE hole IN (SELECT word FROM v) UNION SELECT hole, word FROM holes WHERE hole IN (SELECT word FROM v)),
near AS (SELECT a AS word, b AS near, v.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k FROM pairs JOIN v ON v.word = b),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM near WHERE k = 1) USING (word)),
walk(word, place, depth) AS (SELECT word, word, 0 FROM v UNION ALL SELECT walk.word, form, depth + 1 FROM walk JOIN formed ON formed.word = walk.place WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(place, depth) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

ORACLES = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op2_url_filter": URL_FILTER,
    "op3_exact_search": EXACT_SEARCH,
    "op4_license_scan": _license_scan(),
    "op12_phrase_mining": PHRASE_MINING,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
