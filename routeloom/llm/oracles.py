"""DuckDB statements for the queries that SQL can express."""

from .secrets import BASE, RULES, Rule

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total
  FROM s),
c AS (
  SELECT *, (1.5 * total - coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT arg_min(level, k) AS level FROM c WHERE level * w <= 2.0 * source_size),
t AS (
  SELECT source, source_size, least(level * w, 2.0 * source_size) AS target
  FROM s, l),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole,
         CAST(floor(n.target - n.whole * n.source_size + 0.5) AS BIGINT) AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.key) AS tied,
         count(*) OVER (PARTITION BY d.source, d.key) AS ties
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + CASE WHEN need <= 0 THEN 0 WHEN upto <= need THEN size WHEN upto - tied >= need THEN 0
            ELSE (need - upto + tied) // ties END AS BIGINT) AS taken
FROM r
"""

DECONTAMINATE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
  UNION ALL
  SELECT DISTINCT 'b', item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
g AS (
  SELECT DISTINCT kind, id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
b AS (SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS item_shingles FROM g WHERE kind = 'b')
SELECT g.id AS doc_id, b.item_id, count(*) AS overlap, any_value(b.item_shingles) AS item_shingles
FROM g JOIN b ON g.shingle = b.shingle WHERE g.kind = 'd'
GROUP BY g.id, b.item_id HAVING count(*) >= 0.8 * any_value(b.item_shingles)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, 'ok' AS status
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""


REPEATS = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT id, b * 500 AS base, substr(x, 1000 * b + 1, 1800) AS y FROM (SELECT id, x, unnest(range((len(x) // 2 - 400) // 500 + 1)) AS b FROM d WHERE len(x) >= 800)),
w AS (SELECT id, base + i AS i, md5(substr(y, 2 * i + 1, 800)) AS k FROM (SELECT id, base, y, unnest(range(least(500, len(y) // 2 - 399))) AS i FROM c)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT id, i, sum(CASE WHEN i <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY id ORDER BY i) AS p FROM r)),
s AS (SELECT id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY id, span),
k AS (
  SELECT id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS upto
  FROM (SELECT s.*, x, coalesce(lag(b) OVER (PARTITION BY s.id ORDER BY a), 0) AS since FROM s JOIN d ON s.id = d.id) GROUP BY id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(concat(coalesce(head, ''), substr(x, 2 * coalesce(upto, 0) + 1)))) AS kept_sha256,
       CAST(len(x) // 2 - coalesce(n_removed, 0) AS BIGINT) AS n_kept, coalesce(n_spans, 0) > 0 AS has_repeat
FROM d LEFT JOIN k USING (id)
"""

#: The table of the checksum, by its rule.
CRC_TABLE = """t AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

RUNS = """
WITH """ + CRC_TABLE + """,
d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS old,
         [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')] AS bytes FROM documents),
h AS (SELECT id, doc_id, old, len(old) AS n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x : xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM d, t),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
w AS (
  SELECT id, i, n, CASE WHEN i < coalesce(a, n) THEN old[i + 1] ELSE old[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM a)),
e AS (SELECT x.id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (
  SELECT id, q, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e) GROUP BY id, q, island),
r AS (SELECT id, start, m + q AS length, min(q) AS period FROM s WHERE m + q >= greatest(12, 2 * q) GROUP BY id, start, m + q),
o AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         min({'l': -length, 's': start, 'p': period}) AS best FROM r GROUP BY id),
k AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS kept FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = w.id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, CAST(-best.l AS BIGINT) AS length, best.p AS period, CAST(1000 * -best.l // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM a LEFT JOIN o USING (id) LEFT JOIN k USING (id)
"""

SPELLING = """
WITH RECURSIVE """ + CRC_TABLE + """,
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END FOR c IN string_split(id || ':' || run, '')]) AS bytes FROM g),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST(x AS BIGINT) FOR x IN bytes]), lambda a, x : xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM b, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN concat(run[: h % len(run)], run[h % len(run) + 2 :]) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, concat(word[: i - 1], word[i + 1 :]) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
f AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM p GROUP BY word),
m AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n
  FROM w LEFT JOIN f USING (word)),
c(word, here, onward) AS (SELECT word, word, form FROM m UNION ALL SELECT c.word, m.word, m.form FROM c JOIN m ON c.onward = m.word)
SELECT m.word, form, here AS root, n, n_near, form_n FROM m JOIN c ON c.word = m.word AND onward IS NULL
"""


def _spans(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''").replace("++", "+")  # no backtracking in DuckDB, so possessive is the same there
    return f"""
  SELECT id, {k} AS k, '{rule.kind}' AS kind, upto - len(match) AS s, upto AS e FROM (
    SELECT id, match, measured, sum(len(before) + len(match)) OVER (PARTITION BY id ORDER BY i) AS upto FROM (
      SELECT id, unnest(matches) AS match, unnest(regexp_split_to_array(text, '{pattern}')[: len(matches)]) AS before,
             unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS measured, unnest(range(len(matches))) AS i
      FROM (SELECT id, text, regexp_extract_all(text, '{pattern}') AS matches FROM d)))
  WHERE len(measured) >= {rule.least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans(k, rule) for k, rule in enumerate(RULES))}),
g AS (
  SELECT id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans, count(*) AS n_found
  FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_found, 0) AS n_found
FROM d LEFT JOIN g USING (id)
"""

ORACLES = {
    "op2_secrets": SECRETS,
    "op3_repeated_strings": REPEATS,
    "op4_mix_sources": MIX,
    "op10_decontaminate": DECONTAMINATE,
    "op11_periodic_runs": RUNS,
    "op12_warc_round_trip": WARC,
    "op13_spelling_variants": SPELLING,
}
