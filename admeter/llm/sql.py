"""DuckDB SQL of the queries that SQL can express."""

from .license_scan import NEAR, SHARE, phrases
from .mixing import BLOCK_CHARS, ROUND

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w),
m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // (n_words + 20) ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // (n_lines + 5) ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // (n_words + 20) ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length
  FROM m),
long AS (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_length FROM f WHERE NOT base_failed)
         ON symbols, dup_lines, repeats, word_length INTO NAME rule VALUE v),
binned AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(ltrim(bin(v), '0')) - 6)) << (length(ltrim(bin(v), '0')) - 6) END AS v FROM long),
levels AS (
  SELECT 0 AS level, lang, source, rule, v FROM binned UNION ALL
  SELECT 1, lang, NULL, rule, v FROM binned UNION ALL
  SELECT 2, NULL, NULL, rule, v FROM binned),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY level, lang, source, rule ORDER BY v) AS upto, count(*) OVER (PARTITION BY level, lang, source, rule) AS docs FROM levels),
q AS (
  SELECT level, lang, source, rule, max(docs) AS docs, min(v) FILTER (2 * upto >= docs) AS median, min(v) FILTER (5 * upto >= 4 * docs) AS high
  FROM ranked GROUP BY level, lang, source, rule),
picked AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.docs >= 200 THEN o.high WHEN l.docs >= 200 THEN l.high ELSE a.high END AS high,
         CASE WHEN o.docs >= 200 THEN o.median WHEN l.docs >= 200 THEN l.median ELSE a.median END AS median
  FROM q o JOIN q l ON l.level = 1 AND l.rule = o.rule AND l.lang IS NOT DISTINCT FROM o.lang
  JOIN q a ON a.level = 2 AND a.rule = o.rule WHERE o.level = 0),
c AS (
  SELECT lang, source, max(CASE WHEN rule = 'symbols' THEN high + 3 * greatest(high - median, 25) END) AS symbols,
         max(CASE WHEN rule = 'dup_lines' THEN high + 3 * greatest(high - median, 50) END) AS dup_lines,
         max(CASE WHEN rule = 'repeats' THEN high + 3 * greatest(high - median, 45) END) AS repeats,
         max(CASE WHEN rule = 'word_length' THEN high + 3 * greatest(high - median, 800) END) AS word_length
  FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(f.symbols <= c.symbols, true) AND coalesce(f.dup_lines <= c.dup_lines, true)
       AND coalesce(f.repeats <= c.repeats, true) AND coalesce(f.word_length <= c.word_length, true) AS kept
FROM f LEFT JOIN c ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""

PHRASES = ", ".join(
    f"({n}, '{phrase}', '{label}', {str(base).lower()}, {first}, {last})" for n, (phrase, label, base, first, last) in enumerate(phrases()))

LICENSE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT *, string_split(phrase, ' ') AS pw FROM (VALUES {PHRASES}) v(template, phrase, label, is_base, tells, told)),
tp AS (SELECT template, label, is_base, tells, told, len(pw) - 1 AS pairs, spot, pw[spot + 1] || ' ' || pw[spot + 2] AS pair
       FROM (SELECT *, unnest(range(0, len(pw) - 1)) AS spot FROM t)),
dp AS (SELECT doc_id, place, w[place + 1] || ' ' || w[place + 2] AS pair FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS place FROM d)),
v AS (SELECT doc_id, template, label, is_base, tells, told, pairs, place - spot AS diagonal, spot, place FROM dp JOIN tp USING (pair)),
g AS (SELECT doc_id, template, label, is_base, tells, told, pairs, diagonal, list(DISTINCT spot) AS ats, min(place) AS first, max(place) + 1 AS last FROM v GROUP BY doc_id, template, label, is_base, tells, told, pairs, diagonal),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS passage FROM (
      SELECT *, CASE WHEN NOT is_base AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM g)),
m AS (SELECT *, len(held) / pairs AS share, len(list_filter(held, lambda x: x BETWEEN tells AND told)) = told - tells + 1 AS is_told FROM (
      SELECT doc_id, template, label, is_base, tells, told, pairs, passage, list_distinct(flatten(list(ats))) AS held, min(first) AS first FROM s
      GROUP BY doc_id, template, label, is_base, tells, told, pairs, passage)),
k AS (SELECT * FROM m WHERE share >= CASE WHEN is_base THEN 1.0 ELSE {SHARE} END AND is_told),
r AS (
  SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""

MIXING_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source),
a AS (SELECT list(source ORDER BY source NULLS FIRST) AS src, list(chars ORDER BY source NULLS FIRST) AS ch,
             list(sqrt(greatest(chars, 1)::DOUBLE) ORDER BY source NULLS FIRST) AS w, count(*) AS n, greatest({ROUND}, 4 * count(*)) AS r FROM sizes),
b AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, w), lambda x, y: x + y) AS total FROM a),
c AS (SELECT *, list_transform(w, lambda x: floor((r - n) * x / total)::BIGINT + 1) AS whole FROM b),
o AS (SELECT i, row_number() OVER (ORDER BY -((r - n) * w[i] / total - whole[i] + 1), i) AS place FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c)),
x AS (SELECT list(i) AS extra FROM o, c WHERE place <= r - list_sum(whole)),
k AS (SELECT src, ch, n, r, list_transform(whole, lambda v, i: v + CASE WHEN list_contains(coalesce(extra, []), i) THEN 1 ELSE 0 END) AS k FROM c, x),
e AS (
  SELECT -1::BIGINT AS t, list_transform(k, lambda v: 0::BIGINT) AS done, 0::BIGINT AS pick FROM k
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, i: v + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, list_min(list_transform(k.k, lambda v, i:
      CASE WHEN done[i] < v AND done[i] * r // v <= t + 1 THEN ((done[i] + 1) * r + v - 1) // v * 100000 + i END)) % 100000 AS p
    FROM e, k WHERE t + 1 < r)),
turns AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS ordinal FROM e WHERE t >= 0),
srcs AS (SELECT i, src[i] AS source, k[i] AS k, r, ceil(ch[i] / {BLOCK_CHARS})::BIGINT AS blocks FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k)),
ends AS (SELECT min((blocks - 1) // k * r + t) AS ends FROM srcs JOIN turns ON turns.i = srcs.i AND ordinal = (blocks - 1) % k WHERE blocks > 0),
docs AS (
  SELECT doc_id, source, coalesce(sum(coalesce(length(text), 0)) OVER (
           PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_CHARS} AS block
  FROM documents)
SELECT doc_id, docs.source, block::BIGINT AS block, (block // k * r + t)::BIGINT AS slot, coalesce(block // k * r + t <= ends, true) AS in_mix
FROM docs JOIN srcs ON srcs.source IS NOT DISTINCT FROM docs.source JOIN turns ON turns.i = srcs.i AND ordinal = block % k, ends
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

FILTER_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (
  SELECT doc_id, part, unnest([
    {{'f': 'A', 'failed': len(w) < 100}}, {{'f': 'B', 'failed': 100 * len(list_distinct(w)) < 80 * len(w)}},
    {{'f': 'C', 'failed': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text)}},
    {{'f': 'D', 'failed': regexp_matches(text, '[#$%&*|]')}}, {{'f': 'E', 'failed': doc_id > min(doc_id) OVER (PARTITION BY text)}}]) AS x FROM d),
m AS (SELECT doc_id, part, coalesce(string_agg(x.f, '' ORDER BY x.f) FILTER (x.failed), '') AS mask FROM f GROUP BY doc_id, part),
c AS (
  SELECT part, mask, count(*) AS docs, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
r AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN translate(mask, earlier || f, '') = mask THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') <> mask THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = f THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, c GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, f AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM r
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, (100 - 25 + (25 * len(w) * docs) // total)::BIGINT AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY item_id, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
x AS (
  SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""
