"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from trailmark.llm import licenses

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, first,
             octet_length(encode(html)) >= 100 AND page_id > first AS revisit FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to
FROM q
"""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l,
             regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM m)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win),
        (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
             CAST(length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
      FROM m LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                   + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 15 * n_words)::INT + 32 * (100 * n_dup_lines > 60 * n_lines)::INT
                   + 64 * (2 * n_capitals > word_chars)::INT + 128 * (n_words > 1000000)::INT AS INTEGER) AS fail_bits FROM f)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept FROM b
"""

MIXING = """
WITH RECURSIVE s AS (SELECT source, sum(octet_length(encode(coalesce(text, '')))) AS n_bytes FROM documents GROUP BY source),
w AS (SELECT source, n_bytes, CAST(round(sqrt(n_bytes) * 1000) AS BIGINT) AS weight FROM s),
r AS (SELECT source, CASE WHEN n_bytes > 0 THEN CAST(weight * (SELECT sum(n_bytes) FROM w) AS DOUBLE) / CAST((SELECT sum(weight) FROM w) * n_bytes AS DOUBLE) ELSE 0 END AS rate FROM w),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r WHERE rate > 0
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 25)),
d AS (SELECT doc_id, source, CAST('0x' || substr(md5('mix-1|' || doc_id || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, count(*) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf < d.u GROUP BY ALL)
SELECT doc_id, source, copies, copy, CAST('0x' || substr(md5('mix-1-order|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, source, copies, unnest(generate_series(1, copies)) AS copy FROM n)
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM w GROUP BY ALL HAVING count(DISTINCT n) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) + count(*) AS den FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM w JOIN l USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(CAST(sum(c.c) AS HUGEINT), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (t.total + v.v) AS p, 1 + 1000000000 * (l.c + 1) // v.den AS q
      FROM g JOIN t ON t.lang = g.lang AND t.source = g.source JOIN v ON v.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

FILTER_AUDIT = r"""
WITH RECURSIVE o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, [y FOR y IN regexp_split_to_array(x, '[\x20\x09-\x0D]+') IF y <> ''] AS w, doc_id > min(doc_id) OVER (PARTITION BY x) AS dup FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(dup, false)] AS f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
s AS (SELECT part, filter_order, step, f[ascii(filter_order[step]) - 64] AS own, len([i FOR i IN range(1, step) IF f[ascii(filter_order[i]) - 64]]) > 0 AS before, len([y FOR y IN f IF y]) AS failed, n, good, toxic
      FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT before), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (own AND before), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (own AND failed = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (own AND NOT before), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM r
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, [y FOR y IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF y <> ''] AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, greatest(len(w) - 1, least(len(w), 1) + 1))]) AS s FROM d),
u AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b USING (x) WHERE a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN c ON c.a = s.r JOIN s o ON c.b = o.r GROUP BY s.r, s.doc_id, s.s
"""


def _licenses() -> str:
    """All sentences and rules. DuckDB's expressions have no look-around, so each mark between
    lines is doubled and a match takes one mark on each side."""
    longest_first = sorted(licenses.SENTENCES.values(), key=len, reverse=True)
    blank = r"(?: |\|\|)"
    pattern = "[|~](" + "|".join(x.replace(" ", blank) for x in longest_first) + ")[|~]"
    words = " OR ".join(f"contains(lower(text), '{w}')" for w in licenses.WORDS)
    known = ", ".join(f"('{v}', '{k}')" for k, v in licenses.SENTENCES.items())
    steps = ", ".join(f"replace(r{i}, ' {'  '.join(p)} ', ' # ') AS r{i + 1}" for i, (_, p) in enumerate(licenses.RULES))
    found = ", ".join(f"CASE WHEN contains(r{i}, ' {'  '.join(p)} ') THEN '{x}' END" for i, (x, p) in enumerate(licenses.RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, n, regexp_replace(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '~|', '  '),
      '(?m)[.!?;]+([\x20\x09\x0B-\x0D])|^[^a-z0-9\n]*[a-z0-9]{{1,2}}\)([\x20\x09])', '~\1\2', 'g') AS x FROM d WHERE {words}),
b AS (SELECT doc_id, n, regexp_replace(regexp_replace(x, '[^a-z0-9~\n]+', ' ', 'g'), ' ?\n[ \n]*', '|', 'g') AS x FROM a),
c AS (SELECT doc_id, n, '|' || regexp_replace(x, '^ | $| ?~[ |~]*', '~', 'g') || '|' AS x FROM b),
e AS (SELECT doc_id, n, [replace(y, '||', ' ') FOR y IN regexp_extract_all(replace(replace(x, '|', '||'), '~', '~~'), '{pattern}', 1)] AS s FROM c),
f AS (SELECT n, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM e),
g AS (SELECT n, list(id ORDER BY i) AS ids FROM f JOIN known USING (sentence) GROUP BY n),
r AS (SELECT n, ids, ' ' || list_aggregate(ids, 'string_agg', '  ') || ' ' AS r0, {steps} FROM g),
k AS (SELECT n, ids, list_sort(list_distinct([{found}])) AS all_found FROM r),
l AS (SELECT n, ids, CASE WHEN len(all_found) > 1 THEN [x FOR x IN all_found IF x <> '{licenses.RESERVED}'] ELSE all_found END AS licences FROM k)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
       coalesce(list_aggregate(licences, 'string_agg', ','), '') AS licences
FROM d LEFT JOIN l USING (n)
"""


ORACLE_SQL = {"op2_warc": WARC, "op5_licenses": _licenses(), "op6_mixing": MIXING, "op10_quality_rules": QUALITY_RULES, "op11_jaccard": JACCARD, "op12_filter_audit": FILTER_AUDIT, "op13_divergence": DIVERGENCE}
