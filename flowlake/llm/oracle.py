"""SQL (DuckDB) for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from flowlake.llm.quality_rules import COMMON_WORDS, all_words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DENSE = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS t FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), s WHERE k + n - 1 <= len(w)),
h AS (SELECT p.doc_id, p.k, p.n, i.item_id FROM p JOIN i USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, unnest(range(0, n)) AS u(o) GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)"""

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{DENSE}') AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 19) + 1)) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT k + o) AS gone FROM r, unnest(range(0, 20)) AS u(o) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substring(h, 2 * k - 1, 2) AS x, CASE WHEN k + 99 <= length(h) // 2 THEN md5(substring(h, 2 * k - 1, 200)) END AS t FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS k FROM d)),
r AS (SELECT doc_id, k, x, CASE WHEN t IS NOT NULL AND row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1 THEN 1 ELSE 0 END AS again FROM b),
c AS (SELECT doc_id, k, x, max(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), 0) = 0 THEN 1 ELSE 0 END AS head FROM c),
a AS (SELECT doc_id, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(head) AS BIGINT) AS n_spans, string_agg(x, '' ORDER BY k) FILTER (gone = 0) AS kept FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{DENSE}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS near FROM m UNION SELECT r.doc_id, m.b FROM r JOIN m ON r.near = m.a),
c AS (SELECT doc_id, min(near) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""





def quality_sql() -> str:
    every = ", ".join(f"'{w}'" for w in all_words())
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    langs = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    without = lambda c, p: f"length({c}) - length(regexp_replace({c}, '{p}', '', 'g'))"
    kinds = [r"\p{L}+", "[0-9]+", r"[.,;:!?''\"()\-]+", r"[#*$%&|<>]+"]
    classes = [without("dense", "[A-Za-z]+"), *[without("r", k) for k in kinds], r"length(regexp_replace(r, '[\p{L}0-9.,;:!?''\"()\-#*$%&|<>]+', '', 'g'))"]
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{DENSE}') AS w FROM documents),
e AS (SELECT *, array_to_string(w, '') AS dense, regexp_replace(array_to_string(w, ''), '[A-Za-z]+', '', 'g') AS r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  list_transform(list_filter(w, lambda x: length(x) <= 5), lambda x: lower(x)) AS known, CASE lang {lists} ELSE [{every}] END AS listed FROM d),
p AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 2], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 2) + 1)) AS k FROM d)),
t AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat_words FROM p, unnest(range(0, 3)) AS u(o) WHERE n > 1 GROUP BY 1),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(dense) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [{', '.join(classes)}] AS classes, list_transform(listed, lambda x: len(list_filter(known, lambda y: y = x))) AS common FROM e LEFT JOIN t USING (doc_id)),
h AS (SELECT doc_id, lang, 'classes' AS kind, unnest(range(0, len(classes))) AS i, unnest(classes) AS v FROM f UNION ALL SELECT doc_id, lang, 'common', unnest(range(0, len(common))), unnest(common) FROM f),
q AS (SELECT lang, kind, i, sum(v) AS v FROM h WHERE NOT (lang = '' AND kind = 'classes') GROUP BY ALL UNION ALL SELECT '', kind, i, sum(v) FROM h WHERE kind = 'classes' GROUP BY ALL),
s AS (SELECT doc_id, kind, sum(h.v) OVER (PARTITION BY doc_id, kind) AS total, h.v / greatest(sum(h.v) OVER (PARTITION BY doc_id, kind), 1e-300) AS a, q.v / greatest(sum(q.v) OVER (PARTITION BY doc_id, kind), 1e-300) AS b FROM h JOIN q USING (lang, kind, i)),
j AS (SELECT doc_id, kind, max(total) AS total, sqrt(greatest(0, sum((({half.format('a', 'b')}) + ({half.format('b', 'a')})) / 2))) AS distance FROM s GROUP BY ALL),
v AS (SELECT doc_id, bool_or(CASE kind WHEN 'classes' THEN total >= 200 AND distance > 0.22 ELSE total >= 40 AND distance > 0.6 END) AS far FROM j GROUP BY 1),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, classes[5] AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM g JOIN v USING (doc_id)"""


ORACLE_SQL = {"op9_quality_rules": quality_sql(), "op1_decontamination": DECONTAMINATION, "op4_fingerprint_index": FINGERPRINTS, "op6_ngram_join": NGRAM_JOIN, "op8_suffix_dedup": SUFFIXES}
