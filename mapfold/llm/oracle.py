"""DuckDB SQL for the operators that SQL can express, by the plainest way to the same rows."""

from __future__ import annotations

from mapfold.llm import licenses, quality

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), near AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

SIMILAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)
), near AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

CRC_TABLE = """bits AS (
  SELECT n, 0 AS k, CAST(n AS UINTEGER) AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
)"""

PERIODS = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, CAST(xor(CAST(4294967295 AS UINTEGER), list_reduce(
           list_prepend(CAST(4294967295 AS UINTEGER), list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS UINTEGER))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS h
  FROM documents, crc
), e AS (
  SELECT *, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
), v AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w, n FROM f
), words AS (
  SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM v
), same AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n AND x.n >= 24
), island AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM same
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM island GROUP BY doc_id, p, g HAVING count(*) + p >= 24 AND count(*) >= 2 * p
), run AS (
  SELECT doc_id, start, length, min(p) AS period FROM stretch GROUP BY 1, 2, 3
), told AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM run GROUP BY 1
), best AS (
  SELECT r.*, 1000 * length // period AS exponent_milli FROM run r
  WHERE NOT EXISTS (SELECT 1 FROM run s WHERE s.doc_id = r.doc_id AND (s.length * r.period > r.length * s.period OR s.length * r.period = r.length * s.period AND (s.start < r.start OR s.start = r.start AND s.period < r.period)))
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words x
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY 1
)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(exponent_milli AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM v LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER first AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW first AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER first <= 3
"""

BYTES = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)
), hit AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new
  FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)
), run AS (
  SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY 1, 2
), piece AS (
  SELECT doc_id, r, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS p, lead(a) OVER w IS NULL AS last
  FROM run JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, string_agg(p, '' ORDER BY a) AS head, max(b) AS tail FROM piece GROUP BY 1
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

WORDS = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), hit AS (
  SELECT doc_id, i FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hit, range(35) t(k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def license_sql(threshold: float = 0.9) -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"('{label}', {listed(licenses._template_words(t))})" for label, t in licenses.TEMPLATES)
    low = f"translate({{0}}, '{UPPER}', '{SMALL}')"
    return rf"""
WITH phrases(label, p) AS (VALUES {phrases}), templates(label, side) AS (VALUES {templates}),
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({low.format("coalesce(text, '')")}, '{_LICENSE_WORD}') AS w FROM documents),
places AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrases WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY 1),
blocks AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), lambda p: contains(p, chr(10)))))) AS block FROM w
), tokens AS (
  SELECT doc_id, list_distinct(regexp_extract_all({low.format("block")}, '{_LICENSE_WORD}')) AS t FROM blocks
), found AS (
  SELECT doc_id, label, len(list_intersect(t, side)) / len(side) AS score FROM tokens, templates
  WHERE len(list_intersect(t, side)) >= ceil(round(len(side) * {threshold}, 6))
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def quality_sql() -> str:
    classes = [c.replace("&&[^a-zA-Z0-9#*$%&|<>]", "") for c in quality.CLASSES]
    classes[5] = r"[!-~]+"  # what is left of it after the classes before
    gone = "text"
    lengths = []
    for c in classes:
        rest = f"regexp_replace({gone}, '{c}', '', 'g')"
        lengths.append(f"length({gone}) - length({rest})")
        gone = rest
    counts = ", ".join(lengths)
    bins = "[" + ", ".join(f"'{w}'" for w in quality.BINS) + "]"
    width = len(quality.BINS) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{k}])" for k in range(1, n + 1)) + "]"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    share = lambda c, k: f"(CAST({c}[{k}] AS DOUBLE) / list_sum({c}))"

    def js(p: str, q: str, n: int) -> str:
        terms = " + ".join(f"({part(share(p, k), share(q, k))} + {part(share(q, k), share(p, k))}) / 2" for k in range(1, n + 1))
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, {terms})) END"

    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
         CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE '' END AS lang FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY 1
), m AS (
  SELECT doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(text) AS size, [{counts}] AS c, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({bins}, x)) AS low
  FROM d LEFT JOIN repeated USING (doc_id)
), h AS (
  SELECT * EXCLUDE (c, low), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_append(c, size - list_sum(c)) AS c, list_transform({bins}, lambda y: len(list_filter(low, lambda x: x = y))) AS k FROM m
), g AS (SELECT * EXCLUDE (k), list_append(k, n_words - list_sum(k)) AS k FROM h),
refs AS (SELECT lang, {sums("c", len(classes) + 1)} AS rc, {sums("k", width)} AS rk FROM g WHERE NOT base_failed AND n_words >= {quality.LEAST_WORDS} GROUP BY 1),
far AS (SELECT *, {js("none", "rk", width)} AS wordless FROM (SELECT *, list_append(list_transform({bins}, lambda x: 0), 1) AS none FROM refs)),
js AS (SELECT g.*, wordless, {js("c", "rc", len(classes) + 1)} AS js_chars, {js("k", "rk", width)} AS js_words FROM g LEFT JOIN far USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {quality.LEAST_WORDS} AND (js_chars > {quality.FARTHEST_CHARS} OR (wordless > 0.1 AND js_words > {quality.FARTHEST_WORDS} * wordless)), false) AS kept
FROM js
"""
