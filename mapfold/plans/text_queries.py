"""Queries of the text operators over part names, benchmark texts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import text as T
from mapfold.operators import matching as M
from mapfold.operators import ratio_join as J
from mapfold.plans.registry import query
from mapfold.session import table

_TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"


@query(
    """WITH terms AS (SELECT p_partkey AS row_id, t AS token, count(*) AS tf FROM (SELECT p_partkey, unnest(list_filter(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' '), lambda t: t <> '')) AS t FROM part) GROUP BY ALL),
dl AS (SELECT row_id, sum(tf) AS dl FROM terms GROUP BY 1), stat AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT sum(dl) FROM dl) AS total),
idf0 AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM terms, stat GROUP BY token, n),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT p_partkey AS query_id, t AS token, count(*) AS qf FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part WHERE p_partkey % 50 = 0) GROUP BY ALL),
scored AS (SELECT query_id, row_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS score FROM q JOIN idf USING (token) JOIN terms USING (token) JOIN dl USING (row_id), stat GROUP BY 1, 2),
ranked AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM scored)
SELECT query_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"""
)
def bm25_gazetteer(spark, sf_dir):
    """TXT10, TXT7, WIN2."""
    part = table(spark, sf_dir, "part")
    corpus = part.select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    asked = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return M.bm25(asked, corpus, digits=9).select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH s AS (SELECT p_partkey AS id, array_to_string(list_sort(list_filter(string_split(lower(p_name), ' '), lambda t: t <> '')), ' ') AS n FROM part),
t AS (SELECT DISTINCT id, n, unnest(string_split(n, ' ')) AS token FROM s),
pairs AS (SELECT DISTINCT a.id AS query_id, b.id AS row_id, a.n AS q, b.n AS g FROM t a JOIN t b USING (token) WHERE a.id % 50 = 0),
ranked AS (SELECT *, 1 - levenshtein(q, g) / greatest(length(q), length(g)) AS ratio FROM pairs)
SELECT query_id, row_id, round(ratio, 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, row_id) AS rank FROM ranked) WHERE rank <= 10"""
)
def fuzzy_gazetteer(spark, sf_dir):
    """TXT8, WIN1."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"))
    asked = part.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    return M.fuzzy_top_k(asked, part).select("query_id", "row_id", F.round("ratio", 6).alias("ratio"), "rank")


@query(
    """WITH w AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part), t AS (SELECT a, b, list_filter(regexp_split_to_array(lower(a || ' ' || b), '[^\\w]+'), lambda x: length(x) >= 2) AS wa, list_filter(regexp_split_to_array(lower(b || ' item'), '[^\\w]+'), lambda x: length(x) >= 2) AS wb FROM w),
n AS (SELECT a, b, list_sum(list_transform(list_intersect(wa, wb), lambda x: len(list_filter(wa, lambda y: y = x)) * len(list_filter(wb, lambda y: y = x)))) AS dot,
  sqrt(list_sum(list_transform(list_distinct(wa), lambda x: pow(len(list_filter(wa, lambda y: y = x)) * CASE WHEN list_contains(wb, x) THEN 1.0 ELSE ln(1.5) + 1 END, 2)))) AS na,
  sqrt(list_sum(list_transform(list_distinct(wb), lambda x: pow(len(list_filter(wb, lambda y: y = x)) * CASE WHEN list_contains(wa, x) THEN 1.0 ELSE ln(1.5) + 1 END, 2)))) AS nb FROM t)
SELECT a, b, round(coalesce(dot, 0) / (na * nb), 6) AS cosine FROM n"""
)
def tfidf_pairs(spark, sf_dir):
    """TXT11."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    return names.select("a", "b", F.round(M.pair_tfidf(F.concat_ws(" ", "a", "b"), F.concat_ws(" ", "b", F.lit("item"))), 6).alias("cosine"))


@query(
    """WITH w AS (SELECT DISTINCT lower(t) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM benchmark) WHERE length(t) BETWEEN 3 AND 12),
lex AS (SELECT t AS name, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents WHERE lang = 'en') WHERE length(t) BETWEEN 3 AND 12 GROUP BY 1 HAVING count(*) >= 200),
pairs AS (SELECT word, name, cnt, levenshtein(word, name) AS d FROM w JOIN lex ON abs(length(word) - length(name)) <= 2 WHERE levenshtein(word, name) <= 2),
best AS (SELECT word, name, d FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, cnt DESC, name) = 1)
SELECT word, coalesce(name, word) AS corrected, CAST(d AS INTEGER) AS distance FROM w LEFT JOIN best USING (word)"""
)
def spelling_correction(spark, sf_dir):
    """TXT16, TXT17, D16: benchmark words against a lexicon of the English documents."""
    sized = F.length("word").between(3, 12)
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).filter(sized).select(F.lower("word").alias("word")).distinct()
    seen = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).filter(sized)
    lexicon = seen.groupBy(F.col("word").alias("name")).agg(F.count("*").alias("cnt")).filter("cnt >= 200")
    return M.correct_words(words, lexicon)


@query(
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS w FROM benchmark),
pos AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT item_id AS text_id, CAST(pos AS INTEGER) AS pos, 1 AS n, t AS phrase FROM pos WHERE t IN ('the', 'of', 'and', 'in')"""
)
def phrase_finder(spark, sf_dir):
    """TXT13 and TXT1 with single-word phrases."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    phrases = table(spark, sf_dir, "nation").filter("n_nationkey < 4").select(F.element_at(F.array(*[F.lit(x) for x in ("the", "of", "and", "in")]), F.col("n_nationkey") + 1).alias("phrase"))
    return M.find_phrases(texts, phrases)


_PLAIN = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')".replace("{{", "{").replace("}}", "}")


@query(
    f"""WITH RECURSIVE b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
phrases AS (SELECT DISTINCT ' ' || array_to_string(w[s:s + n - 1], ' ') || ' ' AS p, w[s] AS word, n FROM (SELECT w, 1 + item_id % 3 + 3 * k AS s, 1 + (item_id * 7 + k * 11) % 30 AS n FROM b, range(4) r(k)) WHERE len(w) >= s + n - 1),
texts AS (SELECT doc_id AS text_id, {_PLAIN} AS w FROM documents UNION ALL SELECT -1 - item_id, w FROM b),
joined AS (SELECT text_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM texts),
words AS (SELECT *, 1 + coalesce(sum(length(word) + 1) OVER (PARTITION BY text_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT text_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts)),
hits AS (SELECT text_id, i - 1 AS pos, max(n) AS n, trim(arg_max(p, n)) AS phrase FROM joined JOIN phrases ON contains(t, p) JOIN words USING (text_id, word) WHERE substr(t, CAST(start AS BIGINT), length(p)) = p GROUP BY 1, 2),
marks AS (SELECT text_id, pos AS i, 1 AS hit, CAST(NULL AS BIGINT) AS own FROM hits UNION ALL SELECT text_id, pos + n, 0, pos FROM hits),
linked AS (SELECT text_id, own AS pos, next FROM (SELECT *, min(CASE WHEN hit = 1 THEN i END) OVER (PARTITION BY text_id ORDER BY i, hit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM marks) WHERE hit = 0 AND next IS NOT NULL),
taken AS (SELECT text_id, min(pos) AS pos FROM hits GROUP BY 1 UNION ALL SELECT t.text_id, l.next FROM taken t JOIN linked l ON l.text_id = t.text_id AND l.pos = t.pos)
SELECT text_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, phrase FROM taken JOIN hits USING (text_id, pos)"""
)
def gazetteer_phrases(spark, sf_dir):
    """TXT13: phrases of 1 to 30 words, overlapping ones among them, in all documents and items."""
    words = F.filter(F.split(T.plain(F.col("text")), r"\s+"), lambda t: t != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", words.alias("w"))
    cuts = items.select("w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((1 + F.col("item_id") % 3 + 3 * k).alias("s"), (1 + (F.col("item_id") * 7 + k * 11) % 30).alias("n")))).alias("c"))
    whole = cuts.filter(F.size("w") >= F.col("c.s") + F.col("c.n") - 1)
    phrases = whole.select(F.array_join(F.slice("w", F.col("c.s").cast("int"), F.col("c.n").cast("int")), " ").alias("phrase"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text").unionByName(items.select((-1 - F.col("item_id")).alias("text_id"), "text"))
    return M.find_phrases(texts, phrases)


@query(
    """WITH parts AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN substr(text, 1, 20) END AS title, text FROM conversations)
SELECT conv_id, turn, last_value(title IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM parts"""
)
def carried_titles(spark, sf_dir):
    """TXT5: the last title seen, carried down by turn."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("role") == "user", F.substring("text", 1, 20))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(title, ignorenulls=True).over(order).alias("title"))


@query(
    """SELECT p_partkey, regexp_replace(lower(p_name || ', ' || p_type), '[^\\w\\s]', ' ', 'g') AS plain, upper(substr(p_name, 1, 1)) || substr(p_name, 2) <> p_name AS changes,
trim(regexp_replace(replace(lower('A - ' || p_brand), '-', ' '), '\\s+', ' ', 'g')) AS tidy, replace(string_split('http://x/y/' || p_brand || '.pdf', '/')[-1], '.pdf', '') AS sheet, replace(p_brand, '#', '-') AS hyphen FROM part"""
)
def text_cleaning(spark, sf_dir):
    """TXT1, TXT2, TXT6, TXT15, SRC5."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        T.plain(F.concat(name, F.lit(", "), "p_type")).alias("plain"),
        (F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000)) != name).alias("changes"),
        T.tidy(F.concat(F.lit("A - "), "p_brand")).alias("tidy"),
        T.sheet_name(F.concat(F.lit("http://x/y/"), "p_brand", F.lit(".pdf"))).alias("sheet"),
        F.translate("p_brand", "#", "-").alias("hyphen"),
    )


_RATIOS = """l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM benchmark),
r AS (SELECT lower(n_name) AS b FROM nation UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
bits AS (SELECT a, substr(a, i, 1) AS c, CAST(sum(CAST(1 AS BIGINT) << (i - 1)) AS BIGINT) AS m FROM (SELECT a, CAST(unnest(range(1, length(a) + 1)) AS INTEGER) AS i FROM l) GROUP BY 1, 2),
steps AS (SELECT a, b, 1 AS i, (CAST(1 AS BIGINT) << length(a)) - 1 AS v FROM l, r
 UNION ALL SELECT s.a, s.b, i + 1, ((v + (v & coalesce(m, 0))) | (v - (v & coalesce(m, 0)))) & ((CAST(1 AS BIGINT) << length(s.a)) - 1) FROM steps s LEFT JOIN bits ON bits.a = s.a AND c = substr(s.b, i, 1) WHERE i <= length(s.b)),
ratios AS (SELECT a, b, 2.0 * (length(a) - bit_count(v)) / (length(a) + length(b)) AS ratio FROM steps WHERE i = length(b) + 1)"""


def _word_sides(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("text"))
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("text"))
    return left, names.unionByName(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("text")))


@query(f"WITH RECURSIVE {_RATIOS} SELECT a, b, round(ratio, 6) AS ratio FROM ratios WHERE ratio >= 0.5")
def similar_words(spark, sf_dir):
    """TXT8: pairs of words whose common subsequence has half their length or more."""
    return J.ratio_join(*_word_sides(spark, sf_dir), 0.5).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query(f"WITH RECURSIVE {_RATIOS} SELECT a, b, round(ratio, 6) AS ratio FROM ratios WHERE ratio >= 0.8")
def close_words(spark, sf_dir):
    """TXT8: the same at four fifths, where longer words meet by pairs of characters."""
    return J.ratio_join(*_word_sides(spark, sf_dir), 0.8).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query(
    f"""WITH RECURSIVE {_RATIOS}, best AS (SELECT * FROM ratios WHERE ratio >= 0.5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) = 1)
SELECT a AS text, coalesce(b, a) AS match, round(ratio, 6) AS ratio FROM l LEFT JOIN best USING (a)"""
)
def words_best_matches(spark, sf_dir):
    """JN10 by the ratio of the common subsequence."""
    return J.best_matches(*_word_sides(spark, sf_dir), 0.5).select("text", "match", F.round("ratio", 6).alias("ratio"))
