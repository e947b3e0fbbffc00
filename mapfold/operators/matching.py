"""Text matching between tables: rankings, fuzzy joins, phrases, corrections, age intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import text as T
from mapfold.operators.phrases import phrase_hits
from mapfold.session import written


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, token) of white-space tokens, case kept."""
    return df.select(id_col, F.posexplode(F.filter(F.split(text, r"\s+"), lambda t: t != "")).alias("pos", "token"))


def top_k(df: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; ties by the smaller tie column (WIN1-WIN3)."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_rows(scored: DataFrame, asked: list[str], rows: DataFrame, text: str, score: str, k: int) -> DataFrame:
    """(asked, row_id, score, rank): the k best rows, ties by the smaller row_id, where texts have been scored.

    scored: asked, text, score, each pair of texts once; rows: text, row_id. Equal texts score
    alike, so no row counts that is not among the k least of its text, and no text that k
    others precede by score and least row.
    """
    ids = rows.select(text, "row_id").withColumn("_n", F.row_number().over(Window.partitionBy(text).orderBy("row_id"))).filter(F.col("_n") <= k)
    first = rows.groupBy(text).agg(F.min("row_id").alias("_first"))
    near = top_k(scored.join(first.hint("merge"), text), asked, score, "_first", k).select(*asked, text, score)
    return top_k(near.join(ids.hint("merge"), text), asked, score, "row_id", k).select(*asked, "row_id", score, "rank")


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int | None = None) -> DataFrame:
    """(query_id, row_id, score, rank): the k best rows for each query (TXT10, WIN2).

    queries: query_id, text; corpus: row_id, text. A negative idf counts as epsilon times the
    mean idf. Rows meet queries over shared tokens only. Texts with the same tokens are
    scored once, so copies cost their rows only; with digits the score is rounded before it ranks.
    """
    bag = lambda df, key: df.withColumn(key, F.array_sort(F.filter(F.split("text", r"\s+"), lambda t: t != "")))
    asked_rows, rows = bag(queries, "_q").select("query_id", "_q"), bag(corpus, "_g").select("row_id", "_g")
    texts = written(rows.groupBy("_g").agg(F.count("*").alias("n")))
    counted = lambda df, key, name, *more: df.select(key, *more, F.explode(key).alias("token")).groupBy(key, *more, "token").agg(F.count("*").alias(name))
    terms = counted(texts, "_g", "tf", "n").withColumn("dl", F.size("_g"))
    facts = texts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size("_g")).alias("s")).first()
    n, total = facts.n or 0, facts.s or 0
    avgdl = total / n if n else 1.0
    idf = terms.groupBy("token").agg(F.sum("n").alias("df")).withColumn("idf", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("m")).first().m or 0.0
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")))
    asked = counted(asked_rows.select("_q").distinct(), "_q", "qf")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    score = F.sum(F.col("qf") * F.col("idf") * weight)
    scored = asked.join(idf, "token").join(terms, "token").groupBy("_q", "_g").agg((score if digits is None else F.round(score, digits)).alias("score"))
    best = best_rows(scored, ["_q"], rows, "_g", "score", k)
    return asked_rows.join(best.hint("merge"), "_q").select("query_id", "row_id", "score", "rank")


def fuzzy_top_k(queries: DataFrame, gazetteer: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, row_id, ratio, rank): token-sorted edit ratio, best k (TXT8, WIN1).

    Pairs share at least one token, so the block is an equi-join.
    """
    asked, rows = queries.select("query_id", T.token_sorted(F.col("text")).alias("q")), gazetteer.select("row_id", T.token_sorted(F.col("text")).alias("g"))
    words = lambda df, c: df.select(c).distinct().withColumn("token", F.explode(F.array_distinct(F.split(c, " "))))
    pairs = words(asked, "q").join(words(rows, "g"), "token").select("q", "g").distinct().withColumn("ratio", T.edit_ratio(F.col("q"), F.col("g")))
    best = best_rows(pairs, ["q"], rows, "g", "ratio", k)
    return asked.join(best.hint("merge"), "q").select("query_id", "row_id", "ratio", "rank")


def pair_tfidf(a: Column, b: Column) -> Column:
    """Cosine of two texts under TF-IDF fitted on just the two (TXT11).

    With two documents a shared term weighs 1 and any other ln(3/2) + 1.
    """
    words = lambda s: F.filter(F.split(F.lower(s), r"[^\w]+"), lambda t: F.length(t) >= 2)
    wa, wb = words(a), words(b)
    lone = F.log(F.lit(1.5)) + 1
    tf = lambda ws, t: F.size(F.filter(ws, lambda x: x == t))
    dot = F.aggregate(F.array_intersect(wa, wb), F.lit(0.0), lambda s, t: s + tf(wa, t) * tf(wb, t))

    def norm(ws: Column, other: Column) -> Column:
        return F.sqrt(F.aggregate(F.array_distinct(ws), F.lit(0.0), lambda s, t: s + F.pow(tf(ws, t) * F.when(F.array_contains(other, t), 1.0).otherwise(lone), 2)))

    return F.coalesce(F.try_divide(dot, norm(wa, wb) * norm(wb, wa)), F.lit(0.0))


def _fixed(rows: DataFrame, columns: list[str], most: int = 2000) -> Column:
    """A small fixed table as an array of structs; an error where it is not small."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a fixed table of {most} rows at most is expected")
    kinds = ",".join(f"{c}:{dict(rows.dtypes)[c]}" for c in columns)
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in columns]) for r in got]).cast(f"array<struct<{kinds}>>")


def choose_symbol(items: DataFrame, categories: DataFrame, symbols: DataFrame) -> DataFrame:
    """Best category of each description, then the best symbol of it (TXT12, WIN3).

    items: item_id, description; categories: category, words; symbols: category, symbol,
    keywords, text. Both dimension tables are symbol lists of 2,000 rows at most. An item
    whose best category scores 0 has neither.
    """
    told = F.col("description")
    score = lambda words: pair_tfidf(told, words)
    best = F.array_max(F.transform(_fixed(categories, ["category", "words"]), lambda c: F.struct(score(c["words"]).alias("s"), c["category"].alias("category"))))
    # equal descriptions are scored once
    rows = items.select("description").distinct().withColumn("_c", best).withColumn("category", F.when(F.col("_c.s") > 0, F.col("_c.category")))
    own = F.filter(_fixed(symbols, ["category", "symbol", "keywords", "text"]), lambda s: s["category"] == F.col("category"))
    chosen = F.array_max(F.transform(own, lambda s: F.struct((score(s["keywords"]) + score(s["text"])).alias("s"), s["symbol"].alias("symbol"))))
    scored = rows.select("description", "category", chosen["symbol"].alias("symbol"))
    return items.join(scored, "description", "left").select(*items.columns, "category", "symbol")


def find_phrases(texts: DataFrame, phrases: DataFrame, id_col: str = "text_id", ref_last_word: bool = False) -> DataFrame:
    """(id, pos, n, phrase): longest matches from left to right that do not overlap (TXT13).

    phrases: phrase (words split by one space, of any number). An automaton over words finds
    the longest phrase at each place of a text in one scan; the greedy choice is one pass
    over the matches of a text in order. ref_last_word also matches the last word alone
    where it begins a phrase.
    """
    words = texts.select(id_col, F.filter(F.split(T.plain(F.col("text")), r"\s+"), lambda t: t != "").alias("w")).filter(F.size("w") > 0)
    hits = phrase_hits(words, phrases.select(F.lower("phrase").alias("phrase")), id_col, ref_last_word)
    best = hits.groupBy(id_col, "pos").agg(F.max("n").alias("n"), F.max_by("phrase", "n").alias("phrase"))
    ordered = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "phrase"))).alias("m"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,n:int,phrase:string>>").alias("kept"))

    def take(a: Column, m: Column) -> Column:
        fits = m["pos"] >= a["free"]
        return F.struct(F.when(fits, m["pos"] + m["n"]).otherwise(a["free"]).alias("free"), F.when(fits, F.concat(a["kept"], F.array(m))).otherwise(a["kept"]).alias("kept"))

    return ordered.select(id_col, F.inline(F.aggregate("m", start, take, lambda a: a["kept"])))


def place_filter(texts: DataFrame, topo: DataFrame, per_map: bool = False) -> DataFrame:
    """Topographic sheets for each text: state, then quadrangle, then county (TXT14).

    texts: text_id, text; topo: row_id, map_name, county, state. Each step keeps the sheets
    whose name is a phrase of the text; the vocabulary of a step is what the step before
    left, over all texts or per text. A text without any county keeps all sheets of its
    quadrangles.
    """
    left = None
    for column in ("state", "map_name", "county"):
        vocabulary = topo if left is None or per_map else topo.join(left.select("row_id").distinct(), "row_id", "left_semi")
        found = find_phrases(texts, vocabulary.select(F.col(column).alias("phrase"))).select("text_id", F.col("phrase").alias("_p")).distinct()
        named = topo.select("row_id", F.lower(F.col(column)).alias("_p"))
        rows = found.join(named, "_p").select("text_id", "row_id")
        if left is None:
            left = rows
        elif column == "county":
            none = left.join(found.select("text_id").distinct(), "text_id", "left_anti")
            left = left.join(rows, ["text_id", "row_id"], "left_semi").unionByName(none)
        else:
            left = left.join(rows, ["text_id", "row_id"], "left_semi")
    return left


def correct_words(words: DataFrame, lexicon: DataFrame, most: int = 2, string_order: bool = False) -> DataFrame:
    """(word, corrected, distance): nearest lexicon word, the most frequent at equal distance (TXT16, TXT17).

    words: word, distinct; lexicon: name, cnt. Candidates come from deletion neighbourhoods:
    words within distance two share a form with at most two letters left out, so the block
    is an equi-join, and the distance is checked with its threshold. No candidate: the word
    itself with no distance. string_order compares counts as text.
    """

    def forms(s: Column) -> Column:
        def drop(x: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

        one = F.when(F.length(s) > 0, drop(s)).otherwise(F.array().cast("array<string>"))
        out = F.concat(F.array(s), one)
        if most > 1:
            out = F.concat(out, F.flatten(F.transform(F.filter(F.array_distinct(one), lambda x: F.length(x) > 0), drop)))
        return F.array_distinct(out)

    w = words.select("word", F.regexp_replace(F.lower("word"), "[^a-z]", "").alias("_w")).withColumn("_form", F.explode(forms(F.col("_w"))))
    x = lexicon.select("name", "cnt", F.explode(forms(F.col("name"))).alias("_form"))
    pairs = w.join(x, "_form").select("word", "_w", "name", "cnt").distinct()
    pairs = pairs.withColumn("d", F.levenshtein("_w", "name", most)).filter("d >= 0")
    count = F.col("cnt").cast("string") if string_order else F.col("cnt")
    order = Window.partitionBy("word").orderBy("d", count.desc(), "name")
    best = pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("word", F.col("name").alias("_name"), F.col("d").alias("distance"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("_name", "word").alias("corrected"), "distance")


def carry_titles(items: DataFrame) -> DataFrame:
    """Each short description with the last title above it in front (TXT5).

    items: map_id, item_id, description with parts split by ';'. A part that ends with ':'
    is a title; a part of fewer than four words takes the last title of its map.
    """
    parts = items.select("map_id", "item_id", F.posexplode(F.split("description", ";")).alias("pos", "part")).withColumn("part", F.btrim("part"))
    title = F.when(F.col("part").endswith(":"), F.regexp_replace("part", ":$", ""))
    order = Window.partitionBy("map_id").orderBy("item_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("title", F.last(title, ignorenulls=True).over(order)).filter(~F.col("part").endswith(":"))
    short = F.size(F.split("part", r"\s+")) < 4
    return parts.withColumn("full", F.when(short & F.col("title").isNotNull(), F.concat_ws(" ", "title", "part")).otherwise(F.col("part")))


def age_interval(texts: DataFrame, scale: DataFrame) -> DataFrame:
    """(text_id, b_age, t_age) of the stages, epochs and periods that a text names (TXT23).

    scale: idx, age, epoch, period, b_age, t_age, young to old; a fixed time scale of 2,000 rows at most.
    From periods over epochs to stages each level narrows the interval where it lies inside
    and widens it where it does not.
    """
    fixed = _fixed(scale, ["idx", "age", "epoch", "period", "b_age", "t_age"])
    named = lambda c: F.transform(F.filter(fixed, lambda r: F.col("text").contains(r[c])), lambda r: r["idx"])
    spans = texts.select("text_id", *[f(named(c)).alias(f"{c}_{n}") for c in ("period", "epoch", "age") for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    lo, hi = F.col("period_lo"), F.col("period_hi")
    for c in ("epoch", "age"):
        l, h = F.col(f"{c}_lo"), F.col(f"{c}_hi")  # noqa: E741
        new_lo = F.when(l.isNull(), lo).when(lo.isNull(), l).when((l >= lo) & (l <= hi), l).otherwise(F.least(lo, l))
        new_hi = F.when(h.isNull(), hi).when(hi.isNull(), h).when((h >= lo) & (h <= hi), h).otherwise(F.greatest(hi, h))
        lo, hi = new_lo, new_hi
    spans = spans.select("text_id", lo.alias("lo"), hi.alias("hi"))
    at = lambda place, c: F.get(F.filter(fixed, lambda r: r["idx"] == F.col(place)), F.lit(0))[c]
    return spans.select("text_id", at("hi", "b_age").alias("b_age"), at("lo", "t_age").alias("t_age"))


def deduped_candidates(rows: DataFrame) -> DataFrame:
    """Candidate lists with one entry for the first two '_' tokens, the first one (SET5, AGG4). rows: name, topos array."""
    each = rows.select("name", F.posexplode_outer("topos").alias("pos", "cand"))
    parts = F.split("cand", "_")
    each = each.withColumn("key", F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    first = each.filter("cand IS NOT NULL").groupBy("name", "key").agg(F.min(F.struct("pos", "cand")).alias("m"))
    kept = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["cand"]).alias("kept"))
    out = rows.select("name").distinct().join(kept, "name", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    return out.withColumn("n", F.size("kept"))
