"""Quality rules with a divergence test.

The agreed rules count words, symbols, repeated lines and repeated word windows. The
method then compares two histograms of a text with the reference of its language by the
Jensen-Shannon distance: over classes of characters, and over the common words of all
known languages with one bin for the other words. References are sums over all documents
of a language that pass the agreed rules and the length guard, so they follow the corpus;
texts under the guard are not judged by it. A text is too far off in its words at nine
tenths of the distance that a text without any common word has from the same reference:
clean prose keeps well below, text of another language or without a language lies at it or
beyond. Everything is DataFrame work, in one pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapfold.session import table, written

SPACES = r"[\x20\x09-\x0D]+"
#: Common words of the known languages.
COMMON = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "une", "est", "pour", "par", "dans", "qui"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "im", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"),
}
BINS = tuple(sorted({w for ws in COMMON.values() for w in ws}))
#: Classes of characters, each the pattern of its runs; the rest is a class too.
CLASSES = (r"[a-z]+", r"[A-Z]+", r"[0-9]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+", r"[\x21-\x7E&&[^a-zA-Z0-9#*$%&|<>]]+")
LEAST_WORDS = 50  #: guard: shorter texts have no histogram to speak of
FARTHEST_CHARS = 0.30  #: distance, of 0 to 1
FARTHEST_WORDS = 0.9  #: share of the distance of a text without common words


def bind(value: Column, f) -> Column:
    """f of value, evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    solid = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, SPACES))


def repeated_window_words(words: Column) -> Column:
    """How many words stand in windows of five words that a text has twice or more."""
    size = 5

    def joined(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:
        """One hash for each window of five: pairs, pairs of pairs and one more word."""
        n = F.size(h)
        pairs = joined(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1))
        fours = bind(pairs, lambda p: joined(F.slice(p, 1, n - 3), F.slice(p, 3, n - 3)))
        return joined(F.slice(fours, 1, n - 4), F.slice(h, 5, n - 4))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = bind(placed, lambda p: F.filter(p, lambda s, n: (F.get(p, n - 1)["x"] == s["x"]).eqNullSafe(True) | (F.get(p, n + 1)["x"] == s["x"]).eqNullSafe(True)))
        starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(starts, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = bind(hashes, lambda h: bind(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))
    return F.when(F.size(words) < size, F.lit(0)).otherwise(counted).cast("long")


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, between 0 and 1; null where one is empty."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def divergence(tp: Column, tq: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: (part(x / tp, y / tq) + part(y / tq, x / tp)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))

    totals = F.struct(total(p).alias("p"), total(q).alias("q"))
    return bind(totals, lambda t: F.when((t["p"] > 0) & (t["q"] > 0), divergence(t["p"], t["q"])))


def _language() -> Column:
    return F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("")


def quality_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept.

    A null or empty text has no words and fails the agreed rules. Rows are judged by
    themselves, so repeated rows agree; a null or unknown language is a language of its
    own. Columns of these names in docs are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept")
    docs = docs.drop(*made)
    return measured(docs, docs.columns).select(*docs.columns, *made)


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs and the measures; the table of measures is written once and read for references and verdicts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    rows = docs.withColumns({"_words": words_of(text), "_lines": lines, "_lang": _language(), "_rest0": text})
    # class after class is taken out, so that each pass reads only what the ones before left
    for k, pattern in enumerate(CLASSES):
        rows = rows.withColumn(f"_rest{k + 1}", F.regexp_replace(f"_rest{k}", pattern, ""))
    taken = [(F.length(f"_rest{k}") - F.length(f"_rest{k + 1}")).cast("long") for k in range(len(CLASSES))]
    rows = rows.withColumn("_chars", F.array(*taken))
    # the common words of a text alone, each between spaces of its own: short, so that every bin is a cheap count
    common = F.lower(F.array_join(F.filter("_words", lambda w: F.lower(w).isin(list(BINS))), "  "))
    rows = rows.withColumn("_spread", F.concat(F.lit(" "), common, F.lit(" ")))
    hits = lambda w: ((F.length("_spread") - F.length(F.replace(F.col("_spread"), F.lit(f" {w} ")))) / (len(w) + 2)).cast("long")
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length(text) - F.get("_chars", F.lit(3))).cast("long"),
            "n_symbols": F.get("_chars", F.lit(4)),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_words")),
            "_common": F.array(*[hits(w) for w in BINS]),
            "_length": F.length(text).cast("long"),
        }
    )
    rows = written(rows.select(*[F.col(c) for c in columns], "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars", "_common", "_length"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "_chars": F.concat("_chars", F.array(F.col("_length") - total("_chars"))),
            "_common": F.concat("_common", F.array(F.col("n_words") - total("_common"))),
        }
    )
    sound = rows.filter(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS))
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(k))).cast("double") for k in range(n)])
    width = len(BINS) + 1
    references = sound.groupBy("_lang").agg(sums("_chars", len(CLASSES) + 1).alias("_ref_chars"), sums("_common", width).alias("_ref_common"))  # a row for each known language
    # as far as a text without any common word is
    wordless = F.array(*[F.lit(0).cast("long")] * len(BINS), F.lit(1).cast("long"))
    references = references.withColumn("_wordless", _js_distance(wordless, F.col("_ref_common")))
    rows = rows.join(F.broadcast(references), "_lang", "left")
    rows = rows.withColumns({"js_chars": _js_distance(F.col("_chars"), F.col("_ref_chars")), "js_words": _js_distance(F.col("_common"), F.col("_ref_common"))})
    # a language whose reference has no common word to speak of is not judged by them
    far_words = (F.col("_wordless") > 0.1) & (F.col("js_words") > FARTHEST_WORDS * F.col("_wordless"))
    far = (F.col("n_words") >= LEAST_WORDS) & ((F.col("js_chars") > FARTHEST_CHARS) | far_words)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality_report(docs: DataFrame) -> DataFrame:
    return measured(docs.select(F.col("doc_id").cast("long"), "text", "lang"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"
    )


def op6_language_divergence(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("js_chars", "js_words")
