"""Embedding search, matching and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.operators.vector_blocks import block_search, mutual_search, word_search
from mapfold.session import written

ROW_COMPONENTS = 1 << 22  #: components of a block of rows, about
QUERY_COMPONENTS = 1 << 20  #: components of a block of queries, about


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """VEC3."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def _sound(dims: int) -> Column:
    """Whether a row (id, vec) has an id and dims finite components whose squares add up."""
    return F.coalesce(F.col("id").isNotNull() & (F.size("vec") == dims) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False))), F.lit(False))


def sound_and_odd(rows: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, vec, ..) that closest() can compare, and the others."""
    return rows.filter(_sound(dims)), rows.filter(~_sound(dims))


def measured(rows: DataFrame, dims: int | None = None) -> tuple[int, int, int]:
    """(rows that are sound, others, length of vectors, the greatest if not given)."""
    if dims is None:
        dims = max(rows.agg(F.max(F.size("vec"))).first()[0] or 0, 0)
    sound, every = rows.agg(F.count_if(_sound(dims)), F.count("*")).first()
    return sound, every - sound, dims


def by_every_pair(queries: DataFrame, base: DataFrame, k: int, blocks: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, distance): the k nearest of each block of the base, pair by pair; a distance that is null comes last."""
    b = base.select("id", F.col("vec").alias("_b"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block"))
    q = queries.select(F.col("id").alias("query_id"), "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    pairs = q.join(b, "_block")
    if exclude_self:
        pairs = pairs.filter("id != query_id")
    pairs = pairs.select("query_id", "id", "_block", euclidean(F.col("vec"), F.col("_b")).alias("distance"))
    part = Window.partitionBy("query_id", "_block").orderBy(F.asc_nulls_last("distance"), "id")
    return pairs.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).select("query_id", "id", "distance")


def odd_pairs(queries: DataFrame, base: DataFrame, odd: tuple[int, int], dims: int, k: int, blocks: int, exclude_self: bool) -> list[DataFrame]:
    """What closest() leaves out: pairs with an odd query or an odd row. odd: how many queries and rows are."""
    out = []
    (fit, rest), (_, strange) = sound_and_odd(queries, dims), sound_and_odd(base, dims)
    if odd[0]:
        out.append(by_every_pair(rest, base, k, blocks, exclude_self))
    if odd[1]:
        out.append(by_every_pair(fit, strange, k, blocks, exclude_self))
    return out


def closest(queries: DataFrame, base: DataFrame, keys: list[str], k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, distance): the k nearest rows of each group of keys to each query in it, exact (VEC1).

    queries: keys, id, vec; base: keys, id, vec; all sound. A group of either is one task's.
    """
    q = queries.select(*[F.col(c).alias("q" + c) for c in keys], F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    told = f"query_id {queries.schema['id'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, distance double"
    return q.groupBy(*["q" + c for c in keys]).cogroup(base.select(*keys, "id", "vec").groupBy(*keys)).applyInArrow(block_search(k, exclude_self), told)


def parts(rows: int, dims: int, most: int) -> int:
    """Blocks of at most so many components, about."""
    return max(1, -(-rows * max(1, dims) // most))


def nearest(queries: DataFrame, base: DataFrame, k: int, blocks: int = 16, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): exact k nearest by Euclidean distance (VEC1).

    A stated query set against all rows, in blocks of bounded size: every block of queries
    meets each block of the base once, as matrices, and a query keeps its k best there; those
    are merged, so k rows a query and block move on.
    """
    n, odd, dims = measured(base)
    m, strange, _ = measured(queries, dims)
    of_base, of_queries = max(blocks, parts(n, dims, ROW_COMPONENTS)), parts(m, dims, QUERY_COMPONENTS)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = sound_and_odd(queries, dims)[0].select("id", "vec", own(of_queries).alias("_part"), every(of_base).alias("_block"))
    b = sound_and_odd(base, dims)[0].select("id", "vec", own(of_base).alias("_block"), every(of_queries).alias("_part"))
    best = closest(q, b, ["_block", "_part"], k, exclude_self)
    for more in odd_pairs(queries, base, (strange, odd), dims, k, blocks, exclude_self):
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def hit_rate(found: DataFrame, positives: DataFrame, raw: bool = False) -> DataFrame:
    """Queries with a positive among their found rows, over queries that have positives (VEC2). positives: query_id, id."""
    paired = positives.select("query_id").distinct()
    hit = found.join(positives, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return paired.join(hit, "query_id", "left").fillna(0, ["hits"]).agg(F.sum("hits" if raw else (F.col("hits") > 0).cast("long")).alias("hits"), F.count("*").alias("queries")).withColumn("rate", F.col("hits") / F.col("queries"))


def mutual_nearest(left: DataFrame, right: DataFrame, block: list[str], least_saliency: float) -> DataFrame:
    """Pairs of patches that are each other's most similar, both salient enough (VEC4). Sides: block, patch_idx, vec, saliency."""
    # of equal vectors only the least patch can be the most similar to any other, so the others make no pairs
    one = lambda df, p: df.groupBy(*block, F.col("vec").alias("v" + p)).agg(F.min(F.struct("patch_idx", "saliency")).alias("_m")).select(*block, F.col("_m.patch_idx").alias(p), "v" + p, F.col("_m.saliency").alias("s" + p))
    l, r = one(left, "a"), one(right, "b")  # noqa: E741
    pairs = written(_most_similar(l, r, block))
    of_a = pairs.groupBy(*block, "a").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("b"))
    of_b = pairs.groupBy(*block, "b").agg(F.max_by("a", F.struct("sim", -F.col("a"))).alias("a"))
    both = of_a.join(of_b, [*block, "a", "b"]).join(l, [*block, "a"]).join(r, [*block, "b"]).withColumn("sim", cosine(F.col("va"), F.col("vb")))
    return both.filter((F.col("sa") > least_saliency) & (F.col("sb") > least_saliency)).select(*block, "a", "b", "sim", "sa", "sb")


def _kind(vec: Column) -> Column:
    """1 for vectors that matrices can compare, 0 for those without a cosine to any other, 2 for the rest."""
    sound = F.forall(vec, lambda x: F.coalesce(F.abs(x) < 1e75, F.lit(False))) & norm(vec).between(1e-75, 1e80)
    return F.when(F.coalesce(sound, F.lit(False)), 1).when(F.coalesce(norm(vec) == 0, F.lit(True)), 0).otherwise(2)


def _in_parts(rows: DataFrame, group: list[str], size: str, name: str, own: str) -> DataFrame:
    """rows with name, the number of parts of their group of bounded size, and the part they are dealt to by the digest of own."""
    n = rows.groupBy(*group).agg(F.ceil(F.count("*") * F.greatest(F.max(size), F.lit(1)) / QUERY_COMPONENTS).alias(name))
    return rows.join(n.hint("merge"), group).withColumn("_" + name, F.pmod(F.xxhash64(own), F.col(name)))


def _most_similar(l: DataFrame, r: DataFrame, block: list[str]) -> DataFrame:  # noqa: E741
    """(block, a, b, sim): pairs inside blocks, among them the most similar b of each a and a of each b.

    Vectors of one length meet as matrices, in parts of bounded size; every part of one side
    meets each of the other, and a row and pair of parts moves on one pair.
    """
    marked = lambda df, p: written(df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in block) or "true").select(*block, p, "v" + p, _kind(F.col("v" + p)).alias("_k"), F.size("v" + p).alias("_d")))
    l, r = marked(l, "a"), marked(r, "b")  # noqa: E741
    group = [*block, "_d"]
    a, b = _in_parts(l.filter("_k = 1"), group, "_d", "i", "a"), _in_parts(r.filter("_k = 1"), group, "_d", "j", "b")
    of = lambda rows, n, c: rows.join(n.select(*group, c).distinct().hint("merge"), group).withColumn("_" + c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    cell = [*group, "_i", "_j"]
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in l.select(*block, "a").schema), f"b {r.schema['b'].dataType.simpleString()}", "sim double"])
    a, b = (rows.select(*cell, c, "v" + c) for rows, c in ((of(a, b, "j"), "a"), (of(b, a, "i"), "b")))
    pairs = a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(mutual_search(block), told)
    # a row without a cosine to any of the others takes the least of them
    least = lambda rows, c: rows.groupBy(*block).agg(F.min(c).alias(c))
    for x, y in ((l.select(*block, "a"), least(r, "b")), (r.select(*block, "b"), least(l, "a"))):
        pairs = pairs.unionByName(x.join(y, block).withColumn("sim", F.lit(None).cast("double")))
    odd = [df.filter("_k = 2").isEmpty() for df in (l, r)]
    by_pair = lambda x, y: x.drop("_k").join(y.drop("_k"), group).select(*block, "a", "b", cosine(F.col("va"), F.col("vb")).alias("sim"))
    if not odd[0]:
        pairs = pairs.unionByName(by_pair(l.filter("_k = 2"), r))
    if not odd[1]:
        pairs = pairs.unionByName(by_pair(l.filter("_k = 1"), r.filter("_k = 2")))
    return pairs


def best_per_cluster(rows: DataFrame, rank: str, tie: str) -> DataFrame:
    """The best row of each cluster, best cluster first (WIN10, VEC5)."""
    w = Window.partitionBy("cluster").orderBy(F.desc(rank), tie)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(F.desc(rank), tie)


def closest_words(queries: DataFrame, words: DataFrame, block: list[str]) -> DataFrame:
    """Reference words of a block by falling similarity to each query (VEC8)."""
    w = words.select(*block, "word", F.col("vec").alias("_w"))
    sim = queries.join(w, block).withColumn("sim", cosine(F.col("vec"), F.col("_w")))
    return sim.groupBy(*block, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "word"))), lambda x: x["word"]).alias("words"))


def closest_few_words(queries: DataFrame, words: DataFrame, block: list[str], k: int) -> DataFrame:
    """The first k of closest_words() without the word that is a query's id, and no list of all others (VEC8).

    Vectors of the usual length meet as matrices in parts of bounded size, so k words a
    query and part move on; the others are compared pair by pair.
    """
    keep = " AND ".join(f"`{c}` IS NOT NULL" for c in block) or "true"
    q = written(queries.filter(keep).select(*block, "id", F.col("id").cast("string").alias("name"), "vec", _kind(F.col("vec")).alias("_k"), F.size("vec").alias("_d")))
    w = written(words.filter(keep).select(*block, "word", F.col("vec").alias("wvec"), _kind(F.col("vec")).alias("_k"), F.size("vec").alias("_d")))
    dims = w.agg(F.max("_d")).first()[0]
    fits = (F.col("_k") == 1) & (F.col("_d") == F.lit(dims))
    a, b = _in_parts(q.filter(fits), block, "_d", "i", "id"), _in_parts(w.filter(fits), block, "_d", "j", "word")
    of = lambda rows, n, c: rows.join(n.select(*block, c).distinct().hint("merge"), block).withColumn("_" + c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    cell = [*block, "_i", "_j"]
    a, b = of(a, b, "j").select(*cell, "id", "name", "vec"), of(b, a, "i").select(*cell, "word", "wvec")
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in q.select(*block, "id").schema), "word string", "sim double"])
    found = a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(word_search(block, k), told)
    odd_q, odd_w = (df.filter(~fits).select(*df.columns) for df in (q, w))
    for x, y in ((odd_q, w), (q.filter(fits), odd_w)):
        if not x.isEmpty() and not y.isEmpty():
            near = x.drop("_k", "_d").withColumn("_n", F.monotonically_increasing_id()).join(y.drop("_k", "_d"), block).filter("NOT (name <=> word)").withColumn("sim", cosine(F.col("vec"), F.col("wvec")))
            first = Window.partitionBy("_n").orderBy(F.asc_nulls_first(-F.col("sim")), F.asc_nulls_first("word"))
            found = found.unionByName(near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).select(*block, "id", "word", "sim"))
    top = found.groupBy(*block, "id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "word"))), lambda x: x["word"]), 1, k).alias("words"))
    every = q.select(*block, "id").distinct().join(w.select(*block).distinct(), block, "left_semi")
    return every.join(top, [*block, "id"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def triplets(positives: DataFrame, pool: DataFrame, seed: int = 1) -> DataFrame:
    """(anchor, positive, negative): the negative of a pair by hash rank from the pool, never a positive of the anchor (SMP1).

    positives: anchor, positive; pool: id. Each pair is dealt a few places of the pool and
    takes the first that is no positive. A pair without one takes a place among the rows
    that are left to its anchor, or null where none is.
    """
    numbered, n = _numbered(pool.select(F.col("id").alias("negative")).distinct(), _rank("negative", F.lit(seed)))
    draw = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.pmod(_rank("anchor", "positive", k, F.lit(seed)), F.lit(max(n, 1))))
    dealt = positives.select("anchor", "positive", F.posexplode(draw).alias("_try", "_at")).join(numbered, "_at")
    free = dealt.filter("negative != anchor").join(positives.select("anchor", F.col("positive").alias("negative")), ["anchor", "negative"], "left_anti")
    first = written(free.groupBy("anchor", "positive").agg(F.min_by("negative", "_try").alias("negative")))
    same = lambda c: F.col("p." + c).eqNullSafe(F.col("f." + c))
    rest = written(positives.select("anchor", "positive").distinct().alias("p").join(first.alias("f"), same("anchor") & same("positive"), "left_anti"))
    return first.unionByName(_among_the_free(rest, positives, numbered, n, seed))


def _rank(*parts: str | Column) -> Column:
    """60 bits of a digest that any engine can repeat; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _numbered(pool: DataFrame, rank: Column) -> tuple[DataFrame, int]:
    """(pool (negative) with places _at from 0 by rank, number of rows): places in 4,096 ranges of the rank, moved by the counts of those before."""
    ranked = pool.withColumn("_rank", rank).withColumn("_range", F.shiftright("_rank", 48))
    before, n = [], 0
    for r in sorted(ranked.groupBy("_range").count().collect()):
        before.append((r["_range"], n))
        n += r["count"]
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_rank", "negative")) - 1
    starts = pool.sparkSession.createDataFrame(before, "_range long, _before long")
    placed = ranked.withColumn("_own", own).join(F.broadcast(starts), "_range")
    return written(placed.select("negative", (F.col("_before") + F.col("_own")).alias("_at"))), n


def _among_the_free(rest: DataFrame, positives: DataFrame, numbered: DataFrame, n: int, seed: int) -> DataFrame:
    """rest (anchor, positive) with a negative by hash rank from the rows that are no positive of the anchor, null where there are none.

    The r-th free place is r and as many as the taken places e_0 < e_1 < .. of the anchor
    with e_j - j <= r, so one running count over both finds it.
    """
    anchors = rest.select("anchor").distinct()
    own = anchors.select("anchor", F.col("anchor").alias("negative"))
    taken = positives.select("anchor", F.col("positive").alias("negative")).join(anchors, "anchor", "left_semi").unionByName(own).distinct().join(numbered, "negative")
    gaps = taken.select("anchor", (F.col("_at") - F.row_number().over(Window.partitionBy("anchor").orderBy("_at")) + 1).alias("_r"), F.lit(None).alias("positive"), F.lit(1).alias("_taken"))
    left = F.lit(n) - F.coalesce("_n", F.lit(0))
    asked = rest.join(taken.groupBy("anchor").agg(F.count("*").alias("_n")), "anchor", "left")
    asked = asked.select("anchor", F.when(left > 0, F.pmod(_rank("anchor", "positive", F.lit(seed)), F.greatest(left, F.lit(1)))).alias("_r"), "positive", F.lit(0).alias("_taken"))
    order = Window.partitionBy("anchor").orderBy("_r", F.desc("_taken")).rowsBetween(Window.unboundedPreceding, 0)
    placed = gaps.unionByName(asked).withColumn("_at", F.col("_r") + F.sum("_taken").over(order)).filter("_taken = 0")
    return placed.join(numbered, "_at", "left").select("anchor", "positive", "negative")


def same_area(rows: DataFrame) -> DataFrame:
    """(id, same): other ids with the same name prefix before '_' (SMP2)."""
    p = rows.withColumn("_p", F.split("id", "_")[0])
    groups = p.groupBy("_p").agg(F.array_sort(F.collect_set("id")).alias("same"))
    return p.join(groups, "_p").select("id", F.array_remove("same", F.col("id")).alias("same"))


def split_share(rows: DataFrame, id_col: str, share: float, seed: int = 1) -> DataFrame:
    """rows with validation true for about share of the ids, the same ones every time and in every engine (SMP3)."""
    u = F.conv(F.substring(_digest(id_col, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return rows.withColumn("validation", u < share)


def _digest(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"/{seed}")).cast("binary"))


def folds(rows: DataFrame, map_col: str, k: int, seed: int = 1) -> DataFrame:
    """rows with the fold of their map and the fold after it as validation (SMP4).

    Maps are dealt by the rank of a digest: the first folds take one map more where k does
    not divide their number. Ranks are counted within 4,096 ranges of the digest.
    """
    maps = rows.select(map_col).distinct().withColumn("_rank", _digest(map_col, seed)).withColumn("_range", F.substring("_rank", 1, 3))
    counts = maps.groupBy("_range").agg(F.count("*").alias("_n"))  # 4,096 rows at most
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))
    placed = maps.join(F.broadcast(before.drop("_n")), "_range").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_rank")) - 1).join(total)
    size, more = F.floor(F.col("_total") / k), F.col("_total") % k
    fold = F.when(F.col("_at") < more * (size + 1), F.floor(F.col("_at") / (size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_at") - more * (size + 1), size)))
    maps = placed.select(map_col, fold.cast("int").alias("fold"))
    return rows.join(maps, map_col).withColumn("validation_fold", (F.col("fold") + 1) % k)


def every_nth(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """Every n-th row of each group (SMP5)."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % n == 0).drop("_n")


def salient_clusters(rows: DataFrame, least: float, share: float) -> DataFrame:
    """Clusters salient in enough images (AGG18). rows: image_id, cluster, saliency."""
    votes = rows.groupBy("cluster", "image_id").agg(F.avg("saliency").alias("s")).groupBy("cluster").agg(F.count_if(F.col("s") > least).alias("votes"))
    n = rows.agg(F.countDistinct("image_id").alias("n")).first().n
    return votes.filter(F.col("votes") >= -(-n * share // 1))
