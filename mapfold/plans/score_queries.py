"""Queries of scores over things that stand apart, so that matching is plain and SQL can tell the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import text as X
from mapfold.operators import evaluate as E
from mapfold.operators import pixels as P
from mapfold.operators import spatial as S
from mapfold.operators import vectors as V
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import table

#: A box of 20 by 20 for each customer on a grid of 100, and a detection moved to the right by 0 to 19.
_PAIRS_SQL = """c AS (SELECT c_custkey AS k, c_custkey % 4 AS image_id, c_custkey // 4 % 2 AS class, c_custkey * 7 % 20 AS s, c_custkey * 37 % 101 / 101.0::DOUBLE AS score FROM customer), i AS (SELECT *, (20 - s) * 20.0::DOUBLE / (800 - (20 - s) * 20) AS iou FROM c)"""


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("k"), (k % 4).alias("image_id"), (F.floor(k / 4) % 2).alias("class"), (k * 7 % 20).alias("s"), (k * 37 % 101 / 101.0).alias("score"))
    at = F.struct((F.col("k") % 100 * 100).cast("double").alias("x"), (F.floor(F.col("k") / 100) * 100).cast("double").alias("y"))
    box = lambda d: F.struct((at["x"] + d).alias("xmin"), at["y"].alias("ymin"), (at["x"] + 20 + d).alias("xmax"), (at["y"] + 20).alias("ymax"))
    return c.withColumns({"truth": box(F.lit(0.0)), "found": box(F.col("s").cast("double"))})


@query(
    f"""WITH {_PAIRS_SQL}, g AS (SELECT class, count(*) FILTER (k % 11 <> 0) AS n_true FROM c GROUP BY 1),
d AS (SELECT i.*, t.iou AS t, row_number() OVER (PARTITION BY image_id, class, t.iou ORDER BY score DESC, k) AS nth FROM i, (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(iou)),
h AS (SELECT class, t, score, image_id, k, iou >= t AS tp FROM d WHERE nth <= 100 AND NOT (k % 11 = 0 AND iou >= t)),
r AS (SELECT *, row_number() OVER w AS rank, sum(tp::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS tps FROM h WINDOW w AS (PARTITION BY class, t ORDER BY score DESC, image_id, k)),
p AS (SELECT r.class, t, tps / rank AS precision, tps / n_true AS recall, max(tps / rank) OVER (PARTITION BY r.class, t ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM r JOIN g ON g.class = r.class),
k AS (SELECT p.class, p.t, x / 100.0::DOUBLE AS x, coalesce(max(envelope) FILTER (recall >= x / 100.0::DOUBLE), 0) AS v FROM p, range(101) r(x) GROUP BY 1, 2, 3)
SELECT class, t AS iou, round(avg(v), 6) AS ap, (SELECT round(max(recall), 6) FROM p WHERE p.class = k.class AND p.t = k.t) AS ar FROM k GROUP BY class, t"""
)
def detection_of_lone_boxes(spark, sf_dir):
    """EVL4, WIN12, WIN15: boxes apart from each other, more than a hundred of an image and class at larger scales."""
    b = _boxes(spark, sf_dir)
    own = lambda c, det: b.select("image_id", "class", F.col("k").alias("box_id"), F.lit(det).alias("is_det"), "score", ((F.col("k") % 11 == 0) & F.lit(not det)).alias("ignore"), f"{c}.*")
    curve = E.detection_curve(own("found", True).unionByName(own("truth", False)), (0.5, 0.75))
    return E.average_precision(curve).select("class", "iou", F.round("ap", 6).alias("ap"), F.round("ar", 6).alias("ar"))


@query(
    f"""WITH {_PAIRS_SQL}, s AS (SELECT image_id, count(*) FILTER (k % 13 <> 0) AS nt, count(*) FILTER (k % 13 <> 0) AS np, count(*) FILTER (k % 13 <> 0 AND iou > 0.5 AND k % 3 > 0) AS tp FROM i GROUP BY ROLLUP (image_id))
SELECT image_id, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) ELSE 0 END, 6) AS hmean FROM s"""
)
def spotting_of_lone_words(spark, sf_dir):
    """EVL5, EVL6, AGG12: every third transcription is wrong, every thirteenth word does not count; the totals have no image."""
    b = _boxes(spark, sf_dir).withColumn("iou", G.box_iou(F.col("truth"), F.col("found")))
    own, said = F.concat(F.lit("Word"), "k"), F.concat(F.when(F.col("k") % 3 > 0, F.lit("(WORD")).otherwise(F.lit("x")), "k")
    pairs = b.filter("iou > 0").select("image_id", F.col("k").alias("gt_id"), F.col("k").alias("det_id"), "iou", X.same_transcription(said, own).alias("same_text"))
    truth = b.select("image_id", F.col("k").alias("gt_id"), (F.col("k") % 13 != 0).alias("care"))
    found = b.select("image_id", F.col("k").alias("det_id"), (F.col("k") % 13 == 0).alias("dont_care"))
    return E.text_spotting(pairs, truth, found).select("image_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hmean")])


@query(
    """WITH p AS (SELECT o_orderkey % 20 AS map_id, o_orderpriority AS key, o_orderkey * 20 AS row, o_orderkey % 3 AS s, o_orderkey % 7 > 0 AS t, o_orderkey % 11 > 0 AS d FROM orders),
s AS (SELECT map_id, key, count(*) FILTER (t) AS nt, count(*) FILTER (d) AS np, coalesce(sum(1 - s / 5000.0::DOUBLE) FILTER (t AND d), 0) AS tp FROM p GROUP BY 1, 2)
SELECT map_id, key, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt), 6) AS f1 FROM s WHERE nt > 0 AND np > 0"""
)
def pixel_scores_of_lone_points(spark, sf_dir):
    """EVL1, JN21: pixels far apart, predicted 0 to 2 rows below."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), F.col("o_orderpriority").alias("key"), k, (k * 20).alias("row"), F.lit(7).alias("col"))
    true, pred = o.filter(k % 7 > 0), o.filter(k % 11 > 0).withColumn("row", F.col("row") + k % 3)
    sizes = o.select("map_id").distinct().select("map_id", F.lit(3000).alias("height"), F.lit(4000).alias("width"))
    at = lambda df: df.select("map_id", "key", "row", "col")
    both = true.select("map_id", "key").distinct().join(pred.select("map_id", "key").distinct(), ["map_id", "key"])
    out = E.pixel_f_score(at(true), at(pred), 3, sizes).join(both, ["map_id", "key"], "left_semi")
    return out.select("map_id", "key", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH p AS (SELECT o_orderkey % 20 AS map_id, o_custkey AS start, o_orderkey % 5 * 0.25::DOUBLE AS s, o_orderkey % 7 > 0 AS t, o_orderkey % 11 > 0 AS d, o_orderkey % 3 = 0 AS turned FROM orders),
c AS (SELECT map_id, start, count(*) FILTER (t) AS nt, count(*) FILTER (d) AS np, count(*) FILTER (t AND d AND s <= 0.8) AS near, count(*) FILTER (t AND d AND s <= 0.8 AND NOT turned) AS hit, coalesce(sum(greatest(0, 1.5 * (s - 0.8 / 3))) FILTER (t AND d AND s < 0.8 AND NOT turned), 0) AS cost, count(*) FILTER (t AND d AND s < 0.8 AND NOT turned) AS soft FROM p GROUP BY 1, 2),
m AS (SELECT map_id, avg(CASE WHEN np > 0 THEN hit / np ELSE 0 END) AS precision, avg(CASE WHEN nt > 0 THEN hit / nt ELSE 0 END) AS recall, avg(CASE WHEN np > 0 THEN near / np ELSE 0 END) AS p, avg(CASE WHEN nt > 0 THEN near / nt ELSE 0 END) AS r FROM c WHERE nt + np > 0 GROUP BY 1),
q AS (SELECT map_id, cost + (np - soft) * 0.92 AS s, CASE WHEN np > 0 THEN 1 - (cost + (np - soft) * 0.92) / (np * 0.92) ELSE 0 END AS sp, 1 - (cost + (nt - soft) * 0.92) / (nt * 0.92) AS sr, np FROM c WHERE nt > 0)
SELECT map_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(p, 6) AS p, round(r, 6) AS r, score, f1 FROM m JOIN (SELECT map_id, round(sum(s), 4) AS score, round(avg(CASE WHEN np = 0 THEN 0 ELSE coalesce(2 * sp * sr / nullif(sp + sr, 0), 0) END), 5) AS f1 FROM q GROUP BY 1) USING (map_id)"""
)
def topo_of_lone_points(spark, sf_dir):
    """EVL8, EVL9, EVL17: walk points far apart, predicted 0 to 1 beside, every third one turned by a right angle."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), F.col("o_custkey").alias("start"), k, (k * 50).cast("double").alias("x"), F.lit(0.0).alias("y"))
    put = lambda df, dx, dy: df.select("map_id", "start", "x", "y", dx.cast("double").alias("dx"), dy.cast("double").alias("dy"))
    true = put(o.filter(k % 7 > 0), F.lit(1), F.lit(0))
    turned = k % 3 == 0
    pred = put(o.filter(k % 11 > 0).withColumn("y", k % 5 * 0.25), F.when(turned, 0).otherwise(1), F.when(turned, 1).otherwise(0))
    out = E.topo_measures(true, pred, 0.8)
    return out.select("map_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "p", "r")], F.round("score", 4).alias("score"), F.round("f1", 5).alias("f1"))


@query(
    """WITH e AS (SELECT vec_id % 10 AS image_id, label AS cluster, abs(embedding[1])::DOUBLE AS s, vec_id AS id FROM embeddings), v AS (SELECT cluster, image_id, avg(s) AS s FROM e GROUP BY 1, 2), n AS (SELECT cluster, count_if(s > 0.09) AS votes FROM v GROUP BY 1),
b AS (SELECT cluster, arg_max(id, (s, -id)) AS id, max(s) AS s FROM e GROUP BY 1)
SELECT cluster, votes, b.id, round(b.s, 6) AS saliency FROM n JOIN b USING (cluster) WHERE votes >= ceil((SELECT count(DISTINCT image_id) FROM e) * 0.3)"""
)
def salient_cluster_votes(spark, sf_dir):
    """AGG18, WIN10: clusters salient in enough images, with their most salient member; labels stand for clusters."""
    e = I.embeddings(spark, sf_dir).select((F.col("id") % 10).alias("image_id"), F.col("label").alias("cluster"), F.abs(F.col("vec")[0]).cast("double").alias("saliency"), "id")
    votes = V.salient_clusters(e.select("image_id", "cluster", "saliency"), 0.09, 0.3)
    best = V.best_per_cluster(e, "saliency", "id").select("cluster", "id", "saliency")
    return votes.select("cluster", "votes").join(best, "cluster").select("cluster", "votes", "id", F.round("saliency", 6).alias("saliency"))


_RUNS_SQL = f"{I.MASK_SQL}, g AS (SELECT *, col - row_number() OVER (PARTITION BY map_id, key, row ORDER BY col) AS g FROM mask), sizes AS (SELECT map_id, key, count(*) * 7 AS size FROM g GROUP BY map_id, key, row, g)"


@query(
    f"""WITH {_RUNS_SQL}, s AS (SELECT map_id, key, avg(size) FILTER (size > 5) AS mean, max(size) AS top, count(*) FILTER (size > 5) AS n FROM sizes GROUP BY 1, 2)
SELECT map_id, key, CASE WHEN top > 200 OR n <= 1 THEN 'solid' WHEN abs(mean - 20) < 10 OR n >= 4 THEN 'dotted' ELSE 'dash' END AS pattern FROM s"""
)
def dash_patterns_by_rule(spark, sf_dir):
    """AGG14 over the lengths of runs."""
    sizes = P.mask_runs(I.mask(spark, sf_dir)).select("map_id", "key", ((F.col("c1") - F.col("c0") + 1) * 7).alias("size"))
    return P.dash_pattern_by_rule(sizes)


_FILLED_SQL = """bg AS (SELECT k.map_id, k.key, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT DISTINCT map_id, key FROM {m}) k, range(60) x(r), range(60) y(c) WHERE NOT EXISTS (SELECT 1 FROM {m} m WHERE m.map_id = k.map_id AND m.key = k.key AND m.row = r AND m.col = c)),
outside AS (SELECT map_id, key, row, col FROM bg WHERE row = 0 AND col = 0 UNION SELECT b.map_id, b.key, b.row, b.col FROM outside o JOIN bg b ON b.map_id = o.map_id AND b.key = o.key AND abs(b.row - o.row) + abs(b.col - o.col) = 1),
filled AS (SELECT map_id, key, row, col FROM {m} UNION SELECT b.* FROM bg b WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.map_id = b.map_id AND o.key = b.key AND o.row = b.row AND o.col = b.col))"""


@query(
    """WITH r AS (SELECT c_custkey AS map_id, 10 + c_custkey % 9 AS h, 12 + c_custkey % 5 AS w FROM customer)
SELECT map_id, 'legend' AS key, CAST(h * w + 9 AS BIGINT) AS n FROM r"""
)
def refined_legends(spark, sf_dir):
    """RAS16, AGG16: a frame with a hole, a smaller square beside it, and another class's square."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k.alias("map_id"), (10 + k % 9).alias("h"), (12 + k % 5).alias("w"))
    grid = lambda r0, r1, c0, c1: r.withColumn("row", F.explode(F.sequence(r0, r1 - 1))).withColumn("col", F.explode(F.sequence(c0, c1 - 1)))
    at = lambda df: df.select("map_id", F.lit("legend").alias("key"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    n = lambda v: F.lit(v).cast("long")
    frame = grid(n(2), 2 + F.col("h"), n(2), 2 + F.col("w")).filter("NOT (row BETWEEN 4 AND 6 AND col BETWEEN 5 AND 8)")
    small, other = grid(n(25), n(28), n(25), n(28)), grid(n(30), n(33), n(2), n(5))
    sizes = r.select("map_id", F.lit(40).alias("height"), F.lit(40).alias("width"))
    return P.refined_legend_runs(at(frame).unionByName(at(small)), at(other), sizes).groupBy("map_id", "key").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))


@query(
    f"""WITH RECURSIVE {I.PARTS_SQL}, both_ways AS (SELECT map_id, u, v, CAST(1 + (u + v) % 3 AS DOUBLE) AS len FROM parts UNION ALL SELECT map_id, v, u, CAST(1 + (u + v) % 3 AS DOUBLE) FROM parts),
walk AS (SELECT DISTINCT map_id, u AS a, u AS b, CAST(0 AS DOUBLE) AS d FROM both_ways UNION SELECT w.map_id, a, v, d + len FROM walk w JOIN both_ways e ON e.map_id = w.map_id AND e.u = w.b WHERE d + len <= 3),
starts AS (SELECT DISTINCT map_id, a AS start, (a * 37 % 101) / 100.0 AS score FROM walk),
ranked AS (SELECT s.*, start // 10 AS part, row_number() OVER (PARTITION BY map_id, start // 10 ORDER BY score DESC, start DESC) AS k, (SELECT list(b) FROM walk WHERE walk.map_id = s.map_id AND walk.a = s.start AND b <> a) AS rivals FROM starts s),
pass AS (SELECT DISTINCT map_id, part, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM ranked
 UNION ALL SELECT p.map_id, p.part, r.k, CASE WHEN score >= 0.9 OR rivals IS NULL OR NOT list_has_any(rivals, kept) THEN list_append(kept, start) ELSE kept END FROM pass p JOIN ranked r ON r.map_id = p.map_id AND r.part = p.part AND r.k = p.k + 1)
SELECT map_id, unnest(kept) AS start FROM (SELECT map_id, part, arg_max(kept, k) AS kept FROM pass GROUP BY 1, 2)"""
)
def starts_without_rivals(spark, sf_dir):
    """EVL8: every node as a start with a score; those within a network distance of 3 of a better one go."""
    edges = I.part_rows(spark, sf_dir).withColumn("length", (1 + (F.col("u") + F.col("v")) % 3).cast("double"))
    return E.starts_apart(edges, lambda n: n * 37 % 101 / F.lit(100.0), 3.0)
