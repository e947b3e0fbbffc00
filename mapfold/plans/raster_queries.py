"""Queries of the pixel operators over sparse masks and pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.operators import evaluate as E
from mapfold.operators import pixels as P
from mapfold.plans import inputs as I
from mapfold.plans.registry import query


def _half(spark, sf_dir, k):
    return I.mask(spark, sf_dir).filter(f"(row + col * 7) % 3 <> {k}")


#: Components of a pixel table p by four neighbours: each pixel with the least pixel of its component.
_LABELS = """reach AS (SELECT map_id, key, row, col, row * 100 + col AS root FROM {p}
 UNION SELECT r.map_id, r.key, m.row, m.col, r.root FROM reach r JOIN {p} m ON m.map_id = r.map_id AND m.key = r.key AND abs(m.row - r.row) + abs(m.col - r.col) = 1 WHERE m.row * 100 + m.col > r.root),
label AS (SELECT map_id, key, row, col, min(root) AS label FROM reach GROUP BY ALL)"""
_A, _B = "a AS (SELECT * FROM mask WHERE (row + col * 7) % 3 <> 0)", "b AS (SELECT * FROM mask WHERE (row + col * 7) % 3 <> 1)"


@query(f"WITH {I.MASK_SQL}, {_A}, {_B} SELECT 'and' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'minus', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def mask_algebra(spark, sf_dir):
    """RAS7."""
    a, b = _half(spark, sf_dir, 0), _half(spark, sf_dir, 1)
    told = lambda df, op: df.select(F.lit(op).alias("op"), *P.AT)
    return told(P.mask_and(a, b), "and").unionByName(told(P.mask_or(a, b), "or")).unionByName(told(P.mask_minus(a, b), "minus"))


@query(f"WITH {I.MASK_SQL} SELECT DISTINCT map_id, key, CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col FROM mask, range(-1, 2) r(dr), range(-1, 2) c(dc)")
def dilated_mask(spark, sf_dir):
    """RAS9."""
    return P.dilated(I.mask(spark, sf_dir))


@query(f"WITH {I.MASK_SQL} SELECT map_id, key, CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col FROM mask, range(0, 2) r(dr), range(-1, 2) c(dc) WHERE dr < 1 GROUP BY ALL HAVING count(*) = 3")
def eroded_mask(spark, sf_dir):
    """RAS9 with a flat kernel."""
    return P.eroded(I.mask(spark, sf_dir), 1, 3)


@query(
    f"""WITH {I.MASK_SQL}, g AS (SELECT *, col - row_number() OVER (PARTITION BY map_id, key, row ORDER BY col) AS g FROM mask)
SELECT map_id, key, row, min(col) AS c0, max(col) AS c1 FROM g GROUP BY map_id, key, row, g"""
)
def mask_runs(spark, sf_dir):
    """Gaps and islands of RAS3."""
    return P.mask_runs(I.mask(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {I.MASK_SQL}, {_LABELS.format(p="mask")} SELECT map_id, key, CAST(label // 100 AS INTEGER) AS row, CAST(label % 100 AS INTEGER) AS col, count(*) AS area, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM (SELECT map_id, key, row, col, label FROM label) GROUP BY map_id, key, label""".replace("AS row, CAST(label % 100 AS INTEGER) AS col,", "AS lrow, CAST(label % 100 AS INTEGER) AS lcol,")
)
def mask_components(spark, sf_dir):
    """RAS3; held against a flood fill in the tests."""
    return P.component_summary(P.labelled_runs(I.mask(spark, sf_dir))).select("map_id", "key", F.col("label.row").alias("lrow"), F.col("label.col").alias("lcol"), "area", "row0", "row1", "col0", "col1")


@query(f"""WITH RECURSIVE {I.MASK_SQL}, {_LABELS.format(p="mask")}, a AS (SELECT map_id, key, label, count(*) AS n FROM label GROUP BY ALL) SELECT map_id, key, max(n) AS area FROM a GROUP BY 1, 2""")
def largest_components(spark, sf_dir):
    """AGG16."""
    return P.largest_component(I.mask(spark, sf_dir)).groupBy("map_id", "key").agg(F.count("*").alias("area"))


@query(
    f"""WITH {I.MASK_SQL}, n AS (SELECT map_id, key, count(*) AS n FROM mask GROUP BY 1, 2),
k AS (SELECT x.map_id, x.key AS a, y.key AS b, count(*) AS k FROM mask x JOIN mask y ON x.map_id = y.map_id AND x.row = y.row AND x.col = y.col AND x.key < y.key GROUP BY 1, 2, 3)
SELECT k.map_id, a, b, round(k / x.n, 6) AS of_a, round(k / y.n, 6) AS of_b FROM k JOIN n x ON x.map_id = k.map_id AND x.key = a JOIN n y ON y.map_id = k.map_id AND y.key = b"""
)
def mask_overlaps(spark, sf_dir):
    """RAS10."""
    return P.overlap_ratios(I.mask(spark, sf_dir)).select("map_id", "a", "b", F.round("of_a", 6).alias("of_a"), F.round("of_b", 6).alias("of_b"))


@query(
    f"""WITH {I.MASK_SQL}, {_A}, {_B}, m AS (SELECT coalesce(a.map_id, b.map_id) AS map_id, coalesce(a.key, b.key) AS key, (a.row IS NOT NULL)::INT AS x, (b.row IS NOT NULL)::INT AS y
  FROM a FULL JOIN b ON a.map_id = b.map_id AND a.key = b.key AND a.row = b.row AND a.col = b.col)
SELECT map_id, key, round((2 * sum(x * y) + 1e-6) / (sum(x) + sum(y) + 1e-6), 6) AS dice FROM m GROUP BY ROLLUP (map_id, key) HAVING map_id IS NOT NULL"""
)
def dice_scores(spark, sf_dir):
    """EVL12."""
    return E.dice(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1)).withColumn("dice", F.round("dice", 6))


@query()
def pixel_f_scores(spark, sf_dir):
    """EVL1, JN21; held against a sorted greedy pass in the tests."""
    true, pred = _half(spark, sf_dir, 0), _half(spark, sf_dir, 1)
    sizes = true.select("map_id").distinct().select("map_id", F.lit(60).alias("height"), F.lit(60).alias("width"))
    return E.pixel_f_score(true, pred, 3, sizes).select("map_id", "key", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {I.MASK_SQL}, {_A}, {_B}, m AS (SELECT coalesce(a.map_id, b.map_id) AS map_id, coalesce(a.key, b.key) AS key, (a.row IS NOT NULL)::INT AS t, (b.row IS NOT NULL)::INT AS p, CASE WHEN coalesce(a.col, b.col) % 2 = 0 THEN 0.3 ELSE 0.7 END AS w
  FROM a FULL JOIN b ON a.map_id = b.map_id AND a.key = b.key AND a.row = b.row AND a.col = b.col), s AS (SELECT map_id, key, sum(w * t * p) AS tp, sum(w * t) AS nt, sum(w * p) AS np FROM m GROUP BY 1, 2)
SELECT map_id, key, round(CAST(tp / np AS DOUBLE), 6) AS precision, round(CAST(tp / nt AS DOUBLE), 6) AS recall, round(CAST(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt) AS DOUBLE), 6) AS f1 FROM s"""
)
def polygon_f_scores(spark, sf_dir):
    """EVL2."""
    easy = I.mask(spark, sf_dir).filter("col % 2 = 0")
    return E.polygon_f_score(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1), easy).select("map_id", "key", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {I.COLORS_SQL}, m AS (SELECT map_id, key, CAST(quantile_cont(r, 0.5) FILTER (ok) AS DOUBLE) AS r, CAST(quantile_cont(g, 0.5) FILTER (ok) AS DOUBLE) AS g, CAST(quantile_cont(b, 0.5) FILTER (ok) AS DOUBLE) AS b
  FROM (SELECT *, NOT (greatest(r, g, b) <= 30 OR least(r, g, b) >= 250) AS ok FROM pixels) GROUP BY 1, 2)
SELECT map_id, key, CAST(floor(r) AS INTEGER) AS r, CAST(floor(g) AS INTEGER) AS g, CAST(floor(b) AS INTEGER) AS b, format('#{{:02x}}{{:02x}}{{:02x}}', CAST(floor(r) AS INTEGER), CAST(floor(g) AS INTEGER), CAST(floor(b) AS INTEGER)) AS color FROM m"""
)
def legend_colors(spark, sf_dir):
    """AGG6."""
    return P.legend_color(I.pixels(spark, sf_dir))


@query(
    f"""WITH {I.COLORS_SQL} SELECT map_id, key, round(var_pop(v), 4) AS variance FROM (SELECT map_id, key, unnest([r, g, b]) AS v FROM pixels) GROUP BY 1, 2"""
)
def legend_variance(spark, sf_dir):
    """AGG9."""
    return P.box_variance(I.pixels(spark, sf_dir)).withColumn("variance", F.round("variance", 4))


@query(
    f"""WITH {I.COLORS_SQL} SELECT map_id, key, quantile_cont(r, 0.2) AS r20, quantile_cont(g, 0.5) AS g50, quantile_cont(b, 0.8) AS b80 FROM pixels GROUP BY 1, 2"""
)
def legend_quantiles(spark, sf_dir):
    """AGG8, RAS12."""
    q = P.quantile_box(I.pixels(spark, sf_dir))
    return q.select("map_id", "key", F.col("r")[0].alias("r20"), F.col("g")[1].alias("g50"), F.col("b")[2].alias("b80"))


@query(
    f"""WITH {I.COLORS_SQL}, k AS (SELECT map_id, key, CAST(avg(r) AS INTEGER) AS r, CAST(avg(g) AS INTEGER) AS g, CAST(avg(b) AS INTEGER) AS b FROM pixels GROUP BY 1, 2)
SELECT p.map_id, k.key, p.row, p.col FROM pixels p JOIN k ON k.map_id = p.map_id WHERE p.r BETWEEN greatest(0, k.r - 60) AND least(255, k.r + 60) AND p.g BETWEEN greatest(0, k.g - 60) AND least(255, k.g + 60) AND p.b BETWEEN greatest(0, k.b - 60) AND least(255, k.b + 60)"""
)
def color_masks(spark, sf_dir):
    """RAS1."""
    px = I.pixels(spark, sf_dir)
    keys = px.groupBy("map_id", "key").agg(*[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    return P.color_mask(px.drop("key"), keys, 60)


@query(
    f"""WITH {I.COLORS_SQL} SELECT map_id, round(avg(CASE WHEN greatest(r, g, b) - least(r, g, b) <= 10 THEN 1.0 ELSE 0 END), 6) AS gray, round(avg(CASE WHEN greatest(r, g, b) <= 60 THEN 1.0 ELSE 0 END), 6) AS black, count(*) AS n FROM pixels GROUP BY 1"""
)
def map_area_ratios(spark, sf_dir):
    """AGG10."""
    return P.area_ratios(I.pixels(spark, sf_dir)).select("map_id", F.round("gray", 6).alias("gray"), F.round("black", 6).alias("black"), "n")


@query(
    f"""WITH {I.MASK_SQL} SELECT map_id, key, row // 16 AS patch_row, col // 16 AS patch_col, count(*) AS n, round(count(*) / 256, 6) AS coverage FROM mask GROUP BY ALL"""
)
def patch_coverage(spark, sf_dir):
    """AGG21, FLT13."""
    return P.patches_with_pixels(I.mask(spark, sf_dir), 16).withColumn("coverage", F.round("coverage", 6))


@query(
    f"""WITH {I.BOXES_SQL}, px AS (SELECT DISTINCT map_id, row, col FROM (SELECT map_id, xmin, xmax, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS row FROM boxes), LATERAL (SELECT unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS col))
SELECT map_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM px GROUP BY 1"""
)
def filled_text_rings(spark, sf_dir):
    """RAS5, SNK10: pixels inside the text rings."""
    rings = I.box_rings(spark, sf_dir).select("map_id", F.lit("text").alias("key"), "ring")
    return P.filled_rings(rings).groupBy("map_id").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))
