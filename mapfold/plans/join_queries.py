"""Queries of joins by key, name, place and direction, of rasters, scores and tables of results, each with SQL where it can be told."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions import similarity as Y
from mapfold.operators import evaluate as E
from mapfold.operators import graphs as GR
from mapfold.operators import matching as M
from mapfold.operators import pixels as P
from mapfold.operators import spatial as S
from mapfold.plans import inputs as I
from mapfold.plans.registry import query
from mapfold.session import table

_SEGMENTS_SQL = """seg AS (SELECT o_orderkey % 20 AS map_id, o_orderkey AS seg_id, CAST(o_orderkey * 13 % 500 AS DOUBLE) AS ax, CAST(o_custkey * 7 % 500 AS DOUBLE) AS ay,
 CAST(o_orderkey * 13 % 500 + o_custkey % 41 - 20 AS DOUBLE) AS bx, CAST(o_custkey * 7 % 500 + o_orderkey % 37 - 18 AS DOUBLE) AS bz FROM orders WHERE o_custkey % 41 <> 20 OR o_orderkey % 37 <> 18)"""


def segments(spark, sf_dir):
    """A short segment for each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ax, ay = (k * 13) % 500, (c * 7) % 500
    ends = (("ax", ax), ("ay", ay), ("bx", ax + c % 41 - 20), ("by", ay + k % 37 - 18))
    return table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), k.alias("seg_id"), *[e.cast("double").alias(n) for n, e in ends]).filter("ax != bx OR ay != by")


@query(
    """WITH hit AS (SELECT DISTINCT o_custkey AS map_id FROM orders WHERE list_contains(string_split(upper(o_orderpriority || ' sheet'), ' '), 'SHEET') AND o_orderkey % 50 = 0)
SELECT c_custkey AS map_id, c_name AS title FROM customer WHERE c_custkey IN (SELECT map_id FROM hit)"""
)
def maps_with_a_word(spark, sf_dir):
    """JN3: every 50th label holds the word."""
    k = F.col("o_orderkey")
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("map_id"), F.concat("o_orderpriority", F.when(k % 50 == 0, " sheet").otherwise(" sheets")).alias("text"))
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("map_id"), F.col("c_name").alias("title"))
    return S.maps_with_keyword(labels, catalog, "Sheet")


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_custkey % 40 AS legend_id, o_custkey % 30 AS county_id, o_custkey % 20 AS map_id FROM orders)
SELECT id, n.n_name AS legend, coalesce(m.n_name, '-1') AS county, map_id IN (SELECT n_regionkey FROM nation) AS has_points FROM p LEFT JOIN nation n ON n.n_nationkey = legend_id LEFT JOIN nation m ON m.n_nationkey = county_id"""
)
def joins_by_key(spark, sf_dir):
    """JN9, JN22, JN23, JN24, JN25: legend rows and counties of predictions, and which have a partner."""
    c = F.col("o_custkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (c % 40).alias("legend_id"), (c % 30).alias("county_id"), (c % 20).alias("map_id"))
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    rows = S.with_county(S.with_legend(p, n.select(key.alias("legend_id"), F.col("n_name").alias("legend"))), n.select(key.alias("county_id"), F.col("n_name").alias("county")))
    good, bad = S.present_and_absent(rows, I.gcps(spark, sf_dir), ["map_id"])
    told = lambda df, ok: df.select("id", "legend", "county", F.lit(ok).alias("has_points"))
    return told(good, True).unionByName(told(bad, False))


@query(
    f"""WITH {I.BOXES_SQL}, l AS (SELECT map_id, box_id AS left_id, CASE WHEN box_id % 4 = 1 THEN name || 'x' ELSE 'zq ' || box_id END AS text FROM boxes WHERE box_id % 2 = 1), r AS (SELECT map_id, box_id AS right_id, name FROM boxes WHERE box_id % 2 = 0),
p AS (SELECT left_id, name, right_id, 1 - levenshtein(lower(text), lower(name)) / greatest(length(text), length(name)) AS ratio FROM l JOIN r USING (map_id)),
b AS (SELECT left_id, arg_max(name, (ratio, -right_id)) AS name, max(ratio) AS ratio FROM p WHERE ratio >= 0.5 GROUP BY 1)
SELECT left_id, coalesce(name, text) AS match, round(ratio, 6) AS ratio FROM l LEFT JOIN b USING (left_id)"""
)
def best_descriptions(spark, sf_dir):
    """JN10: the best name of the same map, else the text itself."""
    b = I.boxes(spark, sf_dir)
    left = b.filter("box_id % 2 = 1").select("map_id", F.col("box_id").alias("left_id"), F.when(F.col("box_id") % 4 == 1, F.concat("name", F.lit("x"))).otherwise(F.concat(F.lit("zq "), "box_id")).alias("text"))
    right = b.filter("box_id % 2 = 0").select("map_id", F.col("box_id").alias("right_id"), "name")
    return S.fuzzy_best(left, right, ["map_id"]).select("left_id", "match", F.round("ratio", 6).alias("ratio"))


@query(
    """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS q, list_distinct(string_split(lower(p_name || ' of ' || p_brand), ' ')) AS s FROM part)
SELECT p_partkey, round(len(list_intersect(q, s)) / len(q) + len(list_intersect(q, s)) / len(s), 6) AS score FROM t"""
)
def containment_scores(spark, sf_dir):
    """JN11."""
    score = S.containment_score(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_name", F.lit("of"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query(
    f"""WITH {I.BOXES_SQL}, l AS (SELECT box_id AS label_id, string_split(lower(name), ' ')[1] AS text, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1 FROM boxes WHERE box_id % 2 = 1 AND xmax > xmin),
p AS (SELECT * FROM boxes WHERE box_id % 2 = 0 AND xmax > xmin), k AS (SELECT label_id, list_sort(list(box_id)) AS ids FROM l JOIN p ON x0 <= xmax AND xmin <= x1 AND y0 <= ymax AND ymin <= y1 AND contains(lower(name), text) GROUP BY 1)
SELECT label_id, array_to_string(ids, ',') AS polygons FROM l LEFT JOIN k USING (label_id)"""
)
def linked_labels(spark, sf_dir):
    """JN12: labels with the polygons that hold their word in the name and touch their ring."""
    r = I.box_rings(spark, sf_dir).filter(G.ring_area(F.col("ring")) > 0)
    labels = r.filter("box_id % 2 = 1").select(F.col("box_id").alias("label_id"), F.split("name", " ")[0].alias("text"), "ring")
    polygons = r.filter("box_id % 2 = 0").select(F.col("box_id").alias("polygon_id"), "name", F.col("ring").alias("geom"))
    return S.link_labels(labels, polygons, 64.0).select("label_id", F.array_join("polygon_ids", ",").alias("polygons"))


@query(
    """WITH g AS (SELECT c_custkey AS map_id, c_custkey * 37 % 600 / 10.0 - 120 + 0.05 AS lon, c_custkey * 91 % 250 / 10.0 + 25 + 0.05 AS lat FROM customer), s AS (SELECT n_nationkey * 2 - 118 AS w, n_nationkey % 5 * 5 + 25 AS s FROM nation WHERE n_nationkey % 2 = 0)
SELECT DISTINCT map_id FROM g JOIN s ON lon > w AND lon < w + 3 AND lat > s AND lat < s + 4"""
)
def maps_in_states(spark, sf_dir):
    """JN13: maps by the state of their first control point."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    g = table(spark, sf_dir, "customer").select(k.alias("map_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("gcp_id"))
    k = F.col("map_id")
    g = g.select("map_id", "gcp_id", (k * 37 % 600 / 10.0 - 120 + 0.05 + (F.col("gcp_id") - 1) * 50).alias("mx"), (k * 91 % 250 / 10.0 + 25 + 0.05).alias("my"))
    box = F.struct((n * 2 - 118).cast("double").alias("xmin"), (n % 5 * 5 + 25).cast("double").alias("ymin"), (n * 2 - 115).cast("double").alias("xmax"), (n % 5 * 5 + 29).cast("double").alias("ymax"))
    return S.maps_in_areas(g, table(spark, sf_dir, "nation").filter(n % 2 == 0).select(G.box_ring(box).alias("ring")), 4.0)


@query(f"WITH {I.POINTS_SQL}, {I.BOXES_SQL} SELECT map_id, point_id FROM points p WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.map_id = p.map_id AND x >= xmin AND x < xmax AND y >= ymin AND y < ymax)")
def points_in_counties(spark, sf_dir):
    """JN14."""
    return S.points_in_rings(I.points(spark, sf_dir), I.box_rings(spark, sf_dir), 64.0).select("map_id", "point_id")


@query(
    """WITH p AS (SELECT c_custkey AS place_id, [ 'nation', 'part' || c_custkey % 9 ] AS own, [ 'nation', 'part' || c_custkey % 9, 'small' ] AS p FROM customer), g AS (SELECT p_partkey AS row_id, list_distinct(string_split(lower(p_name || ' part' || p_partkey % 9), ' ')) AS g FROM part WHERE TRUE),
s AS (SELECT place_id, row_id, len(list_intersect(p, g)) / len(p) + len(list_intersect(p, g)) / len(g) AS score FROM p JOIN g ON list_has_any(own, g)),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, row_id) AS rank FROM s) SELECT place_id, row_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def place_lookups(spark, sf_dir):
    """JN15: five candidates for each place name with a suffix."""
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), F.concat(F.lit("Nation part"), F.col("c_custkey") % 9).alias("text"))
    gazetteer = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat("p_name", F.lit(" part"), F.col("p_partkey") % 9).alias("name"))
    return S.place_candidates(places, gazetteer, "Small").select("place_id", "row_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH r AS (SELECT s_suppkey AS map_id, -120 + s_suppkey % 97 / 7.0::DOUBLE AS w, 30 + s_suppkey % 89 / 11.0::DOUBLE AS s FROM supplier),
t AS (SELECT map_id, CAST(floor((w + 180) / 360 * 1024) AS BIGINT) AS c0, CAST(floor((w + 1.3 + 180) / 360 * 1024) AS BIGINT) AS c1, CAST(floor((1 - asinh(tan(radians(s + 0.9))) / pi()) / 2 * 1024) AS BIGINT) AS r0, CAST(floor((1 - asinh(tan(radians(s))) / pi()) / 2 * 1024) AS BIGINT) AS r1 FROM r)
SELECT map_id, col, row FROM (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM t), LATERAL (SELECT unnest(range(r0, r1 + 1)) AS row)"""
)
def covering_tiles(spark, sf_dir):
    """JN16."""
    k = F.col("s_suppkey")
    w, s = -120 + k % 97 / 7.0, 30 + k % 89 / 11.0
    box = F.struct(w.alias("xmin"), s.alias("ymin"), (w + 1.3).alias("xmax"), (s + 0.9).alias("ymax"))
    return S.tiles_of_region(table(spark, sf_dir, "supplier").select(k.alias("map_id"), G.box_ring(box).alias("ring")), 10).select("map_id", "col", "row")


@query(
    """WITH l AS (SELECT o_orderkey % 20 AS map_id, o_orderkey AS line_id, o_orderkey * 7 % 900 + 0.5 AS x0, o_orderkey * 7 % 900 + 0.5 + o_custkey % 300 AS x1, o_custkey * 3 % 900 + 0.5 AS y FROM orders),
p AS (SELECT p_partkey % 20 AS map_id, p_partkey AS seq, p_partkey * 11 % 900 AS x0, p_partkey * 11 % 900 + 60 AS x1, p_partkey * 17 % 900 AS y0, p_partkey * 17 % 900 + 60 AS y1 FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 20 < 3)
SELECT l.map_id, line_id, min(seq) AS patch_seq FROM l LEFT JOIN p ON p.map_id = l.map_id AND l.x0 <= p.x1 AND p.x0 <= l.x1 AND l.y BETWEEN p.y0 AND p.y1 GROUP BY 1, 2""".replace(" WHERE p_partkey % 50 = 0 OR p_partkey % 20 < 3", "")
)
def lines_first_patch(spark, sf_dir):
    """JN17: the first patch that each level line touches."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("p_partkey")
    x, y = k * 7 % 900 + 0.5, (c * 3 % 900 + 0.5).cast("double")
    lines = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), k.alias("line_id"), F.array(G.point(x, y), G.point(x + c % 300, y)).alias("line"))
    px, py = p * 11 % 900, p * 17 % 900
    patches = table(spark, sf_dir, "part").select((p % 20).alias("map_id"), p.alias("patch_seq"), F.struct(*[e.cast("double").alias(n) for n, e in (("xmin", px), ("ymin", py), ("xmax", px + 60), ("ymax", py + 60))]).alias("box"))
    return S.first_patch_of_line(lines, patches, 128.0).select("map_id", "line_id", "patch_seq")


_STARTS_SQL = """st AS (SELECT o_orderkey % 20 AS map_id, o_orderkey AS start_id, (o_orderkey * 11 % 500 + 0.25)::DOUBLE AS x, (o_custkey * 3 % 500 + 0.25)::DOUBLE AS y, (o_orderkey % 5 - 2)::DOUBLE AS dx, (o_custkey % 3 + 1)::DOUBLE AS dy FROM orders)"""


def _starts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ends = (("x", k * 11 % 500 + 0.25), ("y", c * 3 % 500 + 0.25), ("dx", k % 5 - 2), ("dy", c % 3 + 1))
    return table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), k.alias("start_id"), *[e.cast("double").alias(n) for n, e in ends])


@query(
    f"""WITH {_SEGMENTS_SQL}, {_STARTS_SQL}, near AS (SELECT st.map_id, start_id, seg_id, x, y, ax, ay, bx, bz, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / ((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) AS t
 FROM st JOIN seg ON st.map_id = seg.map_id AND least(ax, bx) - 6 <= x AND x <= greatest(ax, bx) + 6 AND least(ay, bz) - 6 <= y AND y <= greatest(ay, bz) + 6
 WHERE 1 - abs((dx * (bx - ax) + dy * (bz - ay)) / (sqrt(dx * dx + dy * dy) * sqrt((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay)))) < 0.04),
d AS (SELECT map_id, start_id, seg_id, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (bz - ay), 2)) AS d FROM near)
SELECT map_id, start_id, arg_min(seg_id, (d, seg_id)) AS seg_id, round(min(d), 6) AS distance FROM d WHERE d < 6 GROUP BY 1, 2"""
)
def nearest_edges(spark, sf_dir):
    """JN19: starts with the nearest segment of their direction."""
    found = S.nearest_edge(_starts(spark, sf_dir), segments(spark, sf_dir), 6.0)
    return found.filter("seg_id IS NOT NULL").select("map_id", "start_id", "seg_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_SEGMENTS_SQL}, {_STARTS_SQL}, n AS (SELECT map_id, seg_id, ax AS nx, ay AS ny, bx - ax AS ex, bz - ay AS ey FROM seg),
d AS (SELECT st.map_id, start_id, seg_id, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS d FROM st JOIN n ON st.map_id = n.map_id AND abs(x - nx) < 12 AND abs(y - ny) < 12 WHERE 1 - abs((dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey))) < 0.1)
SELECT map_id, start_id, arg_min(seg_id, (d, seg_id)) AS seg_id, round(min(d), 6) AS distance FROM d WHERE d < 12 GROUP BY 1, 2"""
)
def nearest_directed_nodes(spark, sf_dir):
    """JN20: starts with the nearest node of a compatible direction."""
    nodes = segments(spark, sf_dir).select("map_id", "seg_id", F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    found = S.nearest_directed(_starts(spark, sf_dir), nodes, "start_id", "seg_id", 12.0, 0.1)
    return found.filter("seg_id IS NOT NULL").select("map_id", "start_id", "seg_id", F.round("distance", 6).alias("distance"))


_TOPO_SQL = "topo AS (SELECT n_nationkey AS row_id, lower(n_name) AS map_name, 'county ' || n_nationkey % 4 AS county, 'state ' || n_regionkey AS state FROM nation)"


def _topo(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("row_id"), F.lower("n_name").alias("map_name"), F.concat(F.lit("county "), n % 4).alias("county"), F.concat(F.lit("state "), "n_regionkey").alias("state"))


@query(
    f"""WITH {_TOPO_SQL}, t AS (SELECT c_custkey AS text_id, n_name, 'state ' || CASE WHEN c_custkey % 7 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS state, CASE WHEN c_custkey % 3 > 0 THEN 'county ' || (n_nationkey + (c_custkey % 3 - 1)) % 4 END AS county FROM customer JOIN nation ON n_nationkey = c_custkey % 25),
two AS (SELECT text_id, row_id, t.county FROM t JOIN topo ON topo.state = t.state AND map_name = lower(n_name)),
known AS (SELECT DISTINCT county FROM topo WHERE row_id IN (SELECT row_id FROM two)),
named AS (SELECT DISTINCT text_id FROM t WHERE county IN (SELECT county FROM known))
SELECT text_id, two.row_id FROM two JOIN topo USING (row_id) WHERE two.county = topo.county OR text_id NOT IN (SELECT text_id FROM named)"""
)
def filtered_places(spark, sf_dir):
    """TXT14: sheets for each title by state, then quadrangle, then county."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(n, "n_name", "n_regionkey"), c % 25 == n)
    state = F.when(c % 7 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    county = F.when(c % 3 > 0, F.concat(F.lit(", County "), (n + (c % 3 - 1)) % 4)).otherwise("")
    texts = rows.select(c.alias("text_id"), F.concat(F.lit("Geologic map of the "), "n_name", F.lit(" quadrangle"), county, F.lit(", State "), state).alias("text"))
    return M.place_filter(texts, _topo(spark, sf_dir))


@query(
    """WITH c AS (SELECT n_regionkey AS category, string_agg('word' || n_nationkey, ' ' ORDER BY n_nationkey) AS words FROM nation GROUP BY 1)
SELECT p_partkey AS item_id, CASE WHEN p_partkey % 30 < 25 THEN CAST(p_partkey % 30 % 5 AS VARCHAR) END AS category, CASE WHEN p_partkey % 30 < 25 THEN 'symbol' || p_partkey % 30 END AS symbol FROM part"""
)
def chosen_symbols(spark, sf_dir):
    """TXT12: the category that knows a description's word, then its symbol; none for words that no category has."""
    n, k = F.col("n_nationkey"), F.col("p_partkey")
    word = F.concat(F.lit("word"), n)
    nation = table(spark, sf_dir, "nation")
    categories = nation.groupBy(F.col("n_regionkey").cast("string").alias("category")).agg(F.array_join(F.array_sort(F.collect_list(word)), " ").alias("words"))
    symbols = nation.select(F.col("n_regionkey").cast("string").alias("category"), F.concat(F.lit("symbol"), n).alias("symbol"), word.alias("keywords"), F.concat(word, F.lit(" drawn")).alias("text"))
    items = table(spark, sf_dir, "part").select(k.alias("item_id"), F.concat(F.lit("a place of word"), k % 30).alias("description"))
    return M.choose_symbol(items, categories, symbols).select("item_id", "category", "symbol")


@query(
    """WITH n AS (SELECT c_custkey AS text_id, c_custkey % 6 AS p, CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 7 % 25 END AS e FROM customer)
SELECT text_id, CASE WHEN p < 5 THEN CASE WHEN e IS NULL THEN p * 5 + 5 WHEN e // 5 = p THEN e + 1 ELSE greatest(p * 5 + 5, e + 1) END WHEN e IS NOT NULL THEN e + 1 END::DOUBLE AS b_age,
 CASE WHEN p < 5 THEN CASE WHEN e IS NULL THEN p * 5 WHEN e // 5 = p THEN e ELSE least(p * 5, e) END WHEN e IS NOT NULL THEN e END::DOUBLE AS t_age FROM n"""
)
def age_intervals(spark, sf_dir):
    """TXT23: periods of five epochs each; an epoch inside its period narrows the interval, one outside widens it."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    letter = lambda e: F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (e + 1).cast("int"))
    scale = table(spark, sf_dir, "nation").select(n.alias("idx"), F.lit(None).cast("string").alias("age"), F.concat(F.lit("Epoch"), n, F.lit(".")).alias("epoch"), F.concat(F.lit("Period"), letter(F.floor(n / 5))).alias("period"), (n + 1).cast("double").alias("b_age"), n.cast("double").alias("t_age"))
    period = F.when(c % 6 < 5, F.concat(F.lit(" Period"), letter(c % 6))).otherwise("")
    epoch = F.when(c % 4 == 1, F.concat(F.lit(" Epoch"), c * 7 % 25, F.lit("."))).otherwise("")
    return M.age_interval(table(spark, sf_dir, "customer").select(c.alias("text_id"), F.concat(F.lit("of the"), period, epoch).alias("text")), scale)


@query()
def sequence_similarities(spark, sf_dir):
    """TXT9: ratios of matching blocks of each name and its type."""
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", F.round(Y.sequence_ratio("a", "b"), 6).alias("ratio"))


@query(f'WITH {I.MASK_SQL}, {I.BOXES_SQL} SELECT map_id, key, row, col FROM mask m WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.map_id = m.map_id AND col BETWEEN xmin / 10 AND xmax / 10 AND row BETWEEN ymin / 10 AND ymax / 10)')
def masks_without_boxes(spark, sf_dir):
    """RAS6: legend boxes taken out of the masks."""
    b = I.boxes(spark, sf_dir).select("map_id", F.struct(*[(F.col(c) / 10).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("box"))
    return P.without_boxes(I.mask(spark, sf_dir), b)


@query(
    """WITH l AS (SELECT DISTINCT o_orderkey % 20 AS map_id, o_orderpriority AS key, o_custkey % 300 AS row, o_orderkey * 7 % 500 AS c0, o_orderkey * 7 % 500 + o_custkey % 30 + 1 AS c1 FROM orders),
p AS (SELECT map_id, key, row, unnest(range(c0, c1 + 1)) AS col FROM l)
SELECT map_id, key, CAST(count(DISTINCT row * 100000 + col) AS BIGINT) AS n FROM (SELECT map_id, key, row + dr AS row, col + dc AS col FROM p, (VALUES (-1), (0)) a(dr), (VALUES (-1), (0)) b(dc)) GROUP BY 1, 2"""
)
def drawn_line_pixels(spark, sf_dir):
    """RAS14: level lines two pixels wide."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = k * 7 % 500, (c % 300).cast("double")
    lines = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), F.col("o_orderpriority").alias("key"), F.array(G.point(x, y), G.point(x + c % 30 + 1, y)).alias("line"))
    return P.drawn_lines(lines).groupBy("map_id", "key").agg(F.count("*").alias("n"))


@query(
    f"""WITH {I.BOXES_SQL}, px AS (SELECT DISTINCT map_id, row, col + d AS col FROM (SELECT map_id, xmin, xmax, unnest(range(CAST(ymin AS BIGINT), CAST(ymax AS BIGINT))) AS row FROM boxes), LATERAL (SELECT unnest(range(CAST(xmin AS BIGINT), CAST(xmax AS BIGINT))) AS col), range(31) t(d))
SELECT map_id, count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM px GROUP BY 1"""
)
def grown_text_masks(spark, sf_dir):
    """RAS17: text rings as pixels, drawn out to the right."""
    rings = I.box_rings(spark, sf_dir).select("map_id", F.lit("text").alias("key"), "ring")
    return P.text_mask(rings).groupBy("map_id").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))


@query(
    """WITH p AS (SELECT o_orderkey % 20 AS map_id, o_orderkey AS label, o_orderpriority AS own, substr(o_orderpriority, 1, 1) || '-R' AS rival, o_orderkey * 7 % 900 AS r, o_custkey * 3 % 900 AS c FROM orders),
s AS (SELECT c_custkey % 20 AS map_id, c_custkey * 31 % 900 AS r, c_custkey * 17 % 900 AS c, c_custkey FROM customer),
a AS (SELECT map_id, label, min(sqrt(pow(p.r - s.r, 2) + pow(p.c - s.c, 2))) AS d FROM p JOIN s USING (map_id) WHERE s.c_custkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT map_id, label, min(sqrt(pow(p.r - s.r, 2) + pow(p.c - s.c, 2))) AS d FROM p JOIN s USING (map_id) WHERE s.c_custkey % 2 = 1 GROUP BY 1, 2)
SELECT map_id, label, CASE WHEN coalesce(a.d < 30 OR a.d < 2.5 * coalesce(b.d, 'infinity'::DOUBLE), false) THEN 'own' ELSE 'rival' END AS winner FROM p LEFT JOIN a USING (map_id, label) LEFT JOIN b USING (map_id, label)"""
)
def settled_conflicts(spark, sf_dir):
    """RAS11: disputed components by the distance of either key's seeds."""
    k, c, q = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    parts = table(spark, sf_dir, "orders").select((k % 20).alias("map_id"), k.alias("label"), F.lit("own").alias("own"), F.lit("rival").alias("rival"), (k * 7 % 900).alias("center_row"), (c * 3 % 900).alias("center_col"))
    seeds = table(spark, sf_dir, "customer").select((q % 20).alias("map_id"), F.when(q % 2 == 0, "own").otherwise("rival").alias("key"), (q * 31 % 900).alias("row"), (q * 17 % 900).alias("col"))
    return P.settled_by_seeds(parts, seeds, near=30.0).select("map_id", "label", "winner")


@query(
    f"""WITH {_SEGMENTS_SQL}, s AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(bz - ay, 2)) AS len, sum(sqrt(pow(bx - ax, 2) + pow(bz - ay, 2))) OVER (PARTITION BY map_id ORDER BY seg_id ROWS UNBOUNDED PRECEDING) AS e, sum(sqrt(pow(bx - ax, 2) + pow(bz - ay, 2))) OVER (PARTITION BY map_id) / 37 AS step FROM seg),
k AS (SELECT *, unnest(range(CAST(ceil(round((e - len) / step, 9)) AS BIGINT), CAST(ceil(round(e / step, 9)) AS BIGINT))) AS k FROM s)
SELECT map_id, CAST(k AS INTEGER) AS k, round(ax + (k * step - e + len) / len * (bx - ax), 3) AS x, round(ay + (k * step - e + len) / len * (bz - ay), 3) AS y FROM k"""
)
def even_samples(spark, sf_dir):
    """EVL10, GRF20: 37 points at even distances along all segments of a map."""
    return GR.sampled(segments(spark, sf_dir), 37, ["seg_id"]).select("map_id", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    """WITH r AS (SELECT o_custkey % 3 AS fold, o_custkey % 20 * 3 + o_custkey % 3 AS map_id, o_orderpriority AS key, avg(o_orderkey % 100) / 100 AS precision, avg(o_orderkey % 50) / 100 AS recall, avg(o_orderkey % 30) / 100 AS f1 FROM orders GROUP BY ALL),
m AS (SELECT fold, NULL::BIGINT AS map_id, NULL::VARCHAR AS key, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM r GROUP BY ROLLUP (fold))
SELECT fold, map_id, key, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT * FROM r UNION ALL SELECT * FROM m)"""
)
def fold_results(spark, sf_dir):
    """EVL14."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select((c % 20 * 3 + c % 3).alias("map_id"), F.col("o_orderpriority").alias("key"), k)
    scores = rows.groupBy("map_id", "key").agg(*[(F.avg(F.col("o_orderkey") % n) / 100).alias(m) for m, n in (("precision", 100), ("recall", 50), ("f1", 30))])
    folds = rows.select("map_id", (F.col("map_id") % 3).alias("fold")).distinct()
    return E.results_table(scores, folds).select("fold", "map_id", "key", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query("SELECT event_type AS stage, count(*) AS runs, round(sum(value), 3) AS seconds, round(max(value), 6) AS longest FROM events GROUP BY 1")
def stage_time_table(spark, sf_dir):
    """EVL15: events stand for the runs of stages."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return E.stage_times(runs).select("stage", "runs", F.round("seconds", 3).alias("seconds"), F.round("longest", 6).alias("longest"))


@query(
    f"""WITH {I.MASK_SQL}, r AS (SELECT map_id, row, min(col) AS c0, max(col) AS c1 FROM mask GROUP BY 1, 2) SELECT map_id, min(c0) AS xmin, -max(row) AS ymin, max(c1) AS xmax, -min(row) AS ymax FROM r GROUP BY 1"""
)
def map_areas(spark, sf_dir):
    """SNK15: the bounds of each map's first region, which is made whole by filling every row."""
    from mapfold.sources import writers as W

    m = I.mask(spark, sf_dir)
    rows = m.groupBy("map_id").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    whole = rows.select("map_id", F.lit("area").alias("key"), F.explode(F.sequence("row0", "row1")).alias("row"), "c0", "c1")
    whole = whole.select("map_id", "key", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return W.map_area_record(P.component_summary(P.labelled_runs(whole)))
