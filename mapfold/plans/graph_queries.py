"""Queries of the graph operators over the graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.operators import graphs as R
from mapfold.plans import inputs as I
from mapfold.plans.registry import query

_BOTH = "both_ways AS (SELECT map_id, u, v FROM edges UNION ALL SELECT map_id, v, u FROM edges)"
_DEGREE = "degree AS (SELECT map_id, u AS node, count(*) AS degree FROM both_ways GROUP BY 1, 2)"


@query(f"WITH {I.EDGES_SQL} SELECT * FROM edges")
def undirected_edges(spark, sf_dir):
    """SET4, GRF1."""
    return I.edges(spark, sf_dir)


@query(
    f"""WITH {I.EDGES_SQL}, {_BOTH}, {_DEGREE}
SELECT map_id, node, degree, CASE WHEN degree = 1 THEN 'end' WHEN degree = 2 THEN 'inner' WHEN degree <= 4 THEN 'junction' ELSE 'crowded' END AS kind FROM degree"""
)
def node_degrees(spark, sf_dir):
    """GRF4, GRF14."""
    return R.degrees(I.edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {I.PARTS_SQL}, both_ways AS (SELECT map_id, u, v FROM parts UNION ALL SELECT map_id, v, u FROM parts),
reach AS (SELECT map_id, u AS node, u AS other FROM both_ways UNION SELECT r.map_id, r.node, b.v FROM reach r JOIN both_ways b ON b.map_id = r.map_id AND b.u = r.other)
SELECT map_id, node, min(other) AS component FROM reach GROUP BY 1, 2"""
)
def graph_components(spark, sf_dir):
    """GRF8."""
    return R.components(I.part_rows(spark, sf_dir))


@query(
    f"""WITH {I.EDGES_SQL}, {_BOTH}, {_DEGREE}, ends AS (SELECT map_id, node FROM degree WHERE degree = 1)
SELECT map_id, u, v FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ends n WHERE n.map_id = e.map_id AND (n.node = e.u OR n.node = e.v))"""
)
def dead_ends_removed(spark, sf_dir):
    """GRF13."""
    return R.without_dead_ends(I.edges(spark, sf_dir)).select("map_id", "u", "v")


@query(
    f"""WITH {I.EDGES_SQL}, {_BOTH}, s AS (SELECT DISTINCT map_id, u AS start FROM both_ways WHERE u % 50 = 0),
h0 AS (SELECT map_id, start, start AS node, 0 AS hops FROM s),
h1 AS (SELECT DISTINCT h.map_id, start, v AS node FROM h0 h JOIN both_ways b ON b.map_id = h.map_id AND b.u = h.node),
h2 AS (SELECT DISTINCT h.map_id, start, v AS node FROM h1 h JOIN both_ways b ON b.map_id = h.map_id AND b.u = h.node),
every AS (SELECT * FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT map_id, start, node, CAST(min(hops) AS INTEGER) AS hops FROM every GROUP BY 1, 2, 3"""
)
def two_hop_neighbourhood(spark, sf_dir):
    """GRF17."""
    edges = I.edges(spark, sf_dir)
    starts = R.both_ways(edges).filter("u % 50 = 0").select("map_id", F.col("u").alias("start")).distinct()
    return R.hops(edges, starts, 2)


@query(
    f"""WITH RECURSIVE {I.PARTS_SQL}, both_ways AS (SELECT map_id, u, v, CAST(1 + (u + v) % 3 AS DOUBLE) AS len FROM parts UNION ALL SELECT map_id, v, u, CAST(1 + (u + v) % 3 AS DOUBLE) FROM parts),
walk AS (SELECT DISTINCT map_id, u AS start, u AS node, CAST(0 AS DOUBLE) AS distance FROM both_ways
 UNION SELECT w.map_id, start, v, distance + len FROM walk w JOIN both_ways b ON b.map_id = w.map_id AND b.u = w.node WHERE distance + len <= 5)
SELECT map_id, start, node, min(distance) AS distance FROM walk GROUP BY 1, 2, 3"""
)
def bounded_network_distance(spark, sf_dir):
    """GRF15, GRF16: from every node."""
    edges = I.part_rows(spark, sf_dir).withColumn("length", (1 + (F.col("u") + F.col("v")) % 3).cast("double"))
    return R.distances_from_nodes(edges, 5.0)


_CHAIN = """e AS (SELECT map_id, u, v, u * 1000000000000 + v AS id FROM parts), ends AS (SELECT map_id, u AS node, id FROM e UNION ALL SELECT map_id, v, id FROM e),
inner2 AS (SELECT map_id, node, min(id) AS x, max(id) AS y FROM ends GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT map_id, x AS a, y AS b FROM inner2 UNION ALL SELECT map_id, y, x FROM inner2)"""


@query(
    f"""WITH RECURSIVE {I.PARTS_SQL}, {_CHAIN}, reach AS (SELECT map_id, id, id AS other FROM e UNION SELECT r.map_id, r.id, l.b FROM reach r JOIN l ON l.map_id = r.map_id AND l.a = r.other),
c AS (SELECT map_id, id, min(other) AS chain FROM reach GROUP BY 1, 2)
SELECT map_id, chain // 1000000000000 AS u, chain % 1000000000000 AS v, count(*) AS edges FROM c GROUP BY 1, 2, 3"""
)
def graph_chains(spark, sf_dir):
    """GRF5, GRF19: chains with their number of edges."""
    chains = R.chains(I.parts(spark, sf_dir)).groupBy("map_id", "chain").agg(F.count("*").alias("edges"))
    return chains.select("map_id", F.col("chain.u").alias("u"), F.col("chain.v").alias("v"), "edges")


@query(
    f"""WITH {I.PARTS_SQL}, both_ways AS (SELECT map_id, u, v FROM parts UNION ALL SELECT map_id, v, u FROM parts), d AS (SELECT map_id, u AS node, min(v) AS a, max(v) AS b FROM both_ways GROUP BY 1, 2 HAVING count(*) = 2),
chosen AS (SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM both_ways l JOIN d y ON y.map_id = l.map_id AND y.node = l.v WHERE l.map_id = x.map_id AND l.u = x.node AND l.v < x.node))
SELECT map_id, u, v FROM parts p WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.map_id = p.map_id AND (c.node = p.u OR c.node = p.v)) UNION SELECT map_id, a, b FROM chosen WHERE a <> b"""
)
def bridged_graph(spark, sf_dir):
    """GRF10, GRF12: one round of bridging over nodes of degree two."""
    edges = I.parts(spark, sf_dir)
    return R.bridged(edges, R.degrees(edges).select("map_id", "node"))


@query(
    f"""WITH {I.EDGES_SQL}, nodes AS (SELECT DISTINCT map_id, node FROM (SELECT map_id, u AS node FROM edges UNION ALL SELECT map_id, v FROM edges)), ids AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY node) AS id FROM nodes)
SELECT e.map_id, CAST(a.id AS INTEGER) AS a, CAST(b.id AS INTEGER) AS b FROM edges e JOIN ids a ON a.map_id = e.map_id AND a.node = u JOIN ids b ON b.map_id = e.map_id AND b.node = v"""
)
def numbered_graph(spark, sf_dir):
    """GRF2, GRF3, GRF21."""
    return R.numbered_nodes(I.edges(spark, sf_dir))[1]
