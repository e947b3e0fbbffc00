"""Queries of k-means by group, the elbow, spread matches and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.operators import kmeans as K
from mapfold.operators import vectors as V
from mapfold.plans import inputs as I
from mapfold.plans.registry import query

_GAP = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_GRID = """list_transform({v}, lambda x: CAST(floor(x / sqrt(list_sum(list_transform({v}, lambda y: y * y))) * 16384 + 0.5) AS BIGINT))"""


def _seeds(k: int) -> str:
    """Seeds s1 to s{k} of v (block, key, f)."""
    ctes = [
        f"smp AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(key || '/1')) AS rk FROM v) WHERE rk <= {64 * k})",
        "s1 AS MATERIALIZED (SELECT block, 0 AS c, f FROM smp WHERE rk = 1)",
    ]
    for j in range(1, k):
        gap = _GAP.format(a="p.f", b="s.f")
        far = f"SELECT p.block, p.rk, p.f, min({gap}) AS d FROM smp p JOIN s{j} s ON s.block = p.block GROUP BY ALL"
        ctes.append(f"s{j + 1} AS MATERIALIZED (SELECT * FROM s{j} UNION ALL SELECT block, {j}, arg_max(f, (d, -rk)) FROM ({far}) GROUP BY block HAVING max(d) > 0)")
    return ",\n".join(ctes)


def _rounds(start: str, name: str, rounds: int) -> str:
    """{name}_c: centres after the rounds; {name}_a: the cluster and cost of each row of v."""
    ctes, at = [], start
    for r in range(rounds + 1):
        gaps = f"SELECT v.block, v.key, s.c, {_GAP.format(a='v.f', b='s.f')} AS d FROM v JOIN {at} s ON s.block = v.block"
        a = f"{name}_a" if r == rounds else f"{name}_a{r}"
        ctes.append(f"{a} AS MATERIALIZED (SELECT block, key, arg_min(c, (d, c)) AS cluster, min(d) AS cost FROM ({gaps}) GROUP BY ALL)")
        if r < rounds:
            parts = f"SELECT v.block, cluster, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM v JOIN {a} a ON a.block = v.block AND a.key = v.key"
            means = f"SELECT block, cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT block, cluster, i, sum(x) AS s, count(*) AS n FROM ({parts}) GROUP BY ALL)"
            to = f"SELECT block, cluster, list(m ORDER BY i) AS f FROM ({means}) GROUP BY ALL"
            ctes.append(f"{name}_c{r + 1} AS MATERIALIZED (SELECT s.block, s.c, coalesce(t.f, s.f) AS f FROM {at} s LEFT JOIN ({to}) t ON t.block = s.block AND t.cluster = s.c)")
            at = f"{name}_c{r + 1}"
    return ",\n".join(ctes)


def _v(block: str) -> str:
    return f"v AS MATERIALIZED (SELECT {block} AS block, CAST(vec_id AS VARCHAR) AS key, {_GRID.format(v='e')} AS f FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings))"


@query(
    f"""WITH {_v('0')},\n{_seeds(4)},\n{_rounds('s4', 'k', 6)}
SELECT CAST(cluster AS INTEGER) AS cluster, vec_id AS id, round(saliency, 6) AS saliency FROM
(SELECT cluster, vec_id, abs(embedding[1]::DOUBLE) AS saliency, row_number() OVER (PARTITION BY cluster ORDER BY abs(embedding[1]) DESC, vec_id) AS n FROM embeddings JOIN k_a ON key = CAST(vec_id AS VARCHAR)) WHERE n = 1"""
)
def vector_clusters(spark, sf_dir):
    """VEC6, WIN10: the most salient vector of each of four clusters of all vectors."""
    e = I.embeddings(spark, sf_dir).withColumn("saliency", F.abs(F.col("vec")[0]).cast("double"))
    found = K.clusters(e, 4, ["id"], rounds=6)
    return V.best_per_cluster(found, "saliency", "id").select("cluster", "id", F.round("saliency", 6).alias("saliency"))


@query(f"WITH {_v('label')},\n{_seeds(3)},\n{_rounds('s3', 'k', 4)}\nSELECT block AS label, CAST(key AS BIGINT) AS id, CAST(cluster AS INTEGER) AS cluster, cost FROM k_a")
def vector_clusters_by_label(spark, sf_dir):
    """VEC6: the vectors of each label clustered by themselves."""
    return K.clusters(I.embeddings(spark, sf_dir), 3, ["id"], ["label"], rounds=4).select("label", "id", "cluster", "cost")


_MOST = 5
_COSTS = " UNION ALL ".join(f"SELECT block, {k} AS k, CAST(sum(cost) AS BIGINT) AS cost FROM e{k}_a GROUP BY block" for k in range(1, _MOST + 1))


@query(
    f"""WITH {_v('label')},\n{_seeds(_MOST)},\n{','.join(_rounds(f's{k}', f'e{k}', 3) for k in range(1, _MOST + 1))},
costs AS ({_COSTS}), steps AS (SELECT *, lag(cost) OVER (PARTITION BY block ORDER BY k) AS before FROM costs)
SELECT block AS label, CAST(min(k) AS INTEGER) AS k, arg_min(cost, k) AS cost FROM steps WHERE coalesce(cost > 0.975::DOUBLE * before, false) OR k = {_MOST} GROUP BY block"""
)
def elbow_by_label(spark, sf_dir):
    """VEC6: the number of clusters of each label where one more saves little."""
    return K.elbow(I.embeddings(spark, sf_dir), ["id"], ["label"], most=_MOST, rounds=3).select("label", "k", "cost")


@query(
    f"""WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, vec_id % 16 // 2 AS block, abs(embedding[1])::DOUBLE AS s FROM embeddings),
p AS (SELECT a.block, a.i AS a, b.i AS b, a.s AS sa, b.s AS sb, a.v AS va, b.v AS vb, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim
 FROM e a JOIN e b ON a.block = b.block WHERE a.i % 2 = 0 AND b.i % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY block, a ORDER BY sim DESC, b) AS m, row_number() OVER (PARTITION BY block, b ORDER BY sim DESC, a) AS n FROM p),
matches AS MATERIALIZED (SELECT block, a, b, (sa + sb) / 2 AS saliency, list_concat(va, vb) AS w, a || '/' || b AS key FROM x WHERE m = 1 AND n = 1 AND sa > 0.01 AND sb > 0.01),
v AS MATERIALIZED (SELECT block, key, {_GRID.format(v='w')} AS f FROM matches),
{_seeds(4)},\n{_rounds('s4', 'k', 4)},
best AS (SELECT block, a, b, cluster, saliency FROM (SELECT m.*, cluster, row_number() OVER (PARTITION BY m.block, cluster ORDER BY saliency DESC, a, b) AS n FROM matches m JOIN k_a k ON k.block = m.block AND k.key = m.key) WHERE n = 1)
SELECT block, a, b, CAST(cluster AS INTEGER) AS cluster, round(saliency, 6) AS saliency, CAST(row_number() OVER (PARTITION BY block ORDER BY saliency DESC, a, b) AS INTEGER) AS rank FROM best"""
)
def spread_matches(spark, sf_dir):
    """VEC4, VEC5, WIN10: of the mutual matches of each block those that lie well apart."""
    i = F.col("id")
    e = I.embeddings(spark, sf_dir).select(i.alias("patch_idx"), "vec", F.floor(i % 16 / 2).alias("block"), F.abs(F.col("vec")[0]).cast("double").alias("saliency"))
    matches = V.mutual_nearest(e.filter("patch_idx % 2 = 0"), e.filter("patch_idx % 2 = 1"), ["block"], 0.01)
    a, b = (e.select("block", F.col("patch_idx").alias(s), F.col("vec").alias("v" + s)) for s in "ab")
    pairs = matches.join(a, ["block", "a"]).join(b, ["block", "b"])
    return K.spread_pairs(pairs, 4, ["block"], rounds=4).select("block", "a", "b", "cluster", F.round("saliency", 6).alias("saliency"), "rank")


@query()
def vector_components(spark, sf_dir):
    """VEC7: places of all vectors on their first three axes."""
    found = K.principal(I.embeddings(spark, sf_dir), 3)
    return found.select("id", F.size("components").alias("n"), F.round(F.abs(F.col("components")[0]), 4).alias("first"))


@query()
def vector_components_by_label(spark, sf_dir):
    """VEC7: places of the vectors of each label on axes of their own."""
    found = K.principal(I.embeddings(spark, sf_dir), 2, ["label"])
    return found.select("label", "id", *[F.round(F.abs(F.col("components")[c]), 4).alias(n) for c, n in enumerate(("first", "second"))])
