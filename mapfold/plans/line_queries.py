"""Queries of lines merged by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapfold.operators import line_cover as L
from mapfold.plans.registry import query
from mapfold.session import table

_BUFFER = 2.7
_ROUNDS = 14

_LINES = """lines AS (SELECT * FROM (SELECT o_orderkey // 1000 AS map_id, CASE o_orderkey % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'dashed' ELSE 'dotted' END AS class, o_orderkey AS seg_id,
 CAST(o_orderkey * 13 % 120 AS DOUBLE) AS ax, CAST(o_custkey * 7 % 40 AS DOUBLE) AS ay, CAST(o_orderkey * 13 % 120 + o_custkey % 41 - 20 AS DOUBLE) AS bx, CAST(o_custkey * 7 % 40 + o_orderkey % 7 - 3 AS DOUBLE) AS bz
 FROM orders) WHERE ax <> bx OR ay <> bz)"""
# the shares at which a line enters and leaves the two discs and the strip
_PARTS = f"""near AS (SELECT l.map_id, l.class, l.seg_id, r.seg_id AS other, l.ax - r.ax AS px, l.ay - r.ay AS py, l.ax - r.bx AS qx, l.ay - r.bz AS qy, l.bx - l.ax AS ux, l.bz - l.ay AS uy, r.bx - r.ax AS wx, r.bz - r.ay AS wy
 FROM lines l JOIN lines r ON r.map_id = l.map_id AND r.class = l.class AND r.seg_id <> l.seg_id
 AND greatest(l.ax, l.bx) + {_BUFFER} >= least(r.ax, r.bx) AND least(l.ax, l.bx) - {_BUFFER} <= greatest(r.ax, r.bx) AND greatest(l.ay, l.bz) + {_BUFFER} >= least(r.ay, r.bz) AND least(l.ay, l.bz) - {_BUFFER} <= greatest(r.ay, r.bz)),
shape AS (SELECT *, ux * ux + uy * uy AS uu, wx * wx + wy * wy AS ww, {_BUFFER}::DOUBLE AS h, {_BUFFER}::DOUBLE * {_BUFFER}::DOUBLE AS hh FROM near),
ends AS (SELECT *, pow(px * uy - py * ux, 2) / uu AS po, pow(qx * uy - qy * ux, 2) / uu AS qo, px * wx + py * wy AS al, ux * wx + uy * wy AS als, py * wx - px * wy AS ac, uy * wx - ux * wy AS acs, h * sqrt(ww) AS rr FROM shape),
marks AS (SELECT map_id, class, seg_id, other, ww > uu OR ww = uu AND other < seg_id AS longer, unnest([
 CASE WHEN po <= hh THEN [-(px * ux + py * uy) / uu - sqrt((hh - po) / uu), -(px * ux + py * uy) / uu + sqrt((hh - po) / uu)] END,
 CASE WHEN qo <= hh THEN [-(qx * ux + qy * uy) / uu - sqrt((hh - qo) / uu), -(qx * ux + qy * uy) / uu + sqrt((hh - qo) / uu)] END,
 [greatest(CASE WHEN als <> 0 THEN least(-al / als, (ww - al) / als) WHEN al BETWEEN 0 AND ww THEN 0 ELSE 2 END, CASE WHEN acs <> 0 THEN least((-rr - ac) / acs, (rr - ac) / acs) WHEN abs(ac) <= rr THEN 0 ELSE 2 END),
  least(CASE WHEN als <> 0 THEN greatest(-al / als, (ww - al) / als) WHEN al BETWEEN 0 AND ww THEN 1 ELSE -1 END, CASE WHEN acs <> 0 THEN greatest((-rr - ac) / acs, (rr - ac) / acs) WHEN abs(ac) <= rr THEN 1 ELSE -1 END)]]) AS m FROM ends),
parts AS MATERIALIZED (SELECT map_id, class, seg_id, other, longer, min(greatest(m[1], 0)) AS t0, max(least(m[2], 1)) AS t1 FROM marks WHERE m IS NOT NULL AND greatest(m[1], 0) <= least(m[2], 1) GROUP BY ALL HAVING max(least(m[2], 1)) > min(greatest(m[1], 0)))"""


def _verdicts() -> str:
    """state{n}: verdict of each line with parts after n rounds: true stays, false goes, null open."""
    ctes = ["state0 AS (SELECT DISTINCT map_id, class, seg_id, CAST(NULL AS BOOLEAN) AS stays FROM parts)"]
    gap = "bool_or({c} AND t0 > coalesce({c}_to, 0) + 1e-9) OR coalesce(max(t1) FILTER ({c}), 0) < 1 - 1e-9"
    for n in range(_ROUNDS):
        counted = f"SELECT p.*, longer OR coalesce(s.stays, false) AS sure, longer OR coalesce(s.stays, true) AS may FROM parts p LEFT JOIN state{n} s ON s.map_id = p.map_id AND s.class = p.class AND s.seg_id = p.other"
        reach = f"SELECT *, max(t1) FILTER (sure) OVER w AS sure_to, max(t1) FILTER (may) OVER w AS may_to FROM ({counted}) WINDOW w AS (PARTITION BY map_id, class, seg_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ctes.append(
            f"state{n + 1} AS MATERIALIZED (SELECT map_id, class, seg_id, CASE WHEN NOT ({gap.format(c='sure')}) THEN false WHEN {gap.format(c='may')} THEN true END AS stays FROM ({reach}) GROUP BY ALL)"
        )
    return ",\n".join(ctes)


_LEFT = f"""{_LINES}, {_PARTS},\n{_verdicts()},
remaining AS MATERIALIZED (SELECT l.* FROM lines l LEFT JOIN state{_ROUNDS} s USING (map_id, class, seg_id) WHERE s.stays IS DISTINCT FROM false)"""


def _lines(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "solid").when(k % 3 == 1, "dashed").otherwise("dotted")
    ax, ay = k * 13 % 120, c * 7 % 40
    ends = {"ax": ax, "ay": ay, "bx": ax + c % 41 - 20, "by": ay + k % 7 - 3}
    return table(spark, sf_dir, "orders").select(F.floor(k / 1000).alias("map_id"), kind.alias("class"), k.alias("seg_id"), *[e.cast("double").alias(n) for n, e in ends.items()])


@query(f"WITH {_LEFT} SELECT map_id, class, seg_id FROM remaining")
def lines_left_by_class(spark, sf_dir):
    """GRF18, AGG15: lines of each dash class that the others of it don't cover between them."""
    return L.without_covered(_lines(spark, sf_dir), ["map_id", "class"], _BUFFER).select("map_id", "class", "seg_id")


@query(
    f"""WITH RECURSIVE {_LEFT},
touch AS MATERIALIZED (SELECT l.map_id, l.class, l.seg_id AS a, r.seg_id AS b FROM remaining l JOIN remaining r ON r.map_id = l.map_id AND r.class = l.class AND r.seg_id <> l.seg_id
 AND greatest(l.ax, l.bx) >= least(r.ax, r.bx) AND least(l.ax, l.bx) <= greatest(r.ax, r.bx) AND greatest(l.ay, l.bz) >= least(r.ay, r.bz) AND least(l.ay, l.bz) <= greatest(r.ay, r.bz)
 AND sign((l.bx - l.ax) * (r.ay - l.ay) - (l.bz - l.ay) * (r.ax - l.ax)) * sign((l.bx - l.ax) * (r.bz - l.ay) - (l.bz - l.ay) * (r.bx - l.ax)) <= 0
 AND sign((r.bx - r.ax) * (l.ay - r.ay) - (r.bz - r.ay) * (l.ax - r.ax)) * sign((r.bx - r.ax) * (l.bz - r.ay) - (r.bz - r.ay) * (l.bx - r.ax)) <= 0),
reach AS (SELECT map_id, class, seg_id AS a, seg_id AS b FROM remaining UNION SELECT r.map_id, r.class, r.a, t.b FROM reach r JOIN touch t ON t.map_id = r.map_id AND t.class = r.class AND t.a = r.b)
SELECT map_id, class, a AS seg_id, min(b) AS "group" FROM reach GROUP BY 1, 2, 3"""
)
def merged_lines_by_class(spark, sf_dir):
    """AGG15: the same lines with the group of those that touch."""
    return L.merged_by_class(_lines(spark, sf_dir), ["map_id", "class"], _BUFFER).select("map_id", "class", "seg_id", "group")
