"""Lists and rings in order, by pointer doubling, and what follows from it for line graphs.

Every round each element jumps over what the element it points to has jumped over, so a
list of n elements is ranked in about log2(n) rounds of one equi-join each, wherever its
elements lie; a round ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from mapfold.operators.chain_cells import STOP, cell_chains
from mapfold.operators.graphs import cumulative_length
from mapfold.operators.mask_rings import LABEL, mask_rings
from mapfold.session import cut, written

CELL_BITS = (16, 12, 8)  #: bits of a node number inside a cell, the first that keeps cells from being crowded
CROWD = 1 << 19  #: edges of a cell at most


def list_ranks(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, last, steps) of the elements of lists that end, and the ids that lie on rings.

    links: id, next; next is null at the end of a list. Every round ranks the elements that
    are up to twice as far from their end; in a round that ranks none, only rings are left.
    """
    state = cut(links.select("id", F.coalesce("next", "id").alias("last"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNotNull().alias("open")))
    left = state.filter("open").count()
    while left:
        to = state.select(F.col("id").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        jumped = state.filter("open").join(to, "last").select("id", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        state = cut(state.filter("not open").unionByName(jumped))
        before, left = left, state.filter("open").count()
        if left == before:
            break
    return state.filter("not open").select("id", "last", "steps"), state.filter("open").select("id")


def ring_ranks(links: DataFrame) -> DataFrame:
    """(id, start, ahead): for elements of rings the ring's start and how many steps on it comes.

    links: id, next, value, with values that differ inside a ring; a ring starts at its
    least value. The start has 0 ahead, what follows it the most. A round that lowers no element's least value has shown
    every element its whole ring.
    """
    state = cut(links.select("id", F.col("next").alias("to"), F.lit(1).cast("long").alias("span"), F.struct("value", F.lit(0).cast("long").alias("off")).alias("least")))
    while True:
        after = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("span").alias("_span"), F.col("least").alias("_least"))
        further = F.struct(F.col("_least.value").alias("value"), (F.col("span") + F.col("_least.off")).alias("off"))
        both = state.join(after, "to").select("id", F.col("_to").alias("to"), (F.col("span") + F.col("_span")).alias("span"), F.least("least", further).alias("least"), (further < F.col("least")).alias("fell"))
        state = cut(both)
        if state.filter("fell").isEmpty():
            break
    return state.select("id", F.col("least.value").alias("start"), F.col("least.off").alias("ahead"))


def ordered_chains(edges: DataFrame) -> DataFrame:
    """(map_id, chain, pos, node): the nodes of every chain in order (GRF5).

    A chain is a path between nodes that don't have two edges, or a ring of nodes that all
    have. It starts at the lesser of its two ends (of equal ends, on the side of the lesser
    neighbour), a ring at its least node, where it ends as well; chain is its first edge.
    Loops, repeated edges and null ends are ignored. Where nodes are whole numbers, chains
    whose nodes lie in one cell of numbers are put in order there, and only the others go
    through rounds of joins.
    """
    clean = edges.filter("u != v").select("map_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if not all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("u", "v")):
        return _chains_by_rounds(clean.distinct().withColumns({"us": F.lit(False), "vs": F.lit(False)}))
    bits = _cell_bits(clean)
    if bits is None:
        return _chains_by_rounds(clean.distinct().withColumns({"us": F.lit(False), "vs": F.lit(False)}))
    placed = written(_chains_in_cells(clean, bits))
    node = edges.schema["u"].dataType if edges.schema["u"].dataType == edges.schema["v"].dataType else LongType()
    chain = F.struct(F.col("cu").cast(node).alias("u"), F.col("cv").cast(node).alias("v")).alias("chain")
    inside = placed.filter("pos is not null").select("map_id", chain, "pos", F.col("node").cast(node).alias("node"))
    # both cells of an edge between cells tell of it, each knows one end
    stop = lambda c: F.max(F.col(c) == STOP)
    left = placed.filter("pos is null").groupBy("map_id", F.col("cu").cast(node).alias("u"), F.col("cv").cast(node).alias("v")).agg(stop("su").alias("us"), stop("sv").alias("vs"))
    left = written(left)
    return inside if left.isEmpty() else inside.unionByName(_chains_by_rounds(left))


def _cell_bits(edges: DataFrame) -> int | None:
    """How many bits of a node number tell nodes of one cell apart, so that no cell has more than CROWD edges; None if small cells have more."""
    for bits in CELL_BITS:
        n = edges.select("map_id", F.explode(F.array_distinct(F.array(F.shiftright("u", bits), F.shiftright("v", bits)))).alias("c")).groupBy("map_id", "c").count()
        if (n.agg(F.max("count")).first()[0] or 0) <= CROWD:
            return bits
    return None


def _chains_in_cells(edges: DataFrame, bits: int) -> DataFrame:
    """(map_id, cu, cv, pos, node, su, sv): nodes of the chains inside cells in order, and without pos the edges of the others."""
    at = ["map_id", "_cell"]
    rows = edges.select("map_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    cell = F.array_distinct(F.array(F.shiftright("u", bits), F.shiftright("v", bits)))
    rows = rows.withColumn("_cell", F.explode(cell)).repartition(*at).dropDuplicates()  # one shuffle for all
    kind = edges.schema["map_id"].dataType.simpleString()
    return rows.groupBy(*at).applyInArrow(cell_chains(bits), f"map_id {kind}, cu long, cv long, pos long, node long, su int, sv int")


def _chains_by_rounds(clean: DataFrame) -> DataFrame:
    """ordered_chains of distinct edges (u < v) by rounds of joins. us and vs tell which ends are known to be stops, with edges that aren't here."""
    numbered = written(clean.withColumn("e", F.monotonically_increasing_id()))
    dart = lambda n, a, b: F.struct((F.col("e") * 2 + n).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(a + "s").alias("stop"))
    darts = numbered.select("map_id", F.inline(F.array(dart(0, "u", "v"), dart(1, "v", "u"))))
    # at a node of two edges what comes in on one goes on along the other; id ^ 1 is the way back
    through = darts.groupBy("map_id", "a").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), F.max("stop").alias("stop")).filter("n = 2 and not stop")
    turn = lambda p, q: F.struct(F.col(p).bitwiseXOR(F.lit(1)).alias("id"), F.col(q).alias("next"))
    follows = through.select("map_id", F.col("a").alias("at"), F.inline(F.array(turn("x", "y"), turn("y", "x"))))
    links = written(darts.select("id", "map_id", "a").join(follows.select("id", "next"), "id", "left"))
    ranks, on_rings = list_ranks(links)

    rings = ring_ranks(links.join(on_rings, "id").select("id", "next", F.struct("map_id", "a").alias("value")))
    # a ring is cut at its start: what would follow the dart that comes back to it
    ends = rings.filter("ahead = 0").select(F.col("id").alias("next"))
    opened = links.join(on_rings, "id", "left_semi").join(ends.withColumn("_cut", F.lit(True)), "next", "left")
    more, _ = list_ranks(opened.select("id", F.when(F.col("_cut").isNull(), F.col("next")).alias("next")))
    ranks = written(ranks.unionByName(more))

    back = ranks.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("last").bitwiseXOR(F.lit(1)).alias("first"), F.col("steps").alias("pos"))
    placed = written(darts.join(ranks, "id").join(back, "id"))
    first = placed.filter("pos = 0").select("first", F.struct(F.col("a").alias("u"), F.col("b").alias("v")).alias("chain"))
    last = placed.filter("steps = 0").select("first", F.struct(F.col("b").alias("u"), F.col("a").alias("v")).alias("other"))
    chosen = first.join(last, "first").filter(F.col("chain") < F.col("other")).select("first", "chain")
    way = placed.join(chosen, "first")
    nodes = F.when(F.col("steps") > 0, F.array(F.struct("pos", F.col("a").alias("node")))).otherwise(F.array(F.struct("pos", F.col("a").alias("node")), F.struct((F.col("pos") + 1).alias("pos"), F.col("b").alias("node"))))
    return way.select("map_id", "chain", F.inline(nodes))


def chain_vertices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(map_id, line_id, pos, x, y, length): chains with the places of their nodes and the length so far. nodes: map_id, node, x, y."""
    placed = ordered_chains(edges).withColumnRenamed("chain", "line_id").join(nodes.select("map_id", "node", "x", "y"), ["map_id", "node"])
    return cumulative_length(placed.select("map_id", "line_id", "pos", "x", "y"))


def _legs(vertices: DataFrame) -> DataFrame:
    """Each vertex with the one before it; lines of one vertex have none."""
    order = Window.partitionBy("map_id", "line_id").orderBy("pos")
    total = F.max("length").over(Window.partitionBy("map_id", "line_id"))
    before = {c: F.lag(c).over(order).alias(c + "0") for c in ("x", "y", "length")}
    return vertices.select("map_id", "line_id", "x", "y", "length", *before.values(), total.alias("total")).filter("length0 is not null")


def _between(legs: DataFrame, parts) -> DataFrame:
    """(map_id, line_id, k, x, y): the inner points that cut a line into so many equal parts; at a vertex the leg before it counts."""
    step = F.col("total") / parts
    first, last = F.floor(F.col("length0") / step) + 1, F.floor(F.col("length") / step)
    last = F.least(last, (parts - 1).cast("long"))
    cut_at = legs.withColumn("_step", step).withColumn("_k0", first).withColumn("_k1", last).filter((F.col("total") > 0) & (F.col("_k0") <= F.col("_k1")))
    t = (F.col("k") * F.col("_step") - F.col("length0")) / (F.col("length") - F.col("length0"))
    points = cut_at.withColumn("k", F.explode(F.sequence("_k0", "_k1")))
    return points.select("map_id", "line_id", "k", (F.col("x0") + t * (F.col("x") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y") - F.col("y0"))).alias("y"))


def resampled(vertices: DataFrame, spacing: float) -> DataFrame:
    """(map_id, line_id, k, x, y): lines as points at even distances of about spacing, both ends kept (GRF5, GEO27).

    vertices as chain_vertices returns them. A line is cut into floor(length / spacing) + 1
    equal parts.
    """
    legs = _legs(vertices)
    parts = F.floor(F.col("total") / spacing) + 1
    inner = _between(legs, parts)
    ends = vertices.groupBy("map_id", "line_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("p"), F.max_by(F.struct("x", "y"), "pos").alias("q"), (F.floor(F.max("length") / spacing) + 1).alias("n"))
    point = lambda k, p: F.struct(k.cast("long").alias("k"), F.col(p + ".x").alias("x"), F.col(p + ".y").alias("y"))
    return inner.unionByName(ends.select("map_id", "line_id", F.inline(F.array(point(F.lit(0), "p"), point(F.col("n"), "q")))))


def start_points(vertices: DataFrame, spacing: float, regions: DataFrame, margin: float = 0.07) -> DataFrame:
    """(map_id, line_id, k, x, y): evaluation starts, evenly along chains (GRF20).

    max(floor(length / spacing), 1) inner points of each chain that is at least half a
    spacing long, those more than margin of the region's size away from its border.
    regions: map_id, box.
    """
    parts = F.greatest(F.floor(F.col("total") / spacing), F.lit(1)) + 1
    points = _between(_legs(vertices).filter(F.col("total") >= spacing / 2), parts)
    away = [F.col("box." + c + "max") - F.col("box." + c + "min") for c in "xy"]
    inside = lambda c, w: (F.col(c) - F.col(f"box.{c}min") > margin * w) & (F.col(f"box.{c}max") - F.col(c) > margin * w)
    return points.join(regions.select("map_id", "box"), "map_id").filter(inside("x", away[0]) & inside("y", away[1])).drop("box")


def mask_polygons(runs: DataFrame) -> DataFrame:
    """(map_id, key, label, ring, holes): every component of a mask as a closed outer ring and closed holes (RAS3, SNK12).

    runs as pixels.labelled_runs returns them, of components whose pixels share sides; where
    only corners touch, rings stay apart. Rings hold corners only. Outer rings turn
    clockwise on the screen, holes the other way; the areas of all rings of a label, by the
    shoelace sum, add up to its pixels. One row holds one component's rings, and one task
    traces them, many components at once.
    """
    at = [*LABEL, "row", "c0", "c1"]
    whole = runs.select("map_id", "key", F.col("label.row").alias("lrow"), F.col("label.col").alias("lcol"), "row", "c0", "c1").dropna(subset=at)
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in LABEL)
    ring = "array<struct<x: double, y: double>>"
    traced = whole.repartition(*LABEL).sortWithinPartitions(*LABEL).mapInArrow(mask_rings, f"{kinds}, ring {ring}, holes array<{ring}>")
    return traced.select("map_id", "key", F.struct(F.col("lrow").alias("row"), F.col("lcol").alias("col")).alias("label"), "ring", F.array_sort("holes").alias("holes"))
