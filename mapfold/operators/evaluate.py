"""Scores of predictions against ground truth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapfold.functions import geometry as G
from mapfold.functions.text import same_transcription
from mapfold.operators.components import connected_components
from mapfold.operators.graph_cells import cell_bits, cell_rivals, in_cells, open_edges, whole_numbers
from mapfold.operators.graphs import both_ways, bounded_distances
from mapfold.operators.spatial import cell_join, overlapping_boxes
from mapfold.operators.walk_scores import maximum_matching, start_scores  # noqa: F401
from mapfold.session import cut, written


def f_score(tp: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, predicted), F.lit(0.0)), F.coalesce(F.try_divide(tp, actual), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def greedy_one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, cost: list[str], rounds: int = 12) -> DataFrame:
    """The pairs a greedy pass in order of (cost, left, right) takes, each side once (EVL1, EVL9).

    A pair that is first for both its ends is taken by the greedy pass, so rounds of
    mutual firsts give the same result; each round removes what they touch. What long
    chains of falling costs leave after some rounds is finished component by component.
    """
    order = [*cost, left, right]
    rest, taken = cut(pairs.select(*group, *order)), None
    for _ in range(rounds):
        first = F.struct(*order)
        by_left = rest.groupBy(*group, left).agg(F.min(first).alias("m")).select(*group, "m.*")
        by_right = rest.groupBy(*group, right).agg(F.min(first).alias("m")).select(*group, "m.*")
        now = cut(by_left.join(by_right, [*group, *order]))
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.unionByName(now)
        rest = cut(rest.join(now.select(*group, left), [*group, left], "left_anti").join(now.select(*group, right), [*group, right], "left_anti"))
    return taken.unionByName(_greedy_by_component(rest, group, left, right, order).select(*taken.columns))


def _greedy_by_component(rest: DataFrame, group: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """The same pass over pairs that hang together, one component at a time."""
    node = lambda side, c: F.xxhash64(F.lit(side), *group, c)
    marked = rest.withColumns({"_l": node("l", left), "_r": node("r", right)})
    components = connected_components(marked.select(F.col("_l").alias("a"), F.col("_r").alias("b")))
    marked = marked.join(components.select(F.col("node").alias("_l"), "component"), "_l")
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy(*order)))

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        keep = []
        for n, (a, b) in enumerate(zip(*(pdf.sort_values("_n")[c].tolist() for c in ("_l", "_r")), strict=True), 1):
            if a not in used and b not in used:
                used |= {a, b}
                keep.append(n)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "_n": keep})

    ranked = cut(ranked)
    kept = ranked.select("component", "_n", "_l", "_r").groupBy("component").applyInPandas(passed, "component long, _n int")
    return ranked.join(kept, ["component", "_n"], "left_semi").select(*group, *order)


def pixel_f_score(true: DataFrame, pred: DataFrame, reach: int, sizes: DataFrame) -> DataFrame:
    """F-score of point or line masks (EVL1, JN21). Masks: map_id, key, row, col; sizes: map_id, height, width.

    Exact overlaps count 1; the others are matched greedily to the nearest pixel of a square
    window, its upper side exclusive, and count 1 - distance / diagonal.
    """
    keys = ["map_id", "key"]
    same = true.join(pred, [*keys, "row", "col"], "left_semi")
    t = true.join(same, [*keys, "row", "col"], "left_anti")
    p = pred.join(same, [*keys, "row", "col"], "left_anti")
    t = t.select(*keys, F.col("row").cast("double").alias("tr"), F.col("col").cast("double").alias("tc"))
    p = p.select(*keys, F.col("row").cast("double").alias("pr"), F.col("col").cast("double").alias("pc"))
    box = lambda r, c: (F.col(c), F.col(r), F.col(c), F.col(r))
    near = cell_join(t, p, keys, box("tr", "tc"), box("pr", "pc"), float(reach), float(reach))
    inside = lambda a, b: (F.col(b) >= F.col(a) - reach) & (F.col(b) < F.col(a) + reach)
    near = near.filter(inside("tr", "pr") & inside("tc", "pc")).withColumn("d", G.distance(F.col("tr"), F.col("tc"), F.col("pr"), F.col("pc")))
    near = near.select(*keys, "d", F.struct("tr", "tc").alias("t"), F.struct("pr", "pc").alias("p"))
    matched = greedy_one_to_one(near, keys, "t", "p", ["d"]).groupBy(*keys).agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = count(true, "n_true").join(count(pred, "n_pred"), keys, "full").join(count(same, "n_same"), keys, "left").join(matched, keys, "left").join(sizes, "map_id")
    out = out.fillna(0, ["n_true", "n_pred", "n_same", "n", "d"])
    tp = F.col("n_same") + F.col("n") - F.col("d") / F.sqrt(F.col("height") ** 2 + F.col("width") ** 2)
    p_, r_, f_ = f_score(tp, F.col("n_pred"), F.col("n_true"))
    return out.select(*keys, p_.alias("precision"), r_.alias("recall"), f_.alias("f1"))


def polygon_f_score(true: DataFrame, pred: DataFrame, easy: DataFrame, weight: float = 0.7, all_easy: bool = False) -> DataFrame:
    """F-score of polygon masks with pixels off the legend colour weighted (EVL2). easy: pixels that match it.

    all_easy counts every easy pixel in the precision's denominator instead of predicted ones.
    """
    at = ["map_id", "key", "row", "col"]
    m = true.select(*at, F.lit(1).alias("t")).join(pred.select(*at, F.lit(1).alias("p")), at, "full").join(easy.select(*at, F.lit(1).alias("e")), at, "full" if all_easy else "left").fillna(0)
    w = F.when(F.col("e") == 1, 1.0 - weight).otherwise(weight)
    s = m.groupBy("map_id", "key").agg(F.sum(w * F.col("t") * F.col("p")).alias("tp"), F.sum(w * F.col("t")).alias("nt"), F.sum(F.when((F.col("e") == 1) & F.lit(all_easy), w).otherwise(w * F.col("p"))).alias("np"))
    p, r, f = f_score(F.col("tp"), F.col("np"), F.col("nt"))
    return s.select("map_id", "key", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def valid_mask(mask: DataFrame) -> DataFrame:
    """Set pixels of masks with values 0, 1, 255; a mask that is one value all over counts as empty (EVL3). mask: map_id, key, row, col, value."""
    facts = mask.groupBy("map_id", "key").agg(F.countDistinct("value").alias("k"), F.bool_and(F.col("value").isin(0, 1, 255)).alias("ok"))
    return mask.join(facts.filter("k > 1 AND ok"), ["map_id", "key"], "left_semi").filter("value > 0").select("map_id", "key", "row", "col")


def without_rivals(starts: DataFrame, rivals: DataFrame, sure: float = 0.9) -> DataFrame:
    """The starts that stay when, by falling score, each one kept drops its rivals (EVL8).

    starts: map_id, start, score; rivals: map_id, a, b, either way round. Of equal scores the
    larger start comes first; a start of score sure or more stays whatever its rivals are,
    and drops them. That is one pass over sorted starts; here every round decides all
    starts whose better rivals are decided, so independent neighbourhoods go at once and a
    checkpoint cuts each round. A null score comes last.
    """
    rank = lambda p: F.struct(F.coalesce(p + "score", F.lit(float("-inf"))), F.col(p + "start"))
    ends = lambda n: starts.select("map_id", F.col("start").alias(n), *[F.col(c).alias(n + c) for c in ("start", "score")])
    both = rivals.select("map_id", "a", "b").unionByName(rivals.select("map_id", F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    better = cut(both.join(ends("a"), ["map_id", "a"]).join(ends("b"), ["map_id", "b"]).filter(rank("a") > rank("b")).select("map_id", "a", F.col("b").alias("start")))
    state = cut(starts.withColumn("_kept", F.when(F.col("score") >= sure, True)))
    left = -1
    while True:
        known = better.join(state.select("map_id", F.col("start").alias("a"), F.col("_kept").alias("_better")), ["map_id", "a"])
        said = known.groupBy("map_id", "start").agg(F.max(F.coalesce("_better", F.lit(False))).alias("_beaten"), F.max(F.col("_better").isNull()).alias("_open"))
        new = F.when(F.coalesce("_beaten", F.lit(False)), False).when(~F.coalesce("_open", F.lit(False)), True)
        state = cut(state.join(said, ["map_id", "start"], "left").withColumn("_kept", F.coalesce("_kept", new)).drop("_beaten", "_open"))
        before, left = left, state.filter("_kept IS NULL").count()
        if not left:
            return state.filter("_kept").drop("_kept")
        if left == before:
            raise RuntimeError("starts must differ inside a map")


def starts_apart(edges: DataFrame, score: Callable[[Column], Column], reach: float, sure: float = 0.9) -> DataFrame:
    """(map_id, start): without_rivals() of all nodes with an edge, whose rivals are those within a network distance of reach (EVL8).

    edges: map_id, u, v, length; score gives a node's score. Parts of the graph whose nodes
    lie in one cell of numbers are settled there, without a row for a pair of rivals.
    """
    sound = edges.filter("map_id IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL").select("map_id", "u", "v", F.col("length").cast("double").alias("length"))
    of = lambda e: both_ways(e.select("map_id", "u", "v")).select("map_id", F.col("u").alias("start")).distinct()

    def by_rounds(e: DataFrame) -> DataFrame:
        near = bounded_distances(e, of(e), reach).select("map_id", F.col("start").alias("a"), F.col("node").alias("b"))
        return without_rivals(of(e).withColumn("score", score(F.col("start"))), near, sure).select("map_id", "start")

    bits, leaves = cell_bits(sound) if whole_numbers(edges, "u", "v") else (None, True)
    if bits is None:
        return by_rounds(edges)
    kind = edges.schema["map_id"].dataType.simpleString()
    low = lambda c: F.coalesce(score(F.col(c)).cast("double"), F.lit(float("-inf")))
    scored = sound.withColumns({"length": F.coalesce("length", F.lit(float("inf"))), "su": low("u"), "sv": low("v")})
    out = in_cells(scored, bits).mapInArrow(cell_rivals(bits, reach, sure), f"map_id {kind}, start long")
    # a node without a whole edge has no rivals
    odd = edges.filter("map_id IS NULL OR u IS NULL OR v IS NULL")
    if not odd.isEmpty():
        out = out.unionByName(of(odd).join(of(sound).hint("merge"), ["map_id", "start"], "left_anti"))
    if not leaves:
        return out
    rest = written(in_cells(sound, bits).mapInArrow(open_edges(bits, sound.columns), f"map_id {kind}, u long, v long, length double"))
    return out if rest.isEmpty() else out.unionByName(by_rounds(rest))


def dice(a: DataFrame, b: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Dice coefficient by (map, key) and, over keys, by map with key null (EVL12)."""
    at = ["map_id", "key", "row", "col"]
    m = a.select(*at, F.lit(1).alias("a")).join(b.select(*at, F.lit(1).alias("b")), at, "full").fillna(0)
    s = m.rollup("map_id", "key").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum("a").alias("na"), F.sum("b").alias("nb")).filter("map_id IS NOT NULL")
    return s.select("map_id", "key", ((2 * F.col("ab") + epsilon) / (F.col("na") + F.col("nb") + epsilon)).alias("dice"))


def _match_image(iou_thresholds: tuple[float, ...], most: int):
    """Greedy matching by score of one image and class; its boxes are those of one map tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        det = pdf[pdf["is_det"]].sort_values(["score", "box_id"], ascending=[False, True]).head(most)
        gt = pdf[~pdf["is_det"]].sort_values(["ignore", "box_id"])
        d, g = det[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float), gt[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float)
        w = np.minimum(d[:, None, 2], g[None, :, 2]) - np.maximum(d[:, None, 0], g[None, :, 0])
        h = np.minimum(d[:, None, 3], g[None, :, 3]) - np.maximum(d[:, None, 1], g[None, :, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        iou = inter / (area(d)[:, None] + area(g)[None, :] - inter + 1e-8)
        ignored, rows = gt["ignore"].to_numpy(bool), []
        for t in iou_thresholds:
            free = np.ones(len(g), bool)
            for k, (box, score) in enumerate(zip(det["box_id"], det["score"], strict=True)):
                # a box to be found before one to be ignored, and either only once; of equal overlaps the later box
                best = max((j for j in range(len(g)) if free[j] and iou[k, j] >= t), key=lambda j: (not ignored[j], iou[k, j], j), default=None)
                if best is not None:
                    free[best] = False
                if best is None or not ignored[best]:
                    rows.append((t, box, score, best is not None))
        out = pd.DataFrame(rows, columns=["iou", "box_id", "score", "tp"])
        out.insert(0, "class", pdf["class"].iloc[0])
        out.insert(0, "image_id", pdf["image_id"].iloc[0])
        return out

    return run


def detection_curve(boxes: DataFrame, thresholds: tuple[float, ...] = (0.5,), most: int = 100) -> DataFrame:
    """Of each image and class the `most` best detections count, as the measure itself has it (WIN15); ranked detections with running precision and recall and the envelope of precision (EVL4, WIN11, WIN12, WIN15).

    boxes: image_id, class, box_id, is_det, score, ignore, xmin, ymin, xmax, ymax. Matching
    is by image and class, which is one tile's boxes; the curve is windows over all images.
    """
    schema = "image_id long, class long, iou double, box_id long, score double, tp boolean"
    hits = boxes.groupBy("image_id", "class").applyInPandas(_match_image(thresholds, most), schema)
    truth = boxes.filter("NOT is_det AND NOT ignore").groupBy("class").agg(F.count("*").alias("n_true"))
    order = Window.partitionBy("class", "iou").orderBy(F.desc("score"), "image_id", "box_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = hits.withColumn("rank", F.row_number().over(order)).withColumn("tps", F.sum(F.col("tp").cast("int")).over(run)).join(F.broadcast(truth), "class")
    out = out.withColumns({"precision": F.col("tps") / F.col("rank"), "recall": F.col("tps") / F.col("n_true")})
    back = Window.partitionBy("class", "iou").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("envelope", F.max("precision").over(back))


def average_precision(curve: DataFrame) -> DataFrame:
    """(class, iou, ap, ar): mean envelope at 101 recalls, and the highest recall (EVL4)."""
    points = curve.groupBy("class", "iou").agg(F.max("recall").alias("ar")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("t", F.col("_k") / 100.0).drop("_k")
    at = points.join(curve.select("class", "iou", "recall", "envelope"), ["class", "iou"]).filter("recall >= t").groupBy("class", "iou", "t").agg(F.max("envelope").alias("p"))
    full = points.join(at, ["class", "iou", "t"], "left").fillna(0.0, ["p"])
    return full.groupBy("class", "iou").agg(F.avg("p").alias("ap"), F.max("ar").alias("ar"))


def ranked_ap(rows: DataFrame, group: list[str], score: str, hit: str, tie: str) -> DataFrame:
    """Average precision of ranked binary hits (WIN14)."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    r = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_hits", F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*group).agg(F.avg(F.when(F.col(hit), F.col("_hits") / F.col("_rank"))).alias("ap"), F.sum(F.col(hit).cast("int")).alias("hits"), F.count("*").alias("n"))


def text_spotting(pairs: DataFrame, truth: DataFrame, found: DataFrame, word_match: bool = True) -> DataFrame:
    """Micro-averaged precision, recall and H of text spotting (EVL5, AGG12).

    pairs: image_id, gt_id, det_id, iou, same_text; a pair over 0.5 is taken in (gt, det)
    order, one to one; truth: image_id, gt_id, care; found: image_id, det_id, dont_care
    (mostly inside a region that does not count).
    """
    cared = truth.filter("care")
    counted = found.filter("NOT dont_care")
    over = pairs.filter("iou > 0.5").join(cared.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_semi").join(counted.select("image_id", "det_id"), ["image_id", "det_id"], "left_semi")
    # in order of gt, each takes its first free det: costs are all equal, so the order is (gt, det)
    taken = greedy_one_to_one(over.select("image_id", "gt_id", "det_id", F.lit(0).alias("c"), "same_text").drop("same_text"), ["image_id"], "gt_id", "det_id", ["c"])
    good = taken.join(pairs.select("image_id", "gt_id", "det_id", "same_text"), ["image_id", "gt_id", "det_id"]).filter(F.col("same_text") | F.lit(not word_match))
    return _spotting_scores(good, truth, found)


def _spotting_scores(good: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Scores of each image and of all (image_id null) from the pairs that were taken with the right text."""
    cared, counted = truth.filter("care"), found.filter("NOT dont_care")
    good = good.groupBy("image_id").agg(F.count("*").alias("tp"))
    per = truth.select("image_id").unionByName(found.select("image_id")).distinct()
    per = per.join(cared.groupBy("image_id").agg(F.count("*").alias("nt")), "image_id", "left").join(counted.groupBy("image_id").agg(F.count("*").alias("np")), "image_id", "left").join(good, "image_id", "left").fillna(0)
    total = per.rollup("image_id").agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("nt").alias("nt"))
    p, r, h = f_score(F.col("tp"), F.col("np"), F.col("nt"))
    return total.select("image_id", p.alias("precision"), r.alias("recall"), h.alias("hmean"))


def box_spotting(truth: DataFrame, found: DataFrame, word_match: bool = True, side: float = 128.0) -> DataFrame:
    """text_spotting of boxes, without a row for each pair of equal ones.

    truth: image_id, gt_id, care, box, text; found: image_id, det_id, dont_care, box, text.
    Boxes are compared by shape; in a group of shapes that hang together each truth, in
    order, takes the least detection that is free in the shapes over 0.5 with its own. A
    group is one task's, with a row for each of its boxes and pairs of shapes.
    """
    corners = lambda b: tuple(F.col(b)[c] for c in ("xmin", "ymin", "xmax", "ymax"))
    cared = truth.filter("care").select("image_id", "gt_id", F.col("box").alias("_g"), F.col("text").alias("_gtext"))
    counted = found.filter("NOT dont_care").select("image_id", "det_id", F.col("box").alias("_d"), F.col("text").alias("_dtext"))
    g = written(cared.select("image_id", "_g").distinct().withColumn("_n", F.monotonically_increasing_id() * 2))
    d = written(counted.select("image_id", "_d").distinct().withColumn("_m", F.monotonically_increasing_id() * 2 + 1))
    over = written(cell_join(g, d, ["image_id"], corners("_g"), corners("_d"), side).filter(G.box_iou(F.col("_g"), F.col("_d")) > 0.5).select("image_id", "_n", "_m"))
    groups = written(connected_components(over.select(F.col("_n").alias("a"), F.col("_m").alias("b"))))
    of = lambda c: groups.select(F.col("node").alias(c), "component")
    row = lambda kind, a, b: ["component", "image_id", F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")]
    rows = cared.join(g.hint("merge"), ["image_id", "_g"]).join(of("_n").hint("merge"), "_n").select(*row(0, "_n", "gt_id"))
    rows = rows.unionByName(counted.join(d.hint("merge"), ["image_id", "_d"]).join(of("_m").hint("merge"), "_m").select(*row(1, "_m", "det_id")))
    rows = rows.unionByName(over.join(of("_n"), "_n").select(*row(2, "_n", "_m")))

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        free: dict[int, list[int]] = {}
        for n, m in pdf.loc[pdf["kind"] == 2, ["a", "b"]].itertuples(index=False):
            near.setdefault(n, []).append(m)
        for m, det in pdf[pdf["kind"] == 1].sort_values("b", ascending=False)[["a", "b"]].itertuples(index=False):
            free.setdefault(m, []).append(det)
        taken = []
        for n, gt in pdf[pdf["kind"] == 0].sort_values("b")[["a", "b"]].itertuples(index=False):
            first = min((m for m in near[n] if free[m]), key=lambda m: free[m][-1], default=None)
            if first is not None:
                taken.append((gt, free[first].pop()))
        return pd.DataFrame(taken, columns=["gt_id", "det_id"], dtype="int64").assign(image_id=pdf["image_id"].iloc[0])

    taken = rows.groupBy("component", "image_id").applyInPandas(passed, "gt_id long, det_id long, image_id long")
    both = taken.join(cared.select("image_id", "gt_id", "_gtext"), ["image_id", "gt_id"]).join(counted.select("image_id", "det_id", "_dtext"), ["image_id", "det_id"])
    good = both.filter(same_transcription(F.col("_gtext"), F.col("_dtext")) | F.lit(not word_match))
    return _spotting_scores(good, truth, found)


def candidate_recall(found: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(share of maps with a true candidate, maps without) (EVL7, SET3, AGG5). Both: name, ids array."""
    both = found.withColumnRenamed("ids", "f").join(truth.withColumnRenamed("ids", "t"), "name").withColumn("hit", F.arrays_overlap("f", "t"))
    return both.agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.count_if("hit").alias("hits"), F.count("*").alias("n")), both.filter("NOT hit")


def merged_boxes(boxes: DataFrame, least_iou: float = 0.2) -> DataFrame:
    """Overlapping boxes replaced by the hull of their group (EVL13). boxes: map_id, box_id, box."""
    # equal boxes of an area overlap wholly: one of them stands for all, the least; those without area overlap nothing
    area = (F.col("box.xmax") > F.col("box.xmin")) & (F.col("box.ymax") > F.col("box.ymin")) & F.lit(least_iou < 1)
    same = boxes.select("map_id", "box_id", F.struct(*[F.col("box")[c].cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("box"), F.when(~F.coalesce(area, F.lit(False)), F.col("box_id")).alias("_own"))
    one = written(same.groupBy("map_id", "box", "_own").agg(F.min("box_id").alias("box_id"), F.count("*").alias("n")))
    pairs = overlapping_boxes(one, least_iou)
    groups = connected_components(pairs.select(F.struct("map_id", F.col("a").alias("n")).alias("a"), F.struct("map_id", F.col("b").alias("n")).alias("b")))
    to = groups.select(F.col("node.map_id").alias("map_id"), F.col("node.n").alias("box_id"), F.col("component.n").alias("group"))
    b = one.join(to, ["map_id", "box_id"], "left").withColumn("group", F.coalesce("group", "box_id"))
    return b.groupBy("map_id", "group").agg(F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"), F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax"), F.sum("n").alias("n"))


def top_k_accuracy(ranked: DataFrame, k: int) -> DataFrame:
    """Share of rows whose label is among their first k predictions (EVL16). ranked: predictions array, label."""
    return ranked.agg(F.avg((F.array_position(F.slice("predictions", 1, k), F.col("label")) > 0).cast("double")).alias("accuracy"))


def simple_topo(true_points: DataFrame, pred_points: DataFrame, threshold: float) -> DataFrame:
    """Share of predicted points near a true one and the reverse, averaged over starts (EVL17, EVL8 without one-to-one).

    Points: map_id, start, x, y, as walk_points gives.
    """
    keys = ["map_id", "start"]
    mark = lambda df, p: df.select(*keys, F.col("x").alias(p + "x"), F.col("y").alias(p + "y"))
    box = lambda p: (F.col(p + "x"), F.col(p + "y"), F.col(p + "x"), F.col(p + "y"))

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = cell_join(mark(a, "a"), mark(b, "b"), keys, box("a"), box("b"), threshold, threshold)
        hit = near.filter(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= threshold).select(*keys, "ax", "ay").distinct().groupBy(*keys).agg(F.count("*").alias("hit"))
        return a.select(*keys, "x", "y").distinct().groupBy(*keys).agg(F.count("*").alias("n")).join(hit, keys, "left").select(*keys, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias(name))

    per = share(pred_points, true_points, "precision").join(share(true_points, pred_points, "recall"), keys, "full").fillna(0.0)
    return per.groupBy("map_id").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def topo_by_start(true_points: DataFrame, pred_points: DataFrame, threshold: float, hard: float = 0.29, soft: float = 0.3) -> DataFrame:
    """(map_id, start, nt, np, near_t, near_p, hit, taken, cost): places and matches of the walk points of each start; see walk_scores.start_scores.

    Points: map_id, start, x, y, dx, dy. The points of a start are those of one bounded walk:
    they meet in one task, many starts at once. Points without a map or start match none.
    """
    keys = ["map_id", "start"]
    side = lambda df, true: df.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "dx", "dy")], F.lit(true).alias("true"))
    both = side(true_points, True).unionByName(side(pred_points, False))
    known = F.col("map_id").isNotNull() & F.col("start").isNotNull()
    counts = ("nt", "np", "near_t", "near_p", "hit", "taken")
    told = ", ".join([*(f"{c} {both.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} long" for c in counts), "cost double"])
    per = both.filter(known).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(start_scores(threshold, hard, soft), told)
    n = lambda true: F.countDistinct(F.when(F.col("true") == true, F.struct("x", "y")))
    lone = both.filter(~known).groupBy(*keys, "true").agg(n(True).alias("nt"), n(False).alias("np")).drop("true")
    return per.unionByName(lone.select(*keys, "nt", "np", *[F.lit(0).cast("long").alias(c) for c in counts[2:]], F.lit(0.0).alias("cost")))


def _topo_measures(per: DataFrame, threshold: float) -> DataFrame:
    """All measures of topo_by_start() by map; score and f1 over the starts with true points."""
    p, r, _ = f_score(F.col("hit"), F.col("np"), F.col("nt"))
    near_p, near_r = (F.coalesce(F.try_divide(F.col("near_" + c), F.col("n" + c)), F.lit(0.0)) for c in "pt")
    lone = threshold * 1.15
    smooth = lambda n: F.coalesce(1 - F.try_divide(F.col("cost") + (F.col(n) - F.col("taken")) * lone, F.col(n) * lone), F.lit(0.0))
    per = per.withColumns({"_p": smooth("np"), "_r": smooth("nt"), "_s": F.col("cost") + (F.col("np") - F.col("taken")) * lone})
    f = F.when(F.col("np") == 0, 0.0).otherwise(F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0)))
    walked = F.col("nt") > 0
    return per.groupBy("map_id").agg(
        F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(near_p).alias("p"), F.avg(near_r).alias("r"), F.sum(F.when(walked, F.col("_s"))).alias("score"), F.avg(F.when(walked, f)).alias("f1"), F.max(walked).alias("walked")
    )


def topo_measures(true_points: DataFrame, pred_points: DataFrame, threshold: float) -> DataFrame:
    """(map_id, precision, recall, p, r, score, f1) of maps with true points: topo_one_to_one, simple_topo (p, r) and soft_topo in one pass."""
    return _topo_measures(topo_by_start(true_points, pred_points, threshold), threshold).filter("walked AND map_id IS NOT NULL").drop("walked")


def topo_one_to_one(true_points: DataFrame, pred_points: DataFrame, threshold: float, angle: float = 0.29) -> DataFrame:
    """Precision and recall of walk points under a maximum one-to-one matching in each start, averaged over starts (EVL8).

    Points: map_id, start, x, y, dx, dy. The points of a start are those of one bounded walk.
    """
    return _topo_measures(topo_by_start(true_points, pred_points, threshold, hard=angle), threshold).select("map_id", "precision", "recall")


def soft_topo(true_points: DataFrame, pred_points: DataFrame, threshold: float, angle: float = 0.3) -> DataFrame:
    """(map_id, score, f1): greedy one-to-one matching by a soft cost in each start (EVL9).

    A pair costs 1.5 times what its distance has over a third of the threshold, and half the
    threshold times how far its directions are apart; an unmatched point costs 1.15
    thresholds. Smooth precision and recall are one less the share of the most it could
    cost; score sums the cost of predicted points over starts, f1 is the mean over starts.
    """
    return _topo_measures(topo_by_start(true_points, pred_points, threshold, soft=angle), threshold).filter("walked").select("map_id", "score", "f1")


def results_table(scores: DataFrame, folds: DataFrame) -> DataFrame:
    """Scores by (fold, map, key) with the means of each fold and of all, keys null (EVL14). scores: map_id, key, precision, recall, f1; folds: map_id, fold."""
    rows = scores.join(folds, "map_id")
    measures = ("precision", "recall", "f1")
    means = rows.rollup("fold").agg(*[F.avg(c).alias(c) for c in measures])
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    kinds = dict(rows.dtypes)
    return rows.select("fold", "map_id", "key", *measures).unionByName(means.select("fold", none(kinds["map_id"], "map_id"), none(kinds["key"], "key"), *measures))


def stage_times(runs: DataFrame) -> DataFrame:
    """(stage, runs, seconds, longest): times of stages over maps (EVL15). runs: stage, seconds."""
    return runs.groupBy("stage").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))


def street_mover(a: DataFrame, b: DataFrame, epsilon: float = 0.1, rounds: int = 20, stop: float = 1e-3) -> DataFrame:
    """(pair_id, cost): entropic transport between two clouds of each pair (EVL11). a, b: pair_id, k, x, y.

    Clouds hold a fixed number of points, so costs are a bounded table for each pair; one
    log-sum-exp aggregation a side and round.
    """
    i = a.select("pair_id", F.col("k").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    j = b.select("pair_id", F.col("k").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    cost = cut(i.join(j, "pair_id").select("pair_id", "i", "j", G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("c")))
    log_n = cost.groupBy("pair_id").agg(F.log(F.countDistinct("i")).alias("la"), F.log(F.countDistinct("j")).alias("lb"))
    u = cost.select("pair_id", "i").distinct().withColumn("u", F.lit(0.0))
    v = cost.select("pair_id", "j").distinct().withColumn("v", F.lit(0.0))
    for _ in range(rounds):
        before = u

        def half(own: str, other: DataFrame, value: str, mass: str) -> DataFrame:
            z = cost.join(other, ["pair_id", "j" if own == "i" else "i"]).withColumn("z", (F.col(value) - F.col("c")) / epsilon)
            top = z.groupBy("pair_id", own).agg(F.max("z").alias("m"))
            s = z.join(top, ["pair_id", own]).groupBy("pair_id", own).agg((F.first("m") + F.log(F.sum(F.exp(F.col("z") - F.col("m"))))).alias("lse"))
            return s.join(log_n, "pair_id").select("pair_id", own, (epsilon * (-F.col(mass) - F.col("lse"))).alias("u" if own == "i" else "v"))

        u = cut(half("i", v, "v", "la"))
        v = cut(half("j", u, "u", "lb"))
        change = u.join(before.withColumnRenamed("u", "w"), ["pair_id", "i"]).agg(F.avg(F.abs(F.col("u") - F.col("w"))).alias("d")).first().d
        if change is None or change < stop:
            break
    plan = cost.join(u, ["pair_id", "i"]).join(v, ["pair_id", "j"]).withColumn("p", F.exp((F.col("u") + F.col("v") - F.col("c")) / epsilon))
    return plan.groupBy("pair_id").agg(F.sum(F.col("p") * F.col("c")).alias("cost"))
