"""Boxes and trees of page elements, a row each. A page's boxes are one group; pages are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rounds import dominant_pairs, first_free


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes (structs of x, y, w, h) share."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Shared over joint area; null if both are empty."""
    joint = a["w"] * a["h"] + b["w"] * b["h"] - overlap(a, b)
    return F.when(joint > 0, overlap(a, b) / joint)


def structure_differs(mean: Column, *faults: Column) -> Column:
    """Whether a page's structure differs: mean overlap below 0.95, or any fault (leaves missing or extra, sections unmatched)."""
    out = mean < 0.95
    for n in faults:
        out = out | (n > 0)
    return F.coalesce(out, F.lit(False))


def _cells(boxes: DataFrame, level: Column, margin: float = 0.0) -> list[Column]:
    """The squares of side 2 ** level that a box with a margin meets, at most two by two: columns level, cx and cy."""
    side = F.pow(F.lit(2.0), level)
    span = lambda p, s: F.sequence(F.floor((F.col("box")[p] - margin) / side), F.floor((F.col("box")[p] + F.col("box")[s] + margin) / side))
    return [F.explode(F.flatten(F.transform(span("x", "w"), lambda x: F.transform(span("y", "h"), lambda y: F.struct(level.alias("level"), x.alias("cx"), y.alias("cy")))))).alias("cell")]


def _meeting(df: DataFrame, page: str, key: str, box: str, margin: float, point: bool, tie: str | None = None) -> DataFrame:
    """g (a struct of page), big, small (structs of k, b and t, which is tie): pairs of boxes of a page that meet in a square.

    A box lies in squares of a level not smaller than itself, four at most; smaller boxes look for it there,
    on the levels that the page has, all they cover or, if point is true, only their corner's. A box that is
    held may stand out by the margin on both sides, so it looks from the level of its bare size on (less
    what rounding adds). So the pairs that meet are near each other, and no page's boxes are paired as such.
    A pair comes once.
    """
    x = df.where(F.col(box).isNotNull()).select(F.struct(F.col(page).alias("p")).alias("g"), F.col(key).alias("k"), F.col(box).alias("box"), (F.col(tie) if tie else F.lit(0)).alias("t"))
    size = F.greatest(F.col("box")["w"], F.col("box")["h"])
    level = lambda s: F.greatest(F.ceil(F.log2(F.greatest(s, F.lit(1.0)))), F.lit(0)).cast("int")
    x = x.withColumns({"level": level(size + 2 * margin), "least": level(size - 0.01)})
    levels = x.groupBy("g").agg(F.collect_set("level").alias("levels"))  # a few dozen at most
    whole = F.struct("k", F.col("box").alias("b"), "t")
    big = x.select("g", whole.alias("big"), *_cells(x, F.col("level"), margin))
    y = x.join(levels, "g").select("g", "k", "box", "t", F.explode(F.filter("levels", lambda v: v >= F.col("least"))).alias("level"))
    if point:
        side = F.pow(F.lit(2.0), F.col("level"))
        at = F.struct("level", F.floor(F.col("box")["x"] / side).alias("cx"), F.floor(F.col("box")["y"] / side).alias("cy"))
        return big.join(y.select("g", whole.alias("small"), at.alias("cell")), ["g", "cell"]).where("big.k <> small.k")
    pairs = big.join(y.select("g", whole.alias("small"), *_cells(y, F.col("level"))), ["g", "cell"]).where("big.k <> small.k")
    side = F.pow(F.lit(2.0), F.col("cell.level"))
    corner = lambda p: F.floor(F.greatest(F.col("big.b")[p], F.col("small.b")[p]) / side)
    return pairs.where((corner("x") == F.col("cell.cx")) & (corner("y") == F.col("cell.cy")))


def not_contained(df: DataFrame, page: str, key: str, box: str, margin: float = 2.0, tie: str | None = None) -> DataFrame:
    """page and key of the boxes kept by descending area (of equals the least in column tie, if given, then the
    least key first), each unless a box kept before holds it up to a margin. Boxes without a size given (null) stay. Keys name the boxes of a page."""
    pairs = _meeting(df, page, key, box, margin, True, tie)
    d, e = F.col("big.b"), F.col("small.b")
    inside = (e["x"] >= d["x"] - margin) & (e["y"] >= d["y"] - margin) & (e["x"] + e["w"] <= d["x"] + d["w"] + margin) & (e["y"] + e["h"] <= d["y"] + d["h"] + margin)
    place = lambda c: F.struct((-F.col(f"{c}.b")["w"] * F.col(f"{c}.b")["h"]).alias("s"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.k").alias("k"))
    edges = pairs.where(inside & (place("big") < place("small"))).select(F.col("g.p").alias(page), F.col("big.k").alias("before"), F.col("small.k").alias("after"), place("small").alias("place"))
    return first_free(df.select(page, key), edges, page, key)


def greedy_disjoint(df: DataFrame, page: str, key: str, box: str) -> DataFrame:
    """page and key of the boxes kept in key order, each if it overlaps none kept before. Empty and null boxes
    overlap nothing. Keys name the boxes of a page."""
    pairs = _meeting(df.where((F.col(box)["w"] > 0) & (F.col(box)["h"] > 0)), page, key, box, 0.0, False)
    pairs = pairs.where(overlap(F.col("big.b"), F.col("small.b")) > 0)
    ends = F.least("big.k", "small.k").alias("before"), F.greatest("big.k", "small.k").alias("after")
    edges = pairs.select(F.col("g.p").alias(page), *ends).distinct()  # boxes of one level meet both ways
    return first_free(df.select(page, key), edges.withColumn("place", F.col("after")), page, key)


def greedy_pairs(candidates: DataFrame, page: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of a page, best score first, then least left, then least right."""
    return dominant_pairs(candidates, page, left, right, score)


def ancestors(path: Column, separator: str = "__") -> Column:
    """All proper prefixes of a node id, shortest first."""
    parts = F.split(path, separator)
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), separator))).otherwise(F.array().cast("array<string>"))


def depth(path: Column, separator: str = "__") -> Column:
    return F.size(F.split(path, separator))


def heights(nodes: DataFrame, id: str = "id") -> DataFrame:
    """Height of each node: 1 for leaves, else one more than the highest child; by one sum over prefixes."""
    below = nodes.select(F.explode(F.concat(F.array(id), ancestors(F.col(id)))).alias(id), depth(F.col(id)).alias("d"))
    top = below.groupBy(id).agg(F.max("d").alias("d")).select(id, (F.col("d") - depth(F.col(id)) + 1).alias("height"))
    return nodes.join(top, id)


def drop_and_reparent(nodes: DataFrame, gone: Column, id: str = "id") -> DataFrame:
    """Nodes that stay, with the nearest ancestor that stays as parent (null at the top)."""
    stay = nodes.where(~gone)
    up = stay.select(id, F.explode(ancestors(F.col(id))).alias("parent")).join(stay.select(F.col(id).alias("parent")), "parent")
    near = up.groupBy(id).agg(F.max_by("parent", depth(F.col("parent"))).alias("parent"))
    return stay.join(near, id, "left")
