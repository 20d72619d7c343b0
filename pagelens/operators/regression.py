"""Whether a new version of a page has broken it: sections and leaves of both versions are matched and their boxes
compared. Everything is joins and folds within pages; pages are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .boxes import ancestors, iou, structure_differs
from .matching import image_matches, paired_texts, text_matches
from .rounds import dealt, written
from .trees import parent, sections, without_dressing, without_empty

#: Boxes that overlap by less count as changed.
SAME = 0.95


def stacked(nodes: DataFrame, page: str, width: float = 1000.0, line: float = 20.0, letters: int = 100) -> DataFrame:
    """nodes with a box, for pages whose boxes are not known: leaves lie below each other in document order, over the
    whole width, a line high for so many letters; other nodes are as large as what lies below them."""
    inner = nodes.select(page, parent(F.col("id")).alias("id")).distinct()
    lines = F.when(F.col("image"), 4).otherwise(F.ceil(F.length("text") / letters))
    leaf = nodes.join(inner, [page, "id"], "left_anti").withColumn("h", lines * line)
    down = W.partitionBy(page).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    leaf = leaf.withColumn("y", F.coalesce(F.sum("h").over(down), F.lit(0.0)))
    above = leaf.select(page, F.explode(F.concat(F.array("id"), ancestors(F.col("id")))).alias("id"), "y", (F.col("y") + F.col("h")).alias("to"))
    box = above.groupBy(page, "id").agg(F.min("y").alias("y"), F.max("to").alias("to"))
    box = box.select(page, "id", F.struct(F.lit(0.0).alias("x"), F.col("y").cast("double").alias("y"), F.lit(width).alias("w"), (F.col("to") - F.col("y")).cast("double").alias("h")).alias("box"))
    return nodes.join(box, [page, "id"])


def prepared(nodes: DataFrame, page: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What is compared of a version with boxes: its nodes without empty and dressing ones, and its sections, those of
    more than most leaves subdivided."""
    x, _ = written(nodes.where("box.w > 0 AND box.h > 0"))  # each step reads its nodes several times
    x, _ = written(without_empty(x, page).drop("parent"))
    x, _ = written(without_dressing(x, page))
    sizes = x.groupBy(page).agg(F.max(F.col("box.x") + F.col("box.w")).alias("page_w"), F.max(F.col("box.y") + F.col("box.h")).alias("page_h"))
    return x, written(sections(x, sizes, page, most=most))[0]


def section_pairs(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """page, l and r of sections (page, id, text, box) that belong together: the only ones of both sides, or the pairs
    with the highest scored_pairs(), one to one."""
    count = lambda d, c: d.groupBy(page).agg(F.count(F.lit(1)).alias(c), F.min("id").alias(f"{c}_id"))
    single = count(left, "a").join(count(right, "b"), page).where("a = 1 AND b = 1").select(page, F.col("a_id").alias("l"), F.col("b_id").alias("r"))
    middle = lambda d: d.join(single, page, "left_anti").select(page, "id", "text", (F.col("box.x") + F.col("box.w") / 2).alias("x"), (F.col("box.y") + F.col("box.h") / 2).alias("y"))
    return single.unionByName(paired_texts(middle(left), middle(right), page))


def _pair(page: str) -> Column:
    """A name of two matched sections; ids hold no vertical bar."""
    return F.concat_ws("|", F.col(page).cast("string"), "l", "r")


def section_leaves(nodes: DataFrame, pairs: DataFrame, page: str, side: str) -> DataFrame:
    """The leaves below (or that are) one side's sections, with pair, the name of both sections."""
    inner = nodes.select(page, "parent").where("parent IS NOT NULL").distinct()
    leaf = nodes.join(inner.select(page, F.col("parent").alias("id")), [page, "id"], "left_anti")
    up = leaf.select("*", F.explode(F.concat(F.array("id"), ancestors(F.col("id")))).alias(side))
    return up.join(pairs, [page, side]).select(page, _pair(page).alias("pair"), "id", "parent", "place", "text", "image", "box")


def _union_box(boxes: Column) -> Column:
    """The box around all of an array."""
    low = lambda p: F.array_min(F.transform(boxes, lambda b: b[p]))
    high = lambda p, s: F.array_max(F.transform(boxes, lambda b: b[p] + b[s]))
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h"))


def compared(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], page: str) -> DataFrame:
    """Of every page that has nodes on both sides: leaf_iou and section_iou (means), leaf_pairs, section_pairs, missing,
    extra, unmatched_left, unmatched_right, and regression. left and right are prepared() versions.

    Sections are matched first, then the text leaves of matched sections in three steps, then their images, to
    which unmatched right text leaves are added, anchored at the texts. Boxes of leaves are compared as shares
    of their sections, those of sections by size alone. A page is a regression if a mean is below SAME or
    anything is missing, extra or unmatched. Pages on one side only are not compared.
    """
    (a, a_ids), (b, b_ids) = left, right
    pages = a.select(page).distinct().join(b.select(page).distinct(), page, "left_semi")
    a_sections, b_sections = (written(x.select(page, "id", "text", "box").join(ids, [page, "id"], "left_semi"))[0] for x, ids in ((a, a_ids), (b, b_ids)))
    pairs, _ = written(section_pairs(a_sections, b_sections, page))
    la, _ = written(section_leaves(a, pairs, page, "l"))
    lb, _ = written(section_leaves(b, pairs, page, "r"))
    flat = lambda d: d.select("pair", "id", "parent", "place", "text", *[F.col(f"box.{k}").alias(n) for k, n in (("x", "left"), ("y", "top"), ("w", "w"), ("h", "h"))])
    texts, _ = written(text_matches(flat(la.where("NOT image")), flat(lb.where("NOT image")), "pair"))
    spot = lambda d, i, x, y: d.select("pair", F.col("id").alias(i), (F.col("box.x") + F.col("box.w") / 2).alias(x), (F.col("box.y") + F.col("box.h") / 2).alias(y), *([F.col("place")] if i == "l" else []))
    heads = texts.select("pair", F.col("lefts")[0].alias("l"), F.col("rights")[0].alias("r"))
    anchors, _ = written(heads.join(spot(la, "l", "x", "y"), ["pair", "l"]).join(spot(lb, "r", "x2", "y2"), ["pair", "r"]).select("pair", "place", "x", "y", "x2", "y2"))
    used = texts.select("pair", F.explode("rights").alias("id"))
    pictures = lb.where("image").unionByName(lb.where("NOT image").join(used, ["pair", "id"], "left_anti"))
    images = image_matches(flat(la.where("image")), flat(pictures), anchors, "pair")
    name = lambda d, c, s: d.select("pair", "n", F.explode(c).alias("place")).join(s.select("pair", "place", "id"), ["pair", "place"]).groupBy("pair", "n").agg(F.array_sort(F.collect_list("id")).alias(c))
    images, _ = written(images.withColumn("n", F.monotonically_increasing_id()))
    images = name(images, "lefts", la).join(name(images, "rights", lb), ["pair", "n"]).select("pair", "lefts", "rights")
    groups, _ = written(texts.select("pair", "lefts", "rights").unionByName(images).withColumn("n", F.monotonically_increasing_id()))

    def around(d: DataFrame, c: str) -> DataFrame:
        x = groups.select("pair", "n", F.explode(c).alias("id")).join(d.select("pair", "id", "box"), ["pair", "id"])
        return dealt(x.groupBy("pair", "n").agg(_union_box(F.collect_list("box")).alias(c)))

    own = lambda d, i, c: d.select(page, F.col("id").alias(i), F.col("box").alias(c))
    whole = pairs.join(own(a_sections, "l", "sa"), [page, "l"]).join(own(b_sections, "r", "sb"), [page, "r"]).select(page, _pair(page).alias("pair"), "sa", "sb")
    share = lambda b, s: F.struct(((b["x"] - s["x"]) / s["w"]).alias("x"), ((b["y"] - s["y"]) / s["h"]).alias("y"), (b["w"] / s["w"]).alias("w"), (b["h"] / s["h"]).alias("h"))
    leaf = around(la, "lefts").join(around(lb, "rights"), ["pair", "n"]).join(dealt(whole), "pair")
    leaf, _ = written(leaf.select(page, F.round(iou(share(F.col("lefts"), F.col("sa")), share(F.col("rights"), F.col("sb"))), 4).alias("iou")))
    at0 = lambda c: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col(c)["w"].alias("w"), F.col(c)["h"].alias("h"))
    size = whole.select(page, F.round(iou(at0("sa"), at0("sb")), 4).alias("iou"))
    exact = F.round(F.avg(F.round(F.col("iou") * 10_000)), 0) / 10_000  # sums of whole numbers, in whatever order
    mean = lambda d, v, n: dealt(d.groupBy(page).agg(exact.alias(v), F.count(F.lit(1)).alias(n)))
    gone = lambda d, c: d.join(groups.select("pair", F.explode(c).alias("id")), ["pair", "id"], "left_anti").select(page, "id").distinct()
    alone = lambda ids, side: ids.join(pairs.select(page, F.col(side).alias("id")), [page, "id"], "left_anti")
    count = lambda d, n: dealt(d.groupBy(page).agg(F.count(F.lit(1)).alias(n)))
    out = pages.join(mean(leaf, "leaf_iou", "leaf_pairs"), page, "left").join(mean(size, "section_iou", "section_pairs"), page, "left")
    faults = {"missing": gone(la, "lefts"), "extra": gone(lb, "rights"), "unmatched_left": alone(a_ids, "l"), "unmatched_right": alone(b_ids, "r")}
    for n, d in faults.items():
        out = out.join(count(d, n), page, "left")
    out = out.na.fill(0)
    verdict = structure_differs(F.least("leaf_iou", "section_iou"), *map(F.col, faults))
    return out.select(page, "leaf_iou", "section_iou", "leaf_pairs", "section_pairs", *faults, verdict.alias("regression"))
