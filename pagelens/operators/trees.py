"""Trees of page elements: a row for each node, with its page, id (path of tags and places, parts joined by __),
tag, text, image flag and box. Pages are spread over tasks; what a rule needs from above or below a node comes
by joins on the beginnings of ids."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.htmltree import parse
from .boxes import ancestors, depth, not_contained
from .ordered import merged_intervals
from .rounds import dealt, folded, written

# Tags of images, and tags that only dress text.
IMAGES = frozenset("img svg canvas picture video".split())
DRESSING = "strong a sup sub span b i em u s del ins small big mark".split()
HIDDEN = frozenset("script style noscript template".split())

#: Characters of the pages whose elements are handed on together.
TOGETHER = 100_000
NODE = "id string, tag string, place int, depth int, text string, image boolean"


def _nodes(source: str):
    """Id, tag, place, depth, text and image flag of every element of a page, in document order.

    The page's visible text is held once; an element's text is a range of it.
    """
    texts, rows, length = [], [], 0
    stack = [(parse(source), "", 0, {}, False)]
    while stack:
        e, above, depth, counts, hidden = stack.pop()
        if isinstance(e, int):  # an element ends
            rows[e][5] = length
            continue
        if isinstance(e, str):
            if not hidden:
                texts.append(e)
                length += len(e)
            continue
        n = counts[e.tag] = counts.get(e.tag, 0) + 1
        id = f"{above}__{e.tag}_{n}" if above else f"{e.tag}_{n}"
        stack.append((len(rows), "", 0, counts, False))
        rows.append([id, e.tag, depth, e.tag in IMAGES, length, length])
        below, hidden = {}, hidden or e.tag in HIDDEN
        stack += [(kid, id, depth + 1, below, hidden) for kid in reversed(e.kids)]
    whole = "".join(texts)
    for place, (id, tag, depth, image, start, end) in enumerate(rows):
        yield id, tag, place, depth, whole[start:end].strip(), image


def build(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page and the elements of every page's HTML, in document order; text is all visible text below one.

    The tree is the one that a browser builds: html, head, body and table bodies that are left out are there,
    a paragraph, list item or cell ends where the next begins, and formatting that is open when a block ends
    goes on in the next. A page is parsed on its own, without a shuffle. Null and empty pages have no nodes.
    """

    kind = pages.schema[page].dataType.simpleString()
    schema = f"{page} {kind}, {NODE}"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                if source := source.as_py():
                    rows += [(key, *node) for node in _nodes(source)]
                    held += len(source)
                if held >= TOGETHER:  # small pages share a batch
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return pages.select(page, html).mapInArrow(run, schema)


def parent(id: Column) -> Column:
    """A node id without its last part; null at the top."""
    return F.try_element_at(ancestors(id), F.lit(-1))


def _without(nodes: DataFrame, page: str, gone: DataFrame) -> DataFrame:
    """nodes that stay, with parent as the nearest ancestor that stays, and image also if one was dropped
    below the node whose nearest ancestor it is. gone: page and id."""
    marked, _ = written(nodes.join(gone.select(page, "id").withColumn("gone", F.lit(True)), [page, "id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    stay = marked.where("not gone").select(page, F.col("id").alias("above"))
    up = marked.select(page, "id", "gone", "image", F.explode(ancestors(F.col("id"))).alias("above")).join(stay, [page, "above"])
    near, _ = written(up.groupBy(page, "id").agg(F.max_by("above", depth(F.col("above"))).alias("parent"), F.first("gone").alias("gone"), F.first("image").alias("image")))
    lit = near.where("gone and image").groupBy(page, F.col("parent").alias("id")).agg(F.lit(True).alias("lit"))
    out = marked.where("not gone").drop("gone").join(near.select(page, "id", "parent"), [page, "id"], "left").join(lit, [page, "id"], "left")
    return out.withColumn("image", F.col("image") | F.coalesce("lit", F.lit(False))).drop("lit")


def without_empty(nodes: DataFrame, page: str) -> DataFrame:
    """Nodes that hold text or an image themselves or below, without images of one pixel; parents as they were."""
    real = F.col("image") & ~((F.col("box.w") == 1) & (F.col("box.h") == 1))
    fills = nodes.where(real | ((F.trim("text") != "") & ~F.col("image")))
    filled = fills.select(page, F.explode(F.concat(F.array("id"), ancestors(F.col("id")))).alias("id")).distinct()
    pixel = F.col("image") & ~real
    return nodes.join(filled, [page, "id"], "left_semi").where(~pixel).withColumn("parent", parent(F.col("id")))


def without_dressing(nodes: DataFrame, page: str) -> DataFrame:
    """Nodes without the dressing tags of parents that hold other text too; what was below them moves up.

    A parent's dressing children go together: if their texts in document order don't make up its text.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    child = nodes.where(F.col("tag").isin(DRESSING)).select(page, "id", "place", "text", parent(F.col("id")).alias("above")).where("above is not null")
    texts = child.groupBy(page, "above").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))  # one element's children
    both = texts.join(nodes.select(page, F.col("id").alias("above"), F.col("text").alias("whole")), [page, "above"])
    mixed = both.where(squeezed(F.array_join(F.transform("all", lambda e: e["text"]), "")) != squeezed(F.col("whole"))).select(page, "above")
    return _without(nodes, page, child.join(mixed, [page, "above"], "left_semi"))


def without_single(nodes: DataFrame, page: str) -> DataFrame:
    """Nodes without sole children that add nothing: no larger than the node they collapse into, with its text, or
    an image in one without text. A chain collapses from the top, so a page is folded as one group."""
    kind = nodes.schema[page].dataType.simpleString()

    def fold(items: list) -> list[tuple]:
        rows = {r.id: r for r in items}
        above = {k: k.rpartition("__")[0] for k in rows}
        children = Counter(above.values())
        text, image, into = {k: r.text for k, r in rows.items()}, {k: r.image for k, r in rows.items()}, {}
        for k, r in rows.items():
            p = into.get(above[k])
            into[k] = k
            if p is not None and children[above[k]] == 1 and r.area <= rows[p].area and (r.text == text[p] or (r.image and not text[p].strip())):
                into[k] = p
                if r.image:
                    image[p], text[p] = True, text[p] + r.text
        return [(getattr(items[0], page), k, into.get(above[k]), text[k], image[k]) for k in rows if into[k] == k]

    area = F.coalesce((F.col("box.w") * F.col("box.h")).cast("double"), F.lit(float("nan")))
    x = nodes.select(page, "id", depth(F.col("id")).alias("depth"), "text", "image", area.alias("area"))
    return folded(x, page, ["depth"], fold, f"{page} {kind}, id string, parent string, text string, image boolean")


def merged_images(nodes: DataFrame, page: str) -> DataFrame:
    """Nodes where parents, all of whose two or more children are image leaves in one tight row or column, stand for
    them: as an image with their texts. A parent made so is not merged again."""
    up = nodes.withColumn("above", parent(F.col("id")))
    inner = up.where("above is not null").select(page, F.col("above").alias("id")).distinct().withColumn("inner", F.lit(True))
    up = up.join(inner, [page, "id"], "left").withColumn("leaf", F.col("image") & F.col("inner").isNull() & F.col("box").isNotNull())
    by = lambda *names: F.array_sort(F.collect_list(F.struct(*[F.col(f"box.{n}").alias(n) for n in names])))
    g = up.where("above is not null").groupBy(page, "above").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("leaf").alias("all"), by("x", "y", "w", "h").alias("row"), by("y", "x", "h", "w").alias("column"),
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts"),
    )

    def tight(boxes: str, along: str, size: str, across: str) -> Column:
        pairs = F.zip_with(F.slice(boxes, 1, F.size(boxes) - 1), F.slice(boxes, 2, F.size(boxes)), lambda a, b: (b[along] - (a[along] + a[size]) < 2) & (F.abs(a[across] - b[across]) < 10))
        return F.forall(pairs, lambda p: p)

    g = g.where((F.col("n") >= 2) & F.col("all")).where(tight("row", "x", "w", "y") | tight("column", "y", "h", "x"))
    words = F.filter(F.transform("texts", lambda e: e["text"]), lambda t: t != "")
    merged = g.select(page, F.col("above").alias("id"), F.trim(F.array_join(words, " ")).alias("joined"))
    gone = up.join(merged.select(page, F.col("id").alias("above")), [page, "above"], "left_semi").select(page, "id")
    x = nodes.join(gone, [page, "id"], "left_anti").join(merged, [page, "id"], "left")
    return x.withColumns({"image": F.col("image") | F.col("joined").isNotNull(), "text": F.coalesce("joined", "text")}).drop("joined")


def leaf_counts(nodes: DataFrame, page: str) -> DataFrame:
    """page, id and leaves: how many leaves lie below a node, 1 for a leaf."""
    inner = nodes.select(page, parent(F.col("id")).alias("id")).distinct()
    leaves = nodes.join(inner, [page, "id"], "left_anti")
    return leaves.select(page, F.explode(F.concat(F.array("id"), ancestors(F.col("id")))).alias("id")).groupBy(page, "id").agg(F.count(F.lit(1)).alias("leaves"))


def subdivided(nodes: DataFrame, sections: DataFrame, page: str, width: Column, most: int, ratio: float = 0.95) -> DataFrame:
    """page and id of sections (page, id), where those of more than most leaves give way to their children, again
    and again, as long as all children span ratio of the page's width (a column of nodes)."""
    up = nodes.select(page, parent(F.col("id")).alias("id"), (F.col("box.w") >= ratio * width).alias("wide"))
    wide = up.where("id is not null").groupBy(page, "id").agg(F.bool_and(F.coalesce("wide", F.lit(False))).alias("wide"))
    splits = leaf_counts(nodes, page).where(F.col("leaves") > most).join(wide.where("wide"), [page, "id"]).select(page, "id")
    below = nodes.select(page, "id", F.explode(F.concat(ancestors(F.col("id")), F.array("id"))).alias("top")).join(sections.select(page, F.col("id").alias("top")), [page, "top"])
    # a node is reached if every node from the section down to its parent splits
    path = below.select(page, "id", "top", F.explode_outer(F.filter(ancestors(F.col("id")), lambda a: (a == F.col("top")) | F.startswith(a, F.concat("top", F.lit("__"))))).alias("step"))
    path = path.join(splits.select(page, F.col("id").alias("step"), F.lit(True).alias("splits")), [page, "step"], "left")
    reached = path.groupBy(page, "id", "top").agg(F.bool_and(F.col("step").isNull() | F.coalesce("splits", F.lit(False))).alias("ok")).where("ok").select(page, "id").distinct()
    return reached.join(splits, [page, "id"], "left_anti")


def rolled_up(groups: DataFrame, page: str, group: str, node: str) -> DataFrame:
    """page, group and below: the deeper groups all of whose nodes have their parent in the group."""
    x = groups.select(page, group, F.col(node).alias("id")).withColumn("above", parent(F.col("id")))
    size = x.groupBy(page, group).agg(F.count(F.lit(1)).alias("n"), F.max(depth(F.col("id"))).alias("d"))
    lower = x.select(page, F.col(group).alias("below"), "id", "above")
    held = lower.join(x.select(page, group, F.col("id").alias("above")).distinct(), [page, "above"])
    held = held.groupBy(page, group, "below").agg(F.count(F.lit(1)).alias("held"))
    held = held.join(size, [page, group]).withColumnRenamed("d", "own").drop("n")
    held = held.join(size.select(page, F.col(group).alias("below"), "n", "d"), [page, "below"])
    return held.where("held = n and d > own").select(page, group, "below")


def sections(nodes: DataFrame, sizes: DataFrame, page: str, tallest: float = 2900.0, most: int | None = None) -> DataFrame:
    """page and id of each page's sections; sizes holds page, page_w and page_h.

    Nodes taller than tallest or nine tenths of the page are left out. The content's width is the commonest
    width (in tens, of those of 0.3 of the page and more; the page's own from 0.95 of it on). Sections are
    nodes that span 0.95 of it, and nodes of horizontal bands (20 pixels apart at most) that span it
    together; those inside a larger one go. Gaps between them are filled by the nodes inside, the topmost
    and widest first, each unless its height lies within one taken before. Of boxes of one size that hold each
    other those of bands stay, the topmost first, then the first in the page. With most, sections of more
    leaves give way to their children, see subdivided(); ids are paths then.
    """
    w, h, y = F.col("box.w"), F.col("box.h"), F.col("box.y")
    x = nodes.select(page, "id", "place", "box").join(sizes, page).where((h <= 0.9 * F.col("page_h")) & (h <= tallest))
    widths = x.where(w >= 0.3 * F.col("page_w")).groupBy(page, (F.bround(w / 10) * 10).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    common = widths.groupBy(page).agg(F.max_by("r", F.struct("n", -F.col("first"))).alias("r"))
    x = x.join(dealt(common), page, "left")
    x = x.withColumn("content", F.when(F.col("r").isNull() | (F.col("r") >= 0.95 * F.col("page_w")), F.col("page_w")).otherwise(F.col("r"))).drop("r")
    x, _ = written(x)
    wide = w >= 0.95 * F.col("content")
    down = W.partitionBy(page).orderBy("box.y", "place")
    before = W.unboundedPreceding
    rest = x.where(~wide).withColumn("reach", F.max(y + h).over(down.rowsBetween(before, -1)))
    rest = rest.withColumn("band", F.sum(F.when(y <= F.col("reach") + 20, 0).otherwise(1)).over(down.rowsBetween(before, 0)))
    across = W.partitionBy(page, "band").orderBy("box.x", "place").rowsBetween(before, -1)
    left, right = F.col("box.x"), F.col("box.x") + w
    rest = rest.withColumn("new", F.greatest(F.lit(0.0), right - F.greatest(left, F.coalesce(F.max(right).over(across), left))))
    bands = rest.groupBy(page, "band").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("covered"), F.first("content").alias("of")).where("n > 1 and covered >= 0.95 * of")
    first = lambda d, full: d.select(page, "place", "box", F.struct(F.lit(full).alias("full"), F.when(F.lit(full == 0), y).otherwise(0.0).alias("y")).alias("tie"))
    chosen, _ = written(first(rest.join(bands.select(page, "band"), [page, "band"], "left_semi"), 0).unionByName(first(x.where(wide), 1)))
    kept = not_contained(chosen, page, "place", "box", tie="tie")
    boxes, _ = written(x.select(page, "place", "id", "box").join(kept, [page, "place"], "left_semi"))
    spans = merged_intervals(boxes.select(page, y.alias("low0"), (y + h).alias("high0")), page, "low0", "high0").select(page, "low", "high")
    order = W.partitionBy(page).orderBy("low")
    gaps = spans.select(page, F.coalesce(F.lag("high").over(order), F.lit(0.0)).alias("from"), F.col("low").alias("to"))
    ends = sizes.select(page, "page_h").join(spans.groupBy(page).agg(F.max("high").alias("high")), page, "left")
    gaps = gaps.unionByName(ends.select(page, F.coalesce("high", F.lit(0.0)).alias("from"), F.col("page_h").alias("to"))).where("`from` < `to`")
    inside = x.join(gaps, page).where((y >= F.col("from")) & (y + h <= F.col("to")))
    one = F.struct(y.alias("y"), (-w).alias("w"), "place", "id", (y + h).alias("end"))
    fill = inside.groupBy(page).agg(F.array_sort(F.collect_set(one)).alias("all"))
    took = F.aggregate("all", F.slice("all", 1, 0), lambda done, e: F.when(F.exists(done, lambda d: (e["y"] >= d["y"]) & (e["end"] <= d["end"])), done).otherwise(F.array_append(done, e)))
    found = boxes.select(page, "id").unionByName(fill.select(page, F.explode(F.transform(took, lambda e: e["id"])).alias("id"))).distinct()
    if most is None:
        return found
    return subdivided(nodes.join(x.select(page, "content").distinct(), page), found, page, F.col("content"), most)
