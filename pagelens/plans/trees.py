"""Queries of trees of page elements: built from pages, or made from regions, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import regression as r, trees as t
from ..operators.rounds import written
from ..sources.tables import table
from .boxes import TREE, _boxes, _tree
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

# number of a node's last part decides tag, text, image and box
NODES = f"""{TREE}, k AS (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS k, row_number() OVER (ORDER BY id) - 1 AS place FROM t),
 n AS (SELECT 1 AS page, id, place, ['div', 'a', 'span', 'p', 'b'][k % 5 + 1] AS tag, CASE WHEN k % 3 = 0 THEN '' ELSE 'w' || k % 4 END AS text, k % 7 < 2 AS image,
  k % 10 * 10.0 AS x, k % 2 * 5.0 AS y, CASE WHEN k % 7 = 1 THEN 1.0 ELSE 10.0 + k % 3 END AS w, CASE WHEN k % 7 = 1 THEN 1.0 ELSE 12.0 END AS h, CASE WHEN contains(id, '__') THEN regexp_extract(id, '^(.*)__[^_]*$', 1) END AS up FROM k)"""


def _nodes(spark, sf):
    ids = _tree(spark, sf)
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    x = ids.withColumn("k", k).withColumn("part", F.get(F.split("id", "__"), F.lit(0)))
    # places count within a region, which is enough to order children
    x = x.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("id")) - 1)
    kk = F.col("k")
    box = F.struct((kk % 10 * 10.0).alias("x"), (kk % 2 * 5.0).alias("y"), F.when(kk % 7 == 1, 1.0).otherwise(10.0 + kk % 3).alias("w"), F.when(kk % 7 == 1, 1.0).otherwise(12.0).alias("h"))
    tag = F.get(F.array(*map(F.lit, ["div", "a", "span", "p", "b"])), (kk % 5).cast("int"))
    return x.select(F.lit(1).alias("page"), "id", "place", tag.alias("tag"), F.when(kk % 3 == 0, "").otherwise(F.concat(F.lit("w"), kk % 4)).alias("text"), (kk % 7 < 2).alias("image"), box.alias("box"))


@query()
def geo_tree_build(spark, sf):
    """Every page's elements; checked against a second reading of the pages in tests/test_trees.py."""
    return t.build(table(spark, sf, "pages"), "page_id", "html")


@query(f"WITH {NODES}, f AS (SELECT id FROM n WHERE image AND k_pixel IS NULL OR NOT image AND trim(text) <> ''), d AS (SELECT DISTINCT n.id FROM n JOIN f ON f.id = n.id OR starts_with(f.id, n.id || '__')) SELECT id, up AS parent FROM n JOIN d USING (id) WHERE NOT (image AND w = 1 AND h = 1)".replace("k_pixel IS NULL", "NOT (w = 1 AND h = 1)"))
def geo_prune_empty(spark, sf):
    return t.without_empty(_nodes(spark, sf), "page").select("id", "parent")


DRESS = "('strong', 'a', 'sup', 'sub', 'span', 'b', 'i', 'em', 'u', 's', 'del', 'ins', 'small', 'big', 'mark')"


@query(f"""WITH {NODES}, c AS (SELECT up, string_agg(text, '' ORDER BY place) AS s FROM n WHERE tag IN {DRESS} AND up IS NOT NULL GROUP BY 1),
 m AS (SELECT c.up FROM c JOIN n ON n.id = c.up WHERE trim(regexp_replace(s, '\\s+', ' ', 'g')) <> trim(regexp_replace(text, '\\s+', ' ', 'g'))),
 z AS (SELECT *, tag IN {DRESS} AND up IS NOT NULL AND up IN (SELECT up FROM m) AS gone FROM n),
 p AS (SELECT a.id, arg_max(b.id, length(b.id)) AS parent FROM z a JOIN z b ON NOT b.gone AND starts_with(a.id, b.id || '__') GROUP BY 1),
 l AS (SELECT parent AS id FROM p JOIN z USING (id) WHERE gone AND image GROUP BY 1)
SELECT z.id, p.parent, z.image OR l.id IS NOT NULL AS image FROM z LEFT JOIN p USING (id) LEFT JOIN l ON l.id = z.id WHERE NOT gone""")
def geo_prune_subtext(spark, sf):
    return t.without_dressing(_nodes(spark, sf), "page").select("id", "parent", "image")


@query()
def geo_prune_single(spark, sf):
    """The elements of pages, with boxes that shrink by one a level; checked on small trees in the tests."""
    x = t.build(table(spark, sf, "pages"), "page_id", "html")
    side = 1000.0 - F.col("depth")
    return t.without_single(x.withColumn("box", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), side.alias("w"), side.alias("h"))), "page_id")


@query(f"""WITH {NODES.replace('k % 7 < 2 AS image', "contains(id, 's') AS image")}, i AS (SELECT DISTINCT up AS id FROM n WHERE up IS NOT NULL), c AS (SELECT n.*, image AND n.id NOT IN (SELECT id FROM i) AS leaf FROM n WHERE up IS NOT NULL),
 a AS (SELECT up, count(*) AS n, bool_and(leaf) AS leaves, trim(coalesce(string_agg(text, ' ' ORDER BY place) FILTER (text <> ''), '')) AS joined FROM c GROUP BY 1),
 r AS (SELECT up, bool_and(coalesce(x - px < 2 AND abs(y - py) < 10, true)) AS tight FROM (SELECT up, x, y, lag(x + w) OVER o AS px, lag(y) OVER o AS py FROM c WINDOW o AS (PARTITION BY up ORDER BY x, y, w, h)) GROUP BY 1),
 s AS (SELECT up, bool_and(coalesce(y - py < 2 AND abs(x - px) < 10, true)) AS tight FROM (SELECT up, x, y, lag(y + h) OVER o AS py, lag(x) OVER o AS px FROM c WINDOW o AS (PARTITION BY up ORDER BY y, x, h, w)) GROUP BY 1),
 m AS (SELECT a.up AS id, joined FROM a JOIN r USING (up) JOIN s USING (up) WHERE n >= 2 AND leaves AND (r.tight OR s.tight))
SELECT n.id, n.image OR m.id IS NOT NULL AS image, coalesce(joined, text) AS text FROM n LEFT JOIN m USING (id) WHERE up IS NULL OR up NOT IN (SELECT id FROM m)""")
def geo_merge_images(spark, sf):
    x = _nodes(spark, sf).withColumn("image", F.contains("id", F.lit("s")))
    return t.merged_images(x, "page").select("id", "image", "text")


LEAVES = "l AS (SELECT n.id, count(*) AS leaves FROM n JOIN n f ON (f.id = n.id OR starts_with(f.id, n.id || '__')) AND NOT EXISTS (SELECT 1 FROM n c WHERE c.up = f.id) GROUP BY 1)"


@query(f"""WITH RECURSIVE {NODES}, {LEAVES}, w AS (SELECT up AS id, bool_and(w >= 9.5) AS wide FROM n WHERE up IS NOT NULL GROUP BY 1), s AS (SELECT l.id FROM l JOIN w USING (id) WHERE leaves > 2 AND wide),
 q(id) AS (SELECT id FROM n WHERE up IS NULL UNION ALL SELECT n.id FROM q JOIN s ON s.id = q.id JOIN n ON n.up = q.id) SELECT id FROM q WHERE id NOT IN (SELECT id FROM s)""")
def geo_subdivide(spark, sf):
    x = _nodes(spark, sf)
    return t.subdivided(x, x.where(~F.contains("id", F.lit("__"))), "page", F.lit(10.0), 2).select("id")


@query(f"""WITH {NODES}, g AS (SELECT id, up, len(string_split(id, '__')) AS d, len(string_split(id, '__')) || '-' || string_split(id, '__')[1] AS g FROM n), z AS (SELECT g, count(*) AS n, max(d) AS d FROM g GROUP BY 1),
 h AS (SELECT p.g AS "group", c.g AS below, count(*) AS held FROM g c JOIN g p ON p.id = c.up GROUP BY 1, 2) SELECT h."group", h.below FROM h JOIN z a ON a.g = h."group" JOIN z b ON b.g = h.below WHERE held = b.n AND b.d > a.d""")
def geo_depth_rollup(spark, sf):
    d = F.size(F.split("id", "__"))
    group = F.concat_ws("-", d, F.get(F.split("id", "__"), F.lit(0)))
    return t.rolled_up(_nodes(spark, sf).withColumn("group", group), "page", "group", "id").select("group", "below")


@query()
def geo_sections(spark, sf):
    """Sections of pages of 50 boxes; checked on small pages in the tests."""
    x = _boxes(spark, sf).select(F.col("label").alias("page"), F.col("vec_id").cast("string").alias("id"), "vec_id", "box").withColumn("place", F.col("vec_id"))
    sizes = x.groupBy("page").agg(F.max(F.col("box.x") + F.col("box.w")).alias("page_w"), F.max(F.col("box.y") + F.col("box.h")).alias("page_h"))
    return t.sections(x, sizes, "page")


def versions(spark, sf):
    """Pages and a second version of each: as it was, with an image before the footer, without a paragraph, or with a
    longer heading."""
    x = table(spark, sf, "pages").select("page_id", "html")
    image, less, longer = F.replace("html", F.lit("<footer>"), F.lit('<p><img src="a.png"></p><footer>')), F.regexp_replace("html", "<p>[^<]*</p></article>", "</article>"), F.replace("html", F.lit("</h1>"), F.lit(" and more of it</h1>"))
    return x, x.withColumn("html", F.element_at(F.array(F.col("html"), image, less, longer), (F.col("page_id") % 4 + 1).cast("int")))


@query()
def eval_pages(spark, sf):
    """Both versions of every page from its source to the verdict: trees, boxes, sections, matches, overlaps."""
    a, b = (r.prepared(r.stacked(written(t.build(v, "page_id", "html"))[0], "page_id"), "page_id") for v in versions(spark, sf))
    return r.compared(a, b, "page_id")
