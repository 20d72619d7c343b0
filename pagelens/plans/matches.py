"""Queries of matches between page elements, of console noise and of source files."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.noise import NOISE, noise
from ..operators import boxes as b, matching as m, ordered as o
from ..sources.files import is_source
from ..sources.tables import table
from .boxes import TREE, _tree
from .libraries import _case, _case_sql
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

TEXTS = [t for texts in NOISE.values() for t in texts]
CATEGORIES = [name for name, texts in NOISE.items() for _ in texts]


@query(f"""WITH p AS (SELECT unnest([{', '.join("'" + t.replace("'", "''") + "'" for t in TEXTS)}]) AS t, unnest({CATEGORIES}) AS c, unnest(range({len(TEXTS)})) AS i),
 x AS (SELECT doc_id, text || {_case_sql(TEXTS + ['plain'], 'doc_id')} || CASE WHEN doc_id % 5 = 0 THEN 'SameSite' ELSE '' END AS t FROM documents)
SELECT doc_id, arg_min(p.c, p.i) AS category FROM x JOIN p ON contains(x.t, p.t) GROUP BY 1""")
def flt_noise_error(spark, sf):
    """Messages that hold a noise pattern, with the first one's category."""
    message = F.concat("text", _case(TEXTS + ["plain"], "doc_id"), F.when(F.col("doc_id") % 5 == 0, "SameSite").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", noise(message).alias("category")).where("category is not null")


@query()
def txt_seqmatcher(spark, sf):
    """Similarity of each part's name and type with the next one's."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", m.ratio(F.col("a"), F.col("b")).alias("ratio"))


def _sides(spark, sf):
    """Parts in pages of 20: even keys on the left, odd ones on the right."""
    k = F.col("p_partkey")
    x = table(spark, sf, "part").select(F.floor(k / 20).alias("page"), k.alias("id"), F.col("p_name").alias("text"), (F.col("p_size") * 10.0).alias("x"), (k % 20 * 30.0).alias("y"))
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


@query()
def join_pairwise_score(spark, sf):
    return m.scored_pairs(*_sides(spark, sf), "page")


@query()
def match_sections(spark, sf):
    """One-to-one matches of the scored pairs, best first."""
    return b.greedy_pairs(m.scored_pairs(*_sides(spark, sf), "page").withColumn("score", F.round("score", 6)), "page", "l", "r", "score")


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, 'a' || l_partkey % 7 AS l, 'b' || l_suppkey % 5 AS r FROM lineitem),
 s(page, i, g) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS STRUCT(l VARCHAR[], r VARCHAR[])[]) FROM p UNION ALL
  SELECT p.page, p.i, CASE WHEN h IS NULL THEN list_append(g, {'l': [p.l], 'r': [p.r]}) ELSE list_transform(g, lambda e, k: CASE WHEN k = h THEN {'l': list_sort(list_distinct(list_append(e.l, p.l))), 'r': list_sort(list_distinct(list_append(e.r, p.r)))} ELSE e END) END
  FROM (SELECT s.page, s.g, p.i, p.l, p.r, coalesce(list_position(list_transform(s.g, lambda e: list_contains(e.l, p.l)), true), list_position(list_transform(s.g, lambda e: list_contains(e.r, p.r)), true)) AS h FROM s JOIN p ON p.page = s.page AND p.i = s.i + 1) p)
SELECT page, CAST(k - 1 AS INTEGER) AS grp, array_to_string(g[k].l, ',') AS lefts, array_to_string(g[k].r, ',') AS rights FROM (SELECT page, g, unnest(range(1, len(g) + 1)) AS k FROM (SELECT page, arg_max(g, i) AS g FROM s GROUP BY 1))""")
def match_merge_groups(spark, sf):
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), place.alias("place"), F.array(F.concat(F.lit("a"), F.col("l_partkey") % 7)).alias("lefts"), F.array(F.concat(F.lit("b"), F.col("l_suppkey") % 5)).alias("rights"))
    return m.merged_groups(x, "page").select("page", "grp", F.array_join("lefts", ",").alias("lefts"), F.array_join("rights", ",").alias("rights"))


@query(f"""WITH {TREE}, n AS (SELECT id FROM t WHERE NOT regexp_matches(id, 'n[0-9]*[05]$')), g AS (SELECT n_nationkey AS section, 'r' || n_regionkey || '__n' || n_nationkey AS target FROM nation)
SELECT DISTINCT section, id FROM g JOIN n ON n.id = target OR starts_with(n.id, target || '__') AND target NOT IN (SELECT id FROM n)""")
def match_json_prefix(spark, sf):
    nodes = _tree(spark, sf).where(~F.col("id").rlike("n[0-9]*[05]$")).withColumn("page", F.lit(1))
    given = table(spark, sf, "nation").select(F.lit(1).alias("page"), F.col("n_nationkey").alias("section"), F.concat(F.lit("r"), "n_regionkey", F.lit("__n"), "n_nationkey").alias("target"))
    return m.given_or_below(given, nodes, "page").select("section", "id")


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT page, vec_id, best FROM (SELECT a.vec_id // 40 AS page, a.vec_id, b.vec_id AS best, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id // 40 = b.vec_id // 40 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE r = 1")
def match_embedding(spark, sf):
    """Vectors in pages of 40: even keys on the left, odd ones on the right."""
    x = table(spark, sf, "embeddings").withColumn("page", F.floor(F.col("vec_id") / 40))
    return m.best_by_vector(x.where("vec_id % 2 = 0"), x.where("vec_id % 2 = 1"), "page", "vec_id", "embedding")


PATHS = ["src/app.JS", "node_modules/x.js", "a/b/page.vue", "lib/jquery.min.js", "README.md", "x/.git/y.html", "img/a.png", "dist/index.html", "views/a.jinja2"]


@query(f"SELECT p_partkey, path FROM (SELECT p_partkey, {_case_sql(PATHS, 'p_partkey')} AS path FROM part) WHERE path IN ('src/app.JS', 'a/b/page.vue', 'README.md', 'views/a.jinja2')")
def src_repo_files(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _case(PATHS, "p_partkey").alias("path")).where(is_source(F.col("path")))


@query("""WITH s AS (SELECT s_suppkey, s_acctbal AS x, CAST(s_suppkey % 10 AS DOUBLE) AS y, s_suppkey % 100 AS h FROM supplier), u AS (SELECT arg_max(s_suppkey, (x, -s_suppkey)) AS s_suppkey FROM s GROUP BY h), p AS (SELECT s.* FROM s JOIN u USING (s_suppkey)),
 f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
 g AS (SELECT s_suppkey, lead(x) OVER a - lag(x) OVER a AS gx, lead(y) OVER b - lag(y) OVER b AS gy, max(x) OVER () - min(x) OVER () AS rx, max(y) OVER () - min(y) OVER () AS ry FROM f WINDOW a AS (ORDER BY x, s_suppkey), b AS (ORDER BY y, s_suppkey))
SELECT s_suppkey, round(d, 6) AS distance FROM (SELECT s_suppkey, CASE WHEN gx IS NULL OR gy IS NULL THEN CAST('infinity' AS DOUBLE) ELSE coalesce(gx / nullif(rx, 0), 0) + coalesce(gy / nullif(ry, 0), 0) END AS d FROM g) ORDER BY d DESC, s_suppkey LIMIT 4""")
def opt_select_parents(spark, sf):
    """The four points of the front with most room around them; of one configuration's points the best counts."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"), (F.col("s_suppkey") % 100).alias("h"))
    one = o.latest(s, ["h"], F.desc("x"), F.col("s_suppkey"))
    front = o.pareto(one, "s_suppkey", ["x", "y"])
    return o.crowding(front, "s_suppkey", ["x", "y"]).orderBy(F.desc("distance"), "s_suppkey").limit(4).withColumn("distance", F.round("distance", 6))


@query()
def match_text_3pass(spark, sf):
    """Names of parts in pages of 20 as leaves: every third right one cut in two, every fourth left one lengthened."""
    k = F.col("p_partkey")
    x = table(spark, sf, "part").select(F.floor(k / 20).alias("page"), k.cast("string").alias("id"), (k % 20 / 4).cast("int").cast("string").alias("parent"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), (k % 4 * 100.0).alias("left"), (k % 20 * 30.0).alias("top"), F.lit(90.0).alias("w"), F.lit(28.0).alias("h"))
    left = x.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    cut = F.when(F.col("id") % 3 == 0, F.array(F.left("text", half), F.call_function("substr", "text", half + 1))).otherwise(F.array("text"))
    right = x.select(*[c for c in x.columns if c != "text"], F.posexplode(cut).alias("n", "text")).withColumns({"id": F.concat_ws("-", "id", "n"), "left": F.col("left") + F.col("n") * 40})
    return m.text_matches(left, right.drop("n"), "page").select("page", "step", F.array_join("lefts", ",").alias("lefts"), F.array_join("rights", ",").alias("rights"))


def image_sides(spark, sf):
    """Parts in pages of 40, every fourth an image, on a board 60 apart; the right page is moved, some of its images
    are missing and some texts longer. The others are matched texts, but on every fifth page."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x = table(spark, sf, "part").select(F.floor(k / 40).alias("page"), k.alias("place"), F.when(k % 8 == 0, F.col("p_name")).otherwise("").alias("text"), (k % 5 * 60.0 + size).alias("left"), (F.floor(k % 40 / 5) * 60.0).alias("top"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"))
    left = x.where("place % 4 = 0")
    moved = x.withColumns({"left": F.col("left") + F.col("page") % 7 * 25, "top": F.col("top") + F.col("place") % 40 * 4 - F.col("place") % 3 * 30})
    right = moved.where("place % 4 = 0 AND place % 28 <> 0").withColumn("text", F.when(F.col("place") % 3 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    middle = lambda d, a, b: d.where("place % 4 <> 0 AND page % 5 <> 0").select("page", "place", (F.col("left") + 20).alias(a), (F.col("top") + 15).alias(b))
    return left, right, middle(x, "x", "y").join(middle(moved, "x2", "y2"), ["page", "place"])


@query()
def match_image_anchor(spark, sf):
    return m.image_matches(*image_sides(spark, sf), "page").select("page", "step", F.array_join("lefts", ",").alias("lefts"), F.array_join("rights", ",").alias("rights"))
