"""Queries of filters, joins and further scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W, functions as F

from ..functions.assets import source_asset
from ..sources.tables import table
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

N = F.lit  # a function: a column is only made within a session


def first_match(text, rules, default=None):
    """The value of the first rule (value, needle) whose needle the text holds."""
    return reduce(lambda rest, r: F.when(F.contains(text, F.lit(r[1])), F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(default))


# Parts of file names and the producers that they show; the first one found decides.
PRODUCERS = [
    ("codex", "_template_codex_"), ("opencode", "_template_opencodegpt41_"), ("opencode", "_template_opencodegpt51codex_"),
    ("opencode", "_template_opencode_"), ("aider", "_template_aider_"), ("claude", "_template_claudecode_"),
]


def producer(path):
    """The producer of a file, by its name without its folders."""
    return first_match(F.substring_index(path, "/", -1), PRODUCERS, "unknown")


def demo(least_gain: float, most_lines: int = 300):
    """Whether a run serves as an example: valid, without regression, with a positive score, a gain over the baseline of
    least_gain per cent or more, a patch of at most most_lines lines and a plan that says something."""
    gain = F.when((F.col("baseline") > 0) & F.col("result").isNotNull(), (F.col("baseline") - F.col("result")) / F.col("baseline") * 100).otherwise(0.0)
    lines = F.size(F.split(F.regexp_replace("patch", "\n$", ""), "\n"))
    return F.coalesce(F.col("valid"), F.lit(False)) & ~F.coalesce(F.col("regression"), F.lit(False)) & (F.col("score") > 0) & (gain >= least_gain) & (lines <= most_lines) & (F.trim(F.regexp_replace("plan", "\\s+", " ")) != "")


def case_sql(text, rules, default="NULL"):
    return "CASE " + " ".join(f"WHEN contains({text}, '{n}') THEN '{v}'" for v, n in rules) + f" ELSE {default} END"



RUNS = ["12_template_codex_a.json", "12_template_opencodegpt41_a.json", "x_template_opencodegpt51codex_b", "_template_opencode_", "3_template_aider_x", "4_template_claudecode_y", "notes.txt", "codex.json"]


@query("SELECT page_id, ['codex', 'opencode', 'opencode', 'opencode', 'aider', 'claude', 'unknown', 'unknown'][CAST(page_id % 8 AS BIGINT) + 1] AS agent FROM pages")
def fn_agent_from_path(spark, sf):
    name = F.concat(F.lit("a/_template_codex_dir/"), F.get(F.array(*map(F.lit, RUNS)), (F.col("page_id") % 8).cast("int")))
    return table(spark, sf, "pages").select("page_id", producer(name).alias("agent"))


SLUG = "lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '__org' || s_nationkey || '__' || s_name || '__host.sh'"


@query(f"SELECT s_suppkey, regexp_extract({SLUG}, '^([0-9]+)__', 1) AS id, regexp_extract({SLUG}, '^[0-9]+__(.*?)__(.*?)__', 1) || '/' || regexp_extract({SLUG}, '^[0-9]+__(.*?)__(.*?)__', 2) AS repo FROM supplier")
def fn_slug_split(spark, sf):
    slug = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), F.lit("__org"), "s_nationkey", F.lit("__"), "s_name", F.lit("__host.sh"))
    part = lambda k: F.regexp_extract(slug, "^([0-9]+)__(.*?)__(.*?)__", k)
    return table(spark, sf, "supplier").select("s_suppkey", part(1).alias("id"), F.concat(part(2), F.lit("/"), part(3)).alias("repo"))


LANGUAGES = {"js": "JavaScript", "ts": "TypeScript", "css": "CSS", "html": "HTML"}


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'CSS' WHEN 3 THEN 'HTML' ELSE 'Other' END AS language FROM part")
def fn_ext_language(spark, sf):
    ends = F.array(*map(F.lit, ["JS", "ts", "min.css", "html", "xyz", "d/none"]))
    path = F.concat(F.lit("src/"), "p_name", F.lit("."), F.get(ends, F.col("p_size") % 6))
    by_end = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.try_element_at(by_end, F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))), F.lit("Other")).alias("language"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Section-A' || n_nationkey WHEN 1 THEN 'Section-B' ELSE 'Leaf-' || n_nationkey END AS label FROM nation")
def fn_label_norm(spark, sf):
    k = F.col("n_nationkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Section.A"), k)).when(k % 3 == 1, "SectionB").otherwise(F.concat(F.lit("leaf "), k))
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_replace(F.regexp_replace(raw, "^(?i:section)[. ]?(?=[A-Z])", "Section-"), "^(?i:leaf)[ .]?(?=[0-9])", "Leaf-").alias("label"))


@query("WITH s AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS total FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN total > 20000 THEN left(text, CAST(floor(length(text) * (20000 / total)) AS BIGINT)) ELSE text END AS text FROM documents d JOIN s ON s.source IS NOT DISTINCT FROM d.source")
def fn_proportional_trim(spark, sf):
    """Each file of a group cut in proportion, so that the group keeps at most 20000 characters."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    s = d.groupBy(F.col("source").alias("_s")).agg(F.sum(F.length("text")).alias("total"))
    cut = F.left("text", F.floor(F.length("text") * (F.lit(20000) / F.col("total"))).cast("int"))
    return d.join(s, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", F.when(F.col("total") > 20000, cut).otherwise(F.col("text")).alias("text"))


@query("SELECT p_partkey, CAST(round(p_size * 2.0, 1) AS DOUBLE) AS performance, CAST(0 AS DOUBLE) AS seo FROM part")
def fn_psi_scores(spark, sf):
    """Category scores times 100, missing ones as 0."""
    audit = F.concat(F.lit('{"performance": {"score": '), (F.col("p_size") / 50).cast("string"), F.lit('}, "seo": {"score": null}}'))
    x = table(spark, sf, "part").select("p_partkey", F.from_json(audit, "map<string, struct<score:double>>").alias("c"))
    score = lambda k: F.round(F.coalesce(F.try_element_at("c", F.lit(k))["score"], F.lit(0.0)) * 100, 1).alias(k)
    return x.select("p_partkey", score("performance"), score("seo"))


@query("""WITH e AS (SELECT vec_id, i, CAST(a.embedding[i] AS DOUBLE) * 128 AS x, CAST(b.embedding[i] AS DOUBLE) * 128 AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings) b USING (vec_id)),
 m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM e GROUP BY 1)
SELECT vec_id, round((2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)), 6) AS ssim FROM m""")
def fn_global_ssim(spark, sf):
    """Structural similarity over one window: means, population variances and covariance of two images."""
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    e = a.join(b, "vec_id").select("vec_id", F.explode(F.arrays_zip("a", "b")).alias("p")).select("vec_id", (F.col("p.a") * 128).alias("x"), (F.col("p.b") * 128).alias("y"))
    m = e.groupBy("vec_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    return m.select("vec_id", F.round(F.expr("(2 * mx * my + 6.5025D) * (2 * c + 58.5225D) / ((mx * mx + my * my + 6.5025D) * (vx + vy + 58.5225D))"), 6).alias("ssim"))


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL AND event_id % 9 <> 0")
def flt_clean_cell(spark, sf):
    """Cells that parse, are no error and hold the signal."""
    cell = F.when(F.col("event_id") % 9 == 0, N('{"k": ')).otherwise(F.col("props"))
    return table(spark, sf, "events").where((F.col("event_type") != "error") & F.get_json_object(cell, "$.k").isNotNull()).select("event_id")


@query("WITH d AS (SELECT user_id, bool_or(event_id % 2 = 0 AND event_type <> 'error') AS mobile, bool_or(event_id % 2 = 1 AND value > 300) AS desktop FROM events GROUP BY 1) SELECT count(*) FILTER (mobile AND desktop) AS kept_both, count(*) FILTER (mobile OR desktop) AS kept_either, count(*) FILTER (mobile AND NOT desktop) AS desktop_only, count(*) FILTER (desktop AND NOT mobile) AS mobile_only FROM d")
def flt_require_both_either(spark, sf):
    """Keys that either rule keeps; desktop_only counts those of which only the desktop side failed."""
    half = lambda k, c: F.bool_or((F.col("event_id") % 2 == k) & c)
    d = table(spark, sf, "events").groupBy("user_id").agg(half(0, F.col("event_type") != "error").alias("m"), half(1, F.col("value") > 300).alias("d"))
    m, d_ = F.col("m"), F.col("d")
    return d.agg(F.count_if(m & d_).alias("kept_both"), F.count_if(m | d_).alias("kept_either"), F.count_if(m & ~d_).alias("desktop_only"), F.count_if(d_ & ~m).alias("mobile_only"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN value > 10 AND event_id % 50 > 0 WHEN 'click' THEN value > 10 ELSE event_id % 50 > 5 END AS strict FROM events")
def flt_usage_strict(spark, sf):
    v, t, kind = F.col("value") > 10, F.col("event_id") % 50, F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.when(kind == "view", v & (t > 0)).when(kind == "click", v).otherwise(t > 5).alias("strict"))


@query("SELECT event_id FROM events WHERE CASE event_type WHEN 'view' THEN value + event_id % 50 > 20 ELSE event_id % 50 > 0 END")
def flt_usage_lenient(spark, sf):
    t = F.col("event_id") % 50
    return table(spark, sf, "events").where(F.when(F.col("event_type") == "view", F.col("value") + t > 20).otherwise(t > 0)).select("event_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def flt_success_valid(spark, sf):
    return table(spark, sf, "labels").where(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), N(False))).select("doc_id")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal IS NOT NULL AND s_acctbal <> 0 AND s_suppkey > 0")
def flt_metric_present(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey > 0 and s_acctbal <> 0").select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > -0.99")
def flt_valid_sentinel(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal > -0.99").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size - 10 > 0 AND p_retailprice > 0 AND (p_retailprice - p_size * 30.0) / p_retailprice * 100 >= 5 AND p_size * 8 <= 300 AND p_partkey % 11 <> 0")
def flt_demo_gate(spark, sf):
    x = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 7 != 0).alias("valid"), (F.col("p_partkey") % 5 == 0).alias("regression"), (F.col("p_size") - 10).alias("score"),
        F.col("p_retailprice").alias("baseline"), (F.col("p_size") * 30.0).alias("result"), F.repeat(F.lit("+ x\n"), F.col("p_size") * 8).alias("patch"),
        F.when(F.col("p_partkey") % 11 == 0, " \n").otherwise("plan").alias("plan"),
    )
    return x.where(demo(5.0)).select("p_partkey")


KEPT_FILES = ["usage.json", "visual.json"]
ARTEFACTS = ["usage.json", "a.patch", "trace.log", "visual.json", "plan.md"]


@query("SELECT doc_id, ['usage.json', 'a.patch', 'trace.log', 'visual.json', 'plan.md'][CAST(doc_id % 5 AS BIGINT) + 1] AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 5 IN (0, 1, 3)")
def flt_bad_ids(spark, sf):
    """Artefacts that are kept (listed ones and patches) of ids that are not on the list of bad ones."""
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    file = F.get(F.array(*map(F.lit, ARTEFACTS)), (F.col("doc_id") % 5).cast("int"))
    x = table(spark, sf, "documents").join(bad, "doc_id", "left_anti").select("doc_id", file.alias("file"))
    return x.where(F.col("file").isin(KEPT_FILES) | F.endswith("file", F.lit(".patch")))


ASSETS = ["a/index.html", "a/app.js", "a/app.min.js", "etc/clientlibs/x.min.js", "s.css", "s.min.css", "img.png", "clientlibs/y.min.css"]


ADDRESSES = "regexp_extract_all(html, '(?:src|href)=\"([^\"]*)\"', 1)"


@query(f"""WITH x AS (SELECT page_id, url, {ADDRESSES} AS a, [{', '.join("'" + a + "'" for a in ASSETS)}] AS l FROM pages), y AS (SELECT page_id, unnest(list_append(list_append(a, url), l[page_id % 8 + 1])) AS path FROM x)
SELECT page_id, path FROM y WHERE path LIKE '%.html' OR path LIKE '%.js' AND (path LIKE '%clientlibs%' OR path NOT LIKE '%.min.js') OR path LIKE '%.css' AND (path LIKE '%clientlibs%' OR path NOT LIKE '%.min.css')""")
def flt_source_assets(spark, sf):
    """Of the addresses in each page, its own, and one of a list of assets: those of source files."""
    one = F.get(F.array(*map(F.lit, ASSETS)), (F.col("page_id") % 8).cast("int"))
    found = F.concat(F.regexp_extract_all("html", F.lit('(?:src|href)="([^"]*)"'), F.lit(1)), F.array("url", one))
    return table(spark, sf, "pages").select("page_id", F.explode(found).alias("path")).where(source_asset(F.col("path")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def flt_passed_branches(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000) & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("SELECT s_suppkey, max(value) FILTER (event_type = 'view') AS mobile_a, max(value) FILTER (event_type = 'click') AS desktop_a, min(value) FILTER (event_type = 'view') AS mobile_b, min(value) FILTER (event_type = 'click') AS desktop_b FROM supplier LEFT JOIN events ON user_id = s_suppkey GROUP BY 1")
def join_left_composite(spark, sf):
    """Two measures of two devices as four columns, by one aggregation and one join."""
    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("s_suppkey")).agg(F.max(of("view")).alias("mobile_a"), F.max(of("click")).alias("desktop_a"), F.min(of("view")).alias("mobile_b"), F.min(of("click")).alias("desktop_b"))
    return table(spark, sf, "supplier").select("s_suppkey").join(e, "s_suppkey", "left")


@query("SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'high') THEN c_name WHEN contains(lower(o_orderpriority), 'low') THEN s_name ELSE coalesce(c_name, s_name) END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 LEFT JOIN supplier ON s_suppkey = o_orderkey % 150")
def join_enrich_by_source(spark, sf):
    """From one of two dimensions, chosen by the row's source; else from the first that has the key."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    x = o.join(c, "o_custkey", "left").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 150, "left")
    kind = F.lower("o_orderpriority")
    name = F.when(F.contains(kind, N("high")), F.col("c_name")).when(F.contains(kind, N("low")), F.col("s_name")).otherwise(F.coalesce("c_name", "s_name"))
    return x.select("o_orderkey", name.alias("name"))


@query("SELECT l_orderkey, string_agg(DISTINCT p_partkey || '=' || p_size, ',' ORDER BY p_partkey || '=' || p_size) AS packages FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 25 GROUP BY 1")
def join_map_filter(spark, sf):
    """A map of the elements that the dimension knows; rows without any are left out."""
    p = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(p, "l_partkey")
    m = x.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "p_size"))).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], N("="), e["value"]))
    return m.select("l_orderkey", F.array_join(F.array_sort(pairs), ",").alias("packages"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'broken' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'missing' ELSE 'kept' END AS reason FROM customer")
def join_semi_gate(spark, sf):
    """Why a row goes or stays, by membership of its key in two sets."""
    keys = lambda c, n: table(spark, sf, "orders").where(c).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn(n, N(True))
    x = table(spark, sf, "customer").select("c_custkey").join(keys("o_totalprice > 400000", "a"), "c_custkey", "left").join(keys("o_orderstatus = 'F'", "b"), "c_custkey", "left")
    return x.select("c_custkey", F.when(F.col("a"), "broken").when(F.col("b").isNull(), "missing").otherwise("kept").alias("reason"))


@query("SELECT s_suppkey, max_by(event_type, event_id) FILTER (event_id % 4 = 1) AS mine, count(event_id) AS n FROM supplier LEFT JOIN events ON user_id = s_suppkey GROUP BY 1")
def join_task_annotation(spark, sf):
    """All tasks with one annotator's last label and the number of all labels."""
    mine = F.max_by("event_type", F.when(F.col("event_id") % 4 == 1, F.col("event_id")))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("s_suppkey")).agg(mine.alias("mine"), F.count(N(1)).alias("n"))
    return table(spark, sf, "supplier").select("s_suppkey").join(e, "s_suppkey", "left").select("s_suppkey", "mine", F.coalesce("n", N(0).cast("long")).alias("n"))


@query("WITH j AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS mobile, max(value) FILTER (event_type = 'click') AS desktop, max(value) FILTER (event_type = 'error') AS visual FROM events GROUP BY 1) SELECT user_id, mobile, desktop, visual, mobile IS NOT NULL OR desktop IS NOT NULL AS valid FROM j WHERE mobile IS NOT NULL OR desktop IS NOT NULL OR visual IS NOT NULL")
def join_tri_file(spark, sf):
    """One row per job from the files of its parts; valid if one of the two devices is there."""
    of = lambda k, n: table(spark, sf, "events").where(F.col("event_type") == k).groupBy("user_id").agg(F.max("value").alias(n))
    x = of("view", "mobile").join(of("click", "desktop"), "user_id", "full_outer").join(of("error", "visual"), "user_id", "full_outer")
    return x.withColumn("valid", F.col("mobile").isNotNull() | F.col("desktop").isNotNull())
