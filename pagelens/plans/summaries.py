"""Queries of summaries, report totals, sampling, ordered rows and sets."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.rules import exclusive_quantile
from ..operators import ordered as o
from ..operators.ranks import placed
from ..operators.selection import stratified
from ..sources.tables import table
from .register import registrar
from .relational import quantile

query, QUERIES, ORACLE_SQL = registrar()

LIST = "WITH g AS (SELECT user_id, list_sort(list(value)) AS a FROM events GROUP BY 1)"


def _sorted_values(spark, sf, *keys):
    return table(spark, sf, "events").groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("a"))


@query(f"{LIST} SELECT user_id, CAST(len(a) AS INTEGER) AS n, CAST(len(k) AS INTEGER) AS kept, list_max(k) AS highest FROM (SELECT user_id, a, CASE WHEN len(a) < 4 THEN a ELSE list_filter(a, lambda x: x BETWEEN {quantile('a', 1, 4)} - 1.5 * ({quantile('a', 3, 4)} - {quantile('a', 1, 4)}) AND {quantile('a', 3, 4)} + 1.5 * ({quantile('a', 3, 4)} - {quantile('a', 1, 4)})) END AS k FROM g)")
def agg_outlier_iqr(spark, sf):
    """Values within 1.5 interquartile ranges of the exclusive quartiles, ends included; all if fewer than 4."""
    a = F.col("a")
    x = _sorted_values(spark, sf, "user_id").withColumns({"q1": exclusive_quantile(a, 1, 4), "q3": exclusive_quantile(a, 3, 4)})
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    k = F.when(F.size(a) < 4, a).otherwise(F.filter(a, lambda v: v.between(F.col("q1") - fence, F.col("q3") + fence)))
    return x.withColumn("k", k).select("user_id", F.size(a).alias("n"), F.size("k").alias("kept"), F.array_max("k").alias("highest"))


@query(f"{LIST} SELECT user_id, CAST(list_sum(list_transform(a, lambda x: CAST(x AS DECIMAL(18,2)))) AS DOUBLE) / len(a) AS mean, (a[CAST(floor((len(a) - 1) / 2) AS BIGINT) + 1] + a[CAST(floor(len(a) / 2) AS BIGINT) + 1]) / 2 AS median, round(CASE WHEN len(a) > 1 THEN list_stddev_samp(a) ELSE 0 END, 6) AS stdev, a[1] AS low, list_max(a) AS high, CASE WHEN len(a) < 4 THEN list_max(a) ELSE {quantile('a', 3, 4)} END AS p75 FROM g")
def agg_summary_stats(spark, sf):
    a = F.col("a")
    x = table(spark, sf, "events").groupBy("user_id").agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("mean"), F.median("value").alias("median"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.sort_array(F.collect_list("value")).alias("a"),
    )
    return x.withColumn("p75", F.when(F.size(a) < 4, F.col("high")).otherwise(exclusive_quantile(a, 3, 4))).drop("a")


@query(f"WITH g AS (SELECT event_type, list_sort(list(value)) AS a FROM events GROUP BY 1) SELECT event_type, round(list_avg(a), 6) AS mean, CASE WHEN len(a) < 20 THEN list_max(a) ELSE {quantile('a', 19, 20)} END AS p95, list_min(a) AS low, list_max(a) AS high FROM g")
def agg_timing_p95(spark, sf):
    """Mean, exclusive 95th percentile (the highest of fewer than 20), lowest and highest, by places in the order."""
    e = table(spark, sf, "events").select("event_type", "value")
    x = placed(e.where("value is not null"), ["event_type"], [F.col("value")])
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(19 * (F.col("n") + 1) / 20)))
    rest = 19 * (F.col("n") + 1) - at * 20
    low, high = (F.max(F.when(F.col("place") == at - 1 + k, F.col("value"))) for k in (0, 1))
    p = x.groupBy("event_type").agg(F.when(F.max("n") < 20, F.max("value")).otherwise((low * (20 - F.max(rest)) + high * F.max(rest)) / 20).alias("p95"))
    m = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return m.join(p, "event_type")


@query("SELECT event_type, count(*) AS n, round(avg(coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0)), 6) AS avg_wall, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS avg_cost FROM events GROUP BY 1")
def agg_usage_summary(spark, sf):
    """Missing wall times count as 0, missing costs do not count."""
    cost = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(cost, F.lit(0.0))), 6).alias("avg_wall"), F.round(F.avg(cost), 6).alias("avg_cost"))


@query("WITH s AS (SELECT p_partkey % 40 AS repo, p_brand AS category, CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN p_size > 35 THEN 3 WHEN p_size > 15 THEN 2 ELSE 1 END AS score FROM part) SELECT repo, category, severity, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY GROUPING SETS ((repo), (repo, category), (repo, severity))")
def agg_pattern_scores(spark, sf):
    level = lambda a, b, c: F.when(F.col("p_size") > 35, a).when(F.col("p_size") > 15, b).otherwise(c)
    x = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("repo"), F.col("p_brand").alias("category"), level("high", "medium", "low").alias("severity"), level(3, 2, 1).alias("score"))
    repo, category, severity = map(F.col, ("repo", "category", "severity"))
    return x.groupingSets([[repo], [repo, category], [repo, severity]], repo, category, severity).agg(F.sum("score").alias("score"))


@query("SELECT p_brand AS category, CAST(sum(p_size) AS BIGINT) AS score, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def agg_corpus_categories(spark, sf):
    x = table(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(F.sum("p_size").alias("score"))
    return x.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "category")).cast("long"))  # a row per category


@query("SELECT source, lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (len(string_split(text, chr(10))) > 50 OR strlen(text) > 10240) AS significant FROM documents GROUP BY 1, 2")
def agg_code_stats(spark, sf):
    lines, size = F.size(F.split("text", "\n")), F.octet_length("text")
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.sum(size).cast("long").alias("bytes"), F.count_if((lines > 50) | (size > 10240)).alias("significant"))


@query("WITH m AS (SELECT event_type AS metric, CAST(user_id % 8 AS BIGINT) AS level, avg(value) AS mean, stddev_samp(value) AS s FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2) SELECT metric, level, round(mean, 6) AS mean, round(s, 6) AS stdev, round((mean / first_value(mean) OVER (PARTITION BY metric ORDER BY level) - 1) * 100, 6) AS pct FROM m")
def agg_parallel_sweep(spark, sf):
    """Values that are not a number are left out; percentages are against the first level."""
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value"))
    x = table(spark, sf, "events").select(F.col("event_type").alias("metric"), (F.col("user_id") % 8).alias("level"), v.alias("v")).where("not isnan(v)")
    x = x.groupBy("metric", "level").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("s"))
    first = F.first_value("mean").over(W.partitionBy("metric").orderBy("level"))
    return x.select("metric", "level", F.round("mean", 6).alias("mean"), F.round("s", 6).alias("stdev"), F.round((F.col("mean") / first - 1) * 100, 6).alias("pct"))


@query("SELECT page_id, CAST(len(l) AS INTEGER) AS files, CAST(list_sum(l) AS BIGINT) AS total, list_sum(l) / len(l) AS mean FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: length(x)) AS l FROM pages)")
def agg_file_sizes(spark, sf):
    x = table(spark, sf, "pages").select("page_id", F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda p: F.length(p).cast("long")).alias("l"))
    total = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0).cast("long"), lambda s, v: s + v))
    return x.select("page_id", F.size("l").alias("files"), total.alias("total"), (total / F.size("l")).alias("mean"))


@query("SELECT user_id, max_by(value, (ts, event_id)) FILTER (event_id % 2 = 0) AS mobile, max_by(value, (ts, event_id)) FILTER (event_id % 2 = 1) AS desktop FROM events GROUP BY 1")
def agg_metric_by_device(spark, sf):
    """The last value of each device, in event order."""
    own = lambda k: F.when(F.col("event_id") % 2 == k, F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", own(0)).alias("mobile"), F.max_by("value", own(1)).alias("desktop"))


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'success' WHEN quality = 1 OR toxic = 0 THEN 'partial' ELSE 'failed' END AS status, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def agg_status_counts(spark, sf):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "success").when((F.col("quality") == 1) | (F.col("toxic") == 0), "partial").otherwise("failed")
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy(status.alias("status"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_visual_counts(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("unknown"))


@query("SELECT n_nationkey, coalesce(round(avg(s_acctbal), 6), -1) AS a, coalesce(round(avg(s_acctbal) FILTER (s_suppkey % 3 = 0), 6), -1) AS b, coalesce(round(avg(s_acctbal) FILTER (s_suppkey % 7 = 0), 6), -1) AS c FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def agg_mean_objectives(spark, sf):
    """Means of three objectives; -1 for those without a value."""
    x = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    mean = lambda k: F.coalesce(F.round(F.avg(F.when(F.col("s_suppkey") % k == 0, F.col("s_acctbal"))), 6), F.lit(-1.0))
    return x.groupBy("n_nationkey").agg(mean(1).alias("a"), mean(3).alias("b"), mean(7).alias("c"))


@query("WITH t AS (SELECT event_type AS trial, user_id, value FROM events) SELECT trial, count(*) AS n, count(*) FILTER (value > 50) AS valid, round(avg(value) FILTER (value > 50), 6) AS mean, round(100.0 * count(*) FILTER (value > 100) / count(*), 6) AS pct_improved, round(max(value) - avg(value), 6) AS gap FROM t GROUP BY trial")
def agg_eval_summary(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("trial")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v > 50).alias("valid"), F.round(F.avg(F.when(v > 50, v)), 6).alias("mean"),
        F.round(100.0 * F.count_if(v > 100) / F.count(F.lit(1)), 6).alias("pct_improved"), F.round(F.max(v) - F.avg(v), 6).alias("gap"),
    )


@query("WITH l AS (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1) SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS suggestions FROM l")
def agg_suggestions_latest(spark, sf):
    x = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    return x.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("suggestions"))


@query("SELECT c_nationkey, w AS mode_width FROM (SELECT c_nationkey, CAST(round(c_acctbal / 1000) * 1000 AS BIGINT) AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS r FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2) WHERE r = 1")
def agg_mode_width(spark, sf):
    """The most frequent rounded width; the first seen wins among equals."""
    w = (F.round(F.col("c_acctbal") / 1000) * 1000).cast("long")
    x = table(spark, sf, "customer").where("c_acctbal >= 0").groupBy("c_nationkey", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    return x.groupBy("c_nationkey").agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("mode_width"))


@query("WITH u AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) SELECT p_name, p_brand, count(*) AS downloads, row_number() OVER (ORDER BY count(*) DESC, p_name, p_brand) AS place FROM u JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def agg_package_union(spark, sf):
    u = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    x = u.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("downloads"))
    x = placed(x.withColumn("all", F.lit(0)), ["all"], [F.desc("downloads"), F.asc("p_name"), F.asc("p_brand")])
    return x.select("p_name", "p_brand", "downloads", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT p.place, p.phase, count(value) AS n, round(avg(value), 6) AS mean FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'none')) p(place, phase) LEFT JOIN events ON event_type = p.phase GROUP BY 1, 2")
def agg_phase_means(spark, sf):
    """All named phases in their fixed order, those without a row too."""
    phases = spark.createDataFrame([(1, "view"), (2, "click"), (3, "purchase"), (4, "none")], "place int, phase string")
    x = table(spark, sf, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return phases.join(x, "phase", "left").select("place", "phase", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean")


SITES = """WITH m AS (SELECT user_id AS site, event_type AS metric, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS b, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS f FROM events GROUP BY 1, 2),
 d AS (SELECT site, metric, b - f AS gain, CAST(CASE WHEN f <= 100 THEN 2 WHEN f <= 200 THEN 1 ELSE 0 END AS BIGINT) - CASE WHEN b <= 100 THEN 2 WHEN b <= 200 THEN 1 ELSE 0 END AS crossing FROM m WHERE b IS NOT NULL AND f IS NOT NULL),
 s AS (SELECT site, round(avg(gain), 6) AS health, CAST(sum(crossing) AS BIGINT) AS crossing, bool_or(gain >= 20) AND NOT bool_or(gain < -20) AS is_pareto, bool_or(gain < -20) AS is_degraded FROM d GROUP BY 1)"""


def _gains(spark, sf):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("site"), "event_type").agg(F.avg(F.when(early, F.col("value"))).alias("b"), F.avg(F.when(~early, F.col("value"))).alias("f"))
    tier = lambda c: F.when(F.col(c) <= 100, 2).when(F.col(c) <= 200, 1).otherwise(0)
    return m.where("b is not null and f is not null").select("site", "event_type", (F.col("b") - F.col("f")).alias("gain"), (tier("f") - tier("b")).alias("c"))


def _sites(spark, sf):
    d = _gains(spark, sf)
    worse = F.bool_or(F.col("gain") < -20)
    return d.groupBy("site").agg(F.round(F.avg("gain"), 6).alias("health"), F.sum("c").alias("crossing"), (F.bool_or(F.col("gain") >= 20) & ~worse).alias("is_pareto"), worse.alias("is_degraded"))


@query(f"{SITES} SELECT * FROM s")
def agg_site_paper(spark, sf):
    """Per site: mean gain, tiers crossed, whether some metric improved and none degraded, whether any degraded."""
    return _sites(spark, sf)


@query(f"{SITES} SELECT count(*) AS n, round(avg(CAST(is_pareto AS INTEGER)), 6) AS pareto_rate, round(avg(CAST(is_degraded AS INTEGER)), 6) AS degraded_rate, round(avg(health), 5) AS health, round(avg(crossing), 6) AS crossing, (SELECT string_agg(metric || '=' || g, ',' ORDER BY metric) FROM (SELECT metric, CAST(round(avg(gain) * 100) AS BIGINT) AS g FROM d GROUP BY 1)) AS per_metric FROM s")
def agg_paper(spark, sf):
    """Over all sites, and the mean gain of each metric in hundredths."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    per = _gains(spark, sf).groupBy("event_type").agg(F.round(F.avg("gain") * 100).cast("long").alias("g"))
    per = per.agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), "g"))), ",").alias("per_metric"))  # a row for each metric
    x = _sites(spark, sf).agg(F.count(F.lit(1)).alias("n"), rate("is_pareto").alias("pareto_rate"), rate("is_degraded").alias("degraded_rate"), F.round(F.avg("health"), 5).alias("health"), F.round(F.avg("crossing"), 6).alias("crossing"))
    return x.crossJoin(per)  # one row each


@query("WITH b AS (SELECT l_suppkey AS page, l_partkey AS box, l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 100 AS y, l_quantity AS h FROM lineitem), r AS (SELECT *, max(y + h) OVER (PARTITION BY page ORDER BY y, id, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM b) SELECT page, band, count(*) AS boxes, min(y) AS top, round(max(y + h), 6) AS bottom FROM (SELECT *, CAST(sum(CASE WHEN low IS NULL OR y > low + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, id, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM r) GROUP BY 1, 2")
def win_band_groups(spark, sf):
    """Boxes of a page in bands: one that starts over 20 below all earlier boxes opens the next band."""
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("box"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 100).alias("y"), F.col("l_quantity").alias("h"))
    w = W.partitionBy("page").orderBy("y", "id", "box")
    low = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("opens", F.coalesce(F.col("y") > low + 20, F.lit(True)).cast("int"))
    x = x.withColumn("band", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("page", "band").agg(F.count(F.lit(1)).alias("boxes"), F.min("y").alias("top"), F.round(F.max(F.col("y") + F.col("h")), 6).alias("bottom"))


@query("WITH m AS (SELECT lang, CAST(n_chars // 1000 AS BIGINT) AS level, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, level, round(100.0 * n / first_value(n) OVER (PARTITION BY lang ORDER BY level), 6) AS pct FROM m")
def win_pct_vs_first(spark, sf):
    x = table(spark, sf, "documents").groupBy("lang", F.floor(F.col("n_chars") / 1000).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("lang", "level", F.round(100.0 * F.col("n") / F.first_value("n").over(W.partitionBy("lang").orderBy("level")), 6).alias("pct"))


@query("SELECT event_id, user_id, count(*) OVER w AS done, round(count(*) OVER w / (1 + (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6), 9) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def win_progress_eta(spark, sf):
    """Rows done so far per second since a user's first."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spent = (at - F.first_value(at).over(w)) / 1e6
    return table(spark, sf, "events").select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("done"), F.round(F.count(F.lit(1)).over(w) / (1 + spent), 9).alias("rate"))


@query("SELECT user_id, coalesce(min(event_id) FILTER (open AND event_id > cur), min(event_id) FILTER (open)) AS next_id FROM (SELECT user_id, event_id, event_type <> 'view' AS open, user_id * 7 AS cur FROM events) GROUP BY 1")
def win_next_unannotated(spark, sf):
    """The next open row after the current one, from the start again at the end."""
    opened, later = F.col("event_type") != "view", F.col("event_id") > F.col("user_id") * 7
    pick = lambda c: F.min(F.when(c, F.col("event_id")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(pick(opened & later), pick(opened)).alias("next_id"))


@query("SELECT o_custkey, max(o_orderpriority) FILTER (o_totalprice > 100000) AS latest FROM orders GROUP BY 1")
def win_latest_dump(spark, sf):
    """The last name among those that hold what is needed."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))).alias("latest"))


@query("WITH f AS (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS k FROM f) SELECT l_suppkey, CAST(sum(q) AS DOUBLE) AS score, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS top, arg_min(l_partkey, k) AS top_file FROM r GROUP BY 1")
def ord_leaderboard(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    r = f.withColumn("k", F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey")))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "l_partkey"))))
    return r.groupBy("l_suppkey").agg(F.sum("q").cast("double").alias("score"), F.array_join(F.transform(top, lambda e: e["l_partkey"].cast("string")), ",").alias("top"), F.min_by("l_partkey", "k").alias("top_file"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def ord_top_n(spark, sf):
    k = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("lang", "doc_id", k.alias("k")).where("k <= 5").select("lang", "doc_id")


@query("SELECT source, doc_id, k AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE list_contains(list_transform(range(10), lambda i: i * n // 10), k)")
def smp_even_step(spark, sf):
    """Ten rows of each source at even steps of its order."""
    x = placed(table(spark, sf, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")])
    at = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.floor(i * F.col("n") / 10))
    return x.where(F.array_contains(at, F.col("place"))).select("source", "doc_id", "place")


STRATIFIED = """WITH RECURSIVE d AS (SELECT doc_id, lang || '__' || (n_chars > 1000) AS stratum, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL),
 z AS (SELECT *, row_number() OVER (ORDER BY n DESC, stratum) AS i, count(*) OVER () AS k FROM (SELECT stratum, count(*) AS n FROM d GROUP BY 1)),
 a(i, stratum, take, remaining) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(60 AS BIGINT) UNION ALL SELECT z.i, z.stratum, CASE WHEN remaining <= 0 THEN 0 ELSE least(n, greatest(1, remaining // (k - z.i + 1))) END, remaining - CASE WHEN remaining <= 0 THEN 0 ELSE least(n, greatest(1, remaining // (k - z.i + 1))) END FROM a JOIN z ON z.i = a.i + 1),
 r AS (SELECT d.*, row_number() OVER (PARTITION BY d.stratum ORDER BY h, doc_id) <= take AS chosen FROM d JOIN a USING (stratum)),
 c AS (SELECT * FROM r ORDER BY chosen DESC, h, doc_id LIMIT 60), s AS (SELECT doc_id, stratum, h, row_number() OVER (ORDER BY md5(h), doc_id) <= 50 AS train FROM c)"""


@query(f"{STRATIFIED} SELECT doc_id, stratum, train FROM s")
def smp_stratified(spark, sf):
    """Sixty documents of the strata of language and size: the largest first, each with its share of what is left, filled
    up from all; fifty train, ten validate. Drawn by hashes, so reruns agree."""
    return _stratified(spark, sf).select("doc_id", "stratum", "train")


def _stratified(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null and n_chars is not null")
    return stratified(d.select("doc_id", F.concat("lang", F.lit("__"), (F.col("n_chars") > 1000).cast("string")).alias("stratum")), "doc_id", "stratum", 60, 50)


@query(f"{STRATIFIED}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS k FROM s WHERE train) SELECT doc_id, CAST((row_number() OVER (ORDER BY k, stratum) - 1) % 5 AS INTEGER) AS batch FROM k")
def smp_minibatch(spark, sf):
    """The fifty training documents dealt to five batches, one stratum after the other in turn."""
    x = _stratified(spark, sf).where("train")
    x = x.withColumn("k", F.row_number().over(W.partitionBy("stratum").orderBy("h", "doc_id")))
    return x.select("doc_id", ((F.row_number().over(W.orderBy("k", "stratum")) - 1) % 5).alias("batch"))  # fifty rows


WORDS = "list_distinct(string_split(lower(text), ' '))"


@query(f"WITH w AS (SELECT item_id, {WORDS} AS w, string_split(lower(text), ' ') AS l FROM benchmark) SELECT a.item_id, CAST(len(list_filter(b.l, lambda x: NOT list_contains(a.w, x))) AS INTEGER) AS new_errors, CAST(len(list_filter(a.l, lambda x: NOT list_contains(b.w, x))) AS INTEGER) AS fixed_errors FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def set_diff_errors(spark, sf):
    """Errors of one list that the other lacks; repeated ones count each time."""
    x = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("a"))
    y = x.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    lacks = lambda p, q: F.size(F.filter(p, lambda e: ~F.array_contains(q, e)))
    return x.join(y, "item_id").select("item_id", lacks("b", F.col("a")).alias("new_errors"), lacks("a", F.col("b")).alias("fixed_errors"))


@query("SELECT key, arg_min(name, src) AS name FROM (SELECT s_nationkey AS key, s_name AS name, (1, s_suppkey) AS src FROM supplier UNION ALL SELECT c_nationkey, c_name, (2, c_custkey) FROM customer) GROUP BY 1")
def set_union_dedup(spark, sf):
    """One row per key; the first source wins, then the smallest id."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.struct(F.lit(1).alias("o"), F.col("s_suppkey").alias("i")).alias("src"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.lit(2).alias("o"), F.col("c_custkey").alias("i")).alias("src"))
    return s.unionByName(c).groupBy("key").agg(F.min_by("name", "src").alias("name"))


@query("SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def set_union_packages(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    half = lambda k: F.collect_set(F.when(F.col("l_linenumber") % 2 == k, F.col("p_brand")))
    return x.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.array_union(half(0), half(1))), ",").alias("brands"))


@query("SELECT 'missing' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def set_missing_extra(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id")
    missing = docs.join(labels, "doc_id", "left_anti").select(F.lit("missing").alias("side"), F.col("doc_id").alias("id"))
    return missing.union(labels.join(docs.where("lang = 'en'"), "doc_id", "left_anti").select(F.lit("extra"), "doc_id"))


@query("SELECT a.p_partkey, concat_ws(',', CASE WHEN b.p_brand IS DISTINCT FROM a.p_brand THEN 'brand' END, CASE WHEN b.p_size IS DISTINCT FROM a.p_size THEN 'size' END, CASE WHEN b.p_type IS DISTINCT FROM a.p_type THEN 'type' END) AS changed FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_style_diff(spark, sf):
    """Properties whose value differs or is absent on the other side."""
    p = table(spark, sf, "part")
    style = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), "p_type")
    a, b = p.select("p_partkey", style.alias("a")), p.select((F.col("p_partkey") - 1).alias("p_partkey"), style.alias("b"))
    changed = F.map_filter("a", lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col("b"), k)))
    return a.join(b, "p_partkey", "left").select("p_partkey", F.array_join(F.array_sort(F.map_keys(changed)), ",").alias("changed"))


@query("""WITH e AS (SELECT user_id % 10 AS trial, event_id % 500 AS k, value, event_id, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id) > 1 AS hit FROM events),
 t AS (SELECT trial, count(*) AS n, count(*) FILTER (hit) AS hits, avg(value) AS mean, arg_max(event_id, (value, event_id)) AS best FROM e GROUP BY 1) SELECT trial, n, hits, round(mean, 6) AS mean, best, round(max(mean) OVER () - mean, 6) AS gap FROM t""")
def opt_trial_log(spark, sf):
    """Trials with their runs, those answered by the cache (the key was met before), mean and best, and the gap to the best trial."""
    first = table(spark, sf, "events").groupBy((F.col("event_id") % 500).alias("k")).agg(F.min("event_id").alias("first"))
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("trial"), (F.col("event_id") % 500).alias("k"), "value", "event_id").join(first, "k")
    t = e.groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") > F.col("first")).alias("hits"), F.avg("value").alias("m"), F.max_by("event_id", F.struct("value", "event_id")).alias("best"))
    top = t.agg(F.max("m").alias("top"))
    return t.crossJoin(F.broadcast(top)).select("trial", "n", "hits", F.round("m", 6).alias("mean"), "best", F.round(F.col("top") - F.col("m"), 6).alias("gap"))  # top: one row


@query("SELECT a.s_suppkey, count(b.s_suppkey) AS dominated_by FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal >= a.s_acctbal AND b.s_suppkey % 10 >= a.s_suppkey % 10 AND (b.s_acctbal > a.s_acctbal OR b.s_suppkey % 10 > a.s_suppkey % 10) GROUP BY 1")
def opt_dominates(spark, sf):
    """How many points of the same group are at least as good in all and better in one objective."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 10).alias("y"))
    return o.dominated_by(s, "s_nationkey", "s_suppkey", "x", "y")
