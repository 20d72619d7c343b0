"""Queries of aggregations, windows, joins, filters and sets."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import aggregates as a, ordered as o, ranks
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


QUANTILE = "({a}[{j}] * ({q} - ({i} * (len({a}) + 1) - {j} * {q})) + {a}[{j} + 1] * ({i} * (len({a}) + 1) - {j} * {q})) / {q}.0"
J = "CAST(greatest(1, least(len({a}) - 1, floor({i} * (len({a}) + 1) / {q}))) AS BIGINT)"


def quantile(a: str, i: int, q: int) -> str:
    return QUANTILE.format(a=a, i=i, q=q, j=J.format(a=a, i=i, q=q))


RUNS = f"""WITH g AS (SELECT user_id, event_type, count(*) AS total_runs, coalesce(list_sort(list(value) FILTER (value < 450)), []) AS a FROM events GROUP BY 1, 2),
 f AS (SELECT *, {quantile('a', 1, 4)} AS q1, {quantile('a', 3, 4)} AS q3 FROM g),
 k AS (SELECT *, CASE WHEN len(a) < 4 THEN a ELSE list_filter(a, lambda x: x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) END AS k FROM f)
SELECT user_id, event_type, total_runs, CAST(len(a) AS INTEGER) AS valid_runs, CAST(len(a) - len(k) AS INTEGER) AS outliers_removed,
 (k[CAST(floor((len(k) - 1) / 2) AS BIGINT) + 1] + k[CAST(floor(len(k) / 2) AS BIGINT) + 1]) / 2 AS median,
 CAST(round(CAST(CAST(list_sum(list_transform(k, lambda x: CAST(x AS DECIMAL(18,6)))) AS DOUBLE) / len(k) AS DECIMAL(18,8)), 4) AS DOUBLE) AS mean,
 CASE WHEN len(k) < 4 THEN list_max(k) ELSE {quantile('k', 3, 4)} END AS p75 FROM k"""


@query(RUNS)
def agg_cwv_runs(spark, sf):
    return a.run_summary(table(spark, sf, "events"), ["user_id", "event_type"], ok=F.col("value") < 450)


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS job, event_type AS phase, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value, event_id % 50 AS tokens FROM events)
SELECT CAST(grouping_id(job, phase, status) AS INTEGER) AS grouping, job, phase, status, count(*) AS calls, count(*) FILTER (status = 'ok') AS ok_calls, CAST(sum(tokens) AS BIGINT) AS tokens,
 CAST(floor(CAST(sum(CAST(value AS DECIMAL(18,3))) AS DOUBLE) / count(*)) AS BIGINT) AS avg_latency_ms FROM c GROUP BY GROUPING SETS ((), (phase), (job), (job, phase), (status))""")
def agg_usage_buckets(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    x = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("phase"), status.alias("status"), (status == "ok").alias("ok"), F.col("value").alias("latency_ms"), (F.col("event_id") % 50).alias("tokens"))
    return a.usage_buckets(x)


@query("SELECT user_id, 100.0 * count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events GROUP BY 1")
def agg_success_rate(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg((100.0 * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("success_rate"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def agg_value_counts(spark, sf):
    return a.value_counts(table(spark, sf, "documents"), "source", "lang")


@query("SELECT lang, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS p75 FROM documents GROUP BY lang")
def agg_describe(spark, sf):
    return a.describe(table(spark, sf, "documents"), ["lang"], "n_chars")


@query("SELECT source, quantile_cont(CAST(n_chars AS DOUBLE), 0) AS q0, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3, quantile_cont(CAST(n_chars AS DOUBLE), 1) AS q4 FROM documents GROUP BY source")
def agg_box_stats(spark, sf):
    g = a.quantiles(table(spark, sf, "documents"), ["source"], "n_chars", [x / 4 for x in range(5)])
    return g.select("source", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(5)])


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in ("en", "de", "fr", "es")) + " FROM documents GROUP BY source")
def agg_crosstab(spark, sf):
    return a.crosstab(table(spark, sf, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("SELECT bin, low, (SELECT count(*) FROM events WHERE value >= low AND (high IS NULL OR value < high)) AS n FROM (VALUES (0, 0.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 1000.0), (3, 1000.0, NULL)) t(bin, low, high)")
def agg_histogram(spark, sf):
    return a.histogram(table(spark, sf, "events"), "value", [0, 50, 100, 1000])


@query("SELECT l_suppkey, l_partkey, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3")
def agg_top_packages(spark, sf):
    return a.top_k(a.value_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey"), ["l_suppkey"], 3, F.desc("n"), F.col("l_partkey"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS with_risk, count(*) FILTER (value > 200) AS high, CAST(sum(event_id % 7) AS BIGINT) AS total_score FROM events GROUP BY user_id")
def agg_framework_stats(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("with_risk"), F.count_if(F.col("value") > 200).alias("high"), F.sum(F.col("event_id") % 7).alias("total_score"))


@query("SELECT user_id, bool_or(event_type = 'error') AS any_regression FROM events GROUP BY user_id")
def agg_any_regression(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.coalesce(F.col("event_type") == "error", F.lit(False))).alias("any_regression"))


@query("SELECT string_split(o_orderpriority, '-')[1] AS code, count(*) AS n FROM orders GROUP BY 1")
def agg_failure_codes(spark, sf):
    return table(spark, sf, "orders").groupBy(F.get(F.split("o_orderpriority", "-"), F.lit(0)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


NOTES = "SELECT user_id % 7 AS annotator, event_type AS label, event_id % 97 AS task FROM events"


@query(f"WITH n AS ({NOTES}) SELECT 'done' AS kind, annotator, NULL AS label, count(DISTINCT task) AS n FROM n GROUP BY 2 UNION ALL SELECT 'label', annotator, label, count(*) FROM n GROUP BY 2, 3 UNION ALL SELECT 'disagreement', task, string_agg(DISTINCT label, ',' ORDER BY label), count(DISTINCT label) FROM n GROUP BY 2 HAVING count(DISTINCT label) > 1")
def agg_annotator(spark, sf):
    """Per annotator the tasks done and how often each label was given; and the tasks with more than one label."""
    x = table(spark, sf, "events").select((F.col("user_id") % 7).alias("annotator"), F.col("event_type").alias("label"), (F.col("event_id") % 97).alias("task"))
    none = F.lit(None).cast("string")
    done = x.groupBy("annotator").agg(F.count_distinct("task").alias("n")).select(F.lit("done").alias("kind"), "annotator", none.alias("label"), "n")
    labels = x.groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "annotator", "label", "n")
    apart = x.select("task", "label").distinct().groupBy("task").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.union(labels).union(apart.select(F.lit("disagreement").alias("kind"), F.col("task").alias("annotator"), "label", "n"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def agg_package_freq(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select("p_brand", "l_orderkey").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, value AS latest_value, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_latest_per_key(spark, sf):
    return o.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("event_type", F.col("value").alias("latest_value"), "event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def win_first_per_key(spark, sf):
    return o.latest(table(spark, sf, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def win_best_per_key(spark, sf):
    return o.latest(table(spark, sf, "events"), ["event_type"], F.desc("value"), F.col("event_id")).select("event_type", "event_id", "value")


@query("SELECT event_type, event_id, value, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 15")
def win_top_k_group(spark, sf):
    return a.top_k(table(spark, sf, "events"), ["event_type"], 15, F.desc("value"), F.col("event_id")).select("event_type", "event_id", "value", "rank")


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events")
def win_phase_durations(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", (at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("us"))


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 THEN 1 ELSE 0 END AS n FROM events),
 s AS (SELECT *, 1 + sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM f) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY ALL""")
def st_session_gap(spark, sf):
    return o.gap_sessions(table(spark, sf, "events"), "user_id", "ts", 7200)


@query("""WITH x AS (SELECT l_suppkey, l_extendedprice AS lo, l_extendedprice + l_quantity AS hi FROM lineitem), f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM x),
 s AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM f) SELECT l_suppkey, min(lo) AS low, max(hi) AS high, count(*) AS n FROM s GROUP BY l_suppkey, i""")
def win_interval_merge(spark, sf):
    x = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("low"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("high"))
    return o.merged_intervals(ranks.in_pieces(x, "l_suppkey"), "l_suppkey", "low", "high")


POINTS = "SELECT l_suppkey AS id, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS x, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS y, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS z FROM lineitem GROUP BY 1"


def points(spark, sf):
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(total("l_quantity").alias("x"), total("l_discount").alias("y"), total("l_tax").alias("z"))


@query(f"WITH p AS ({POINTS}) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.x >= p.x AND q.y >= p.y AND q.z >= p.z AND (q.x > p.x OR q.y > p.y OR q.z > p.z))")
def opt_pareto(spark, sf):
    return o.pareto(points(spark, sf), "id", ["x", "y", "z"])


CROWD = " + ".join(f"CASE WHEN lag({c}) OVER (ORDER BY {c}, id) IS NULL OR lead({c}) OVER (ORDER BY {c}, id) IS NULL THEN CAST('inf' AS DOUBLE) ELSE (lead({c}) OVER (ORDER BY {c}, id) - lag({c}) OVER (ORDER BY {c}, id)) / (max({c}) OVER () - min({c}) OVER ()) END" for c in "xyz")


@query(f"WITH p AS ({POINTS}) SELECT id, {CROWD} AS distance FROM p")
def win_crowding(spark, sf):
    return o.crowding(points(spark, sf), "id", ["x", "y", "z"])


@query("SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(CAST(n AS VARCHAR), '') AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_two_device(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    x = x.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce(F.col("n").cast("string"), F.lit("")).alias("orders"))


@query("WITH t AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1) SELECT user_id, a, b, b - a AS delta FROM t WHERE a IS NOT NULL AND b IS NOT NULL")
def join_inner_ab(spark, sf):
    best = lambda k, n: table(spark, sf, "events").where(F.col("event_type") == k).groupBy("user_id").agg(F.max("value").alias(n))
    return best("view", "a").join(best("click", "b"), "user_id").withColumn("delta", F.col("b") - F.col("a"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_inner_unmatched_log(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'n/a') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_default_value(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("n/a")).alias("quality"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END, ''), p_name, '') AS name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def join_update_coalesce(spark, sf):
    x = table(spark, sf, "part").join(table(spark, sf, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    new = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("")
    return x.select("p_partkey", F.coalesce(F.nullif(new, F.lit("")), "p_name", F.lit("")).alias("name"))


@query("SELECT doc_id, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def join_upsert(spark, sf):
    d, new = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(new, "doc_id", "left_anti").withColumn("version", F.lit("old")).union(new.join(d, "doc_id", "left_semi").withColumn("version", F.lit("new")))


@query("SELECT c_custkey, r_name, i FROM customer, region, range(2) t(i)")
def join_cross_jobs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").crossJoin(F.broadcast(table(spark, sf, "region").select("r_name"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))


@query("SELECT user_id, min_by(value, (ts, event_id)) AS baseline, max_by(value, (ts, event_id)) AS final, max_by(value, (ts, event_id)) - min_by(value, (ts, event_id)) AS delta FROM events GROUP BY user_id")
def join_baseline_final(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", at).alias("baseline"), F.max_by("value", at).alias("final")).withColumn("delta", F.col("final") - F.col("baseline"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def flt_id_list(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(ids, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt_resume_skip(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_exclude_train(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND value > 100")
def flt_isin(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("view", "click") & (F.col("value") > 100)).select("event_id")


@query("SELECT doc_id FROM documents WHERE trim(text) <> ''")
def flt_not_blank(spark, sf):
    return table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r BETWEEN 101 AND 200")
def flt_slice_limit(spark, sf):
    return table(spark, sf, "events").select("event_id").orderBy("event_id").offset(100).limit(100)


@query("SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 300))) AS only_high FROM (SELECT user_id, event_type, value FROM events) GROUP BY user_id HAVING count(*) FILTER (value > 300) > 0")
def set_distinct_ordered(spark, sf):
    x = table(spark, sf, "events").where("value > 300").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("only_high"))
    return x


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersect_keys(spark, sf):
    own = lambda k: table(spark, sf, "events").where(F.col("event_type") == k).select("user_id")
    return own("purchase").intersect(own("error"))


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")))
