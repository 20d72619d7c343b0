"""Queries of text, geometry, sampling and page-event operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import aggregates as a, ordered as o, text as t
from ..operators.ranks import placed
from ..operators.rounds import written
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


VISIBLE = "list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')), '[\\p{L}\\p{N}_]+'))"
DOM = "list_transform(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9-]*[^>]*>'), lambda t: lower(regexp_extract(t, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) || CASE WHEN len(list_filter(regexp_split_to_array(regexp_extract(t, 'class=\"([^\"]*)\"', 1), ' +'), lambda c: c <> '')) > 0 THEN '.' || array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_extract(t, 'class=\"([^\"]*)\"', 1), ' +'), lambda c: c <> '')), '.') ELSE '' END)"


@query(f"SELECT page_id, len({VISIBLE}) AS n_tokens, array_to_string(list_sort({VISIBLE}), ' ') AS tokens FROM pages")
def txt_tokens(spark, sf):
    k = t.visible_tokens(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(k).cast("long").alias("n_tokens"), F.array_join(F.array_sort(k), " ").alias("tokens"))


@query(f"WITH x AS (SELECT page_id, {VISIBLE} AS t FROM pages) SELECT a.page_id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM x a JOIN x b ON b.page_id = a.page_id + 1")
def txt_jaccard(spark, sf):
    x, _ = written(table(spark, sf, "pages").select("page_id", t.visible_tokens(F.col("html")).alias("t")))  # tokens once, for both sides
    y = x.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("u"))
    return x.join(y, "page_id").select("page_id", t.jaccard(F.col("t"), F.col("u")).alias("jaccard"))


@query(f"SELECT page_id, array_to_string({DOM}, ' ') AS dom FROM pages")
def txt_dom_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(t.dom_tokens(F.col("html")), " ").alias("dom"))


BITS = " + ".join(f"CASE WHEN b{k} > 0 THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))
HALF = lambda a: f"CAST('0x' || substr(md5(t), {a}, 8) AS UBIGINT)"
VOTES = ", ".join(f"sum(CASE WHEN ({HALF(17) if k >= 32 else HALF(25)} >> {k % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS b{k}" for k in range(64))
SIMHASH = f"x AS (SELECT page_id, unnest({DOM}) AS t FROM pages), v AS (SELECT page_id, {VOTES} FROM x GROUP BY 1), s AS (SELECT page_id, {BITS} AS h FROM v), f AS (SELECT page_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS simhash FROM s)"


def fingerprints(spark, sf):
    return t.simhash64(table(spark, sf, "pages"), "page_id", t.dom_tokens(F.col("html")))


@query(f"WITH {SIMHASH} SELECT * FROM f")
def txt_simhash64(spark, sf):
    return fingerprints(spark, sf)


@query(f"WITH {SIMHASH} SELECT a.page_id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM f a JOIN f b ON b.page_id = a.page_id + 1")
def txt_hamming(spark, sf):
    x = fingerprints(spark, sf)
    y = x.select((F.col("page_id") - 1).alias("page_id"), F.col("simhash").alias("other"))
    return x.join(y, "page_id").select("page_id", t.hamming(F.col("simhash"), F.col("other")).alias("distance"))


LINES = "string_split(html, chr(10))"


@query(f"SELECT page_id, strlen(html) AS bytes, CAST(len({LINES}) AS INTEGER) AS lines, list_max(list_transform({LINES}, lambda x: length(x))) AS longest, list_sum(list_transform({LINES}, lambda x: length(x))) / len({LINES}) AS mean_line, len(list_filter({LINES}, lambda x: length(x) > 500)) AS long_lines, (length(html) - length(replace(html, chr(10), ''))) / length(html) AS newline_share, (length(html) - length(regexp_replace(html, '[ \\t\\n\\r]+', '', 'g'))) / length(html) AS space_share FROM pages")
def fn_code_density(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[c.alias(k) for k, c in t.code_density(F.col("html")).items()])


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '```', '^\\s*```[a-zA-Z]*\\s*\\n?', ''), '\\n?```\\s*$', '')) AS body FROM documents")
def txt_strip_fence(spark, sf):
    body = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return table(spark, sf, "documents").select("doc_id", t.strip_fence(body).alias("body"))


@query("SELECT user_id, d AS inp FROM (SELECT user_id, list_sort(list(d), 'DESC')[CAST(least(floor(count(*) * 0.25), count(*) - 1) AS BIGINT) + 1] AS d FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(value) AS d FROM events GROUP BY 1, 2 HAVING k IS NOT NULL AND k <> 0 AND d >= 16) GROUP BY 1)")
def st_inp_select(spark, sf):
    x = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value").where("k <> 0")
    x = x.groupBy("user_id", "k").agg(F.max("value").alias("d")).where("d >= 16").groupBy("user_id").agg(F.sort_array(F.collect_list("d"), asc=False).alias("d"))
    n = F.size("d")
    return x.select("user_id", F.get("d", F.least(F.floor(n * 0.25), n - 1).cast("int")).alias("inp"))


@query("SELECT user_id, max_by(coalesce(nullif(value, 0), event_id), (ts, event_id)) AS lcp FROM events GROUP BY user_id")
def st_lcp_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.coalesce(F.nullif("value", F.lit(0.0)), F.col("event_id").cast("double")), F.struct("ts", "event_id")).alias("lcp"))


@query("SELECT user_id, min_by(value, (ts, event_id)) FILTER (event_type = 'view') AS first_view, max_by(value, (ts, event_id)) FILTER (event_type = 'click') AS last_click FROM events GROUP BY user_id")
def st_first_last_metric(spark, sf):
    own = lambda k: F.when(F.col("event_type") == k, F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", own("view")).alias("first_view"), F.max_by("value", own("click")).alias("last_click"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events),
 s(user_id, i, f, l, total, best) AS (SELECT user_id, i, t, t, v, v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN j THEN f ELSE t END, t, CASE WHEN j THEN total + v ELSE v END, greatest(best, CASE WHEN j THEN total + v ELSE v END)
  FROM (SELECT s.*, e.i AS ei, e.t, e.v, s.total <> 0 AND e.t - s.l < 7200 AND e.t - s.f < 36000 AS j FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) x JOIN e ON e.user_id = x.user_id AND e.i = x.ei)
SELECT user_id, max(best) AS worst FROM s GROUP BY user_id""".replace("e.user_id, e.i, CASE WHEN j THEN f ELSE t END, t, CASE WHEN j THEN total + v ELSE v END, greatest(best, CASE WHEN j THEN total + v ELSE v END)\n  FROM (SELECT s.*, e.i AS ei", "x.user_id, x.ei, CASE WHEN j THEN f ELSE t END, t, CASE WHEN j THEN total + v ELSE v END, greatest(best, CASE WHEN j THEN total + v ELSE v END)\n  FROM (SELECT s.*, e.i AS ei").replace(" x JOIN e ON e.user_id = x.user_id AND e.i = x.ei)", " x)"))
def st_cls_session(spark, sf):
    return o.capped_session_max(table(spark, sf, "events"), "user_id", "ts", "value", 7200, 36000)


@query("SELECT doc_id, CASE WHEN s >= p90 THEN 'B4' WHEN s >= p70 THEN 'B3' WHEN s >= p50 THEN 'B2' END AS bin FROM (SELECT doc_id, lang, log10(n_chars) AS s FROM documents WHERE n_chars > 0) JOIN (SELECT lang, quantile_cont(log10(n_chars), 0.5) AS p50, quantile_cont(log10(n_chars), 0.7) AS p70, quantile_cont(log10(n_chars), 0.9) AS p90 FROM documents WHERE n_chars > 0 GROUP BY lang) USING (lang) WHERE s >= p50")
def smp_size_bins(spark, sf):
    x = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "lang", F.log10("n_chars").alias("s"))
    q = a.quantiles(x, ["lang"], "s", [0.5, 0.7, 0.9])
    at = lambda k: F.get("q", F.lit(k))
    x = x.join(q, "lang").where(F.col("s") >= at(0))
    return x.select("doc_id", F.when(F.col("s") >= at(2), "B4").when(F.col("s") >= at(1), "B3").otherwise("B2").alias("bin"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_totalprice DESC, o_orderkey) AS place FROM orders")
def ord_multi(spark, sf):
    order = [F.substring("o_orderpriority", 1, 1).cast("int"), F.desc("o_totalprice"), F.col("o_orderkey")]
    x = placed(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), ["o_orderstatus"], order)
    return x.select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("(SELECT s_suppkey, s_acctbal, 'best' AS side FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3) UNION ALL (SELECT s_suppkey, s_acctbal, 'worst' FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 3)")
def ord_best_worst_k(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3).withColumn("side", F.lit("best")).union(s.orderBy("s_acctbal", "s_suppkey").limit(3).withColumn("side", F.lit("worst")))


W1 = "list_distinct(string_split(lower(b.text), ' '))"
W2 = "list_distinct(string_split(lower(c.text), ' '))"


@query(f"SELECT b.item_id, array_to_string(list_sort(list_filter({W1}, lambda x: NOT list_contains({W2}, x))), ' ') AS only_first, array_to_string(list_sort(list_filter({W2}, lambda x: NOT list_contains({W1}, x))), ' ') AS only_second, array_to_string(list_sort(list_intersect({W1}, {W2})), ' ') AS common FROM benchmark b JOIN benchmark c ON c.item_id = b.item_id + 1")
def set_three_way(spark, sf):
    x = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("a"))
    y = x.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return x.join(y, "item_id").select("item_id", *[F.array_join(c, " ").alias(k) for k, c in t.three_way(F.col("a"), F.col("b")).items()])
