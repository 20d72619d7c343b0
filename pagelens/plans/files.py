"""Queries of sources and sinks: a table is written in a format and read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as r, hub as h, sinks as w
from ..sources.tables import table
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

EVENTS = "event_id long, user_id long, event_type string, value double, props string"
NAMES = ["event_id", "user_id", "event_type", "value", "props"]
ALL_EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").select(*NAMES)


def _lines(df, column, path):
    df.select(column).write.text(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def src_csv(spark, sf):
    path = w.scratch(spark, "t.csv")
    w.write_csv(table(spark, sf, "documents"), path, ["doc_id", "text", "source"])
    return r.read_csv(spark, path, ["doc_id", "text", "source"])


@query("SELECT CAST(user_id AS VARCHAR) AS repo_id, min(event_id) AS event_id FROM events WHERE user_id > 9 GROUP BY 1")
def src_csv_bom_fallback(spark, sf):
    """Lines behind a byte order mark, some of them broken; those whose id is well formed, the first of each id."""
    line = F.concat(F.when(F.col("event_id") % 50 == 0, F.lit("﻿")).otherwise(F.lit("")), F.col("user_id"), F.lit(","), F.col("event_id")).alias("value")
    path = _lines(_events(spark, sf).orderBy("event_id").select(line), "value", w.scratch(spark, "t.csv"))
    x = r.read_first_of_each(spark, path, ["repo_id", "event_id"], "repo_id", "[0-9]{2,}")
    return x.select("repo_id", F.col("event_id").cast("long").alias("event_id"))


@query("SELECT CAST(s_suppkey + 1 AS INTEGER) AS rank, s_name AS domain FROM supplier WHERE s_suppkey < 60")
def src_csv_ranked(spark, sf):
    path = w.scratch(spark, "t.csv")
    table(spark, sf, "supplier").orderBy("s_suppkey").select(F.lit("x"), "s_name").write.csv(path)
    return r.read_ranked(spark, path, 60)


@query("SELECT p_name || ' ' || p_partkey AS name, p_partkey * 1000 AS count FROM part WHERE p_partkey % 10 <> 0 AND p_partkey * 1000 > 5000 AND p_partkey * 1000 < 150000")
def src_tsv_counts(spark, sf):
    n = F.when(F.col("p_partkey") % 10 == 0, F.lit("n/a")).otherwise(F.format_number(F.col("p_partkey") * 1000, 0))
    line = F.concat_ws("\t", F.concat_ws(" ", "p_name", "p_partkey"), n)
    x = table(spark, sf, "part").select(line.alias("value")).union(table(spark, sf, "region").select(F.concat(F.lit("# "), "r_name")))
    return r.read_counts(spark, _lines(x, "value", w.scratch(spark, "t.tsv")), 5000, 150000)


@query(ALL_EVENTS)
def src_json_array(spark, sf):
    """Files that each hold JSON arrays of at most 1000 records, one a line."""
    x = _events(spark, sf).groupBy(F.floor(F.col("event_id") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct(*NAMES))).alias("value"))
    path = w.scratch(spark, "t.json")
    x.write.partitionBy("k").text(path)
    return r.read_json_array(spark, f"{path}/k=*", EVENTS)


@query(ALL_EVENTS)
def src_jsonl_strict(spark, sf):
    path = w.scratch(spark, "t.jsonl")
    w.write_jsonl(_events(spark, sf), path)
    return r.read_jsonl(spark, path, EVENTS, strict=True)


@query(f"{ALL_EVENTS} WHERE event_id % 20 <> 0")
def src_jsonl_lenient(spark, sf):
    line = F.when(F.col("event_id") % 20 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct(*NAMES))).alias("value")
    return r.read_jsonl(spark, _lines(_events(spark, sf).select(line), "value", w.scratch(spark, "t.jsonl")), EVENTS)


@query(f"SELECT kind, event_id, user_id, event_type, value, props FROM ({ALL_EVENTS}), (VALUES ('csv'), ('jsonl'), ('parquet')) k(kind)")
def src_autodetect(spark, sf):
    x, out = _events(spark, sf), []
    for kind in ("csv", "jsonl", "parquet"):
        path = w.scratch(spark, f"t.{kind}")
        x.write.parquet(path) if kind == "parquet" else w.write_jsonl(x, path) if kind == "jsonl" else w.write_csv(x, path, NAMES)
        out.append(r.read_any(spark, path, EVENTS).select(F.lit(kind).alias("kind"), "*"))
    return out[0].union(out[1]).union(out[2])


@query("SELECT CASE WHEN event_type = 'view' THEN 'first' ELSE 'other' END AS producer, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def src_glob_json_docs(spark, sf):
    """Records in files below a folder per kind; the producer is told by the file's path."""
    path = w.scratch(spark, "docs")
    _events(spark, sf).withColumn("part", F.col("event_type")).write.partitionBy("part").json(path)
    x = r.read_documents(spark, f"{path}/part=*", EVENTS)
    producer = F.when(F.contains("file", F.lit("part=view")), "first").otherwise("other")
    return x.groupBy(producer.alias("producer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, source FROM documents GROUP BY ALL HAVING lang IS NOT NULL AND source IS NOT NULL")
def src_result_tree(spark, sf):
    """Which (group, model) folders of a tree hold files, from paths alone."""
    path = w.scratch(spark, "tree")
    table(spark, sf, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "source").write.partitionBy("lang", "source").json(path)
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1)
    return r.read_tree(spark, path, "*.json").select(part("lang").alias("lang"), part("source").alias("source")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_json_after_log(spark, sf):
    x = _events(spark, sf).select("event_id", F.concat(F.lit("[log] loading\nready "), "props").alias("t"))
    return x.select("event_id", r.json_after_noise(F.col("t"), "k long")["k"].alias("k"))


@query("WITH x AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS a FROM pages) SELECT page_id, CAST(least(4, len(list_filter(a, lambda u: length(u) % 2 = 0 AND NOT ends_with(lower(u), '.xml')))) AS INTEGER) AS urls FROM x")
def src_sitemap(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    host = lambda u: F.when(F.length(u) % 2 == 0, "https://a.example").otherwise("https://b.example")
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(links, lambda u: F.concat(F.lit("<url><loc>"), host(u), u, F.lit("</loc></url>"))), "\n"), F.lit("</urlset>"))
    return table(spark, sf, "pages").select("page_id", F.size(r.sitemap_urls(xml, F.lit("a.example"), 4)).alias("urls"))


ASSETS = "list_transform(regexp_extract_all(html, '(?:src|href)=\"([^\"]*)\"', 1), lambda u: CASE WHEN length(u) % 2 = 0 THEN 'https://cdn.example.com' ELSE '' END || u)"


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter({ASSETS}, lambda u: contains(lower(u), 'https')))), ' ') AS assets FROM pages WHERE len(list_filter({ASSETS}, lambda u: contains(lower(u), 'https'))) > 0")
def src_repo_assets(spark, sf):
    """Distinct https references of a page; links of even length stand for external ones."""
    urls = F.regexp_extract_all("html", F.lit('(?:src|href)="([^"]*)"'), F.lit(1))
    urls = F.transform(urls, lambda u: F.concat(F.when(F.length(u) % 2 == 0, "https://cdn.example.com").otherwise(""), u))
    urls = F.filter(urls, lambda u: F.contains(F.lower(u), F.lit("https")))
    return table(spark, sf, "pages").select("page_id", F.array_sort(F.array_distinct(urls)).alias("a")).where(F.size("a") > 0).select("page_id", F.array_join("a", " ").alias("assets"))


@query("SELECT conv_id, role, count(*) AS calls, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY GROUPING SETS ((conv_id), (conv_id, role))")
def src_agent_ndjson(spark, sf):
    """Agent events as JSON lines, summed per job and phase and per job."""
    path = w.scratch(spark, "t.ndjson")
    tokens = F.floor((F.length("text") + 3) / 4)
    w.write_jsonl(table(spark, sf, "conversations").select("conv_id", "role", tokens.alias("tokens")), path)
    x = r.read_jsonl(spark, path, "conv_id long, role string, tokens long")
    conv, role = F.col("conv_id"), F.col("role")
    return x.groupingSets([[conv], [conv, role]], conv, role).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_type AS finish FROM events")
def src_sse_usage(spark, sf):
    """The last usage and the last finish reason of each event stream body."""
    data = lambda c: F.concat(F.lit("data: "), c, F.lit("\n"))
    usage = F.concat(F.lit('{"usage": {"total": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    body = F.concat(F.lit(": start\n"), data(F.lit('{"usage": {"total": 0}}')), data(F.concat(F.lit('{"finish": "'), "event_type", F.lit('"}'))), data(usage), F.lit("data: [DONE]\n"))
    x = _events(spark, sf).select("event_id", r.sse_events(body, "usage struct<total:long>, finish string").alias("e"))
    last = lambda get: F.element_at(F.filter(F.transform("e", get), lambda v: v.isNotNull()), -1)
    return x.select("event_id", last(lambda e: e["usage"]["total"]).alias("tokens"), last(lambda e: e["finish"]).alias("finish"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS score FROM events GROUP BY 1, 2")
def src_eval_cache(spark, sf):
    """A cache to which scores are only appended; the latest of each key counts."""
    path = w.scratch(spark, "cache")
    for k in (0, 1):
        _events(spark, sf).where(F.col("event_id") % 2 == k).write.mode("append").parquet(path)
    return spark.read.schema(EVENTS).parquet(path).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("score"))


@query("SELECT user_id AS row_id, max_by(event_type, event_id) AS suggestion FROM events WHERE event_id % 20 <> 0 AND user_id % 9 <> 0 GROUP BY 1")
def src_suggestions_index(spark, sf):
    """The last readable suggestion of each id that is not blank."""
    own = F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).otherwise(F.lit(" "))
    line = F.when(F.col("event_id") % 20 == 0, F.lit("oops")).otherwise(F.to_json(F.struct(own.alias("row_id"), "event_id", "event_type"))).alias("value")
    x = r.read_jsonl(spark, _lines(_events(spark, sf).select(line), "value", w.scratch(spark, "t.jsonl")), "row_id string, event_id long, event_type string")
    return x.where("trim(row_id) <> ''").groupBy(F.col("row_id").cast("long").alias("row_id")).agg(F.max_by("event_type", "event_id").alias("suggestion"))


@query("SELECT page_id, url FROM pages")
def src_hub_dataset(spark, sf):
    """Both splits of a dataset in shards, two columns of three."""
    pages, at = table(spark, sf, "pages"), w.scratch(spark, "hub")
    h.write_hub({"train": pages.where("page_id % 5 <> 0"), "test": pages.where("page_id % 5 = 0")}, at, "page_id", 8)
    split = lambda name: h.read_hub(spark, at, "page_id bigint, url string, html string", name, ["page_id", "url"])
    return split("train").unionByName(split("test"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def sink_csv_project(spark, sf):
    path = w.scratch(spark, "t.csv")
    w.write_csv(table(spark, sf, "orders"), path, ["o_orderkey", "o_orderstatus"])
    return r.read_csv(spark, path, ["o_orderkey", "o_orderstatus"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def sink_csv_append(spark, sf):
    path = w.scratch(spark, "t.csv")
    for k in (0, 1, 2):
        w.write_csv(table(spark, sf, "orders").where(F.col("o_orderkey") % 3 == k), path, ["o_orderkey", "o_orderstatus"], append=True)
    return r.read_csv(spark, path, ["o_orderkey", "o_orderstatus"])


@query(ALL_EVENTS)
def sink_jsonl(spark, sf):
    path = w.scratch(spark, "t.jsonl")
    w.write_jsonl(_events(spark, sf), path)
    return r.read_jsonl(spark, path, EVENTS, strict=True)


@query("SELECT '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS summary FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def sink_json_summary(spark, sf):
    x = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.summary_json(x, "event_type", F.col("n"))


@query("SELECT 'records' AS sink, count(*) AS n FROM events UNION ALL SELECT 'table', count(*) FROM events UNION ALL SELECT 'done', count(DISTINCT user_id) FROM events")
def sink_multi_atomic(spark, sf):
    path = w.scratch(spark, "together")
    for batch in (0, 1, 1):  # a batch that is written again replaces itself
        w.write_together(_events(spark, sf).where(F.col("event_id") % 2 == batch), path, batch, "user_id", ["event_id", "value"])
    n = lambda k, df: df.agg(F.lit(k).alias("sink"), F.count(F.lit(1)).alias("n"))
    done = spark.read.parquet(f"{path}/done")
    whole = lambda df: df.join(done.select("batch").distinct(), "batch", "left_semi")
    table_ = spark.read.schema("event_id string, value string, batch int").csv(f"{path}/table", header=True)
    return n("records", whole(spark.read.schema(f"{EVENTS}, batch int").json(f"{path}/records"))).union(n("table", whole(table_))).union(n("done", done.select("user_id").distinct()))
