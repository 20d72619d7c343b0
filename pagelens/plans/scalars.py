"""Queries of scalar functions: metric math and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m, urls as u
from ..operators import text as t
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def _bind() -> None:
    """Columns that several projections share; they can be made only while a session is there."""
    global v, kind, metric, scaled, b, r, delta, worse, pct, before, after, e, box, url
    v, kind = F.col("value"), F.col("event_type")
    metric = F.when(kind == "view", "LCP").when(kind == "click", "INP").when(kind == "signup", "CLS").otherwise(kind)
    scaled = F.when(kind == "signup", v / 1000).otherwise(v * 10)
    b, r = F.col("s_acctbal"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") * (F.col("s_suppkey") % 5))
    delta, worse = m.clamped_delta(b, r, 100.0), F.col("s_suppkey") % 11 == 0
    pct = m.improvement_pct(F.col("p_retailprice"), F.col("p_size") * 30.0)
    before, after = F.col("p_retailprice"), F.col("p_size") * 30.0
    e = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    box = lambda k: tuple(map(e, range(k, k + 4)))
    url = F.col("url")


def over(name: str, source: str, sql: str, columns):
    """Registers a projection of a table: id columns as they are and the computed ones that columns() gives."""
    keys = {"events": ["event_id"], "pages": ["page_id"], "documents": ["doc_id"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "embeddings": ["vec_id"], "customer": ["c_custkey"], "orders": ["o_orderkey"]}[source]

    def query(spark, sf_dir):
        _bind()
        return table(spark, sf_dir, source).select(*keys, *[c.alias(k) for k, c in columns().items()])

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, {sql} FROM {source}"


METRIC = "CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'signup' THEN 'CLS' ELSE event_type END"
SCALED = "CASE WHEN event_type = 'signup' THEN value / 1000 ELSE value * 10 END"

over("fn_rating", "events", f"""CASE {METRIC}
  WHEN 'LCP' THEN CASE WHEN {SCALED} <= 2500 THEN 'Good' WHEN {SCALED} <= 4000 THEN 'Needs Improvement' ELSE 'Poor' END
  WHEN 'INP' THEN CASE WHEN {SCALED} <= 200 THEN 'Good' WHEN {SCALED} <= 500 THEN 'Needs Improvement' ELSE 'Poor' END
  WHEN 'CLS' THEN CASE WHEN {SCALED} <= 0.1 THEN 'Good' WHEN {SCALED} <= 0.25 THEN 'Needs Improvement' ELSE 'Poor' END
  ELSE 'Unknown' END AS rating""", lambda: dict(rating=m.rating(metric, scaled)))  # fmt: skip
over("fn_health_score", "events", "CASE WHEN value <= 100 THEN 100.0 WHEN value <= 200 THEN 100.0 - 50.0 * (value - 100) / 100 ELSE greatest(0.0, 50.0 * (1 - (value - 200) / 200)) END AS health", lambda: dict(health=m.health_score(v, F.lit(100.0), F.lit(200.0))))
over("fn_tier", "events", "CASE WHEN value <= 100 THEN 2 WHEN value <= 200 THEN 1 ELSE 0 END AS tier", lambda: dict(tier=m.tier(v, F.lit(100.0), F.lit(200.0))))
B, R = "s_acctbal", "CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal * (s_suppkey % 5) END"
DELTA = f"CASE WHEN {R} IS NULL THEN -1.0 ELSE greatest(-1.0, least(1.0, ({B} - ({R})) / greatest({B}, 100.0))) END"
over("fn_clamped_delta", "supplier", f"{DELTA} AS delta", lambda: dict(delta=m.clamped_delta(b, r, 100.0)))
over("fn_composite_score", "supplier", f"greatest(-1.0, least(1.0, 0.5 * ({DELTA}) + 0.35 * (({DELTA}) / 2) + 0.15 * (({DELTA}) / 4) - CASE WHEN s_suppkey % 11 = 0 THEN 1.0 ELSE 0.0 END)) AS score", lambda: dict(score=m.composite_score(delta, delta / 2, delta / 4, worse)))
over("fn_objectives", "supplier", f"CASE WHEN s_suppkey % 11 = 0 THEN -1.0 ELSE ({DELTA}) END AS lcp, CASE WHEN s_suppkey % 11 = 0 THEN -1.0 ELSE ({DELTA}) / 2 END AS inp, CASE WHEN s_suppkey % 11 = 0 THEN -1.0 ELSE ({DELTA}) / 4 END AS cls", lambda: dict(**{k: F.when(worse, -1.0).otherwise(delta / d) for k, d in (("lcp", 1), ("inp", 2), ("cls", 4))}))
PCT = "CASE WHEN p_retailprice > 0 THEN round((p_retailprice - p_size * 30.0) / p_retailprice * 100, 2) END"
over("fn_improvement_pct", "part", f"{PCT} AS pct", lambda: dict(pct=pct))
over("fn_change_class", "part", f"CASE WHEN ({PCT}) > 5 THEN 'improved' WHEN ({PCT}) < -5 THEN 'regressed' ELSE 'no_change' END AS change", lambda: dict(change=m.change_class(pct)))
over("fn_improved_degraded", "part", "p_retailprice - p_size * 30.0 >= 100 AS improved, p_size * 30.0 - p_retailprice > 50 AS degraded", lambda: dict(improved=m.improved(before, after, F.lit(100.0)), degraded=m.degraded(before, after, F.lit(50.0))))
over("fn_log_size", "documents", "CASE WHEN n_chars > 0 THEN log10(n_chars) END AS log_size", lambda: dict(log_size=m.log_size(F.col("n_chars"))))
over("fn_yn", "events", "CASE WHEN event_type = 'error' THEN 'ERR' WHEN value > 100 THEN 'YES' ELSE 'NO' END AS yn", lambda: dict(yn=m.yes_no(F.when(kind != "error", v > 100))))
over("fn_token_split", "orders", "CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN o_custkey - o_orderkey % 2 WHEN o_custkey % 3 <> 0 THEN o_custkey END AS completion", lambda: dict(completion=m.token_split(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.col("o_orderkey") % 2)))
over("fn_est_tokens", "documents", "CAST(ceil(length(text) / 4) AS BIGINT) AS tokens", lambda: dict(tokens=m.estimated_tokens(F.col("text"))))
over("fn_token_budget", "documents", "greatest(0, 500 - CAST(ceil(length(text) / 4) AS BIGINT)) AS room", lambda: dict(room=F.greatest(F.lit(0), 500 - m.estimated_tokens(F.col("text")))))
E = lambda k: f"abs(CAST(embedding[{k + 1}] AS DOUBLE))"
IW = f"greatest(0.0, least({E(0)} + {E(2)}, {E(4)} + {E(6)}) - greatest({E(0)}, {E(4)}))"
IH = f"greatest(0.0, least({E(1)} + {E(3)}, {E(5)} + {E(7)}) - greatest({E(1)}, {E(5)}))"
over("fn_bbox_area_center_iou", "embeddings", f"{E(2)} * {E(3)} AS area, {E(0)} + {E(2)} / 2 AS cx, {E(1)} + {E(3)} / 2 AS cy, {IW} * {IH} / ({E(2)} * {E(3)} + {E(6)} * {E(7)} - {IW} * {IH}) AS iou", lambda: dict(area=m.box_area(e(2), e(3)), cx=e(0) + e(2) / 2, cy=e(1) + e(3) / 2, iou=m.box_iou(box(0), box(4))))

AUTH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
SLUG = f"regexp_replace({AUTH}, '^www\\.', '')"
CANON = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {SLUG} || regexp_replace({PATH}, '/+$', '')"
over("fn_canonical_url", "pages", f"{CANON} AS canonical", lambda: dict(canonical=u.canonical_url(url)))
over("fn_domain_slug", "pages", f"{SLUG} AS slug", lambda: dict(slug=u.domain_slug(url)))
STEM = f"regexp_replace(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/', '__', 'g')"
STEM = f"regexp_replace(CASE WHEN {STEM} = '' THEN 'index' ELSE {STEM} END, '[^A-Za-z0-9_.-]', '_', 'g')"
over("fn_page_slug", "pages", f"left({STEM} || CASE WHEN {QUERY} <> '' THEN '_' || left(md5({QUERY}), 6) ELSE '' END, 100) AS slug", lambda: dict(slug=u.page_slug(url)))
over("fn_slugify", "pages", "left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 80) AS slug", lambda: dict(slug=u.slugify(url)))
over("fn_same_origin", "pages", f"({SLUG} = '' OR {SLUG} = 'example.com' OR ends_with({SLUG}, '.example.com')) AS same", lambda: dict(same=u.same_origin(url, F.lit("https://www.example.com/x"))))
over("fn_rsc_category", "pages", f"CASE WHEN regexp_matches(lower({PATH}), '\\.(png|jpe?g|gif|webp|svg|avif|ico)$') THEN 'image' WHEN regexp_matches(lower({PATH}), '\\.m?js$') THEN 'script' WHEN regexp_matches(lower({PATH}), '\\.css$') THEN 'style' WHEN regexp_matches(lower({PATH}), '\\.(woff2?|ttf|otf|eot)$') THEN 'font' ELSE 'other' END AS category", lambda: dict(category=u.resource_category(url, F.lit(None).cast("string"))))
over("fn_repo_from_url", "pages", "regexp_replace(array_to_string(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '/+$', ''), '/')[1:2], '/'), '\\.git$', '') AS repo", lambda: dict(repo=u.repo_from_url(url)))
over("fn_fuzzy_repo_key", "part", "regexp_replace(regexp_replace(replace(lower(trim(p_name)), 'github.io', 'githubio'), '_[0-9]{8}_[0-9]{6}$', ''), '[^a-z0-9]+', '', 'g') AS repo_key", lambda: dict(repo_key=u.repo_key(F.col("p_name"))))
over("fn_template_id", "part", "coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_partkey || '_x' END, '^([0-9]{1,9})_', 1), '') AS INTEGER), 9999) AS template_id", lambda: dict(template_id=u.leading_number(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("_x"))))))
over("fn_base_token", "part", "regexp_split_to_array(p_brand || '-' || p_size, '[-_.]')[1] AS base", lambda: dict(base=u.base_token(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")))))
over("fn_config_hash", "part", "left(sha256(p_name || p_brand), 16) AS hash", lambda: dict(hash=u.config_hash(F.col("p_name"), F.col("p_brand"))))
over("fn_key_alias", "documents", "coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), nullif(lang, '')) AS k", lambda: dict(k=u.first_filled(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("lang"))))
over("fn_framework_norm", "customer", "CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'construction' WHEN 'automobile' THEN 'vehicles' ELSE lower(trim(c_mktsegment)) END AS segment", lambda: dict(segment=F.coalesce(F.element_at(F.create_map(*map(F.lit, ("building", "construction", "automobile", "vehicles"))), F.lower(F.trim("c_mktsegment"))), F.lower(F.trim("c_mktsegment")))))
over("fn_truncate_head_tail", "documents", "CASE WHEN len(string_split(text, chr(10))) <= 3 THEN text ELSE array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '... (' || (len(string_split(text, chr(10))) - 3) || ' more lines)' END AS head, right(text, 50) AS tail, left(text, 40) AS start", lambda: dict(head=t.first_lines(F.col("text"), 3), tail=F.right(F.col("text"), F.lit(50)), start=F.left(F.col("text"), F.lit(40))))
over("fn_xpath_transform", "part", "regexp_replace(replace('/html[1]/body[1]/div[' || p_size || ']', '/', '__'), '([A-Za-z0-9]+)\\[([0-9]+)\\]', '\\1_\\2', 'g') AS id", lambda: dict(id=F.regexp_replace(F.replace(F.concat(F.lit("/html[1]/body[1]/div["), F.col("p_size").cast("string"), F.lit("]")), F.lit("/"), F.lit("__")), "([A-Za-z0-9]+)\\[([0-9]+)\\]", "$1_$2")))
over("fn_json_path", "events", "coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END, -1) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS top", lambda: dict(k=t.json_at(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))).otherwise(F.lit('{"a": null}')), "$.a.b.k", "long", -1), top=t.json_at(F.col("props"), "$.k", "long", 0)))
over("flt_keyword_gate", "documents", "regexp_matches(lower(text || CASE WHEN doc_id % 3 = 0 THEN ' Render-Blocking' ELSE '' END), 'lcp|inp|cls|largest contentful paint|interaction to next paint|cumulative layout shift|lazy|preload|defer|async|image|font|cache|render-blocking|critical|viewport|width|height|layout shift|resource hint') AS has_keyword", lambda: dict(has_keyword=t.speaks_of_vitals(F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Render-Blocking").otherwise("")))))
