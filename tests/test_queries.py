"""Every query that has SQL, against DuckDB on the same tables; and edge rows of the operators."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelens.functions import code, metrics, packages, rules, signatures, urls
from pagelens.operators import aggregates, ordered, text
from pagelens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") if math.isfinite(x) else repr(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(f"{float(x):.9g}")
    return x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.oracle_sql():
        sql = duck.sql(registry.oracle_sql()[name])
        assert sorted(sql.columns) == columns
        at = [sql.columns.index(c) for c in columns]
        assert ours == sorted(repr(tuple(plain(r[k]) for k in at)) for r in sql.fetchall())


def one(spark, column, **row):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], names).select(column.alias("x")).first()["x"]


def test_exclusive_quantile(spark):
    a = F.array(*map(F.lit, [1.0, 2.0, 3.5, 7.0, 20.0, 21.0]))
    got = [one(spark, rules.exclusive_quantile(a, k, 4), v=1.0) for k in (1, 2, 3)]
    assert got == [1.75, 5.25, 20.25]


@pytest.mark.parametrize("metric,value,want", [("LCP", 2500.0, "Good"), ("CLS", 0.25, "Needs Improvement"), ("INP", 501.0, "Poor"), ("LCP", float("nan"), "Poor"), ("X", 1.0, "Unknown")])
def test_rating(spark, metric, value, want):
    assert one(spark, metrics.rating(F.col("m"), F.col("v")), m=metric, v=value) == want


@pytest.mark.parametrize("v,want", [(100.0, 100.0), (150.0, 75.0), (200.0, 50.0), (300.0, 25.0), (500.0, 0.0), (None, None)])
def test_health(spark, v, want):
    assert one(spark, metrics.health_score(F.col("v"), F.lit(100.0), F.lit(200.0)), v=v) == want


def test_clamped_delta(spark):
    d = lambda b, r: one(spark, metrics.clamped_delta(F.col("b"), F.col("r"), 100.0), b=b, r=r)
    assert d(10.0, None) == -1.0 and d(10.0, 5.0) == 0.05 and d(200.0, 900.0) == -1.0 and d(None, 0.0) == 0.0


@pytest.mark.parametrize("url,want", [
    ("https://x.org/", "homepage"), ("https://x.org/fr-fr", "homepage"), ("https://x.org/tv/show", "other"), ("https://x.org/en/feed", "resource"),
    ("https://x.org/a/rss.xml", "resource"), ("https://x.org/a/login", "app"), ("https://x.org/de/impressum", "corporate"), ("https://x.org/blog/page/2", "listing"),
    ("https://x.org/users/7", "profile"), ("https://x.org/docs/x", "documentation"), ("https://x.org/x/sale", "marketing"), ("https://x.org/shop/x", "product"),
    ("https://x.org/blog", "listing"), ("https://x.org/blog/x", "article"), ("https://x.org/2024/05/slug", "article"), ("https://x.org/zzz", "other"),
])
def test_page_type(spark, url, want):
    assert one(spark, urls.page_type(F.col("u")), u=url) == want


@pytest.mark.parametrize("token,want", [
    ("css/bootstrap-3.3.5.min.css", "bootstrap"), ("css/bootstrap-select-1.7.2.min.css", "bootstrap-select"), ("js/jquery-2.1.4.min.js", "jquery"),
    ("https://cdn.example.net/npm/bulma@1.0.0/css/bulma.css", "bulma"), ("https://fonts.googleapis.com/css?family=X", "google-fonts"), ("3d.js", None), ("", None),
])
def test_package_name(spark, token, want):
    assert one(spark, packages.package_name(F.col("t")), t=token) == want


def test_signatures(spark):
    html = '<script src="/_next/static/x.js"></script><div class="btn x">gtag(1) fbq(2)</div>'
    got = {k: one(spark, c, h=html) for k, c in signatures.frameworks(F.col("h"), F.lit("new Vue({})")).items()}
    assert got == {"ui_frameworks": ["Vue 2"], "meta_frameworks": ["Next.js"], "bundlers": [], "cms": [], "css_frameworks": ["Bootstrap"]}
    assert one(spark, signatures.bundler_mark(F.col("h")), h=html) == "/_next/static"
    assert [r["service"] for r in one(spark, signatures.marketing(F.col("h")), h=html)] == ["google_analytics", "facebook_pixel"]
    assert one(spark, signatures.bundler_mark(F.col("h")), h=" " * 50_000 + "parcelRequire") is None


def test_complexity(spark):
    js = "// a\nfunction f(x) {\n  if (x) {\n\n  }\n}\nclass A { g(y) => { return 1 } }\n"
    got = {k: one(spark, c, t=js) for k, c in code.complexity(F.col("t"), F.lit("javascript")).items()}
    assert got == {"blank_lines": 2, "comment_lines": 1, "nesting": 2, "functions": 2, "classes": 1}
    assert one(spark, code.script_verdict(F.col("t")), t="x" * 600) == "long_lines" and one(spark, code.script_verdict(F.col("t")), t=js) is None
    assert [one(spark, code.path_score(F.col("t")), t=p) for p in ("README.md", "docs/index.html", "a/b.css")] == [108, 122, 0]


def test_run_summary_edges(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", float("nan")), ("b", None)] + [("c", v) for v in (1.0, 1.1, 1.2, 1.3, 99.0)] + [("d", 5.0)]
    out = {r["k"]: r for r in aggregates.run_summary(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert (out["a"]["median"], out["a"]["p75"], out["a"]["mean"]) == (2.0, 3.0, 2.0)
    assert out["b"]["valid_runs"] == 0 and out["b"]["median"] is None and out["b"]["total_runs"] == 2
    assert out["d"]["p75"] == 5.0 and out["c"]["valid_runs"] == 5
    assert aggregates.run_summary(spark.createDataFrame([], "k string, value double"), ["k"]).count() == 0


def test_sessions_split_at_exact_gap(spark):
    rows = spark.sql("select 1 k, timestamp_seconds(t) ts from values (0), (10), (20), (29) v(t)")
    assert [r["n"] for r in ordered.gap_sessions(rows, "k", "ts", 10).orderBy("session").collect()] == [1, 1, 2]


def test_pareto_and_crowding(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 2.0), (4, 0.0, 1.0)], "id int, x double, y double")
    assert sorted(r["id"] for r in ordered.pareto(df, "id", ["x", "y"]).collect()) == [1, 2, 3]
    assert all(r["distance"] == float("inf") for r in ordered.crowding(df.limit(2), "id", ["x", "y"]).collect())


def test_text_edges(spark):
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), v=1.0) is None
    assert one(spark, text.strip_fence(F.col("t")), t="```json\n{}\n```") == "{}"
    assert one(spark, F.array_join(text.visible_tokens(F.col("h")), " "), h="<p>Über <script>no</script>über x</p>") == "über x"
    same = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, [])], "k int, t array<string>")
    out = {r["k"]: r["simhash"] for r in text.simhash64(same, "k", F.col("t")).collect()}
    assert out[1] == out[2] and 3 not in out
