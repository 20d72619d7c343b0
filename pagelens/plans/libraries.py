"""Queries of page types, names of packages and files, signatures, code measures and dependent selections.

The tables hold no such values, so each query makes them from a list of cases and the row's key.
"""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import assets as a, code as c, packages as p, signatures as g, urls as u
from ..operators import repositories, selection as s
from ..operators.rounds import written
from ..sources.tables import table
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()


def _case(cases: list[str], key: str):
    """The case of a row: by its key, in turn."""
    return F.get(F.array(*map(F.lit, cases)), (F.col(key) % len(cases)).cast("int"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_sql(cases: list[str], key: str) -> str:
    return f"([{', '.join(map(_quoted, cases))}])[CAST({key} % {len(cases)} AS BIGINT) + 1]"


def _list(words) -> str:
    return f"[{', '.join(map(_quoted, words))}]"


PATHS = ["/", "/en/", "/tv/x", "/feed", "/a/rss.xml", "/x/Login", "/fr-fr/impressum", "/blog/page/3", "/a/tags/b", "/users/4", "/docs/api", "/x/sale", "/de/shop/7", "/blog", "/news/x", "/2024/05/title", "/2024/05/09/title/x", "/zzz"]
PARTS = "list_filter(string_split(lower(path), '/'), lambda x: x <> '')"


@query(f"""WITH x AS (SELECT page_id, {_case_sql(PATHS, 'page_id')} AS path FROM pages), y AS (SELECT page_id, {PARTS} AS a FROM x),
 z AS (SELECT page_id, CASE WHEN len(a) > 0 AND regexp_full_match(a[1], '({'|'.join(u.LANGUAGE_CODES)})([-_][a-z][a-z])?') THEN a[2:] ELSE a END AS a FROM y)
SELECT page_id, CASE WHEN len(a) = 0 THEN 'homepage' WHEN list_contains({_list(u.FEED_FIRST)}, a[1]) OR list_contains({_list(u.FEED_LAST)}, a[-1]) THEN 'resource'
 WHEN list_has_any(a, {_list(u.APP)}) THEN 'app' WHEN list_has_any(a, {_list(u.CORPORATE)}) THEN 'corporate' WHEN list_has_any(a, {_list(u.LISTING)}) OR regexp_matches('/' || array_to_string(a, '/'), '/page[/-]?[0-9]') THEN 'listing'
 WHEN list_contains({_list(u.PROFILE)}, a[1]) THEN 'profile' WHEN list_contains({_list(u.DOCS)}, a[1]) THEN 'documentation' WHEN list_has_any(a, {_list(u.MARKETING)}) THEN 'marketing' WHEN list_contains({_list(u.PRODUCT)}, a[1]) THEN 'product'
 WHEN list_contains({_list(u.BLOG)}, a[1]) THEN CASE WHEN len(a) = 1 THEN 'listing' ELSE 'article' END
 WHEN len(a) BETWEEN 2 AND 4 AND regexp_full_match(a[1], '[0-9]{{4}}') AND regexp_full_match(a[2], '[0-9]{{2}}') AND (len(a) < 4 OR regexp_full_match(a[3], '[0-9]{{2}}')) THEN 'article' ELSE 'other' END AS page_type FROM z""")
def fn_page_type(spark, sf):
    url = F.concat(F.lit("https://"), u.authority(F.col("url")), _case(PATHS, "page_id"), F.lit("?x=1"))
    return table(spark, sf, "pages").select("page_id", u.page_type(url).alias("page_type"))


REPOS = ["ACME/site", "ACME/acme.GitHub.io", "https://acme.example.org/x", "http://a.example", "plain.example"]


@query(f"""WITH x AS (SELECT s_suppkey, replace({_case_sql(REPOS, 's_suppkey')}, 'ACME', 'org' || s_nationkey) AS r FROM supplier)
SELECT s_suppkey, CASE WHEN starts_with(r, 'http') THEN r WHEN NOT contains(r, '/') THEN 'https://' || r WHEN ends_with(lower(r), '.github.io') THEN 'https://' || split_part(r, '/', 2) || ' https://' || split_part(r, '/', 1) || '.github.io/' || split_part(r, '/', 2)
 ELSE 'https://' || split_part(r, '/', 1) || '.github.io/' || split_part(r, '/', 2) END AS urls FROM x""")
def fn_site_urls(spark, sf):
    repo = F.replace(_case(REPOS, "s_suppkey"), F.lit("ACME"), F.concat(F.lit("org"), "s_nationkey"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(u.site_urls(repo), " ").alias("urls"))


FILES = ["/a/app.js?v=1", "/a/app", "/", "/style.CSS#x", "/img/logo.png", "/data"]
KINDS = ["text/javascript; charset=utf-8", "application/javascript", "text/html", "text/css", "image/jpeg", "application/octet-stream", "image/svg+xml"]
WANTED = "CASE WHEN contains(t, 'css') THEN '.css' WHEN contains(t, 'javascript') THEN '.js' WHEN contains(t, 'html') THEN '.html' WHEN contains(t, 'jpeg') THEN '.jpg' WHEN contains(t, 'svg') THEN '.svg' ELSE '' END"


@query(f"""WITH x AS (SELECT page_id, unnest(list_append(regexp_extract_all(html, 'href="([^"]*)"', 1), {_case_sql(FILES, 'page_id')})) AS f, {_case_sql(KINDS, 'page_id')} AS t FROM pages), y AS (SELECT page_id, f, split_part(split_part(split_part(f, '?', 1), '#', 1), '/', -1) AS n, {WANTED} AS e FROM x),
 z AS (SELECT page_id, f, CASE WHEN n = '' THEN 'index' ELSE n END AS n, e FROM y) SELECT page_id, f AS address, CASE WHEN e <> '' AND NOT ends_with(lower(n), e) THEN n || e ELSE n END AS name FROM z""")
def fn_safe_filename(spark, sf):
    """Names of the files that a page's links would be stored in, and of one of a list."""
    x = table(spark, sf, "pages").select("page_id", F.explode(F.array_append(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), _case(FILES, "page_id"))).alias("address"))
    return x.select("page_id", "address", u.safe_filename(F.concat(F.lit("https://x.example"), "address"), _case(KINDS, "page_id")).alias("name"))


ASSETS = ["https://static.example.com/a.js", "//cdn.other.net/b.js", "https://a.b.shop.co.uk/x", "https://x.github.io/y", "https://example.org:8080/z"]
HOMES = ["https://www.example.com/", "https://example.org/a", "https://shop.co.uk", "https://y.github.io"]
APEX = "CASE WHEN regexp_matches(h, '(^|\\.)(co\\.uk|github\\.io)$') THEN regexp_extract(h, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE regexp_extract(h, '([^.]+\\.[^.]+)$', 1) END"


@query(f"""WITH x AS (SELECT page_id, url, {_case_sql(ASSETS, 'page_id')} AS a, {_case_sql(HOMES, 'page_id')} AS p, regexp_extract(url, '//([^/:]+)', 1) AS h FROM pages),
 z AS (SELECT page_id, unnest([a, a, '//static.' || h || ':8080/x.js', '//' || regexp_extract(h, '[.](.*)', 1) || '/y.css']) AS asset, unnest([p, url, url, url]) AS page FROM x), y AS (SELECT *, regexp_extract(asset, '//([^/:]+)', 1) AS ah, regexp_extract(page, '//([^/:]+)', 1) AS ph FROM z)
SELECT page_id, asset, page, {APEX.replace('h,', 'ah,')} = {APEX.replace('h,', 'ph,')} AS own FROM y""")
def fn_apex_own_asset(spark, sf):
    """Assets of a list, of a page's own host, of a host below it and of the one above it, against the page."""
    host, a = F.regexp_extract("url", "//([^/:]+)", 1), _case(ASSETS, "page_id")
    pair = lambda asset, page: F.struct(asset.alias("asset"), page.alias("page"))
    own = [F.concat(F.lit("//static."), host, F.lit(":8080/x.js")), F.concat(F.lit("//"), F.regexp_extract(host, "[.](.*)", 1), F.lit("/y.css"))]
    pairs = F.array(pair(a, _case(HOMES, "page_id")), *[pair(x, F.col("url")) for x in (a, *own)])
    x = table(spark, sf, "pages").select("page_id", F.explode(pairs).alias("e")).select("page_id", "e.*")
    return x.withColumn("own", u.own_asset(F.col("asset"), F.col("page")))


TOKENS = ["css/NAME-3.3.5.min.css", "https://cdn.example.net/npm/NAME@1.0/dist/x.js", "https://fonts.googleapis.com/css?family=A", "js/NAME-select-1.7.min.js", "js/jquery.js", "x/", "3d.min.js", "https://h.example/a/NAME.bundle.js?v=2#t", "react-dom.js"]
NAME = "replace(p_name, ' ', '-')"
STOP = "list_position(list_transform(a, lambda y: regexp_matches(y, '^[0-9]')), true)"


@query(f"""WITH x AS (SELECT p_partkey, lower(replace({_case_sql(TOKENS, 'p_partkey')}, 'NAME', {NAME})) AS t FROM part), y AS (SELECT *, regexp_extract(t, '/npm/([^/@]+)', 1) AS npm,
 list_filter(regexp_split_to_array(replace(replace(regexp_replace(regexp_replace(split_part(split_part(split_part(t, '?', 1), '#', 1), '/', -1), '\\.css$', ''), '\\.js$', ''), '.min', ''), '-min', ''), '[-_.]'), lambda y: y <> '') AS a FROM x),
 z AS (SELECT *, array_to_string(CASE WHEN coalesce({STOP}, 0) > 0 THEN a[1:{STOP} - 1] ELSE a END, '-') AS n FROM y)
SELECT p_partkey, CASE WHEN npm <> '' THEN npm WHEN contains(t, 'fonts.googleapis.com') THEN 'google-fonts' WHEN n <> '' THEN n END AS package FROM z""")
def fn_package_name(spark, sf):
    token = F.replace(_case(TOKENS, "p_partkey"), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", p.package_name(token).alias("package"))


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(t, 'jquery') THEN 'jquery' WHEN regexp_matches(t, 'bootstrap') THEN 'bootstrap' WHEN contains(t, 'react') THEN 'react' WHEN contains(t, 'three') THEN 'threejs' WHEN contains(t, 'd3') THEN 'd3' END AS library
FROM (SELECT p_partkey, {_case_sql(['bootstrap.min.css', 'JQuery-ui', 'x.js', 'd3.v7', 'three.module', 'react-dom'], 'p_partkey')} AS o, lower(o) AS t FROM part)""")
def fn_canonical_lib(spark, sf):
    token = _case(["bootstrap.min.css", "JQuery-ui", "x.js", "d3.v7", "three.module", "react-dom"], "p_partkey")
    return table(spark, sf, "part").select("p_partkey", p.library(token).alias("library"))


PACKAGES = ["NAME", "main", "NAME-min", "2024", "vendor", "NAME-theme", "NAME.map", "ab", "deadbeef0123x", "github", "NAME-old", "css"]
PACKAGE = f"replace({_case_sql(PACKAGES, 'p_partkey')}, 'NAME', {NAME})"


def _package():
    return F.replace(_case(PACKAGES, "p_partkey"), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit("-")))


@query(f"SELECT p_partkey, t AS package FROM (SELECT p_partkey, {PACKAGE} AS t FROM part) WHERE t NOT IN ('', 'all', 'main', 'page', 'pages', 'script', 'scripts', 'style', 'styles', 'lib', 'libs', 'build', 'dist', 'bundle', 'vendor', 'assets', 'static', 'js', 'css') AND NOT regexp_matches(t, '(-map|-css-map|-js-map|-themes?|-bundle|-min|-old)$|^[0-9]+$')")
def flt_junk_structural(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _package().alias("package")).where(~p.structural_junk(F.col("package")))


@query(f"SELECT p_partkey, t AS package FROM (SELECT p_partkey, {PACKAGE} AS t FROM part) WHERE t NOT IN ('main', 'vendor', 'github', 'css') AND NOT contains(t, '.map') AND NOT (regexp_matches(t, '[a-f0-9]{{8}}') AND length(t) > 10) AND length(t) > 2")
def flt_junk_explicit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _package().alias("package")).where(~p.explicit_junk(F.col("package")))


STATS = ['{"build_artifacts": ["js/NAME.min.js", "a.css", "b.min.css", "b.min.css"]}', "{\"other\": 1}", "x 'dist/NAME.min.js' and \"y.js\", 'z.min.css'", "none"]


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'b.min.css js/' || {NAME} || '.min.js' WHEN 2 THEN 'dist/' || {NAME} || '.min.js z.min.css' ELSE '' END AS artifacts FROM part")
def txt_minified_from_stats(spark, sf):
    stats = F.replace(_case(STATS, "p_partkey"), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(p.minified_artifacts(stats), " ").alias("artifacts"))


MANIFESTS = ['{"dependencies": {"NAME": "1", "vue": "^3"}, "devDependencies": {"vite": "5"}}', "# pinned\nNAME==1.2\n\nflask>=2.0\nnumpy\n", "gem 'NAME'\ngem \"jekyll\", '~> 4'", "require example.org/NAME v1\nrequire x.org/y v2"]


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN n || ' vue vite' WHEN 1 THEN n || ' flask numpy' WHEN 2 THEN n || ' jekyll' ELSE 'example.org/' || n || ' x.org/y' END AS names FROM (SELECT p_partkey, {NAME} AS n FROM part)")
def txt_deps_parse(spark, sf):
    manifest = F.replace(_case(MANIFESTS, "p_partkey"), F.lit("NAME"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(p.dependencies(manifest, _case(["npm", "pip", "gem", "go"], "p_partkey")), " ").alias("names"))


SNIPPETS = [
    "", '<script src="/_next/static/Jquery.min.js"></script><div class="btn x">gtag(1)</div>', "<link href='/wp-content/bootstrap.css'><script>fbq(1); import a from 'vue'; const d = require('d3')</script>",
    '<meta name="generator" content="Hugo 1"><div x-data="{}" class="columns"></div>', '<script src="https://cdn.shopify.com/x.js">window.webpackJsonp=[]</script> intercom.io analytics.js',
]
SNIPPED = f"SELECT page_id, html || {_case_sql(SNIPPETS, 'page_id')} AS t FROM pages"


def _snipped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat("html", _case(SNIPPETS, "page_id")).alias("t"))


def _found_sql(tab) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_quoted('(?i)' + '|'.join(x))}) THEN {_quoted(n)} END" for n, x in tab) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT page_id, {', '.join(f'array_to_string({_found_sql(tab)}, chr(44)) AS {k}' for k, tab in g.FRAMEWORKS.items())} FROM ({SNIPPED})")
def txt_framework_fp(spark, sf):
    return g.with_frameworks(_snipped(spark, sf), "t").select("page_id", *[F.array_join(k, ",").alias(k) for k in g.FRAMEWORKS])


@query(f"SELECT page_id, nullif(regexp_extract(left(t, 50000), '__webpack_require__|webpackJsonp|__webpack_modules__|/_next/static|__NEXT_DATA__|/_nuxt/|/__vite__|vite/dist/client|/_app/immutable|__sveltekit|/gatsby-|___gatsby|__remixContext|parcelRequire'), '') AS mark FROM ({SNIPPED})")
def txt_bundler_fp(spark, sf):
    return _snipped(spark, sf).select("page_id", g.bundler_mark(F.col("t")).alias("mark"))


@query(" UNION ALL ".join(f"SELECT page_id, {_quoted(n)} AS service, CAST(len(list_filter({_list(x)}, lambda r: regexp_matches(t, '(?i)' || r))) AS INTEGER) AS patterns FROM ({SNIPPED}) WHERE regexp_matches(t, {_quoted('(?i)' + '|'.join(x))})" for n, x in g.MARKETING))
def txt_marketing_stack(spark, sf):
    return _snipped(spark, sf).select("page_id", F.explode(g.marketing(F.col("t"))).alias("s")).select("page_id", "s.service", F.size("s.found").alias("patterns"))


LIBS = [("bootstrap", "bootstrap"), ("d3", "d3"), ("jquery", "jquery"), ("vue", "vue")]


@query(f"SELECT page_id, array_to_string(list_filter([{', '.join(_quoted(n) + ' || CASE WHEN len(list_filter(a, lambda x: contains(x, ' + _quoted(w) + '))) > 0 THEN chr(32) ELSE NULL END' for n, w in LIBS)}], lambda x: x IS NOT NULL), ',') AS libraries FROM (SELECT page_id, list_concat(regexp_extract_all(lower(t), '(?:src|href)=[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(lower(t), '(?:import\\s.*?from\\s+|require\\()[''\"]([^''\"]+)[''\"]', 1)) AS a FROM ({SNIPPED}))")
def txt_libs_from_text(spark, sf):
    named = F.transform(F.filter(p.libraries_in(F.col("t")), lambda x: x.isin([n for n, _ in LIBS])), lambda x: F.concat(x, F.lit(" ")))
    return _snipped(spark, sf).select("page_id", F.array_join(named, ",").alias("libraries"))


MAP = {"/The": "T.html", "/The/x": "TX.html", "/to": "t.html", "/and": "a.html"}


@query("SELECT page_id, md5(replace(replace(replace(replace(t, '/The/x', 'TX.html'), '/The', 'T.html'), '/and', 'a.html'), '/to', 't.html')) AS hash FROM (SELECT page_id, html || '<a href=\"/The/x\">' AS t FROM pages)")
def txt_rewrite_longest_first(spark, sf):
    """Every key of a map replaced by its value, the longest keys first."""
    pairs = F.array(*[F.struct(F.lit(-len(k)).alias("n"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in MAP.items()])
    text = F.aggregate(F.array_sort(pairs), F.concat("html", F.lit('<a href="/The/x">')), lambda t, e: F.replace(t, e["k"], e["v"]))
    return table(spark, sf, "pages").select("page_id", F.md5(text).alias("hash"))


CODE = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, chr(10), '') WHEN 2 THEN regexp_replace(html, '[ \\t\\n\\r]', '', 'g') || '//' ELSE replace(html, '>', '>' || chr(10)) || '){return' END AS t FROM pages"
SPACE = "(length(t) - length(regexp_replace(t, '[ \\t\\n\\r]', '', 'g'))) / length(t)"
MEAN = "length(t) / len(string_split(t, chr(10)))"


def _code(spark, sf):
    k = F.col("page_id") % 4
    t = F.when(k == 0, F.col("html")).when(k == 1, F.replace("html", F.lit("\n"), F.lit(""))).when(k == 2, F.concat(F.regexp_replace("html", "[ \\t\\n\\r]", ""), F.lit("//"))).otherwise(F.concat(F.replace("html", F.lit(">"), F.lit(">\n")), F.lit("){return")))
    return table(spark, sf, "pages").select("page_id", t.alias("t"))


@query(f"""SELECT page_id, CASE WHEN {MEAN} > 500 THEN 'long_lines' WHEN regexp_matches(left(t, 3000), '\\{{return[^\\s]|;var[^\\s]|;function[^\\s]|\\}}else\\{{|\\)\\{{|\\}}catch\\(|\\}}finally\\{{|,function\\(') AND {SPACE} < 0.1 THEN 'syntax'
 WHEN {SPACE} < 0.05 AND NOT regexp_matches(t, '//|(?s:/\\*.*?\\*/)') THEN 'no_space' END AS script, ({MEAN} > 500 OR {MEAN} > 80 AND {SPACE} < 0.06) AS style FROM ({CODE})""")
def fn_minified_verdict(spark, sf):
    t = F.col("t")
    return _code(spark, sf).select("page_id", c.script_verdict(t).alias("script"), c.style_minified(t, F.lit("a.css")).alias("style"))


@query(f"""WITH l AS (SELECT page_id, i, string_split(t, chr(10))[i] AS x FROM (SELECT page_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM (SELECT page_id, html || chr(10) || '// note' || chr(10) || chr(10) || 'function f(x) {{' || chr(10) || ' class B {{ a(b) => 1 }}' || chr(10) || '}}' AS t FROM pages))),
 n AS (SELECT *, regexp_matches(x, '[^ \\t\\r\\f\\v]') AS full_, length(x) - length(replace(x, '{{', '')) - length(x) + length(replace(x, '}}', '')) AS d FROM l),
 r AS (SELECT *, sum(CASE WHEN full_ THEN d ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM n)
SELECT page_id, count(*) FILTER (NOT full_) AS blank_lines, count(*) FILTER (regexp_matches(x, '^\\s*(//|/\\*)')) AS comment_lines, CAST(greatest(0, max(depth) FILTER (full_)) AS BIGINT) AS nesting,
 count(*) FILTER (regexp_matches(x, '\\bfunction\\s+\\w+|\\w+\\s*\\(.*\\)\\s*=>')) AS functions, count(*) FILTER (regexp_matches(x, '\\bclass\\s+\\w+')) AS classes FROM r GROUP BY 1""")
def fn_complexity(spark, sf):
    code = F.concat("html", F.lit("\n// note\n\nfunction f(x) {\n class B { a(b) => 1 }\n}"))
    return table(spark, sf, "pages").select("page_id", *[x.alias(k) for k, x in c.complexity(code, F.lit("javascript")).items()])


FILE_PATHS = ["README.md", "docs/index.html", "src/App.vue", "package.json", "_config.yml", "blog/posts/NAME.md", "mkdocs.yml", "a/NAME.css"]
POINTS = [108, 122, 8, 70, 60, 33, 80, 0]


@query(f"SELECT p_partkey, ({POINTS})[CAST(p_partkey % 8 AS BIGINT) + 1] AS points FROM part")
def fn_path_score(spark, sf):
    path = F.replace(_case(FILE_PATHS, "p_partkey"), F.lit("NAME"), F.lit("x"))
    return table(spark, sf, "part").select("p_partkey", c.path_score(path).alias("points"))


# Audits that are opportunities, and display modes of audits that do not apply.
OPPORTUNITIES = (
    "uses-optimized-images uses-modern-image-formats uses-text-compression render-blocking-resources unminified-css "
    "unminified-javascript unused-css-rules unused-javascript uses-responsive-images efficient-animated-content "
    "duplicated-javascript legacy-javascript server-response-time redirects uses-rel-preconnect prioritize-lcp-image unsized-images"
).split()
NOT_APPLIED = ["notApplicable", "informational", "manual"]
AUDIT = "map<string, struct<score:double, scoreDisplayMode:string, title:string, displayValue:string, details:struct<overallSavingsMs:double, overallSavingsBytes:double>>>"


def opportunities(df, key: str, audits: str):
    """key, id, title, savings_ms and savings_kb of audits that are opportunities, apply and score below 1."""
    x = df.select(key, F.explode(F.from_json(audits, AUDIT)).alias("id", "a")).where(F.col("id").isin(OPPORTUNITIES))
    x = x.where(~F.coalesce(F.col("a.scoreDisplayMode"), F.lit("")).isin(NOT_APPLIED) & (F.col("a.score") < 1))
    some = lambda v: F.nullif(v, F.lit(0.0))
    return x.select(key, "id", F.coalesce("a.title", "id").alias("title"), some(F.col("a.details.overallSavingsMs")).alias("savings_ms"), F.round(some(F.col("a.details.overallSavingsBytes")) / 1024, 1).alias("savings_kb"))


@query("""SELECT p_partkey, 'redirects' AS id, 'R' AS title, CAST(nullif(p_size, 10) AS DOUBLE) AS savings_ms, CAST(NULL AS DOUBLE) AS savings_kb FROM part WHERE p_size < 50
UNION ALL SELECT p_partkey, 'unused-css-rules', 'unused-css-rules', NULL, round(p_size * 100.0 / 1024, 1) FROM part WHERE p_size % 2 = 0""")
def fn_psi_opportunities(spark, sf):
    size = F.col("p_size")
    audits = F.format_string('{"redirects": {"score": %s, "title": "R", "details": {"overallSavingsMs": %d}}, "unused-css-rules": {"score": 0, "scoreDisplayMode": "%s", "details": {"overallSavingsBytes": %d}}, "other": {"score": 0}}', (size / 50).cast("string"), F.when(size == 10, 0).otherwise(size), F.when(size % 2 == 0, "numeric").otherwise("manual"), size * 100)
    return opportunities(table(spark, sf, "part").select("p_partkey", audits.alias("audits")), "p_partkey", "audits")


@query("SELECT o, CAST(sum(n) AS BIGINT) AS total_assets, sum(q) AS total_bytes, string_agg(t || '=' || n, ',' ORDER BY t) AS breakdown FROM (SELECT l_orderkey AS o, CASE l_partkey % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'css' WHEN 2 THEN 'img' ELSE 'other' END AS t, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg_mirror_meta(spark, sf):
    """Assets and bytes of a mirror, and how many lie in each folder below the first."""
    path = F.concat(_case(["assets/js/", "assets/css/", "assets/img/", ""], "l_partkey"), F.col("l_partkey").cast("string"))
    parts = F.split(path, "/")
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("other").alias("t"), "l_quantity")
    x = x.groupBy("o", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    x = x.groupBy("o").agg(F.sum("n").alias("total_assets"), F.sum("q").alias("total_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("m"))
    return x.select("o", "total_assets", "total_bytes", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("breakdown"))


@query("""WITH d AS (SELECT user_id, event_id, event_type <> 'error' AS ok, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), p AS (SELECT user_id, bool_or(ok) AS ok, sum(k % 3) AS new, sum(k % 2) AS fixed FROM d GROUP BY 1)
SELECT count(*) AS total_pages, CAST(0 AS BIGINT) AS live_ok, CAST(coalesce(sum(new) FILTER (ok), 0) AS BIGINT) AS new_errors, CAST(coalesce(sum(fixed) FILTER (ok), 0) AS BIGINT) AS fixed_errors FROM p""")
def agg_report_totals(spark, sf):
    """Pages, and new and fixed errors over all devices of pages of which one device is ok. live_ok counts a
    page's own status, which only its devices have: always 0, as in the reports this replaces."""
    k = F.get_json_object("props", "$.k").cast("int")
    errors = lambda n: F.sum(F.size(F.array_repeat(F.lit("e"), n)))
    page = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") != "error").alias("ok"), errors(k % 3).alias("new"), errors(k % 2).alias("fixed"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).cast("long")
    return page.agg(F.count(F.lit(1)).alias("total_pages"), F.lit(0).cast("long").alias("live_ok"), total("new").alias("new_errors"), total("fixed").alias("fixed_errors"))


SCORE = "CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 5 WHEN 'signup' THEN 0 ELSE 4 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, arg_max(event_type, (s, -first)) AS root, CAST(max(s) AS INTEGER) AS score FROM (SELECT user_id, event_type, max({SCORE}) AS s, min(event_id) AS first FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2) GROUP BY 1")
def txt_detect_rank(spark, sf):
    """The project root of a repository with the most points, the first of equals: confidence (high 3, medium 2,
    low 1, none 0), 3 for a known framework, 2 for a build script, 1 for the repository's own folder."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    points = F.when(kind == "view", 3 + 3).when(kind == "click", 2 + 3).when(kind == "signup", 0).otherwise(1 + 3)
    points = points + F.when(k % 5 == 0, 2).otherwise(0) + F.when(kind == "error", 1).otherwise(0)
    root = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(points).alias("s"), F.min("event_id").alias("first"))
    return root.groupBy("user_id").agg(F.max_by("event_type", F.struct("s", -F.col("first"))).alias("root"), F.max("s").alias("score"))


MARKERS = ["package.json", "index.html", "mkdocs.yml", "_config.yml", "hugo.toml", "hugo.yaml", "hugo.yml", "config.toml", "vite.config.js", "vite.config.ts", "next.config.js", "next.config.mjs", "astro.config.mjs", "gatsby-config.js"]
SKIPPED = ["node_modules", "dist", "build", ".next", "public", "_site", "site"]
TREES = ["app/package.json", "dist/index.html", ".git/index.html", "docs/mkdocs.yml", "web/src/index.html", "site/x.md", "api/main.py", "blog/hugo.toml"]


@query(f"""WITH f AS (SELECT DISTINCT l_orderkey AS repo, ({_list(TREES)})[CAST(l_partkey % 8 AS BIGINT) + 1] AS path FROM lineitem), r AS (SELECT DISTINCT repo, split_part(path, '/', 1) AS root FROM f WHERE path IN ('app/package.json', 'docs/mkdocs.yml', 'blog/hugo.toml'))
SELECT repo, root FROM (SELECT repo, '.' AS root FROM f UNION SELECT repo, root FROM r)""")
def flt_project_roots(spark, sf):
    """The repository's own folder and its folders that hold a marker file, without hidden and built ones; ten at most."""
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("repo"), F.split(_case(TREES, "l_partkey"), "/").alias("a"))
    root = F.get("a", F.lit(0))
    child = (F.size("a") == 2) & F.get("a", F.lit(1)).isin(MARKERS) & ~root.isin(SKIPPED) & ~F.startswith(root, F.lit("."))
    x = f.select("repo", F.explode(F.array_compact(F.array(F.lit("."), F.when(child, root)))).alias("root")).distinct()
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.col("root") != ".", "root"))
    return x.withColumn("place", place).where("place <= 10").select("repo", "root")


VARIANTS = "SELECT DISTINCT l_orderkey AS repo, CASE l_partkey % 5 WHEN 0 THEN 'jquery' WHEN 1 THEN 'jquery-ui' WHEN 2 THEN 'vue.router' WHEN 3 THEN 'd3_' || l_partkey % 7 ELSE 'd3' END AS p FROM lineitem"


@query(f"""WITH x AS ({VARIANTS}), f AS (SELECT p, count(*) AS n FROM x GROUP BY 1), b AS (SELECT repo, regexp_split_to_array(p, '[-_.]')[1] AS b, count(*) AS m FROM x GROUP BY 1, 2),
 r AS (SELECT repo, b, m / greatest(1, coalesce(n, 0)) > 0.85 AS one FROM b LEFT JOIN f ON f.p = b.b)
SELECT DISTINCT x.repo, CASE WHEN one THEN b ELSE p END AS package FROM x JOIN r ON r.repo = x.repo AND r.b = regexp_split_to_array(p, '[-_.]')[1]""")
def agg_variant_collapse(spark, sf):
    k = F.col("l_partkey") % 5
    name = F.when(k == 0, "jquery").when(k == 1, "jquery-ui").when(k == 2, "vue.router").when(k == 3, F.concat(F.lit("d3_"), F.col("l_partkey") % 7)).otherwise("d3")
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("repo"), name.alias("package"))
    return s.collapse_variants(x, "repo", "package", u.base_token(F.col("package")))


TARGET = "regexp_replace(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name || ' site' ELSE left(p_name, 2) END, '[^a-z0-9]+', '', 'g')"


@query(f"""WITH t AS (SELECT p_partkey, {TARGET} AS a FROM part), d AS (SELECT DISTINCT replace(p_name, ' ', '') AS b FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, dir FROM (SELECT p_partkey, b AS dir, row_number() OVER (PARTITION BY p_partkey ORDER BY a = b DESC, abs(length(a) - length(b)), b) AS r FROM t LEFT JOIN d ON contains(a, b) OR contains(b, a)) WHERE r = 1""")
def join_fuzzy_containment(spark, sf):
    x, k = table(spark, sf, "part"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).when(k == 2, F.concat("p_name", F.lit(" site"))).otherwise(F.left("p_name", F.lit(2)))
    left = x.select("p_partkey", F.regexp_replace(name, "[^a-z0-9]+", "").alias("a"))
    return s.contained_match(left, x.where("p_partkey % 3 = 0").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("dir")), "p_partkey", "a", "dir")


QUOTA = "WITH z AS (SELECT lang, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1500 THEN 1 ELSE 2 END AS b, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT lang, CAST(least(60, sum(n)) AS BIGINT) AS q, coalesce(max(n) FILTER (b = 0), 0) AS n0, coalesce(max(n) FILTER (b = 1), 0) AS n1, coalesce(max(n) FILTER (b = 2), 0) AS n2 FROM z GROUP BY 1), a AS (SELECT *, least(q * 60 // 224, n0) AS t0, q * 60 // 224 AS s0, q * 72 // 224 AS s1 FROM t), c AS (SELECT *, least(s1 + s0 - t0, n1) AS t1 FROM a), e AS (SELECT *, least(q - t0 - t1, n2) AS t2 FROM c)"


@query(f"{QUOTA} SELECT * FROM (SELECT lang, 'B2' AS bin, t0 AS take FROM e UNION ALL SELECT lang, 'B3', t1 FROM e UNION ALL SELECT lang, 'B4', t2 FROM e) WHERE take > 0")
def smp_quota_alloc(spark, sf):
    return _quotas(spark, sf)


def _binned(spark, sf):
    place = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 1500, 1).otherwise(2)
    return table(spark, sf, "documents").withColumn("place", place)


#: Documents of a language at most, see QUOTA.
QUOTA_MOST = 60


def _quotas(spark, sf):
    sizes = _binned(spark, sf).groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(QUOTA_MOST), F.sum("n")).alias("quota"))
    sizes = sizes.join(total, F.col("lang").eqNullSafe(F.col("of"))).withColumn("bin", F.concat(F.lit("B"), (F.col("place") + 2).cast("string")))
    return s.quotas(sizes, "lang", "bin", F.col("place"), F.col("n"), F.col("quota"), {0: 60, 1: 72, 2: 92})


@query()
def smp_greedy_diversity(spark, sf):
    """The quotas of smp_quota_alloc filled in turn by the document of the bin that adds most words not yet covered."""
    q, n = written(_quotas(spark, sf).withColumnRenamed("lang", "l").withColumnRenamed("bin", "b"))
    bin = F.concat(F.lit("B"), (F.col("place") + 2).cast("string")).alias("bin")
    x = _binned(spark, sf).select("doc_id", "lang", bin, "text").join(s.few(q, n), F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b")))
    x = x.select("doc_id", "lang", "bin", "take", F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")).alias("words"))
    return s.most_covering(x, ["lang", "bin"], "doc_id", "words", "take")


@query()
def smp_demo_sets(spark, sf):
    return s.demo_sets(table(spark, sf, "part"), "p_partkey", "p_brand", "p_retailprice")


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(trim(lower(text)), '[ \\t\\n\\r]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 s(conv_id, i, kept) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(t BIGINT, w VARCHAR[])[]) FROM w UNION ALL
  SELECT w.conv_id, w.i, CASE WHEN len(list_filter(s.kept, lambda k: len(list_intersect(k.w, w.w)) >= 0.85 * len(list_distinct(list_concat(k.w, w.w))))) = 0 THEN list_append(s.kept, {'t': CAST(w.turn AS BIGINT), 'w': w.w}) ELSE s.kept END FROM s JOIN w ON w.conv_id = s.conv_id AND w.i = s.i + 1)
SELECT conv_id, k.t AS turn FROM (SELECT conv_id, unnest(arg_max(kept, i)) AS k FROM s GROUP BY 1)""")
def txt_near_dup_greedy(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return s.keep_dissimilar(x, "conv_id", "turn", F.split(F.regexp_replace(F.lower("text"), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""), "[ \\t\\n\\r]+"), 0.85)


PAGE_ASSETS = ["", "<script src='/js/app.min.js'></script>", "<script src='/js/jquery-3.min.js'></script><link href='/a.css'>", "<script src='https://cdn.other.net/x.min.js'></script> parcelRequire", "<link href='https://www.example.com/s.bundle.css?v=1'>__NEXT_DATA__", "<script src=\"/src/main.js\">"]
SIGNALS = [None, "minified_url", "density", "bundler_fingerprint", "both", "density"]


@query(f"SELECT page_id, {_case_sql(['', *SIGNALS[1:]], 'page_id')} AS signal FROM pages WHERE page_id % 6 > 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 6 = 0")
def txt_minified_assets(spark, sf):
    html = F.concat("html", _case(PAGE_ASSETS, "page_id"))
    signal = a.minified_signal(html, F.lit("https://example.com/"), F.lit("density"))
    return table(spark, sf, "pages").select("page_id", signal.alias("signal"))


REPO_FILES = {
    0: [("index.html", "<meta name=\"generator\" content=\"Hexo 6\">")],
    1: [("Gemfile", "gem 'jekyll'"), ("_config.yml", "x")],
    2: [("hugo.toml", "")],
    3: [("package.json", '{"dependencies": {"react": "18", "react-dom": "18"}}')],
    4: [("web/package.json", '{"dependencies": {"next": "14", "react": "18", "react-dom": "18"}}')],
    5: [("package.json", '{"dependencies": {"express": "4", "vue": "3"}}'), ("server.js", "express()")],
    6: [("requirements.txt", "Pelican\nFlask")],
    7: [("_quarto.yml", "")],
    8: [("index.html", "<p>x</p>"), ("css/a.css", "")],
    9: [("main.py", "x")],
}
NAMED = ["Hexo", "Jekyll", "Hugo", "React", "Next.js", "Express,Vue", "Pelican,Flask", "Quarto", "Static HTML", ""]


@query(f"SELECT s_suppkey, {_case_sql(NAMED, 's_suppkey')} AS frameworks FROM supplier")
def txt_framework_repo(spark, sf):
    """Frameworks of repositories, by the presence and the text of their files."""
    files = F.array(*[F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("content")) for path, text in x]) for x in REPO_FILES.values()])
    x = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.get(files, (F.col("s_suppkey") % 10).cast("int"))).alias("f")).select("s_suppkey", "f.*")
    return repositories.frameworks(x, "s_suppkey").select("s_suppkey", F.array_join("frameworks", ",").alias("frameworks"))
