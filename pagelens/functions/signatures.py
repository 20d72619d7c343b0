"""Signatures that tell which frameworks, bundlers and services a page uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .literals import Prefilter

# Group, name and patterns, all without regard to case.
FRAMEWORKS = {
    "ui_frameworks": [
        ("React", ["React\\.createElement", "data-reactroot", "__react\\w", "_reactFiber"]),
        ("Vue 3", ["_createVNode", "Vue\\.createApp"]),
        ("Vue 2", ["new Vue\\(", "__vue__"]),
        ("Angular", ["ng-version", "platformBrowserDynamic", "@angular/"]),
        ("Svelte", ["__svelte", 'class="svelte-', "svelte/internal"]),
        ("Lit", ["customElements\\.define", "LitElement", "lit-html"]),
        ("Alpine.js", ["x-data=", "Alpine\\.start", "x-init="]),
        ("jQuery", ["jQuery", "\\$\\.fn\\.jquery", "jquery\\.js", "jquery\\.min\\.js"]),
        ("HTMX", ["hx-get=", "hx-post=", "htmx\\.config", "htmx\\.min\\.js"]),
        ("Stimulus", ["data-controller=", "Stimulus\\.Application"]),
        ("Preact", ["preact", "h\\(Fragment"]),
        ("Solid.js", ["solidjs", "solid-js"]),
        ("Ember", ["Ember\\.Application", "ember\\.js", "data-ember-action"]),
        ("Backbone", ["Backbone\\.View", "backbone\\.js"]),
        ("Mithril", ["m\\.render\\(", "mithril\\.js"]),
        ("Qwik", ["qwik", "q:container"]),
    ],
    "meta_frameworks": [
        ("Next.js", ["__NEXT_DATA__", "/_next/static"]),
        ("Nuxt.js", ["__NUXT__", "/_nuxt/"]),
        ("SvelteKit", ["__sveltekit", "/_app/immutable"]),
        ("Astro", ["astro-island", "astro:page-load", "@astrojs"]),
        ("Remix", ["__remixContext", "remix-"]),
        ("Gatsby", ["___gatsby", "/gatsby-"]),
        ("Eleventy", ['name="generator" content="Eleventy']),
        ("Hugo", ['name="generator" content="Hugo']),
        ("Jekyll", ['name="generator" content="Jekyll']),
        ("Docusaurus", ["docusaurus", "__docusaurus"]),
        ("VitePress", ["vitepress", "__vitepress"]),
    ],
    "bundlers": [
        ("Webpack", ["__webpack_require__", "webpackJsonp", "__webpack_modules__"]),
        ("Vite", ['type="module".*/@vite/', "__vite__", "vite/dist/client"]),
        ("Parcel", ["parcelRequire"]),
        ("Rollup", ["/\\* rollup \\*/", "rollup\\.js"]),
        ("esbuild", ["// esbuild", "esbuild"]),
        ("Turbopack", ["__turbopack"]),
        ("Browserify", ["_dereq_\\(", "browserify"]),
        ("RequireJS", ["require\\.config\\(", "requirejs"]),
    ],
    "cms": [
        ("WordPress", ["/wp-content/", "/wp-includes/", "wp-json"]),
        ("Drupal", ["Drupal\\.settings", "/sites/default/files/"]),
        ("Ghost", ["ghost-url", "content\\.ghost\\.io"]),
        ("Webflow", ["webflow\\.com/css", "data-wf-"]),
        ("Squarespace", ["squarespace\\.com", '"sqsp"']),
        ("Wix", ["wix\\.com", "wixstatic\\.com"]),
        ("Shopify", ["cdn\\.shopify\\.com", "Shopify\\.theme"]),
        ("Contentful", ["contentful\\.com", "ctfl-"]),
        ("Sanity", ["sanity\\.io", "_sanity"]),
        ("Strapi", ["strapi"]),
        ("Joomla", ["/joomla/", "joomla\\.js"]),
        ("Magento", ["Mage\\.Cookies", "/skin/frontend/"]),
        ("BigCommerce", ["bigcommerce\\.com", "bc-sf-filter"]),
    ],
    "css_frameworks": [
        ("Tailwind", ["tailwindcss", 'class="[^"]*\\b(?:flex|grid|p-\\d|m-\\d|text-\\w+)\\b']),
        ("Bootstrap", ["bootstrap\\.min\\.css", "bootstrap\\.css", 'class="[^"]*\\bbtn\\b']),
        ("Bulma", ["bulma\\.io", "bulma\\.css", 'class="columns"']),
        ("Foundation", ["foundation\\.min\\.css", "foundation\\.css"]),
        ("UIkit", ["uikit\\.min\\.css", "uikit\\.css"]),
        ("Materialize", ["materialize\\.css", "materialize\\.min\\.css"]),
        ("Chakra UI", ["chakra-ui", "@chakra-ui"]),
        ("Ant Design", ["antd\\.css", "ant-design"]),
        ("Semantic UI", ["semantic\\.min\\.css", "semantic-ui"]),
    ],
}

# What bundlers leave in a page; letter case counts; bundler_mark() searches the first 50000 characters unless told otherwise.
BUNDLER_MARKS = [
    "__webpack_require__", "webpackJsonp", "__webpack_modules__", "/_next/static", "__NEXT_DATA__", "/_nuxt/", "/__vite__",
    "vite/dist/client", "/_app/immutable", "__sveltekit", "/gatsby-", "___gatsby", "__remixContext", "parcelRequire",
]
MARKS_WITHIN = 50_000

# Marketing services and the patterns that show them.
MARKETING = [
    ("google_analytics", ["google-analytics\\.com", "googletagmanager\\.com", "[\"']UA-\\d+-\\d+[\"']", "gtag\\(", "ga\\(", "_gaq"]),
    ("facebook_pixel", ["facebook\\.net", "fbevents\\.js", "fbq\\(", "_fbp"]),
    ("hotjar", ["hotjar\\.com", "_hjid", "hj\\("]),
    ("segment", ["segment\\.(com|io)", "analytics\\.js", "analytics\\.identify"]),
    ("mixpanel", ["mixpanel\\.com", "mixpanel\\.init"]),
    ("intercom", ["intercom\\.io", "Intercom\\("]),
    ("hubspot", ["hubspot\\.com", "_hsq"]),
    ("linkedin", ["linkedin\\.com/analytics", "_linkedin_partner_id"]),
    ("twitter", ["twitter\\.com/i/adsct", "twq\\("]),
    ("clarity", ["clarity\\.ms", "clarity\\("]),
    ("amplitude", ["amplitude\\.com", "amplitude\\.getInstance"]),
]


def detected(text: Column, table: list[tuple[str, list[str]]], may=lambda pattern: F.lit(True)) -> Column:
    """Names of a table, in its order, of which a pattern occurs; only patterns that may match are tried."""

    def tried(patterns: list[str]) -> Column:
        return F.when(reduce(Column.__or__, map(may, patterns)), text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))

    return F.array_compact(F.array(*[F.when(tried(patterns), F.lit(name)) for name, patterns in table]))


def frameworks(html: Column, script: Column) -> dict[str, Column]:
    """Per group, the frameworks of a page and its inline script."""
    both = F.concat(html, F.lit("\n"), F.coalesce(script, F.lit("")))
    return {group: detected(both, table) for group, table in FRAMEWORKS.items()}


def with_frameworks(df: DataFrame, html: str, script: str | None = None) -> DataFrame:
    """df with frameworks() as columns. Page and script are joined once, and one pass over them finds which
    literals occur that the patterns can't do without; only patterns whose literals are there are tried."""
    filter_ = Prefilter(p for table in FRAMEWORKS.values() for _, patterns in table for p in patterns)
    both = F.concat(F.col(html), F.lit("\n"), F.coalesce(F.col(script) if script else F.lit(None).cast("string"), F.lit("")))
    x = df.withColumn("_both", both).withColumn("_hits", filter_.hits(F.col("_both")))
    may = lambda p: filter_.may(p, F.col("_hits"))
    return x.withColumns({group: detected(F.col("_both"), table, may) for group, table in FRAMEWORKS.items()}).drop("_both", "_hits")


def bundler_mark(html: Column, within: int | None = MARKS_WITHIN) -> Column:
    """The first mark of a bundler, in the whole text if within is None; null if there is none."""
    found = F.regexp_extract(html if within is None else F.substring(html, 1, within), "|".join(BUNDLER_MARKS), 0)
    return F.nullif(found, F.lit(""))


def marketing(text: Column) -> Column:
    """name and the patterns found, of every marketing service of a page."""
    found = [F.struct(F.lit(name).alias("service"), F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns])).alias("found")) for name, patterns in MARKETING]
    return F.filter(F.array(*found), lambda s: F.size(s["found"]) > 0)
