"""Scalar functions on URLs, repository names and file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import first_match


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def authority(url: Column) -> Column:
    """Host and port, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def domain_slug(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(authority(url), "^www\\.", "")


def canonical_url(url: Column) -> Column:
    """scheme://host without www/path without trailing slashes; query and fragment go."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.concat(scheme, F.lit("://"), domain_slug(url), F.regexp_replace(path(url), "/+$", ""))


def page_slug(url: Column, longest: int = 100) -> Column:
    """The path as a file name, with six hex digits of the query's md5; index for the root."""
    base = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "__")
    base = F.regexp_replace(F.when(base == "", F.lit("index")).otherwise(base), "[^A-Za-z0-9_.-]", "_")
    marked = F.when(query(url) != "", F.concat(base, F.lit("_"), F.substring(F.md5(query(url)), 1, 6))).otherwise(base)
    return F.substring(marked, 1, longest)


def slugify(text: Column, longest: int = 80) -> Column:
    s = F.regexp_replace(text, "^[A-Za-z]+://", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_.-]", "_"), "_+", "_")
    return F.substring(F.regexp_replace(s, "^[_.]+|[_.]+$", ""), 1, longest)


def same_origin(asset: Column, page: Column) -> Column:
    """Relative assets, and those on the page's host or below it."""
    a, p = domain_slug(asset), domain_slug(page)
    return (a == "") | (a == p) | F.endswith(a, F.concat(F.lit("."), p))


# Words of page types, and the language codes that may begin a path.
FEED_FIRST = "feed rss atom sitemap robots.txt".split()
FEED_LAST = "feed rss atom rss.xml atom.xml feed.xml sitemap.xml robots.txt".split()
APP = "login signin sign-in signup sign-up register auth logout sign_in sign_up oauth sso".split()
CORPORATE = (
    "about about-us about-me bio team our-team staff ueber-uns qui-sommes-nous company mission vision "
    "contact contact-us contacto kontakt reach-us get-in-touch privacy privacy-policy terms terms-of-service "
    "tos legal cookie-policy cookies gdpr imprint impressum disclaimer copyright"
).split()
LISTING = (
    "search faq help support frequently-asked-questions hilfe aide tag tags label labels topic topics keyword "
    "keywords category categories cat rubrik kategorie rubrique section sections archive archives"
).split()
PROFILE = (
    "author authors profile profiles user users contributor contributors member members gallery portfolio "
    "portfolios project projects work works showcase case-study case-studies"
).split()
DOCS = "docs doc documentation guide guides tutorial tutorials wiki manual reference api handbook learn knowledge kb".split()
MARKETING = "promo promotion offer campaign landing sale special showcase".split()
PRODUCT = "product products shop store cart checkout buy pricing plans order orders item items catalogue catalog".split()
BLOG = "blog blogs post posts article articles news journal stories story updates newsletter".split()
LANGUAGE_CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en "
    "eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv "
    "ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne "
    "ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st "
    "su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()


def page_type(url: Column) -> Column:
    """One of eleven types of page by the words of its path, after a language code such as /en or /fr-fr.

    The first rule that holds counts: nothing left of the path, feeds, application pages, the site's own
    pages, listings (page numbers too), profiles, documentation, marketing, products, articles (a blog's
    first page is a listing), paths that begin with a date; else other.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(F.try_url_decode(path(url)), path(url))), "/"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    code = F.regexp_extract(first, "^([a-z]{2})(?:[-_][a-z]{2})?$", 1)
    parts = F.when(F.coalesce(code.isin(LANGUAGE_CODES), F.lit(False)), F.slice(parts, 2, 10_000)).otherwise(parts)
    first, last = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))
    anywhere = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    whole = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return first_match([
        (F.size(parts) == 0, "homepage"),
        (first.isin(FEED_FIRST) | last.isin(FEED_LAST), "resource"),
        (anywhere(APP), "app"),
        (anywhere(CORPORATE), "corporate"),
        (anywhere(LISTING) | whole.rlike("/page[/-]?[0-9]+"), "listing"),
        (first.isin(PROFILE), "profile"),
        (first.isin(DOCS), "documentation"),
        (anywhere(MARKETING), "marketing"),
        (first.isin(PRODUCT), "product"),
        (first.isin(BLOG), F.when(F.size(parts) == 1, "listing").otherwise("article")),
        (whole.rlike("^/[0-9]{4}/[0-9]{2}(/[0-9]{2})?(/[^/]+)?/?$"), "article"),
    ], "other")


def site_urls(repo: Column) -> Column:
    """Candidate addresses of a repository's site, in order: an address itself; for owner/name the name's own
    host if it is one, then the owner's project page; else the name as a host."""
    owner, name = F.substring_index(repo, "/", 1), F.regexp_extract(repo, "^[^/]*/(.*)$", 1)
    host = F.when(F.endswith(F.lower(name), F.lit(".github.io")), F.concat(F.lit("https://"), name))
    project = F.concat(F.lit("https://"), owner, F.lit(".github.io/"), name)
    https = F.startswith(repo, F.lit("http://")) | F.startswith(repo, F.lit("https://"))
    return F.when(https, F.array(repo)).when(F.contains(repo, F.lit("/")), F.array_distinct(F.array_compact(F.array(host, project)))).otherwise(F.array(F.concat(F.lit("https://"), repo)))


# File endings by kind of content.
ENDINGS = {
    "js": ".js", "css": ".css", "html": ".html", "woff": ".woff", "woff2": ".woff2", "ttf": ".ttf", "png": ".png", "jpeg": ".jpg",
    "gif": ".gif", "webp": ".webp", "svg+xml": ".svg", "ico": ".ico", "json": ".json", "xml": ".xml",
}


def safe_filename(url: Column, content_type: Column) -> Column:
    """The last part of an address' path (index for none) with the ending of its content type, if that is known."""
    name = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    name = F.when(F.length(name) > 0, name).otherwise("index")
    kind = F.lower(content_type)
    sub = F.trim(F.substring_index(F.substring_index(kind, ";", 1), "/", -1))
    sub = F.when(F.contains(kind, F.lit("css")), "css").when(F.contains(kind, F.lit("javascript")), "js").otherwise(sub)
    ending = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), sub)
    return F.when(ending.isNotNull() & ~F.endswith(F.lower(name), ending), F.concat(name, ending)).otherwise(name)


#: Public suffixes of two labels that are told from a registered name; pass more where they are known.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp or.jp ne.jp com.br com.mx co.in co.nz co.za com.cn com.tr com.sg github.io gitlab.io".split()


def registered_name(url: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered domain of an address: one label more than its public suffix."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), ":[0-9]*$|^[^@]*@", ""))
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), F.when(two == host, "").otherwise(F.substring_index(host, ".", -3))).otherwise(two)


def own_asset(asset: Column, page: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """Whether an asset comes from the page's registered domain."""
    a, p = registered_name(asset, suffixes), registered_name(page, suffixes)
    return (a != "") & (a == p)


def resource_category(url: Column, kind: Column) -> Column:
    """image, script, style or font by type, else by the URL's ending."""
    u = F.lower(path(url))
    return first_match([
        (kind.isin("image", "script", "style", "font"), kind),
        (kind == "stylesheet", "style"),
        (u.rlike("\\.(png|jpe?g|gif|webp|svg|avif|ico)$"), "image"),
        (u.rlike("\\.m?js$"), "script"),
        (u.rlike("\\.css$"), "style"),
        (u.rlike("\\.(woff2?|ttf|otf|eot)$"), "font"),
    ], "other")


def repo_from_url(url: Column) -> Column:
    """org/repo of a repository's address."""
    s = F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+/", ""), "/+$", "")
    return F.regexp_replace(F.substring_index(s, "/", 2), "\\.git$", "")


def repo_key(name: Column) -> Column:
    """A name for loose matching: lower case, without a time stamp at its end, letters and digits only."""
    s = F.replace(F.lower(F.trim(name)), F.lit("github.io"), F.lit("githubio"))
    return F.regexp_replace(F.regexp_replace(s, "_[0-9]{8}_[0-9]{6}$", ""), "[^a-z0-9]+", "")


def leading_number(name: Column, missing: int = 9999) -> Column:
    return F.coalesce(F.regexp_extract(name, "^([0-9]{1,9})_", 1).try_cast("int"), F.lit(missing))


def base_token(package: Column) -> Column:
    return F.get(F.split(package, "[-_.]"), F.lit(0))


def config_hash(first: Column, second: Column) -> Column:
    return F.substring(F.sha2(F.concat(first, second), 256), 1, 16)
