"""Names of packages and libraries in addresses, manifests and source text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import first_match

# Tokens that name no package, and endings of build products.
GENERIC_TOKENS = "all main page pages script scripts style styles lib libs build dist bundle vendor assets static js css".split()
PRODUCT_ENDINGS = "-map -css-map -js-map -theme -themes -bundle -min -old".split()

# Tokens that are no dependency of their own, and parts of build products.
NO_DEPENDENCY = (
    "all main index default app data page pages js css html script scripts style styles assets static lib libs "
    "vendor vendors content media images fonts header footer nav menu sidebar about blog post posts api client "
    "server framework frameworks theme themes skin skins github"
).split()
PRODUCT_PARTS = "css-map js-map source-map .map".split()

# Library and the parts that name it; the first library with a part in the token wins.
LIBRARIES = {
    "jquery": ["jquery"],
    "bootstrap": ["bootstrap"],
    "tailwind": ["tailwind"],
    "alpinejs": ["alpine"],
    "react": ["react", "react-dom"],
    "vue": ["vue"],
    "d3": ["d3"],
    "threejs": ["three"],
    "swiper": ["swiper"],
    "gsap": ["gsap", "greensock"],
    "fontawesome": ["fontawesome", "fa-"],
}


def _or(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def library(token: Column) -> Column:
    """The canonical library that a token names; null if none."""
    low = F.lower(token)
    return first_match([(_or(*[F.contains(low, F.lit(p)) for p in parts]), name) for name, parts in LIBRARIES.items()], None)


def package_name(token: Column) -> Column:
    """The package that an address or path names, as far as it can be told; null for none.

    The npm path of a content network names it; font services are one package; else, scoped npm names too, it
    is the file's name up to the first part that begins with a digit.
    """
    low = F.lower(F.trim(token))
    npm = F.trim(F.regexp_extract(low, "/npm/([^/@]+)", 1))
    file = F.regexp_extract(F.regexp_extract(low, "^([^?#]*)", 1), "([^/]*)$", 1)
    file = F.regexp_replace(F.regexp_replace(F.regexp_replace(file, "\\.css$", ""), "\\.js$", ""), "[.-]min", "")
    parts = F.filter(F.split(file, "[-_.]"), lambda p: p != "")
    stop = F.array_position(F.transform(parts, lambda p: p.rlike("^\\p{Nd}")), True)
    name = F.array_join(F.when(stop > 0, F.slice(parts, 1, (stop - 1).cast("int"))).otherwise(parts), "-")
    return F.when(F.length(npm) > 0, npm).when(F.contains(low, F.lit("fonts.googleapis.com")), "google-fonts").when(F.length(name) > 0, name)


def structural_junk(token: Column) -> Column:
    """Empty, generic, with a build product's ending, or all digits."""
    return _or(token == "", token.isin(GENERIC_TOKENS), *[F.endswith(token, F.lit(e)) for e in PRODUCT_ENDINGS], token.rlike("^\\p{Nd}+$"))


def explicit_junk(token: Column) -> Column:
    """No dependency's name: listed, with a build product's part, a long hexadecimal number, or two characters at most."""
    t = F.lower(F.trim(token))
    return _or(t.isin(NO_DEPENDENCY), *[F.contains(t, F.lit(p)) for p in PRODUCT_PARTS], t.rlike("[a-f0-9]{8,}") & (F.length(t) > 10), F.length(t) <= 2)


def minified_artifacts(stats: Column) -> Column:
    """Sorted distinct .min. files of code statistics: of their build_artifacts if they are an object, else of
    quoted names in the text."""
    listed = F.from_json(stats, "build_artifacts array<string>")["build_artifacts"]
    quoted = F.regexp_extract_all(stats, F.lit("[\"']([^\"']*?\\.min\\.[^\"']+?)[\"']"), F.lit(1))
    found = F.when(F.ltrim(stats).startswith("{"), F.coalesce(F.filter(listed, lambda a: F.contains(a, F.lit(".min."))), F.array().cast("array<string>"))).otherwise(quoted)
    return F.array_sort(F.array_distinct(found))


def dependencies(manifest: Column, kind: Column) -> Column:
    """Names that a manifest of kind npm, pip, gem or go lists, in order."""
    names = lambda field: F.coalesce(F.map_keys(F.from_json(F.get_json_object(manifest, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))
    lines = F.filter(F.split(manifest, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    pip = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^(.*?)(?:==|>=|$)", 1)))
    gem = F.regexp_extract_all(manifest, F.lit("gem\\s+['\"]([^'\"]+)['\"]"), F.lit(1))
    go = F.regexp_extract_all(manifest, F.lit("require\\s+([^\\s]+)"), F.lit(1))
    return F.when(kind == "npm", F.concat(names("dependencies"), names("devDependencies"))).when(kind == "pip", pip).when(kind == "gem", gem).when(kind == "go", go)


def libraries_in(text: Column) -> Column:
    """Sorted distinct libraries that src, href, import and require of a text name."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in ("src=[\"']([^\"']+)[\"']", "href=[\"']([^\"']+)[\"']", "import\\s+.*?from\\s+['\"]([^'\"]+)['\"]", "require\\(['\"]([^'\"]+)['\"]\\)")]
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(*found), library))))
