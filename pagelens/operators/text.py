"""Text and HTML analytics by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def visible_tokens(html: Column) -> Column:
    """Distinct lower-case words outside script, style and noscript elements and tags, in order."""
    s = F.regexp_replace(html, "(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)>", " ")
    s = F.lower(F.regexp_replace(s, "(?s)<[^>]*>", " "))
    return F.array_distinct(F.regexp_extract_all(s, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two sets; null if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n)


def dom_tokens(html: Column) -> Column:
    """Opening tags in order, with sorted classes: p, div.a.b."""
    tags = F.regexp_extract_all(html, F.lit("<[a-zA-Z][a-zA-Z0-9-]*[^>]*>"), F.lit(0))

    def token(t):
        name = F.lower(F.regexp_extract(t, "^<([a-zA-Z][a-zA-Z0-9-]*)", 1))
        classes = F.array_sort(F.filter(F.split(F.regexp_extract(t, "class=\"([^\"]*)\"", 1), " +"), lambda c: c != ""))
        return F.when(F.size(classes) > 0, F.concat(name, F.lit("."), F.array_join(classes, "."))).otherwise(name)

    return F.transform(tags, token)


def simhash64(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key and the 64-bit fingerprint of its tokens: each bit by the votes of the tokens' low md5 bits.

    The votes are summed per key with map-side combining, as 64 sums of one pass over the tokens.
    """
    x = df.select(key, F.explode_outer(tokens).alias("t")).where("t is not null").groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))
    half = lambda a: F.conv(F.substring(F.md5("t"), a, 8), 16, 10).cast("long")
    x = x.withColumns({"hi": half(17), "lo": half(25)})
    bit = lambda k: F.shiftright("hi" if k >= 32 else "lo", k % 32).bitwiseAND(F.lit(1))
    votes = [F.sum(F.when(bit(k) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{k}") for k in range(64)]
    g = x.groupBy(key).agg(*votes)
    total = F.lit(0).cast("long")
    for k in range(64):
        total = total.bitwiseOR(F.when(F.col(f"b{k}") > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return g.select(key, total.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def three_way(a: Column, b: Column) -> dict[str, Column]:
    """What only the first of two sets holds, only the second, and both; sorted."""
    return {"only_first": F.array_sort(F.array_except(a, b)), "only_second": F.array_sort(F.array_except(b, a)), "common": F.array_sort(F.array_intersect(a, b))}


def code_density(code: Column) -> dict[str, Column]:
    """Bytes, lines, mean and longest line, lines over 500 characters, share of newlines and white space."""
    lines, n = F.split(code, "\n"), F.length(code)
    lengths = F.transform(lines, F.length)
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return {
        "bytes": F.octet_length(code), "lines": F.size(lines), "longest": F.array_max(lengths),
        "mean_line": F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.size(lines),
        "long_lines": F.size(F.filter(lengths, lambda x: x > 500)),
        "newline_share": share(n - F.length(F.replace(code, F.lit("\n"), F.lit("")))),
        "space_share": share(n - F.length(F.regexp_replace(code, "[ \\t\\n\\r]+", ""))),
    }


def pattern_counts(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """key, pattern and n of every literal pattern that occurs, all counted in one pass over the text."""
    own = F.array(*[F.struct(F.lit(name).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("n")) for name, p in patterns])
    return df.select(key, F.explode(own).alias("m")).select(key, "m.*").where("n > 0")


def strip_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^\\s*```[a-zA-Z]*\\s*\\n?", ""), "\\n?```\\s*$", ""))


def first_lines(text: Column, n: int) -> Column:
    """The first n lines, and how many more there are."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    more = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(lines) <= n, text).otherwise(more)


def json_at(json: Column, path: str, kind: str, default) -> Column:
    """The value at a path of a JSON text; default where a level, the value or the text itself is missing."""
    return F.coalesce(F.get_json_object(json, path).try_cast(kind), F.lit(default).cast(kind))


# Words that speak of web vitals and what moves them.
VITALS = [
    "lcp", "inp", "cls", "largest contentful paint", "interaction to next paint", "cumulative layout shift", "lazy", "preload", "defer", "async",
    "image", "font", "cache", "render-blocking", "critical", "viewport", "width", "height", "layout shift", "resource hint",
]


def speaks_of_vitals(text: Column) -> Column:
    return F.lower(text).rlike("|".join(VITALS))
