"""Pattern libraries over source files: counts, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.literals import Prefilter
from ..functions.pattern_tables import WEIGHTS
from ..functions.rules import first_match

Pattern = tuple[str, str, str, str, str]


def applying(table: list[Pattern], framework: str | None = None) -> list[Pattern]:
    """The patterns of a table that apply to all frameworks or to the one given; all if none is given."""
    return [p for p in table if framework is None or p[3] in ("global", framework)]


def _prefiltered(df: DataFrame, keys: list[str], text: str, table: list[Pattern]) -> tuple[DataFrame, dict[str, Column]]:
    """df with the literals that occur in text as _hits, from one pass, and for each pattern whether they let it match."""
    filter_ = Prefilter(p for _, p, *_ in table)
    x = df.select(*keys, text, filter_.hits(F.col(text)).alias("_hits"))
    return x, {name: filter_.may(p, F.col("_hits")) for name, p, *_ in table}


def found(df: DataFrame, keys: list[str], text: str, table: list[Pattern]) -> DataFrame:
    """keys, pattern, category, severity, n and score (matches by the severity's weight) of every pattern that occurs.

    One pass over the text finds which literals occur that patterns can't do without; only patterns whose
    literals are there are counted. Nothing is shuffled. Null texts have no findings.
    """
    x, may = _prefiltered(df, keys, text, table)
    count = lambda name, p: F.when(may[name], F.regexp_count(text, F.lit(f"(?im){p}"))).otherwise(0)
    one = [F.struct(F.lit(name).alias("pattern"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), count(name, p).alias("n"), F.lit(WEIGHTS[severity]).alias("w")) for name, p, category, _, severity in table]
    x = x.select(*keys, F.explode(F.filter(F.array(*one), lambda m: m["n"] > 0)).alias("m"))
    return x.select(*keys, "m.pattern", "m.category", "m.severity", F.col("m.n").cast("long").alias("n"), (F.col("m.n") * F.col("m.w")).cast("long").alias("score"))


def matches(df: DataFrame, keys: list[str], text: str, table: list[Pattern]) -> DataFrame:
    """keys, pattern, place (1, 2, ...), line and match (100 characters at most) of every single match."""
    x, may = _prefiltered(df, keys, text, table)
    every = lambda name, p: F.when(may[name], F.regexp_extract_all(text, F.lit(f"(?im){p}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    one = [F.struct(F.lit(name).alias("pattern"), every(name, p).alias("all")) for name, p, *_ in table]
    x = x.select(*keys, text, F.explode(F.filter(F.array(*one), lambda m: F.size(m["all"]) > 0)).alias("m"))
    x = x.select(*keys, text, "m.pattern", F.posexplode("m.all").alias("_place", "match"), F.col("m.all").alias("_all"))
    # text before a match: up to the first occurrence of its own after those of the matches before it
    again = 1 + F.size(F.filter(F.slice("_all", F.lit(1), F.col("_place")), lambda a: a == F.col("match")))
    before = F.call_function("substring_index", F.col(text), F.col("match"), again.cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return x.select(*keys, "pattern", (F.col("_place") + 1).alias("place"), line.cast("long").alias("line"), F.left("match", F.lit(100)).alias("match"))


def _of(column: str, value: str, measure: str) -> Column:
    return F.sum(F.when(F.col(column) == value, F.col(measure)).otherwise(0))


def totals(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key: total, high (score of high severity), n_high, and n_<category> of those that verdicts look at."""
    categories = ("missing_dimensions", "ads_embeds", "font_loading", "dynamic_injection", "animations", "discrete_input", "paint_trigger", "layout_thrash")
    counts = [_of("category", c, "n").alias(f"n_{c}") for c in categories]
    return findings.groupBy(*keys).agg(F.sum("score").alias("total"), _of("severity", "high", "score").alias("high"), _of("severity", "high", "n").alias("n_high"), *counts)


def file_risk() -> Column:
    """Risk of a file, from totals()."""
    return first_match([(F.col("high") >= 15, "high"), ((F.col("high") >= 6) | (F.col("total") >= 20), "medium"), (F.col("total") > 0, "low")], "none")


def repository_risk() -> Column:
    """Risk of a repository, from totals()."""
    missing = F.col("n_missing_dimensions")
    return first_match([
        ((F.col("n_ads_embeds") > 0) | (F.col("high") >= 50) | (missing > 20), "high"),
        ((F.col("high") >= 20) | (missing > 10), "medium"),
        (F.col("total") > 0, "low"),
    ], "none")


def risk_factors() -> Column:
    """What makes a repository's pages shift, from totals()."""
    rules = [("images_without_dimensions", "n_missing_dimensions", 5), ("ads_or_embeds", "n_ads_embeds", 0), ("many_fonts", "n_font_loading", 3), ("heavy_injection", "n_dynamic_injection", 10), ("layout_animations", "n_animations", 5)]
    return F.array_compact(F.array(*[F.when(F.col(c) > more, F.lit(name)) for name, c, more in rules]))


def inp_likely() -> Column:
    """Late responses are likely where discrete input meets paint or layout work, from totals()."""
    return (F.col("n_discrete_input") > 0) & ((F.col("n_paint_trigger") > 0) | (F.col("n_layout_thrash") > 0))


def inp_confidence() -> Column:
    return first_match([
        (inp_likely() & (F.col("n_high") > 10), "high"),
        (inp_likely() & (F.col("n_high") > 3), "medium"),
        (F.col("n_discrete_input") > 0, "low"),
    ], "none")
