"""Measures and verdicts of source files by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import first_match

# What minified scripts hold and written ones hardly do.
MINIFIED_SYNTAX = ["\\{return[^\\s]", ";var[^\\s]", ";function[^\\s]", "\\}else\\{", "\\)\\{", "\\}catch\\(", "\\}finally\\{", ",function\\("]
# Bounds of mean line length and of the share of white space.
LONG_LINE, LITTLE_SPACE, NO_SPACE, STYLE_LINE, STYLE_SPACE = 500, 0.10, 0.05, 80, 0.06

# Points of a path for its last part, for its ending, and for words anywhere in it.
NAME_POINTS = [
    (100, ["readme.md", "readme", "readme.txt"]),
    (90, ["index.html", "index.htm"]),
    (70, ["package.json", "pyproject.toml", "requirements.txt", "pipfile", "gemfile"]),
    (60, ["_config.yml", "_config.yaml", "config.toml", "config.yaml", "config.yml"]),
    (60, ["mkdocs.yml", "mkdocs.yaml", "docusaurus.config.js", "gatsby-config.js"]),
]
WORD_POINTS = [(20, "docs"), (15, "blog"), (10, "posts")]
ENDING_POINTS = [(8, ".md"), (12, ".html"), (8, ".vue"), (8, ".svelte")]


def path_score(path: Column) -> Column:
    """How much a path promises about what a repository is: a sum of points."""
    p = F.lower(path)
    base = F.substring_index(p, "/", -1)
    terms = [(points, base.isin(names)) for points, names in NAME_POINTS]
    terms += [(points, F.contains(p, F.lit(w))) for points, w in WORD_POINTS] + [(points, F.endswith(base, F.lit(e))) for points, e in ENDING_POINTS]
    return sum((F.when(c, points).otherwise(0) for points, c in terms), F.lit(0))


def space_share(code: Column) -> Column:
    n = F.length(code)
    return F.when(n > 0, (n - F.length(F.regexp_replace(code, "[ \\t\\n\\r]+", ""))) / n).otherwise(0.0)


def comment_share(code: Column) -> Column:
    n = F.length(code)
    return F.when(n > 0, (n - F.length(F.regexp_replace(code, "//[^\\n]*|(?s:/\\*.*?\\*/)", ""))) / n).otherwise(0.0)


def mean_line(code: Column) -> Column:
    return F.length(code) / (F.regexp_count(code, F.lit("\n")) + 1)


def script_verdict(code: Column) -> Column:
    """Why a script counts as minified: its mean line, its syntax with little space, or no space and comments; else null."""
    syntax = F.substring(code, 1, 3000).rlike("|".join(MINIFIED_SYNTAX))
    return first_match([
        (mean_line(code) > LONG_LINE, "long_lines"),
        (syntax & (space_share(code) < LITTLE_SPACE), "syntax"),
        ((space_share(code) < NO_SPACE) & (comment_share(code) == 0), "no_space"),
    ], None)


def style_minified(code: Column, url: Column) -> Column:
    """Whether a style sheet is minified, by its address or by long lines with little space."""
    mean = mean_line(code)
    return F.contains(F.lower(url), F.lit(".min.")) | (mean > LONG_LINE) | ((mean > STYLE_LINE) & (space_share(code) < STYLE_SPACE))


def complexity(code: Column, language: Column) -> dict[str, Column]:
    """Blank lines, comment lines, deepest nesting of braces, functions and classes of a source file.

    Blank lines count for nothing else. What is a comment, a function or a class depends on the language;
    braces are counted in all of them.
    """
    blank = lambda x: F.trim(F.regexp_replace(x, "[\\t\\r\\f\\x0B]", " ")) == ""
    lines = F.filter(F.split(code, "\n"), lambda x: ~blank(x))
    count = lambda c: F.size(F.filter(lines, c)).cast("long")
    starts = lambda p: lambda x: x.rlike(f"^\\s*(?:{p})")
    braces = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, x: F.struct(
            (a["now"] + F.regexp_count(x, F.lit("\\{")) - F.regexp_count(x, F.lit("\\}"))).alias("now"),
            F.greatest(a["most"], a["now"] + F.regexp_count(x, F.lit("\\{")) - F.regexp_count(x, F.lit("\\}"))).alias("most"),
        ),
    )
    js, py = language == "javascript", language == "python"
    return {
        "blank_lines": F.size(F.filter(F.split(code, "\n"), blank)).cast("long"),
        "comment_lines": F.when(language.isin("javascript", "c/c++", "java", "php", "go", "rust"), count(starts("//|/\\*"))).when(py, count(starts("#"))).when(language.isin("markup", "style"), count(lambda x: F.contains(x, F.lit("<!--")) | F.contains(x, F.lit("/*")))).otherwise(F.lit(0).cast("long")),
        "nesting": braces["most"].cast("long"),
        "functions": F.when(js, count(lambda x: x.rlike("\\bfunction\\s+\\w+|\\w+\\s*\\(.*\\)\\s*=>"))).when(py, count(starts("def\\s+\\w+"))).otherwise(F.lit(0).cast("long")),
        "classes": F.when(js, count(lambda x: x.rlike("\\bclass\\s+\\w+"))).when(py, count(starts("class\\s+\\w+"))).otherwise(F.lit(0).cast("long")),
    }
