"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import SPACE

#: Rule, measure, lowest and highest value allowed (None: open). A document is kept if all hold.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 20, None),
    ("repeats", "repeat_pct", None, 30),
    ("word_length", "mean_word", 1.5, 20),
    ("symbols", "symbol_ratio", None, 0.3),
    ("stop_words", "stop_ratio", 0.005, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
]

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that for with as was on are by be this it at or from "
    "der die das und ist nicht ein eine den von zu mit sich auf für auch dem des im "
    "le la les de des et en un une que est pour dans qui sur pas au du par avec "
    "el los las y del que es por con para una su al lo como más"
).split()

WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once: higher-order functions re-evaluate what lies outside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur at least twice."""

    def pairwise(h: Column, by: int) -> Column:
        return _let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, 1 + by, F.size(x) - by), lambda a, b: F.xxhash64(a, b)))

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            n = F.size(s)
            follows = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["h"] == b["h"])
            # element k is repeated if it equals its neighbour on either side
            edge = F.array(F.lit(False))
            flags = F.zip_with(F.concat(edge, follows), F.concat(follows, edge), lambda a, b: a | b)
            return F.array_sort(F.transform(F.filter(F.zip_with(s, flags, lambda e, f: F.struct(e["i"].alias("i"), f.alias("f"))), lambda e: e["f"]), lambda e: e["i"]))

        def total(p: Column) -> Column:
            n = F.size(p)
            gaps = F.zip_with(F.slice(p, 2, n - 1), F.slice(p, 1, n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)

        return _let(_let(ordered, same), total)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = pairwise(pairwise(pairwise(hashes, 1), 2), 4)
    repeated = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) > WINDOW, repeated).otherwise(0)


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text column; expressions of built-in functions only."""
    clean = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, f"{SPACE}+"))
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = _let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^\\x20\\x09-\\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return {
        "_w": of_words,
        "_l": of_lines,
        "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
    }


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, base measures, ratios and the verdict of every row of docs, by one projection.

    Words are maximal runs without ASCII white space; n_repeat_words counts the words that lie in
    8-word windows found twice or more in the text. Null and empty texts have no words: all counts 0,
    ratios 0, base_failed true, kept false. Repeated rows give repeated results; other columns of docs
    are not read. An empty table gives an empty result. failed lists the rules a document breaks.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    # inline() of one struct: the optimizer does not copy a generator's input into every later use
    m = base.select("doc_id", F.inline(F.array(F.struct(*[c.alias(k) for k, c in measures(F.col("_text")).items()]))))
    m = m.select("doc_id", "word_chars", "n_symbols", "_w.*", "_l.*")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = {
        "repeat_pct": per("n_repeat_words", "n_words") * 100,
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }
    m = m.withColumns(ratios)
    broken = [F.when(((F.col(c) < lo) if lo is not None else F.lit(False)) | ((F.col(c) > hi) if hi is not None else F.lit(False)), F.lit(rule)) for rule, c, lo, hi in rules]
    m = m.withColumn("failed", F.array_compact(F.array(*broken)))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
