"""Mixing sources to target weights by pivotal dependent rounding along a reduction tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ._common import WORD, prefix_sums, union_all, written

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most that it takes of a source or document, both as multiples.
SHARE = 1.5
MOST = 2.0
#: Probabilities that one task's fold reduces to a single residual.
FAN = 64
#: Sources up to this number are broadcast.
FEW = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, n) with k (place by code point, null last), first (rows of sources
    before it), weight and target. Targets above most times the size stop there; what is over goes to the
    others by weight until none is above. Only sums pass through the driver."""
    order = [F.col("source").asc_nulls_last()]
    x = prefix_sums(sources.withColumn("one", F.lit(1)), order, {"k": "one", "first": "n"})
    x = x.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    x = written(x.select("source", "source_size", "n", "k", "first", "weight"), "sources")
    budget = share * (x.agg(F.sum("source_size")).first()[0] or 0)
    rate, above = 0.0, -1
    while True:
        full = F.col("weight") * rate > most * F.col("source_size")
        s = x.agg(
            F.count_if(full).alias("above"),
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if s["above"] == above or not s["open"]:
            break
        above, rate = s["above"], max(rate, (budget - s["taken"]) / s["open"])
    return x.withColumn("target", F.least(F.col("weight") * F.lit(rate), most * F.col("source_size")))


def _chance(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(seed: int):
    """One pivotal step: mass (size times probability) moves between the residual and the next element,
    either way with the chance that keeps both expectations, until one of them is 0 or 1."""

    def step(acc, x):
        a = acc["open"]
        up_a, down_a = a["w"] * (1 - a["p"]), a["w"] * a["p"]
        up_x, down_x = x["w"] * (1 - x["p"]), x["w"] * x["p"]
        to_a, to_x = F.least(up_a, down_x), F.least(down_a, up_x)
        raised = _chance(seed, a["rank"], x["rank"]) * (to_a + to_x) < to_x
        pa = F.when(raised, F.when(up_a <= down_x, 1.0).otherwise(a["p"] + to_a / a["w"])).otherwise(F.when(down_a <= up_x, 0.0).otherwise(a["p"] - to_x / a["w"]))
        px = F.when(raised, F.when(down_x <= up_a, 0.0).otherwise(x["p"] - to_a / x["w"])).otherwise(F.when(up_x <= down_a, 1.0).otherwise(x["p"] + to_x / x["w"]))
        met = F.struct(pa.alias("pa"), px.alias("px"))

        def settle(m):
            settled = m["pa"].isin(0.0, 1.0)
            done = F.struct(F.when(settled, a["rank"]).otherwise(x["rank"]).alias("rank"), F.when(settled, m["pa"]).otherwise(m["px"]).cast("int").alias("up"))
            left = F.struct(F.when(settled, x["rank"]).otherwise(a["rank"]).alias("rank"), F.when(settled, x["w"]).otherwise(a["w"]).alias("w"), F.when(settled, m["px"]).otherwise(m["pa"]).alias("p"))
            return F.struct(left.alias("open"), F.concat(acc["done"], F.array(done)).alias("done"))

        return F.get(F.transform(F.array(met), settle), F.lit(0))

    return step


def _reduced(rows: DataFrame, seed: int) -> DataFrame:
    """k, ord (of the chunk), open (its residual) and done (its decisions) from k, ord, rank, w and p."""
    x = rows.withColumn("chunk", F.floor(F.col("ord") / FAN)).groupBy("k", "chunk")
    x = x.agg(F.sort_array(F.collect_list(F.struct("ord", "rank", "w", "p"))).alias("all"))
    x = x.withColumn("all", F.transform("all", lambda e: F.struct(e["rank"].alias("rank"), e["w"].alias("w"), e["p"].alias("p"))))
    start = F.struct(F.element_at("all", 1).alias("open"), F.array().cast("array<struct<rank:bigint,up:int>>").alias("done"))
    s = F.aggregate(F.slice(F.col("all"), 2, FAN), start, _meet(seed))
    return x.select("k", F.col("chunk").alias("ord"), s.alias("s")).select("k", "ord", "s.*")


def _decided(rows: DataFrame, longest: int, seed: int) -> DataFrame:
    """k, rank and up (0 or 1) of rows k, rank, w, p with 0 < p < 1: a tree of folds of FAN elements each."""
    levels = max(1, math.ceil(math.log(max(2, longest), FAN) - 1e-9))
    out, now = [], rows.select("k", F.col("rank").alias("ord"), "rank", "w", "p")
    for level in range(levels):
        x = written(_reduced(now, seed), "residuals")
        out.append(x.select("k", F.explode("done").alias("d")).select("k", "d.*"))
        now = x.select("k", "ord", "open.*")
    last = F.when(F.col("p").isin(0.0, 1.0), F.col("p").cast("int")).otherwise((_chance(seed, F.lit(-1), F.col("rank")) < F.col("p")).cast("int"))
    return union_all([*out, now.select("k", "rank", last.alias("up"))])


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, _h (hash of the text), source, size, source_size, target, copies and taken of every row of docs.

    size: words of the text (null: 0). Each document of a source is due target / source_size copies; the
    whole part is certain, the rest is rounded so that each source's words differ from its target by less
    than one document's. Documents are ordered by a hash of their id, folded in chunks, and the chunks'
    residuals folded again level by level, so no task holds a source. One seed gives one result, however
    the rows are dealt out.

    Null sources are one source, the last. Rows of size 0 are taken 0 times; repeated rows count each, and
    which of equal rows is taken does not show. Null ids come first. An empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"))
    rows = written(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, most)
    s = sources.select(F.col("source").alias("_s"), "source_size", "k", "first", "target")
    numbers = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("size"), F.col("_h")]
    x = prefix_sums(rows.withColumn("one", F.lit(1)), order, {"rank": "one"}).drop("one")
    x = x.join(F.broadcast(s) if numbers[0] <= FEW else s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    x = x.withColumn("rank", F.col("rank") - F.col("first"))
    due = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = written(x.withColumn("due", due).drop("first"), "due")
    part = F.col("due") - F.floor("due")
    open_ = x.withColumn("p", part).where("p > 0").select("k", "rank", F.col("size").cast("double").alias("w"), "p")
    up = _decided(open_, numbers[1] or 1, seed)
    x = x.join(up, ["k", "rank"], "left")
    copies = F.floor("due").cast("long") + F.coalesce("up", F.lit(0))
    return x.select("doc_id", "_h", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """docs with each row as often as plan() says: none, once or twice; all columns stay, whatever their
    names, as rows are carried whole. Rows without a word (null and empty texts too), which no count of words
    can weigh, stay once and are set aside, as any number of them may be equal. Of repeated rows with words
    each is taken or not as plan() counts them. An empty table gives an empty result."""
    p = plan(docs, **kw).where("size > 0").groupBy("doc_id", "_h", "source").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"))
    x = docs.select(F.struct(*docs.columns).alias("row"))
    worded = F.coalesce(F.col("row.text").rlike(WORD.rstrip("+")), F.lit(False))
    bare, x = x.where(~worded).select("row"), x.where(worded)
    x = x.withColumns({"id": F.col("row.doc_id"), "h": F.coalesce(F.xxhash64("row.text"), F.lit(0)), "s": F.col("row.source").cast("string")})
    x = x.join(p, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("_h")) & F.col("s").eqNullSafe(F.col("source")))
    one = x.where("n = 1").withColumn("k", F.col("c"))
    same = W.partitionBy("id", "h", "s").orderBy("h")
    many = x.where("n > 1").withColumn("r", F.row_number().over(same))
    share = F.floor(F.col("c") / F.col("n")) + (F.col("r") <= F.col("c") % F.col("n")).cast("long")
    many = many.withColumn("k", share).drop("r")
    x = one.unionByName(many).where("k > 0")
    return x.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k").cast("long")))).select("row").unionByName(bare).select("row.*")
