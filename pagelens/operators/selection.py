"""Selections whose result depends on what was chosen before: quotas, coverage, near-duplicates, loose matches."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from heapq import heapify, heappop, heapreplace

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .ranks import placed
from .rounds import FEW, folded, written


def quotas(sizes: DataFrame, group: str, bin: str, place: Column, size: Column, total: Column, ratio: dict[int, int]) -> DataFrame:
    """take of each group's bins (places 0 to k - 1): total is split by ratio, rounded down, the rest to the last
    bin; what a bin cannot fill is added to the next one.

    One row per group and bin goes in; the fold is over a group's few bins.
    """
    parts = sum(ratio.values())
    k = len(ratio)
    share = F.floor(F.col("quota") * F.try_element_at(F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv]), F.col("place")) / parts)
    have = sizes.select(group, F.col(bin).alias("bin"), place.alias("place"), size.cast("long").alias("size"), total.cast("long").alias("quota"))
    bins = have.groupBy(group, "quota").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("bin", "size")))).alias("have"))
    rows = bins.select(group, "quota", "have", F.explode(F.array(*map(F.lit, range(k)))).alias("place")).withColumn("share", share.cast("long"))
    first = F.sum("share").over(W.partitionBy(group, "quota"))
    rows = rows.withColumn("share", F.when(F.col("place") == k - 1, F.col("share") + F.col("quota") - first).otherwise(F.col("share")))
    rows = rows.select(group, "place", "share", F.try_element_at("have", F.col("place")).alias("h"))
    each = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "share", F.col("h.bin").alias("bin"), F.coalesce("h.size", F.lit(0)).alias("size")))).alias("all"))
    none = F.array().cast("array<struct<bin:string,take:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("spill"), none.alias("done"))

    def step(a, e):
        want = e["share"] + a["spill"]
        take = F.least(want, e["size"])
        return F.struct((want - take).alias("spill"), F.array_append(a["done"], F.struct(e["bin"].cast("string").alias("bin"), take.alias("take"))).alias("done"))

    return each.select(group, F.explode(F.aggregate("all", start, step, lambda a: a["done"])).alias("d")).select(group, "d.*").where("take > 0")


#: Rows of a group that one task chooses from in a round (Spark ranks by limits up to 1000 before it shuffles), and their items.
POOL, ITEMS = 900, 200_000


def _covering(rows: dict, take: int, outside: tuple | None = None) -> tuple[list, int]:
    """Keys in the order of choice, and how many gains were looked at.

    Gains only fall, so a heap may hold stale ones: the top is looked at again, and chosen if it still holds.
    An index from item to rows takes a newly covered item off the gains of those rows alone. outside is the best
    row that is not among these, as its gain less than 0 and its key: what is not ahead of it is left open.
    """
    holders, gains = defaultdict(list), {}
    for key, items in rows.items():
        gains[key] = len(items)
        for i in items:
            holders[i].append(key)
    heap = [(-g, key) for key, g in gains.items()]
    heapify(heap)
    out, looked = [], 0
    while heap and len(out) < take:
        g, key = heap[0]
        looked += 1
        if -g != gains[key]:
            heapreplace(heap, (-gains[key], key))
            continue
        if outside is not None and (g, key) > outside:
            break
        heappop(heap)
        out.append(key)
        for i in rows[key]:
            for other in holders.pop(i, ()):
                gains[other] -= 1
    return out, looked


def few(df: DataFrame, n: int) -> DataFrame:
    """df, which has n rows at most, for a broadcast if these are few."""
    return F.broadcast(df) if n <= FEW else df


def most_covering(rows: DataFrame, group: list[str], key: str, items: str, take: str) -> DataFrame:
    """group, key and place (1, 2, ...) of the rows chosen in each group, up to take: always the row that adds most
    items not covered yet, the least key of equals. Keys name the rows of a group; null items are no items.

    All rows of a group are candidates, and its rows are spread over tasks. A round counts every row's gain, lets
    one task choose among the best of a group (POOL of them, of ITEMS items together) as long as its choice is
    ahead of the best row outside, whose gain can only fall, and takes what is covered off all other rows. So
    each choice is that of the whole group, a round makes one at least, and most make many.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()
    names = f"g struct<{','.join(f'{c}:{kind(c)}' for c in group)}>, k struct<{key}:{kind(key)}>"
    item = rows.schema[items].dataType.elementType.simpleString()
    g, k = F.struct(*group).alias("g"), F.struct(key).alias("k")
    docs, n = written(rows.select(g, k, F.col(take).cast("int").alias("take"), F.lit(0).alias("done")))
    held, m = written(rows.select(g, k, F.explode(F.array_distinct(items)).alias("item")).where("item IS NOT NULL"))
    best = W.partitionBy("g").orderBy(F.desc("gain"), "k")

    def choose(pool: list) -> list[tuple]:
        sets = {r.by_key: set(r.items or ()) for r in pool if r.inside}
        outside = next(((-r.gain, r.by_key) for r in pool if not r.inside), None)  # in order of gain, then key
        own, covered, out = {r.by_key: r.k for r in pool}, set(), []
        for place, c in enumerate(_covering(sets, pool[0].take - pool[0].done, outside)[0], pool[0].done + 1):
            out.append((pool[0].g, own[c], place, list(sets[c] - covered)))
            covered |= sets[c]
        return out

    def chosen(top: DataFrame, n: int) -> DataFrame:
        of = held.join(few(top.where("inside").select("g", "k"), n), ["g", "k"]).groupBy("g", "k").agg(F.collect_list("item").alias("items"))
        return folded(top.join(of, ["g", "k"], "left"), "g", ["r"], choose, f"{names}, place int, items array<{item}>")

    found = []
    while True:
        gains = docs.join(held.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")), ["g", "k"], "left").withColumn("gain", F.coalesce("n", F.lit(0)))
        top = gains.withColumn("r", F.row_number().over(best)).where(F.col("r") <= POOL + 1)
        together = F.sum("gain").over(best.rowsBetween(W.unboundedPreceding, 0))
        top = top.withColumn("inside", (F.col("r") == 1) | ((F.col("r") <= POOL) & (together <= ITEMS)))
        top = top.select("g", "k", "take", "done", "gain", "r", "inside", F.row_number().over(W.partitionBy("g").orderBy("k")).alias("by_key"))
        if n <= POOL and m <= ITEMS:  # no row is outside: nothing stays open
            found.append(chosen(top, n))
            break
        top, n = written(top)
        took, some = written(chosen(top, n))
        found.append(took)
        at = took.groupBy("g").agg(F.max("place").alias("at"))  # a row for each open group, as each made a choice
        docs = docs.join(few(took.select("g", "k"), some), ["g", "k"], "left_anti").join(few(at, some), "g").where("at < take")
        docs, n = written(docs.select("g", "k", "take", F.col("at").alias("done")))
        if not n:
            break
        covered, many = written(took.select("g", F.explode("items").alias("item")))
        held = held.join(few(covered, many), ["g", "item"], "left_anti").join(few(docs.select("g").distinct(), some), "g", "left_semi")
        held, m = written(held.select("g", "k", "item"))
    return reduce(DataFrame.unionByName, found).select(*[F.col(f"g.{c}").alias(c) for c in group], F.col(f"k.{key}").alias(key), "place")


def keep_dissimilar(rows: DataFrame, group: str, key: str, words: Column, threshold: float) -> DataFrame:
    """group and key of the rows kept in key order: each whose word set has a Jaccard similarity below threshold
    with all kept before it in its group. Two empty sets are equal. Groups are lists of candidates, not tables."""
    one = F.struct(F.col(key).alias("k"), F.array_distinct(words).alias("w"))
    x = rows.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def near(a, b):
        union = F.size(F.array_union(a["w"], b["w"]))
        return F.when(union == 0, True).otherwise(F.size(F.array_intersect(a["w"], b["w"])) >= threshold * union)

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, e: F.when(F.exists(done, lambda d: near(d, e)), done).otherwise(F.array_append(done, e)))
    return x.select(group, F.explode(F.transform(kept, lambda e: e["k"])).alias(key))


def _grams(name: Column, most: int = 3) -> Column:
    """Distinct parts of up to most characters."""
    n = F.length(name)

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(name, i, F.lit(k)))

    return F.array_distinct(F.flatten(F.array(*map(of, range(1, most + 1)))))


def contained_match(left: DataFrame, right: DataFrame, key: str, name: str, other: str) -> DataFrame:
    """left's key with the best of right's names (column other): the equal one; else, of those that hold it or
    that it holds, the nearest in length, then the least.

    A name held by another begins with one of the other's parts of three characters (fewer if it is
    shorter), so candidates come from joins on such parts, not from all pairs.
    """
    head = lambda c: F.substring(c, 1, 3)
    a = left.select(F.col(key), F.col(name).alias("a")).where("a <> ''").distinct()
    b = right.select(F.col(other).alias("b")).where("b <> ''").distinct()
    # distinct names only: equal keys of the left share their match
    names = a.select("a").distinct()
    holds = names.withColumn("part", head(F.col("a"))).join(b.withColumn("part", F.explode(_grams(F.col("b")))), "part").where(F.contains("b", F.col("a")))
    held = b.withColumn("part", head(F.col("b"))).join(names.withColumn("part", F.explode(_grams(F.col("a")))), "part").where(F.contains("a", F.col("b")))
    best = F.min_by("b", F.struct((F.col("a") != F.col("b")).alias("exact"), F.abs(F.length("a") - F.length("b")).alias("gap"), "b"))
    found = holds.select("a", "b").union(held.select("a", "b")).groupBy("a").agg(best.alias(other))
    return a.join(found, "a", "left").select(key, other)


def collapse_variants(rows: DataFrame, repo: str, package: str, base: Column, ratio: float = 0.85) -> DataFrame:
    """repo and package: of each base's variants in a repository the base alone, where they outnumber ratio times
    the repositories that hold the base itself; else the variants."""
    x = rows.select(repo, package).distinct().withColumn("base", base)
    often = x.groupBy(F.col(package).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    many = x.groupBy(repo, "base").agg(F.count(F.lit(1)).alias("m")).join(often, "base", "left")
    many = many.select(repo, "base", (F.col("m") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) > ratio).alias("one"))
    return x.join(many, [repo, "base"]).select(repo, F.when(F.col("one"), F.col("base")).otherwise(F.col(package)).alias(package)).distinct()


def demo_sets(rows: DataFrame, key: str, kind: str, gain: str, seed: int = 0) -> DataFrame:
    """set (0 to 7) and key of eight example sets: 0 and 1 hold 3 rows of different kinds, filled up by gain; 2, 3
    and 4 hold 4 rows of the better two thirds, drawn by a seeded hash; 5, 6 and 7 hold 5 by gain from places 0,
    2 and 4 on (from 0 where too few follow)."""
    order = [F.desc(gain), F.col(key)]
    n = rows.count()
    top = rows.orderBy(*order).limit(9).select(key, kind, gain)
    drawn = lambda s, k: F.xxhash64(F.lit(seed), F.lit(s), F.col(k))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where("r = 1").select(key, kind, gain)
    out = []
    for s in (0, 1):
        some = first.orderBy(drawn(s, kind)).limit(3).select(key, F.lit(0).alias("fill"), F.lit(0.0).alias("g"))
        rest = top.select(key, F.lit(1).alias("fill"), (-F.col(gain)).alias("g"))
        both = some.unionByName(rest).groupBy(key).agg(F.min(F.struct("fill", "g")).alias("o")).orderBy("o", key).limit(3)
        out.append(both.select(F.lit(s).alias("set"), key))
    pool = max(1, n * 2 // 3)
    better = placed(rows.select(key, gain, F.lit(0).alias("_all")), ["_all"], order).where(F.col("place") < pool).select(key)
    for s in (2, 3, 4):
        some = better.orderBy(drawn(s, key), key).limit(4)
        out.append(some.select(F.lit(s).alias("set"), key))
    nine = top.withColumn("place", F.row_number().over(W.orderBy(*order)) - 1)  # nine rows
    for s, skip in ((5, 0), (6, 2), (7, 4)):
        skip = skip if n >= skip + 5 else 0
        out.append(nine.where((F.col("place") >= skip) & (F.col("place") < skip + 5)).select(F.lit(s).alias("set"), key))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def stratified(rows: DataFrame, key: str, stratum: str, total: int, train: int) -> DataFrame:
    """key, stratum, h and train of total rows: strata by size, the largest first, each take an equal share of what is
    left (one at least, all they have at most); what is missing then comes from all others. Rows are drawn by
    the md5 of their key (h), and the first train of them by its md5 again are marked.
    """
    d = rows.select(key, stratum, F.md5(F.col(key).cast("string")).alias("h"))
    sizes = d.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    every = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), stratum, "n"))).alias("all"))  # a row for each stratum
    start = F.struct(F.lit(total).cast("long").alias("left"), F.size("all").cast("long").alias("open"), F.array().cast("array<struct<s:string,take:bigint>>").alias("done"))

    def step(a, e):
        take = F.when(a["left"] <= 0, 0).otherwise(F.least(e["n"], F.greatest(F.lit(1), F.floor(a["left"] / a["open"])))).cast("long")
        return F.struct((a["left"] - take).alias("left"), (a["open"] - 1).alias("open"), F.array_append(a["done"], F.struct(e[stratum].cast("string").alias("s"), take.alias("take"))).alias("done"))

    shares = every.select(F.explode(F.aggregate("all", start, step, lambda a: a["done"])).alias("d")).select(F.col("d.s").alias(stratum), "d.take")
    place = F.row_number().over(W.partitionBy(stratum).orderBy("h", key))
    # no row beyond the first total of a stratum can be chosen
    x = d.withColumn("place", place).where(F.col("place") <= total).join(shares, stratum)
    x = x.orderBy((F.col("place") <= F.col("take")).desc(), "h", key).limit(total)
    return x.select(key, stratum, "h", (F.row_number().over(W.orderBy(F.md5("h"), key)) <= train).alias("train"))  # total rows
