"""Aggregations over measurement runs, usage records and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import exclusive_quantile
from .rounds import written


def decimal_mean(values: Column) -> Column:
    """Mean of an array, summed as decimals so that the order of rows does not show; null if empty."""
    total = F.aggregate(values, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x.cast("decimal(20,6)")).cast("decimal(38,6)"))
    return F.when(F.size(values) > 0, total.cast("double") / F.size(values))


def inliers(ordered: Column) -> Column:
    """Values within 1.5 interquartile ranges (exclusive quartiles) of an ascending array; all, if fewer than 4."""
    q1, q3 = exclusive_quantile(ordered, 1, 4), exclusive_quantile(ordered, 3, 4)
    kept = F.filter(ordered, lambda x: x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    return F.when(F.size(ordered) < 4, ordered).otherwise(kept)


def run_summary(runs: DataFrame, keys: list[str], value: str = "value", ok: Column | None = None) -> DataFrame:
    """Per key: runs in all, valid ones, outliers removed, and median, mean and p75 of the rest.

    Failed runs, nulls and NaN go first; p75 is the maximum for fewer than four values. Keys whose runs all
    failed stay, with null statistics. One key's runs are gathered: they are a handful of repeated
    measurements, and the list is built by map-side combining.
    """
    good = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.lit(True) if ok is None else ok)
    g = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_runs"), F.sort_array(F.collect_list(F.when(good, F.col(value)))).alias("_all"))
    g = g.withColumn("_kept", inliers(F.col("_all")))
    n = F.size("_kept")
    middle = (F.get("_kept", F.floor((n - 1) / 2).cast("int")) + F.get("_kept", F.floor(n / 2).cast("int"))) / 2
    p75 = F.when(n < 4, F.array_max("_kept")).otherwise(exclusive_quantile(F.col("_kept"), 3, 4))
    return g.select(
        *keys, "total_runs", F.size("_all").alias("valid_runs"), (F.size("_all") - n).alias("outliers_removed"),
        F.when(n > 0, middle).alias("median"), F.round(decimal_mean(F.col("_kept")), 4).alias("mean"), F.when(n > 0, p75).alias("p75"),
    )


def usage_buckets(calls: DataFrame) -> DataFrame:
    """Calls, successes, latency and tokens by nothing, phase, job, job and phase, and status, in one pass.

    calls: job, phase, status, ok, latency_ms, tokens. Missing jobs and phases count as unknown, missing
    numbers as 0; the mean latency is cut to whole milliseconds. grouping tells the five groupings apart.
    """
    unknown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    x = calls.select(unknown("job").alias("job"), unknown("phase").alias("phase"), "status", "ok", F.coalesce("latency_ms", F.lit(0.0)).alias("ms"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    sets = [[], [F.col("phase")], [F.col("job")], [F.col("job"), F.col("phase")], [F.col("status")]]
    g = x.groupingSets(sets, F.col("job"), F.col("phase"), F.col("status")).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok_calls"),
        F.sum("tokens").alias("tokens"), F.sum(F.col("ms").cast("decimal(18,3)")).alias("_ms"),
    )
    return g.select("grouping", "job", "phase", "status", "calls", "ok_calls", "tokens", F.floor(F.col("_ms").cast("double") / F.col("calls")).cast("long").alias("avg_latency_ms"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _ordered_bits(v: Column) -> Column:
    """A double as a long of the same order: exponent and mantissa side by side, the sign outside."""
    size = F.abs(v)
    e = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(5e-324)))), F.lit(-1022)).cast("double")
    # the logarithm can be off by one beside a power of two
    unit = lambda e: F.when(e > 1022, F.pow(F.lit(2.0), e - 1) * 2).otherwise(F.pow(F.lit(2.0), e))
    e = F.when(size < unit(e), F.greatest(e - 1, F.lit(-1022.0))).when(size / unit(e) >= 2, e + 1).otherwise(e)
    bits = ((e + 1022).cast("long") * (1 << 52)) + (size / unit(e) * float(1 << 52)).cast("long")
    return F.when(v < 0, -bits).otherwise(bits)


#: Bits of a value by which one step of quantiles() tells rows apart.
STEP = 16


def quantiles(df: DataFrame, keys: list[str], value: str, parts: list[float]) -> DataFrame:
    """keys and q, the exact inclusive quantiles of each group: an array, in the order of parts.

    Histograms are refined: rows are counted by the leading bits of their value, then, only in the bins that
    hold a wanted rank, by the next ones, until a bin holds one value. What a group keeps is a count for each
    of at most 2 ** STEP bins a rank, however many values there are, and counts are summed before any shuffle.
    Infinities count as the greatest doubles. Nulls and NaN are left out; a group with nothing else has no row.
    """
    most = 1.7976931348623157e308
    v = F.least(F.greatest(F.col(value).cast("double"), F.lit(-most)), F.lit(most))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(*keys).alias("g"), v.alias("v")).withColumn("bits", _ordered_bits(F.col("v")))
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in parts])))
    sizes, _ = written(sizes)
    open_ = sizes.select("g", F.explode(ranks).alias("rank"), "lo", "hi").withColumns({"bin": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    done = []
    for shift in range(64 - STEP, -1, -STEP):
        name = F.lit(0).cast("long") if shift == 64 - STEP else F.shiftright("bits", shift + STEP)
        bins = open_.select("g", "bin").distinct()
        counts = rows.withColumn("bin", name).join(bins, ["g", "bin"]).groupBy("g", "bin", F.shiftright("bits", shift).alias("next")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("g", "bin").orderBy("next").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)
        x = open_.select("g", "rank", "bin", "base").join(counts, ["g", "bin"]).where((F.col("rank") >= F.col("base") + F.col("before")) & (F.col("rank") < F.col("base") + F.col("before") + F.col("n")))
        x, _ = written(x.select("g", "rank", "lo", "hi", F.col("next").alias("bin"), (F.col("base") + F.col("before")).alias("base")))
        done.append(x.where("lo = hi").select("g", "rank", "lo"))
        open_, n = written(x.where("lo < hi"))
        if not n:
            break
    found = reduce(DataFrame.unionByName, done).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("by"))  # two ranks a part at most
    low, high = (lambda p: F.try_element_at("by", F.floor(at(p)))), (lambda p: F.try_element_at("by", F.ceil(at(p))))
    values = [low(p) + (high(p) - low(p)) * (at(p) - F.floor(at(p))) for p in parts]
    return sizes.join(found, "g").select("g.*", F.array(*values).alias("q"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extremes, mean, sample deviation and inclusive quartiles per group."""
    c = F.col(value).cast("double")
    g = df.groupBy(F.struct(*keys).alias("_g")).agg(F.count(value).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75]).select(F.struct(*keys).alias("_g"), "q")
    return g.join(q, "_g", "left").select("_g.*", "n", "lo", "hi", "mean", "std", *[F.get("q", F.lit(k)).alias(f"p{p}") for k, p in enumerate((25, 50, 75))])


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of the column's given values per row, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts of half-open bins [a, b), the last one open above; empty bins count 0."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(k, float(a)) for k, a in enumerate(edges)], "bin int, low double")
    own = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), sum((F.col(value) >= a).cast("int") for a in edges) - 1)
    counts = df.select(own.alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; ties must be broken by order."""
    from pyspark.sql import Window as W

    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
