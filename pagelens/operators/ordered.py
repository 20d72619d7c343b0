"""Order-sensitive operators: latest per key, sessions, interval merging, crowding, fronts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .ranks import neighbours, ranged


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in the order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def gap_sessions(df: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """key, session (1, 2, ...), first, last and n: a pause of gap_s seconds or more begins a session."""
    w = W.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = (at - F.lag(at).over(w) >= gap_s * 1_000_000).cast("int")
    x = df.withColumn("session", 1 + F.sum(F.coalesce(fresh, F.lit(0))).over(w.rangeBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def merged_intervals(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """key, low, high and n of each run of closed intervals that overlap or touch."""
    w = W.partitionBy(key).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = df.withColumn("_new", F.when(F.col(low) <= reach, 0).otherwise(1))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "_island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("n")).drop("_island")


def pareto(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Rows (key and objectives) that no other row dominates (as good in all objectives and better in one; more is
    better). Rows with a null or NaN objective are left out.

    Each partition keeps its own front; fronts are merged by eights until one is left. So a task holds
    fronts only, and no rows are compared across partitions before.
    """

    def fronts(batches):
        kept = None
        for pdf in batches:
            pdf = pdf.dropna(subset=objectives)
            pool = pdf if kept is None else pd.concat([kept, pdf])
            x = pool[objectives].to_numpy(np.float64)
            stays = np.ones(len(x), bool)
            for i in np.argsort(-x.sum(1)):  # strong rows first, so that most go early
                if stays[i]:
                    beaten = (x[i] >= x).all(1) & (x[i] > x).any(1)
                    stays[beaten] = False
            kept = pool[stays]
        if kept is not None:
            yield kept

    x = df.select(key, *objectives)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = x.repartition(n, key).mapInPandas(fronts, x.schema)
    while n > 1:
        n = max(1, n // 8)
        x = x.repartition(n).mapInPandas(fronts, x.schema)
    return x


def crowding(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """key and distance: per objective the gap between the neighbours over the range, infinite at the ends.

    All objectives are dealt to ranges at once, as groups; a key's gaps are added up at the end. Keys name
    the rows; null values sort first, and a gap beside one counts 0.
    """
    long = df.select(key, F.posexplode(F.array(*[F.col(o).cast("double") for o in objectives])).alias("_o", "_v"))
    x = neighbours(long, "_o", key, "_v")
    gap = F.coalesce((F.col("after") - F.col("before")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    end = F.col("before").isNull() | F.col("after").isNull()
    gaps = x.select(key, F.struct("_o", F.when(end, F.lit(float("inf"))).otherwise(gap).alias("gap")).alias("g"))
    total = F.aggregate(F.array_sort(F.collect_list("g")), F.lit(0.0), lambda t, g: t + g["gap"])  # one value an objective, in their order
    return gaps.groupBy(key).agg(total.alias("distance"))


def _smaller_before(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each place the weight of the earlier places with a smaller value: halves are merged, widths doubling."""
    n, out = len(v), np.zeros(len(v), np.int64)
    at, width = np.arange(n), 1
    order = np.argsort(v, kind="stable")
    while width < n:
        block, right = at[order] // (2 * width), at[order] // width % 2 == 1
        by = np.lexsort((~right, v[order], block))  # equal values: right ones first, so that they don't count
        o, r = order[by], right[by]
        left = np.where(r, 0, w[o])
        sums = np.cumsum(left)
        start = np.flatnonzero(np.append(True, block[by][1:] != block[by][:-1]))
        base = np.repeat((sums - left)[start], np.diff(np.append(start, n)))
        out[o[r]] += (sums - base)[r]
        width *= 2
    return out


def dominated_by(df: DataFrame, group: str, key: str, x: str, y: str) -> DataFrame:
    """key and dominated_by: how many rows of the group are at least as good (as high) in both and better in one.

    Equal points count as one with a weight. In two orders, by x and by y (each time the other one, falling,
    for equals), a point is dominated by exactly those before it in both. Ranges of both orders cut a group
    into cells: whole cells before a point's come from running sums of their weights; points of its own
    range of x, and of its own range of y, are counted by merging within that range. So no group is joined
    with itself or held by one task. Rows with a null or NaN are neither compared nor dominated.
    """
    fit = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.when(fit, F.col(x)).alias("x"), F.when(fit, F.col(y)).alias("y"))
    points = rows.where("x is not null").groupBy(F.struct("g").alias("g"), "x", "y").agg(F.count(F.lit(1)).alias("w"))
    p = ranged(points, "g", F.desc("x"), F.desc("y")).withColumnRenamed("_range", "i")
    p = ranged(p, "g", F.desc("y"), F.desc("x")).withColumnRenamed("_range", "j")
    cells = p.groupBy("g", "i", "j").agg(F.sum("w").alias("n"))
    grid = cells.select("g", "i").distinct().join(cells.select("g", "j").distinct(), "g").join(cells, ["g", "i", "j"], "left")  # ranges times ranges at most
    column = W.partitionBy("g", "j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    line = W.partitionBy("g", "i").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.withColumn("above", F.coalesce(F.sum("n").over(column), F.lit(0)))
    grid = grid.select("g", "i", "j", F.coalesce(F.sum("above").over(line), F.lit(0)).alias("n"))

    def within(own: str):
        """Points before in both orders: in the same range of x, or in the same range of y but an earlier one of x."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first, second = ("x", "y") if own == "i" else ("y", "x")
            pdf = pdf.sort_values(["gid", first, second], ascending=[True, False, False], kind="stable")
            n = np.zeros(len(pdf), np.int64)
            ids = pdf["gid"].to_numpy()
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
            for a, b in zip(cuts, [*cuts[1:], len(pdf)]):
                part = pdf.iloc[a:b]
                v = np.lexsort((-pd.to_numeric(part["x"]).to_numpy(), -pd.to_numeric(part["y"]).to_numpy())).argsort() if own == "i" else part["i"].to_numpy()
                n[a:b] = _smaller_before(v, part["w"].to_numpy())
            return pd.DataFrame({"gid": pdf["gid"], "x": pdf["x"], "y": pdf["y"], "n": n})

        return run

    kinds = {c: df.schema[o].dataType.simpleString() for c, o in (("x", x), ("y", y))}
    gid = F.to_json("g").alias("gid")  # a null group is a group
    flat = p.select(gid, "x", "y", "w", "i", "j")
    schema = f"gid string, x {kinds['x']}, y {kinds['y']}, n long"
    counts = [flat.groupBy(own).applyInPandas(within(own), schema) for own in "ij"]
    counts.append(p.join(grid, ["g", "i", "j"]).select(gid, "x", "y", "n"))
    total = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("gid", "x", "y").agg(F.sum("n").alias("n"))
    out = rows.withColumn("gid", F.to_json(F.struct("g"))).join(total, ["gid", "x", "y"], "left")
    return out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).alias("dominated_by"))


def capped_session_max(df: DataFrame, key: str, ts: str, value: str, gap_s: float, span_s: float) -> DataFrame:
    """key and the largest session sum: a session ends at a pause of gap_s, a span of span_s, or a sum of 0.

    The fold needs one key's entries in order: a page's, which are few; they are gathered per key.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    g = df.select(key, F.struct(at.alias("t"), F.col(value).alias("v")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    zero = F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(a, e):
        joins = (a["sum"] != 0) & (e["t"] - a["last"] < gap_s) & (e["t"] - a["first"] < span_s)
        total = F.when(joins, a["sum"] + e["v"]).otherwise(e["v"])
        return F.struct(F.when(joins, a["first"]).otherwise(e["t"]).alias("first"), e["t"].alias("last"), total.alias("sum"), F.greatest(a["best"], total).alias("best"))

    return g.select(key, F.aggregate("_e", zero, step, lambda a: a["best"]).alias("worst"))
