"""Greedy choices without going row by row: rounds that settle all that no earlier choice can change.

A round is joins and grouped minima over all pages at once, so no task holds a page. When few rows are open,
which is counted, a pass over them in order settles the rest; it keeps only the ids it has settled of one page.
"""

from __future__ import annotations

from collections import namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.sinks import scratch

#: Open rows up to which one pass in order is cheaper than further rounds.
FEW = 200_000
#: Rows that a fold hands on together.
BATCH = 4096


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by dealing out both sides. Files of paths and nested texts are a small part of their rows, and
    folds and unions of them are judged by these files, so Catalyst would send what grows with the table whole
    through the driver."""
    return df.hint("merge")


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table in the shared folder, dealt(), and its rows; cuts the lineage of rounds."""
    seen, path = Observation(), scratch(df.sparkSession, "round")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return dealt(df.sparkSession.read.schema(df.schema).parquet(path)), seen.get["n"]


def folded(df: DataFrame, page: str, order: list, fold, schema: str) -> DataFrame:
    """What fold() makes of each page's rows in order: a list of named tuples goes in, tuples of schema come out.

    A task goes through its pages one after the other and holds one; many small pages share a batch, as a call
    of pandas for each would cost more than the fold. A null page is a page.
    """
    given = df.repartition(page).sortWithinPartitions(page, *order)
    item, at, kind = namedtuple("Item", df.columns), df.columns.index(page), to_arrow_schema(StructType.fromDDL(schema))

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    def run(batches):
        rows, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[at] != rows[0][at]:
                    out += fold(rows)
                    rows = []
                    if len(out) >= BATCH:
                        yield made(out)
                        out = []
                rows.append(item._make(row))
        if rows:
            out += fold(rows)
        if out:
            yield made(out)

    return given.mapInArrow(run, schema)


def _in_order(df: DataFrame, order: list, fold, schema: str) -> DataFrame:
    """Rows of df by page (column g) in order; fold() makes a function of a page that says which rows to hand on."""
    names = df.columns
    given = df.repartition("g").sortWithinPartitions("g", *order)

    def run(batches):
        page, takes = None, None
        for batch in batches:
            rows, hits = batch.to_pylist(), []
            for k, row in enumerate(rows):
                if takes is None or row["g"] != page:
                    page, takes = row["g"], fold()
                if takes(row):
                    hits.append(k)
            yield batch.take(pa.array(hits, pa.int64())).select(names)

    return given.mapInArrow(run, schema)


def dominant_pairs(candidates: DataFrame, page: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of a page, best score first, then least left, then least right.

    A pair that is the best of all open ones for both its ends is in the greedy result whatever else is: a
    round takes all of these and drops what shares an end with them. NaN scores count as lowest, repeated
    candidates as one, a null page as a page.
    """
    x = candidates.select(F.struct(F.col(page).alias("p")).alias("g"), F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s"))
    x, n = written(x)
    taken, rank = [], lambda: F.struct(-F.col("s"), F.col("l"), F.col("r"))
    while n > FEW:
        best = {e: x.groupBy("g", e).agg(F.min(rank()).alias(f"best_{e}")) for e in "lr"}
        both = x.join(best["l"], ["g", "l"]).join(best["r"], ["g", "r"]).where((rank() == F.col("best_l")) & (rank() == F.col("best_r")))
        took, _ = written(both.select(x.columns).distinct())
        taken.append(took)
        x, n = written(x.join(took.select("g", "l"), ["g", "l"], "left_anti").join(took.select("g", "r"), ["g", "r"], "left_anti").select(x.columns))

    def fold():
        lefts, rights = set(), set()

        def takes(row):
            free = row["l"] not in lefts and row["r"] not in rights
            if free:
                lefts.add(row["l"])
                rights.add(row["r"])
            return free

        return takes

    out = _in_order(x, [-F.col("s"), "l", "r"], fold, x.schema)
    for took in taken:
        out = out.unionByName(took)
    return out.select(F.col("g.p").alias(page), F.col("l").alias(left), F.col("r").alias(right), F.col("s").alias(score))


def first_free(nodes: DataFrame, edges: DataFrame, page: str, key: str) -> DataFrame:
    """nodes that a pass in order keeps, each unless one kept before excludes it.

    edges: page, before and after (keys), and place, the order of after; before excludes after. A round keeps
    what nothing open excludes and drops all that it excludes. Rows of nodes with one page and key stand or
    fall together.
    """
    x = edges.select(F.struct(F.col(page).alias("p")).alias("g"), "before", "after", "place")
    x, n = written(x)
    dropped = []
    while n > FEW:
        roots = x.select("g", "before").distinct().join(x.select("g", F.col("after").alias("before")), ["g", "before"], "left_anti")
        gone, _ = written(x.join(roots, ["g", "before"], "left_semi").select("g", "after").distinct())
        dropped.append(gone)
        x = x.join(gone, ["g", "after"], "left_anti").join(gone.select("g", F.col("after").alias("before")), ["g", "before"], "left_anti")
        x, n = written(x.select("g", "before", "after", "place"))

    def fold():
        gone = set()

        def takes(row):
            if row["after"] in gone or row["before"] in gone:
                return False
            gone.add(row["after"])
            return True

        return takes

    gone = _in_order(x, ["place", "after"], fold, x.schema).select("g", "after")
    for more in dropped:
        gone = gone.unionByName(more)
    gone = dealt(gone.select(F.col("g.p").alias("_page"), F.col("after").alias("_key")))
    return nodes.join(gone, nodes[page].eqNullSafe(gone["_page"]) & (nodes[key] == gone["_key"]), "left_anti")
