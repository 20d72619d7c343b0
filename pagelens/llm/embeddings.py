"""Embedding near-duplicates: sorted projection passes over random hyperplane hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import components, prefix_sums, written

THRESHOLD = 0.9
BITS = 48
WINDOW = 512
#: Chance with which a pair exactly at the threshold may be missed by the first passes, if vectors are spread evenly.
MISS = 0.01
#: Passes that share a shuffle; after the first passes, as many more as long as they pay.
BATCH = 4
#: Passes go on while a batch joins more than one of so many grouped vectors to another group.
PAYS = 2000
#: Vectors of a block; a task that counts links meets two halves.
BLOCK = 4096
#: Parts over which the rows of one large group are dealt in joins on the group.
SALT = 16


def passes(n: int) -> int:
    """Passes so that a pair at the threshold is neighbours in one with a chance of 1 - MISS.

    About WINDOW vectors share log2(n / WINDOW) leading bits if they are spread evenly, and a bit of both
    agrees with a chance of 1 - angle / pi; so the number grows slowly with the table. Where vectors crowd
    more is missed, which shows in what a further batch still joins.
    """
    bits = max(1.0, math.log2(max(2, n) / WINDOW))
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(4, math.ceil(math.log(MISS) / math.log1p(-min(meet, 0.99))))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The values of a list column as arrays of doubles."""
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _hashes(first: int, last: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights, k = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64), last - first
        for batch in batches:
            node, rows = batch.column("node").to_numpy(), _vectors(batch.column("embedding"))
            dims = np.array([len(v) for v in rows], np.int64)
            out = np.empty((len(rows), k), np.int64)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.concatenate([np.random.RandomState([d, p]).standard_normal((BITS, d)) for p in range(first, last)]).T
                here = np.flatnonzero(dims == d)
                bits = np.stack([rows[r] for r in here]) @ planes[d] > 0
                out[here] = bits.reshape(len(here), k, BITS).astype(np.int64) @ weights
            cols = [np.repeat(node, k), np.tile(np.arange(first, last), len(node)), np.repeat(dims, k), out.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "pass", "dim", "hash"])

    return run


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dim(pdf: pd.DataFrame):
    size = pdf["embedding"].map(len)
    for _, part in pdf.groupby(size):
        yield part


def _neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) that connect what the block's links connect; a link is a pair at the threshold of which one
    is among the WINDOW next ones of the other. All links count: of each part that they connect, each vector
    but the first has an edge to the first.
    """
    found = []
    for part in _by_dim(pdf.sort_values("rank")):
        x, rank, node, own = _unit(part["embedding"]), part["rank"].to_numpy(), part["node"].to_numpy(), part["own"].to_numpy()
        ends = []
        for start in range(0, len(x), 256):
            a = slice(start, min(start + 256, len(x)))
            b = slice(start, min(start + 256 + WINDOW, len(x)))
            gap = rank[None, b] - rank[a, None]
            hit = (x[a] @ x[b].T >= THRESHOLD) & (gap > 0) & (gap <= WINDOW) & own[a, None]
            ends.append(np.stack(np.nonzero(hit)) + start)
        i, j = np.concatenate(ends, axis=1)
        label = np.arange(len(x))
        while True:
            new, low = label.copy(), np.minimum(label[i], label[j])
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        k = np.flatnonzero(label < np.arange(len(x)))
        found.append(np.stack([node[label[k]], node[k]], 1))
    out = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Of each left vector of two blocks of one group, how many rows of the right one it links with."""
    out = []
    for d in {len(r[3]) for r in rows}:
        left, right = ([r for r in rows if r[0] == flag and len(r[3]) == d] for flag in (True, False))
        if left and right:
            hit = _unit([r[3] for r in left]) @ _unit([r[3] for r in right]).T >= THRESHOLD
            hit &= np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])[None]
            n = hit.astype(np.float64) @ np.array([r[2] for r in right], np.float64)
            out += zip([r[1] for r in left], n.astype(np.int64).tolist())
    return out


def _counts(batches):
    """_links() of each run of rows with one key."""
    key, rows = None, []

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["node", "links"])

    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("root", "l", "r", "left", "node", "size")]
        for *now, left, node, size, vector in zip(*cols, _vectors(batch.column("embedding"))):
            if now != key:
                out += _links(rows)
                key, rows = now, []
            rows.append((left, node, size, vector))
        yield batch_of(out)
    yield batch_of(_links(rows))


def _of_root(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows joined on root with found (a row per root), the rows of a large group dealt out."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    return rows.join(found.select("*", salts), ["root", "salt"]).drop("salt")


def _pass(classes: DataFrame, n: int, first: int, last: int) -> DataFrame:
    """Edges (a, b) that connect what the passes first to last - 1 find among n classes."""
    h = classes.select("node", "embedding").mapInArrow(_hashes(first, last), "node long, pass long, dim long, hash long")
    order = [F.col(c) for c in ("pass", "dim", "hash", "node")]
    h = prefix_sums(h.withColumn("one", F.lit(1)), order, {"rank": "one"})  # n rows in each pass
    h = h.select("node", (F.col("rank") - n * (F.col("pass") - first)).alias("rank"), "pass")
    block = F.floor(F.col("rank") / BLOCK)
    halo = F.when(F.col("rank") % BLOCK < WINDOW, F.array(block, block - 1)).otherwise(F.array(block))
    h = h.withColumn("home", block).withColumn("block", F.explode(halo))
    h = h.join(classes.select("node", "embedding"), "node").withColumn("own", F.col("home") == F.col("block"))
    return written(h.groupBy("pass", "block").applyInPandas(_neighbours, "a long, b long").distinct(), "pairs")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Equal vectors form a class, compared once. In each pass classes are ordered by BITS concatenated
    random hyperplane signs (ties by class) and compared with the WINDOW next ones; all pairs verified in
    any pass are united to groups. After the first passes, whose number follows from the table's size,
    more follow in batches until one joins hardly any groups any more. In every group each class is then
    compared with all others, block by block, which gives exact link counts and leaves no pair of a group
    out.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so
    do vectors of different lengths. component_id is the least vec_id of the vectors reachable (null ids
    last). Rows may repeat and ids be null: each row counts as a vector. An empty table gives an empty
    result; other columns are not read.
    """
    kept = vectors.schema["embedding"].dataType.simpleString()
    kind = "array<float>" if kept == "array<float>" else "array<double>"
    v = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    norm = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    usable = F.coalesce(F.forall("embedding", fine) & (norm > 0) & (norm < float("inf")), F.lit(False))
    v = v.withColumn("key", F.when(usable, F.md5(F.to_json(F.struct("embedding")).cast("binary"))))
    v = written(v, "vectors")
    classes = v.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, done, links, roots = classes.count(), 0, None, None
    total = passes(n)
    while True:
        last = min(done + BATCH, total) if done < total else done + BATCH
        found = _pass(classes, n, done, last)
        links = found if links is None else links.union(found)
        done = last
        if done < total:
            continue
        if roots is not None:
            root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
            apart = found.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            new = apart.where("a <> b").distinct().count()
            if new:
                roots = components(links)
            if new * PAYS <= roots.count():
                break
        else:
            roots = components(links)
            if n <= WINDOW:  # each pass compares all
                break
    groups = classes.join(roots, "node").select("node", "root", "size", "embedding")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    groups = _of_root(groups, sizes).withColumn("blocks", F.ceil(F.col("m") / (BLOCK // 2)))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = lambda flag: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.when(F.lit(flag), F.col("block")).otherwise(o).alias("l"), F.when(F.lit(flag), o).otherwise(F.col("block")).alias("r"), F.lit(flag).alias("left")))
    pairs = groups.select("node", "root", "size", "embedding", F.explode(F.concat(each(True), each(False))).alias("p")).select("node", "root", "size", "embedding", "p.*")
    pairs = pairs.repartition("root", "l", "r").sortWithinPartitions("root", "l", "r")
    counted = pairs.mapInArrow(_counts, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    counted = written(counted, "counted")
    of = classes.join(roots, "node", "left").join(counted, "node", "left").select("node", "key", "rep", "size", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = _of_root(of, least).select("key", "component_id", (F.col("links") + F.col("size") - 1).alias("n_links"))
    out = v.select("vec_id", "key").join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
