"""Audit of how sources diverge: count-min prefilter, exact counts of what is left, sparse pairs of sources."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ._common import union_all, written
from ._words import _LOWER, _powers_to, mix

#: A term must occur in so many documents of its language.
LEAST = 10
#: Rows of the sketch; counters a row grow with the documents, up to a bound: 3 MB to 12 MB of bytes a task.
DEPTH, LEAST_WIDTH, MOST_WIDTH, WIDTH_PER_DOC = 3, 1 << 16, 1 << 22, 16
#: Counters in a row of the sketch's table.
CHUNK = 4096
#: Terms reported for a source.
TOP = 10
#: Bytes of text that a worker cuts into terms at once (a longer document on its own), and counts that it
#: holds before it hands them on.
SLICE, HELD = 1 << 20, 400_000

_IS_TERM = np.ones(256, bool)
_IS_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _slices(texts: pa.Array):
    """Runs of consecutive documents: their bytes and where each begins, and the number of the first one."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        yield data[offsets[k] : offsets[end]], offsets[k:end] - offsets[k], k
        k = end


def _terms(data: np.ndarray, begins: np.ndarray):
    """Starts, ends, hashes (A-Z as a-z) and document numbers of all terms."""
    n = len(data)
    inside = _IS_TERM[data]
    at = begins[begins < n]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[at] = inside[at]
    last[at[at > 0] - 1] = inside[at[at > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(begins, starts, "right") - 1


def _distinct(a: np.ndarray, b: np.ndarray):
    """An order that sorts by a, then b, and where in it each distinct pair begins."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool))


def _language_salts(langs: pa.Array) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs.to_pylist())}
    return np.array([known[x] for x in langs.to_pylist()], np.uint64)


def _cells(keys: np.ndarray, width: int):
    for row in range(DEPTH):
        yield row, (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def _sketches(width: int, least: int):
    """Document frequencies of one task's documents: counters that stop at least, as chunks of bytes."""

    def run(batches):
        counts = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            salts = _language_salts(batch.column(0))
            for data, begins, row in _slices(batch.column(1)):
                _, _, hashes, doc = _terms(data, begins)
                order, at = _distinct(doc, hashes)
                keys = hashes[order[at]] ^ salts[row + doc[order[at]]]
                for k, cell in _cells(keys, width):
                    cells, n = np.unique(cell, return_counts=True)
                    counts[k, cells] = np.minimum(counts[k, cells] + n, least)
        flat = counts.reshape(-1, CHUNK)
        for some in np.array_split(np.flatnonzero(flat.any(1)), 8):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([flat[k].tobytes() for k in some], pa.binary())], names=["chunk", "cells"])

    return run


def _merged(least: int):
    """Chunks added up as they come; a bit for each counter that reaches least."""

    def run(batches):
        sums = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.frombuffer(cells, np.uint8)
                sums[k] = np.minimum(sums[k] + cells, least) if k in sums else cells.astype(np.uint16)
        bits = [np.packbits(c >= least).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    return run


def possible(docs: DataFrame, least: int = LEAST) -> tuple[int, bytes]:
    """Width of the sketch and a bit for each of its counters that reaches least.

    A count-min sketch of document frequencies: every task counts its own documents, chunks of counters are
    added up as they stream in. Counters only grow by what falls into them, so a term with a counter below
    least occurs in fewer documents. What the driver gets are DEPTH * width bits, 1.5 MB at most.
    """
    width = LEAST_WIDTH
    while width < min(MOST_WIDTH, docs.count() * WIDTH_PER_DOC):
        width *= 2
    parts = docs.select("lang", "text").mapInArrow(_sketches(width, least), "chunk long, cells binary")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = parts.repartition(n, "chunk").mapInArrow(_merged(least), "chunk long, bits binary").collect()
    bits = bytearray(DEPTH * width // 8)
    for r in sums:
        bits[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = r["bits"]
    return width, bytes(bits)


def _counts(width: int, shared):
    """Occurrences and documents of each language, source and term that the sketch lets pass, summed in the
    worker until HELD rows are there."""

    def strings(data, starts, ends):
        size = ends - starts
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[data[take]])])

    def run(batches):
        allowed = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool).reshape(DEPTH, width)
        groups, held = {}, []

        def summed():
            g, h, n, d = (np.concatenate([x[k] for x in held]) for k in range(4))
            order, at = _distinct(g, h)
            sums = [np.add.reduceat(x[order], at) if len(at) else x for x in (n, d)]
            return g[order[at]], h[order[at]], *sums, pa.concat_arrays([x[4] for x in held]).take(pa.array(order[at]))

        def rows(g, _, n, d, names):
            keys = list(groups)
            pick = pa.array(g)
            langs, sources = (pa.array([k[i] for k in keys], pa.string()).take(pick) for i in (0, 1))
            return pa.RecordBatch.from_arrays([langs, sources, names, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            salts = _language_salts(batch.column(0))
            pairs = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            for data, begins, row in _slices(batch.column(1)):
                starts, ends, hashes, doc = _terms(data, begins)
                keys, fit = hashes ^ salts[row + doc], np.ones(len(hashes), bool)
                for k, cell in _cells(keys, width):
                    fit &= allowed[k, cell]
                starts, ends, hashes, doc = starts[fit], ends[fit], hashes[fit], doc[fit]
                # first by document, for the number of documents, then by group
                order, at = _distinct(doc, hashes)
                n = np.diff(np.append(at, len(order)))
                of, h = order[at], hashes[order[at]]
                g = group[row + doc[of]]
                order, at = _distinct(g, h)
                if len(at):
                    one = of[order[at]]
                    held.append((g[order[at]], h[order[at]], np.add.reduceat(n[order], at), np.diff(np.append(at, len(order))), strings(data, starts[one], ends[one])))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = [summed()]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*summed())

    return run


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, n (occurrences) and per, the occurrences by source, of every term in at least so many
    documents of the language. The sketch drops only terms that cannot have as many; exact counts decide."""
    width, bits = possible(docs, least)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    counts = docs.select("lang", "text", "source").mapInArrow(_counts(width, shared), "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "n", "per")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)), by long division in two steps of at most 10^5."""
    d = total + 2 * terms
    high = (n + 2) * 100_000
    return 1 + F.call_function("div", high, d) * 10_000 + F.call_function("div", F.pmod(high, d) * 10_000, d)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """How far each source's terms lie from every other source's of its language (part pair), and which of
    its terms stand out most against the language (part term): lang, source, part, item, value and rank.

    A term is a run of letters and non-ASCII characters, only A-Z lower-cased. A language keeps the terms in
    at least `least` of its documents; every (lang, source) that occurs, even without terms, gives each kept
    term a share, smoothed by two. A pair's value sums the distance over all kept terms: terms that neither
    source holds and terms that one holds are summed from counts of counts, and only terms that both hold
    are met pair by pair. Ranks go by value, ties by the item's bytes; terms stop at rank `top`.

    Null text, lang and source count as empty strings. Repeated rows count again. A language without a kept
    term has pairs of value 0 and no terms. A source alone in its language has no pairs. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "text", "source")])
    kept = written(frequent(read, least), "frequent-terms")
    each = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("per").alias("e")).select("lang", "term", "n_lang", "e.source", "e.n")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total_lang"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "terms", "total_lang"])
    zero = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = written(groups.withColumn("zero", zero), "groups")

    def side(x: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("total", "own", "terms", "zero")])

    a, b = side("a"), side("b")
    share = lambda n, x: _share(F.col(n), F.col(f"total_{x}"), F.col(f"terms_{x}"))
    # terms that a holds, against b's share of a term that it does not hold
    levels = each.groupBy("lang", F.col("source").alias("a"), "n").agg(F.count(F.lit(1)).alias("times"))
    levels = levels.join(a, ["lang", "a"]).withColumn("p", share("n", "a")).select("lang", "a", "p", "times")
    alone = levels.join(b.select("lang", "b", "zero_b"), "lang").where("a <> b")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(_apart(F.col("p"), F.col("zero_b")) * F.col("times")).alias("alone"))
    # terms that both hold: what they add beyond that
    both = kept.select("lang", "per", F.explode("per").alias("x")).select("lang", "x", F.explode(F.filter("per", lambda y: y["source"] > F.col("x.source"))).alias("y"))
    both = both.select("lang", F.col("x.source").alias("a"), F.col("x.n").alias("n_a"), F.col("y.source").alias("b"), F.col("y.n").alias("n_b"))
    both = both.join(a, ["lang", "a"]).join(b, ["lang", "b"]).withColumns({"p": share("n_a", "a"), "q": share("n_b", "b")})
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "zero_a", "zero_b"))
    both = both.groupBy("lang", "a", "b").agg(F.sum(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("both"))
    pairs = a.join(b, "lang").where("a < b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.join(alone, ["lang", "a", "b"], "left").join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("other")), ["lang", "a", "b"], "left")
    neither = (F.col("terms_a") - F.col("own_a") - F.col("own_b")) * _apart(p0, q0)
    value = F.when(F.col("terms_a") > 0, neither + sum(F.coalesce(c, F.lit(0)) for c in ("both", "alone", "other"))).otherwise(F.lit(0))
    pairs = written(pairs.select("lang", "a", "b", value.cast("long").alias("value")), "pairs")
    pairs = union_all([pairs.select("lang", F.col(s).alias("source"), F.col(i).alias("item"), "value") for s, i in (("a", "b"), ("b", "a"))])

    terms = each.join(groups.drop("own", "zero"), ["lang", "source"])
    p, q = (_share(F.col(n), F.col(t), F.col("terms")) for n, t in (("n", "total"), ("n_lang", "total_lang")))
    terms = terms.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    terms = terms.select("*", rank).where(F.col("rank") <= top)
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, x in (("pair", pairs.select("*", rank)), ("term", terms))]
    return union_all(parts)
