"""MinHash near-duplicates: one-permutation signatures, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import components, written
from ._worker import enter, release
from ._words import OnePermutation, set_key, shingle_set, texts

WORDS = 5
THRESHOLD = 75  # per cent of the union
BINS, ROWS = 128, 4  # 32 bands of 4: a pair at the threshold meets in none of them with a chance of 5e-6
#: Bits of BINS in which sketches of a candidate pair may differ; a pair at the threshold differs in 16 +- 3.7.
SKETCH_BITS = 38
#: Sets with fewer shingles fill too few bins for a sketch to tell; their pairs go to the full check.
SKETCH_FROM = 256
#: Members and shingles of a block; a task that compares the members of a large bucket meets two blocks.
BLOCK, SHINGLES = 512, 1 << 19
#: Rows with whole sets that are taken out of a batch at a time.
SLICE = 500


def _signatures(batches):
    enter("minhash")
    minwise = OnePermutation(BINS, ROWS)
    for batch in batches:
        ids, cols = batch.column(0), [[], [], [], [], []]
        for data in texts(batch.column(1)):
            s = shingle_set(data, WORDS)
            cols[0].append(len(s))
            if not len(s):
                row = (None, None, None, None)
            else:
                g = minwise.signature(s)
                k = minwise.sketch(g)
                row = (set_key(s), minwise.bands(g), int(k[0]), int(k[1]))
            for c, v in zip(cols[1:], row):
                c.append(v)
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "n_shingles", "cls", "bands", "s0", "s1"])


def _matching(batches):
    enter("minhash")
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
        sets = [shingle_set(t, WORDS) for t in texts(batch.column("text"))]
        ok = pa.array([set_key(s) == c for s, c in zip(sets, batch.column("cls").to_pylist())], pa.bool_())
        found = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])
        yield found.filter(ok)


def _verified(batches):
    enter("minhash")
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
        ok = []
        for x, y in zip(batch.column("hashes").to_pylist(), batch.column("hashes_b").to_pylist()):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= THRESHOLD * (len(a) + len(b) - both))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), "hashes"), "a").select("a", "b", "hashes", "hashes_b")
    return written(x.mapInArrow(_verified, "a long, b long"), "links")


def _possible(a: str, b: str):
    """Whether sizes and sketches of two structs of node, n, s0 and s1 don't rule a link out."""
    least, most = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    apart = [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s0", "s1")]
    return ((apart[0] + apart[1] <= SKETCH_BITS) | (least < SKETCH_FROM)) & (100 * least >= THRESHOLD * most)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The nodes a < b of two structs, where they differ and a link is possible."""
    x = rows.where((F.col(f"{a}.node") != F.col(f"{b}.node")) & _possible(a, b))
    return x.select(F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b"))


def _split(met: DataFrame, roots: DataFrame) -> DataFrame:
    """band, me and root of the members of those buckets that hold more than one component."""
    x = met.select("band", "me", F.col("me.node").alias("node")).join(roots, "node", "left").select("band", "me", F.coalesce("root", "node").alias("root"))
    open_ = x.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    return written(x.join(open_, "band"), "split")


def _star_pairs(split: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with its bucket's best linked member of another component: the hub, and
    for the hub's own component the best linked one outside it."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    x = split.withColumn("node", F.col("me.node")).join(degree, "node", "left")
    x = x.select("band", "me", "root", F.struct(F.coalesce("d", F.lit(0)).alias("d"), -F.col("node"), "me", "root").alias("best"))
    of_root = x.groupBy("band", "root").agg(F.max("best").alias("best"))
    hubs = of_root.groupBy("band").agg(F.max("best").alias("h"))
    other = of_root.join(hubs, "band").where(F.col("root") != F.col("h.root")).groupBy("band").agg(F.max("best").alias("o"), F.first("h").alias("h"))
    x = x.select("band", "me", "root").join(other, "band")
    x = x.withColumn("to", F.when(F.col("root") == F.col("h.root"), F.col("o.me")).otherwise(F.col("h.me")))
    return _pairs(x, "me", "to").distinct()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common: frequent ones by a product of indicator
    matrices, a slice of columns at a time, the others pair by pair."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    times = np.diff(np.append(starts, len(hashes)))
    column = np.repeat(np.arange(len(starts)), times)
    out = np.zeros((m, m), np.float32)
    rare = times[column] <= 8
    c, o = column[rare], owner[rare]
    for gap in range(1, 8):
        same = np.flatnonzero(c[gap:] == c[:-gap])
        out += np.bincount(o[same] * m + o[same + gap], minlength=m * m).reshape(m, m)
    out += out.T
    frequent = np.flatnonzero(times > 8)
    for at in range(0, len(frequent), 1024):
        some = np.zeros(len(times), np.int64) - 1
        part = frequent[at : at + 1024]
        some[part] = np.arange(len(part))
        here = some[column]
        x = np.zeros((m, len(part)), np.float32)
        x[owner[here >= 0], here[here >= 0]] = 1
        out += x @ x.T
    return out


def _joined(rows: list[tuple]) -> list[tuple[int, int]]:
    """Edges (a, b) between roots that the links of one pair of blocks connect; rows: root, side (0 or 1 of
    two blocks, 2 of a block that meets itself) and hashes."""
    root = np.array([r[0] for r in rows])
    side = np.array([r[1] for r in rows])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets], np.float32)
    if len(rows) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        linked = root[0] != root[1] and 100 * both >= THRESHOLD * (n.sum() - both)
        return [(int(root.min()), int(root.max()))] if linked else []
    both = _shared(sets)
    hit = (100 * both >= THRESHOLD * (n[:, None] + n[None] - both)) & (root[:, None] != root[None]) & ((side[:, None] != side[None]) | (side[0] == 2))
    i, j = np.nonzero(np.triu(hit, 1))
    names, label = np.unique(root, return_inverse=True)
    i, j, label = label[i], label[j], np.arange(len(names))
    while True:  # the least root of what is connected
        new, low = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label < np.arange(len(names)))
    return list(zip(names[label[k]].tolist(), names[k].tolist()))


def _compared(batches):
    """_joined() of each run of rows with one key."""
    enter("minhash")
    key, rows = None, []
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):
        out = []
        for *now, root, side, hashes in zip(*[batch.column(c).to_pylist() for c in ("band", "l", "r", "root", "side", "hashes")]):
            if now != key:
                out += _joined(rows) if len(rows) > 1 else []
                key, rows = now, []
            rows.append((root, side, hashes))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    out = _joined(rows) if len(rows) > 1 else []
    rows.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _block_links(split: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) of roots between which any two members of one bucket are linked.

    Buckets of the same members count once. A bucket's members are dealt to blocks of bounded numbers of
    members and shingles, and each two blocks meet in one task. A component that fills blocks of its own
    is not compared with itself; the other components share blocks.
    """
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / SHINGLES)).cast("long")
    hashed = F.sum(F.xxhash64("me.node").cast("decimal(38,0)"))
    of_root = split.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("me.n").alias("n"), hashed.alias("x"))
    of_root = of_root.withColumn("k", blocks(F.col("m"), F.col("n")))
    shared = lambda c: F.sum(F.when(F.col("k") == 1, F.col(c)).otherwise(0))
    own = F.collect_list(F.when(F.col("k") > 1, F.struct(F.col("root").alias("own"), "k")))  # a row for BLOCK members or more
    of_band = of_root.groupBy("band").agg(F.sum("x").alias("x"), F.sum("m").alias("m"), blocks(shared("m"), shared("n")).alias("k"), own.alias("own"))
    of_band = of_band.groupBy("x", "m").agg(F.min_by(F.struct("band", "k", "own"), "band").alias("b")).select("b.*")
    x = split.join(of_band, "band")
    mine = F.get(F.filter("own", lambda o: o["own"] == F.col("root")), F.lit(0))
    block = F.struct(F.coalesce(mine["own"], F.lit(-1)).alias("own"), F.pmod(F.xxhash64("me.node"), F.coalesce(mine["k"], F.col("k"))).alias("j"))
    numbers = lambda own, k: F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.struct(own.alias("own"), j.alias("j")))
    every = F.concat(F.when(F.col("k") > 0, numbers(F.lit(-1).cast("long"), F.col("k"))).otherwise(F.array()), F.flatten(F.transform("own", lambda o: numbers(o["own"], o["k"]))))
    x = x.select("band", F.col("me.node").alias("node"), "root", block.alias("block"), every.alias("every"))
    x = x.withColumn("o", F.explode(F.filter("every", lambda o: (o["own"] == -1) | (o["own"] != F.col("block.own")))))
    side = F.when(F.col("block") == F.col("o"), 2).when(F.col("block") < F.col("o"), 0).otherwise(1)
    name = lambda c: F.concat_ws(":", c["own"], c["j"])
    x = x.select("band", name(F.least("block", "o")).alias("l"), name(F.greatest("block", "o")).alias("r"), "node", "root", side.alias("side")).join(sets, "node")
    x = x.repartition("band", "l", "r").sortWithinPartitions("band", "l", "r").select("band", "l", "r", "root", "side", "hashes")
    return written(x.mapInArrow(_compared, "a long, b long"), "joined")


def _keyed(batches):
    for batch in batches:
        rows = batch.column("row")
        sets = [shingle_set(t, WORDS) for t in texts(batch.column("text"))]
        keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([rows, batch.column("id"), keys], names=["row", "id", "cls"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Rows with equal shingle sets form a class, so copies cost one row each. Classes meet in buckets of
    four signature bins. Candidate edges are stars: a class is compared with that hub, of the least and
    greatest classes of its buckets, which it meets most often; then, where a bucket holds more than one
    component, its members with its best linked member of another one. Sizes and sketches rule edges out; the others are checked on full sets. Buckets that still hold
    several components are compared block by block on full sets, which gives at most one edge for each
    component: so no two classes of a bucket stay apart that are linked.

    Words are maximal runs without ASCII white space, A-Z as a-z. A text of fewer than five words is one
    shingle; null, empty and blank texts have none, link with nothing and are kept. component_id is the
    least doc_id reachable (null ids come last; null if there is no other). Rows with one doc_id all get
    that id's result if their texts agree, else each its own. An empty table gives an empty result; other
    columns are not read.
    """
    return _verdicts(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls, component_id and own of every row; own: the row has the class and the id that
    stand for its component, which are the least id and, of that id's classes, the least. Rows without
    words have no class and are their own."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sigs = written(docs.mapInArrow(_signatures, f"doc_id {id_type}, n_shingles long, cls binary, bands array<long>, s0 long, s1 long"), "sigs")
    found = sigs.where("n_shingles > 0")
    classes = found.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("bands", "s0", "s1")])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    me = F.struct("node", "n", "s0", "s1").alias("me")
    bands = classes.select(me, F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("me").alias("lo"), F.max("me").alias("hi")).where("lo.node < hi.node")
    members = written(bands.join(hubs, "band"), "members")
    met = members.select("me", F.explode(F.array("lo", "hi")).alias("hub")).where(F.col("me.node") != F.col("hub.node"))
    met = met.where(_possible("me", "hub")).groupBy(F.col("me.node").alias("a"), F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    first = met.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    first = written(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")

    need = members.select(F.col("me.node").alias("node")).distinct().join(classes.select("node", "rep", "cls"), "node")
    sets = docs.join(need, docs["doc_id"].eqNullSafe(need["rep"])).select("node", "cls", "text")
    sets = sets.mapInArrow(_matching, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = written(sets, "sets")
    links = _links(first, sets)
    roots = components(links)
    split = _split(members, roots)
    if split.take(1):
        more = _links(_star_pairs(split, links).join(first, ["a", "b"], "left_anti"), sets)
        if more.take(1):
            roots = components(links.union(more))
            split = _split(split, roots)
        joined = _block_links(split, sets)
        if joined.take(1):
            joined = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
            # a root that no link was found for before stands for itself
            nodes = roots.unionByName(joined.select(F.col("root").alias("node"), "root")).distinct()
            roots = written(nodes.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    of_class = classes.join(roots, "node", "left").select("cls", "rep", F.coalesce("root", "node").alias("root"))
    first_class = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cls"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"), first_class["cls"].alias("least"))
    ids = of_class.join(least, "root").select("cls", "component_id", (F.col("cls") == F.col("least")).alias("stands"))
    out = sigs.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = (F.col("n_shingles") == 0) | (F.col("stands") & F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "n_shingles", "cls", component.alias("component_id"), own.alias("own"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group; all columns stay, whatever their names.

    Of several rows with the id and the shingle set that stay, one remains; rows that share an id, or have
    none, but are no near duplicates all stay. Rows without words link with nothing and all stay, repeated
    ones too.
    """
    of = written(_verdicts(docs), "verdicts")
    n = of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    n = written(n.where("own"), "kept")
    x = docs.select(F.struct(*docs.columns).alias("row")).withColumn("id", F.col("row.doc_id"))
    x = x.join(n, F.col("id").eqNullSafe(F.col("doc_id"))).select("row", "id", "n")
    once, many = x.where("n = 1").select("row"), x.where("n > 1").select("row", "id", F.col("row.text").alias("text"))
    keyed = many.mapInArrow(_keyed, many.select("row", "id", F.lit(None).cast("binary").alias("cls")).schema)
    stays = of.where("own and n_shingles > 0").join(n.where("n > 1").select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    stays = stays.select(F.col("doc_id").alias("stay"), F.col("cls").alias("key")).distinct()
    held = keyed.join(stays, (F.col("cls") == F.col("key")) & F.col("id").eqNullSafe(F.col("stay")), "left_semi")
    held = held.dropDuplicates(["id", "cls"]).unionByName(keyed.where("cls is null"))
    return once.unionByName(held.select("row")).select("row.*")
