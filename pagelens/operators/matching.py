"""Matches between the elements of two versions of a page. Candidates meet within a page; pages are spread over tasks."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.functions import pandas_udf

from .boxes import greedy_pairs
from .rounds import dealt, folded, written
from .trees import ancestors


#: Letters are counted by their code point modulo so many.
LETTERS = 64


def _letters(texts: list[str]) -> np.ndarray:
    """How often each class of letters occurs in each text."""
    return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS) for t in texts]).astype(np.int32)


def _at_most(x: list[str], y: list[str]) -> np.ndarray:
    """A bound of the similarity of texts, pair by pair: what letters they share, in any order."""
    own = {t: k for k, t in enumerate(dict.fromkeys([*x, *y]))}
    counts, a, b = _letters(list(own)), np.array([own[t] for t in x]), np.array([own[t] for t in y])
    size = counts.sum(1)
    total = size[a] + size[b]
    return np.where(total > 0, 2.0 * np.minimum(counts[a], counts[b]).sum(1) / np.maximum(total, 1), 1.0)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff and Obershelp's similarity of two texts, 0 to 1; no built-in function has it, so batches go to difflib.

    Null where the letters alone tell that it is below least. Equal texts have 1, and of repeated pairs one is
    compared.
    """

    @pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out, known = [None] * len(x), {}
        there = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        for k in range(0, len(there), 1024):
            part = there[k : k + 1024]
            p, q = x.iloc[part].tolist(), y.iloc[part].tolist()
            for i, t, u, most in zip(part.tolist(), p, q, _at_most(p, q).tolist() if least else [1.0] * len(p)):
                if most >= least:
                    if (t, u) not in known:
                        known[t, u] = 1.0 if t == u else SequenceMatcher(None, t, u).ratio()
                    out[i] = known[t, u]
        return pd.Series(out, dtype=object)

    return of(a, b)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def scored_pairs(left: DataFrame, right: DataFrame, page: str, least: float = 0.8) -> DataFrame:
    """page, l, r and score of the pairs of one page whose texts are alike by at least least.

    left and right hold page, id, text, x and y (the box's middle). The score is the text's share 0.8 and
    the nearness' 0.2 (within 1000 pixels); the other way round where the left text is empty. Lengths that
    rule the similarity out are dropped before the texts are compared.
    """
    a = left.select(page, F.col("id").alias("l"), squeezed(F.col("text")).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.select(page, F.col("id").alias("r"), squeezed(F.col("text")).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    x = a.join(dealt(b), page)
    n, m = F.length("a"), F.length("b")
    x = x.where(2 * F.least(n, m) >= least * (n + m)).withColumn("alike", ratio(F.col("a"), F.col("b"), least)).where(F.col("alike") >= least)
    return x.select(page, "l", "r", _score(F.col("alike")).alias("score"))


def _score(alike: Column) -> Column:
    """The score of texts a and b with middles ax, ay, bx and by that are alike by so much, see scored_pairs()."""
    near = _near(("ax", "ay"), ("bx", "by"))
    return F.when(F.col("a") == "", alike * 0.2 + near * 0.8).otherwise(alike * 0.8 + near * 0.2)


def paired_texts(left: DataFrame, right: DataFrame, page: str, least: float = 0.8) -> DataFrame:
    """page, l and r of what greedy_pairs() takes of scored_pairs(), with few texts compared.

    Letters and places bound what a pair can score, and equal texts have that score. So a pair of equal texts
    ahead of all else that its ends can score is taken whatever the others are, and what shares an end with it
    need not be compared.
    """

    @pandas_udf("array<int>")
    def letters(texts: pd.Series) -> pd.Series:
        there = texts.notna().to_numpy()
        counts = iter(_letters(texts[there].tolist()) if there.any() else ())
        return pd.Series([next(counts) if t else None for t in there], dtype=object)

    def side(d: DataFrame, i: str, t: str) -> DataFrame:
        d = d.select(page, F.col("id").alias(i), squeezed(F.col("text")).alias(t), F.col("x").alias(f"{t}x"), F.col("y").alias(f"{t}y"))
        return written(d.withColumn(f"{t}n", letters(t)))[0]

    a, b = side(left, "l", "a"), side(right, "r", "b")
    n, m = F.length("a"), F.length("b")
    x = a.join(b, page).where(2 * F.least(n, m) >= least * (n + m))
    shared = F.aggregate(F.zip_with("an", "bn", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    x = x.withColumn("most", F.when(n + m > 0, 2.0 * shared / (n + m)).otherwise(1.0)).where(F.col("most") >= least)
    x, _ = written(x.select(page, "l", "r", (F.col("a") == F.col("b")).alias("same"), F.coalesce(_score(F.col("most")), F.lit(float("nan"))).alias("top")))

    def ahead(end: str) -> Column:
        down = W.partitionBy(page, end).orderBy(F.desc("top"))  # NaN first, which settles nothing
        return (F.row_number().over(down) == 1) & F.coalesce(F.lead("top").over(down) < F.col("top"), F.lit(True))

    sure = x.withColumns({"of_l": ahead("l"), "of_r": ahead("r")}).where("same AND of_l AND of_r AND NOT isnan(top)")
    sure, _ = written(sure.select(page, "l", "r"))
    rest = x.select(page, "l", "r").join(sure.select(page, "l"), [page, "l"], "left_anti").join(sure.select(page, "r"), [page, "r"], "left_anti")
    rest = rest.join(a.drop("an"), [page, "l"]).join(b.drop("bn"), [page, "r"]).withColumn("alike", ratio(F.col("a"), F.col("b"), least)).where(F.col("alike") >= least)
    found = greedy_pairs(rest.select(page, "l", "r", _score(F.col("alike")).alias("score")), page, "l", "r", "score")
    return sure.unionByName(found.select(page, "l", "r"))


def merged_groups(pairs: DataFrame, page: str) -> DataFrame:
    """page, grp (0, 1, ...), lefts and rights: pairs (page, place, lefts, rights) in order of place, each added to
    the first group that holds one of its lefts, else one of its rights, else a group of its own.

    One pass, as in the reports this serves: groups that a later pair would connect stay apart. For what is
    connected see connected_groups(). A page's pairs are folded as one group.
    """
    kind = pairs.schema[page].dataType.simpleString()

    def fold(rows: list) -> list[tuple]:
        groups: list[tuple[set, set]] = []
        first = {}, {}  # of an item on the left, on the right: the first group that holds it
        for r in rows:
            pair = set(r.lefts), set(r.rights)
            home = next((min(found) for found in ([own[i] for i in items if i in own] for own, items in zip(first, pair)) if found), None)
            if home is None:
                home = len(groups)
                groups.append((set(), set()))
            for own, held, items in zip(first, groups[home], pair):
                held |= items
                for i in items:
                    own[i] = min(own.get(i, home), home)
        return [(getattr(rows[0], page), k, sorted(a), sorted(b)) for k, (a, b) in enumerate(groups)]

    return folded(pairs.select(page, "place", "lefts", "rights"), page, ["place"], fold, f"{page} {kind}, grp int, lefts array<string>, rights array<string>")


def given_or_below(given: DataFrame, nodes: DataFrame, page: str) -> DataFrame:
    """page, section and id: of every given target (page, section, target) the node of that id; where there is none,
    all nodes below it (ids are paths, parts joined by __)."""
    exact = given.join(nodes.select(page, F.col("id").alias("target")).distinct(), [page, "target"]).select(page, "section", F.col("target").alias("id"))
    none = given.join(nodes.select(page, F.col("id").alias("target")), [page, "target"], "left_anti")
    below = nodes.select(page, "id", F.explode(ancestors(F.col("id"))).alias("target")).join(none, [page, "target"])
    return exact.unionByName(below.select(page, "section", "id")).distinct()


def best_by_vector(left: DataFrame, right: DataFrame, page: str, id: str, vector: str) -> DataFrame:
    """page, id and best: of each left vector the right one of its page with the highest cosine, the least id of
    equals. All pairs of a page meet; pages are small."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    a = left.select(page, id, F.col(vector).cast("array<double>").alias("e"))
    b = right.select(page, F.col(id).alias("other"), F.col(vector).cast("array<double>").alias("f"))
    cos = dot("e", "f") / F.sqrt(dot("e", "e") * dot("f", "f"))
    return a.join(b, page).groupBy(page, id).agg(F.max_by("other", F.struct(F.round(cos, 12), -F.col("other"))).alias("best"))


def _near(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Nearness of two middles, 1 to 0 at 1000 pixels; of each the columns of x and y."""
    return 1 - F.least(F.hypot(F.col(a[0]) - F.col(b[0]), F.col(a[1]) - F.col(b[1])) / 1000, F.lit(1.0))


def _pairs_of_neighbours(rows: list) -> list[tuple]:
    """Rows of one page, by top, left and id, two by two: first those of one parent, then those that stand close below or beside each other."""
    used, out = set(), []

    def close(a, b) -> bool:
        below = b.top - (a.top + a.h) < 2 and abs(a.left - b.left) < 10
        return below or (b.left - (a.left + a.w) < 2 and abs(a.top - b.top) < 10)

    for fits in (lambda a, b: a.parent == b.parent, close):
        for a in rows:
            b = None if a.id in used else next((b for b in rows if b.id != a.id and b.id not in used and fits(a, b)), None)
            if b is not None:
                used.update((a.id, b.id))
                out.append((a, b))
    return out


def held_texts(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """page, lefts and rights: a leaf with those of the other side whose texts it holds, each text used up once.

    left and right hold page, id, text, left, top, and x and y (the middle). Pairs of a page meet by a join;
    as each choice takes text away from later ones, a page's pairs are folded in order of score.
    """
    kind, item = (left.schema[c].dataType.simpleString() for c in (page, "id"))
    low = lambda d, i, t, s: d.select(page, F.col("id").alias(i), F.lower(squeezed(F.col("text"))).alias(t), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), F.struct("top", "left").alias(f"{s}at")).where(F.col(t) != "")
    c = low(left, "l", "lt", "a").join(dealt(low(right, "r", "rt", "b")), page).where((F.col("lt") != F.col("rt")) & (F.contains("lt", F.col("rt")) | F.contains("rt", F.col("lt"))))
    share = F.least(F.length("lt"), F.length("rt")) / F.greatest(F.length("lt"), F.length("rt"))
    c = c.withColumn("score", share * 0.7 + _near(("ax", "ay"), ("bx", "by")) * 0.3)

    def consume(found: list) -> list[tuple]:
        groups: dict[tuple[str, str], list] = {}  # (side, holder): what it holds, with places
        text_left, held = {}, {"l": set(), "r": set()}
        for r in found:
            side, other = ("l", "r") if r.rt in r.lt else ("r", "l")
            holder, part = getattr(r, side), getattr(r, other)
            if part in held[other] or (holder in held[side] and (side, holder) not in groups):
                continue
            whole, piece = text_left.get((side, holder), getattr(r, f"{side}t")), getattr(r, f"{other}t")
            if piece in whole:
                groups.setdefault((side, holder), []).append((r.bat if side == "l" else r.aat, part))
                held[other].add(part)
                held[side].add(holder)
                text_left[side, holder] = whole.replace(piece, "", 1).strip()
        rows = [([k], [p for _, p in sorted(v, key=lambda e: (e[0]["top"], e[0]["left"], e[1]))]) for (_, k), v in groups.items()]
        at = getattr(found[0], page)
        return [(at, x, y) if s == "l" else (at, y, x) for (s, _), (x, y) in zip(groups, rows)]

    c = c.select(page, "l", "r", "lt", "rt", F.coalesce("score", F.lit(float("-inf"))).alias("score"), "aat", "bat")
    return folded(c, page, [F.desc("score"), "l", "r"], consume, f"{page} {kind}, lefts array<{item}>, rights array<{item}>")


def text_matches(left: DataFrame, right: DataFrame, page: str, least: float = 0.9) -> DataFrame:
    """page, step (1 to 3), lefts and rights: the text leaves of two versions of a page that belong together.

    left and right hold page, id, parent, text, left, top, w and h. Step 1: one to one, best scored_pairs()
    first. Step 2, of the rest: a left leaf with two neighbouring right ones whose texts joined are alike.
    Step 3: a leaf with those of the other side whose texts it holds, each text used up once. Candidates are
    made and scored by joins within pages; choices that depend on those before are folds over one page's.
    """
    middle = lambda d: d.withColumns({"x": F.col("left") + F.col("w") / 2, "y": F.col("top") + F.col("h") / 2})
    a, b = middle(left), middle(right)
    kind = left.schema[page].dataType.simpleString()
    one, _ = written(greedy_pairs(scored_pairs(a, b, page, least), page, "l", "r", "score"))
    rest = lambda d, gone, c: d.join(gone.select(page, F.col(c).alias("id")), [page, "id"], "left_anti")
    a2, b2 = rest(a, one, "l"), rest(b, one, "r")

    def pair(rows: list) -> list[tuple]:
        box = lambda g, h: ((min(g.left, h.left) + max(g.left + g.w, h.left + h.w)) / 2, (min(g.top, h.top) + max(g.top + g.h, h.top + h.h)) / 2)
        return [(getattr(rows[0], page), g.id, h.id, g.text + h.text, *box(g, h)) for g, h in _pairs_of_neighbours(rows)]

    sides = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("left", "top", "w", "h")]  # what is not known is close to nothing
    two = folded(b2.select(page, "id", "parent", F.coalesce("text", F.lit("")).alias("text"), *sides), page, ["top", "left", "id"], pair, f"{page} {kind}, r1 string, r2 string, both string, bx double, by double")
    c = a2.select(page, F.col("id").alias("l"), "text", F.col("x").alias("ax"), F.col("y").alias("ay")).join(dealt(two), page)
    n, m = F.length("text"), F.length("both")
    c = c.where(2 * F.least(n, m) >= least * (n + m)).withColumn("alike", ratio(F.col("text"), F.col("both"), least)).where(F.col("alike") >= least)
    c = c.select(page, "l", F.concat_ws("\n", "r1", "r2").alias("r"), (F.col("alike") * 0.8 + _near(("ax", "ay"), ("bx", "by")) * 0.2).alias("score"))
    two = written(greedy_pairs(c, page, "l", "r", "score"))[0].withColumn("rights", F.split("r", "\n"))
    a3, b3 = rest(a2, two, "l"), rest(b2, two.select(page, F.explode("rights").alias("r")), "r")
    three = held_texts(a3, b3, page)
    out = one.select(page, F.lit(1).alias("step"), F.array("l").alias("lefts"), F.array("r").alias("rights"))
    out = out.unionByName(two.select(page, F.lit(2).alias("step"), F.array("l").alias("lefts"), "rights"))
    return out.unionByName(three.select(page, F.lit(3).alias("step"), "lefts", "rights"))


class _Middles:
    """Points of one page in squares, for the nearest one to a place."""

    def __init__(self, side: float = 200.0):
        self.side, self.squares, self.n = side, {}, 0

    def square(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.side), math.floor(y / self.side)

    def add(self, x: float, y: float, payload) -> None:
        """Of equally near points the one added first counts."""
        self.squares.setdefault(self.square(x, y), []).append((x, y, self.n, payload))
        self.n += 1

    def drop(self, x: float, y: float, payload) -> None:
        at = self.square(x, y)
        self.squares[at] = [e for e in self.squares[at] if e[3] != payload]
        if not self.squares[at]:
            del self.squares[at]

    def nearest(self, x: float, y: float, within: float = math.inf):
        """Distance, number and payload of the nearest point less than within away, or None."""
        at, best = self.square(x, y), None
        known = sorted((max(abs(c - at[0]), abs(r - at[1])), (c, r)) for c, r in self.squares) if len(self.squares) < 64 else None
        rings = known if known is not None else self._rings(at)
        for ring, cell in rings:
            if (ring - 1) * self.side > min(within, best[0] if best else math.inf):
                break
            for px, py, n, payload in self.squares.get(cell, ()):
                d = math.hypot(x - px, y - py)
                if d < within and (best is None or (d, n) < best[:2]):
                    best = (d, n, payload)
        return best

    def _rings(self, at):
        """Squares by their distance from one, as far as there are points."""
        far = max(max(abs(c - at[0]), abs(r - at[1])) for c, r in self.squares)
        for ring in range(far + 1):
            if (2 * ring + 1) ** 2 > 4 * len(self.squares):  # the rest is quicker looked up by what is there
                rest = ((max(abs(c - at[0]), abs(r - at[1])), (c, r)) for c, r in self.squares)
                yield from sorted(e for e in rest if e[0] >= ring)
                return
            for c in range(at[0] - ring, at[0] + ring + 1):
                for r in range(at[1] - ring, at[1] + ring + 1):
                    if max(abs(c - at[0]), abs(r - at[1])) == ring:
                        yield ring, (c, r)


def _projected(rows, within: float) -> list[tuple[int, int]]:
    """Places of left and right images of one page. Each left image in order is carried over by the nearest anchor
    and takes the nearest free right image; both are an anchor for those that follow."""
    anchors, free, out = _Middles(), _Middles(), []
    for r in rows:
        if r.kind == "anchor":
            anchors.add(r.x, r.y, (r.x, r.y, r.x2, r.y2))
        elif r.kind == "right":
            free.add(r.x, r.y, (r.place, r.x, r.y))
    for r in rows:
        near = anchors.nearest(r.x, r.y) if r.kind == "left" and anchors.squares else None
        if near is None:
            continue
        ax, ay, bx, by = near[2]
        hit = free.nearest(bx + r.x - ax, by + r.y - ay, within)
        if hit:
            place, x, y = hit[2]
            free.drop(x, y, hit[2])
            anchors.add(r.x, r.y, (r.x, r.y, x, y))
            out.append((r.place, place))
    return out


def image_matches(left: DataFrame, right: DataFrame, anchors: DataFrame, page: str, least: float = 0.9, within: float = 200.0) -> DataFrame:
    """page, step (1 to 4), lefts and rights (places): the image leaves of two versions of a page that belong together.

    left and right hold page, place (the order of leaves), text, left, top, w and h; anchors hold page,
    place, and the middles x, y (left) and x2, y2 (right) of text leaves that are matched. Step 1: one to one
    by text (alike by least) and nearness. Step 2: an image with those of the other side whose texts it holds.
    Step 3: what is left, in order of place, goes by the nearest anchor (text first, then images of step 1,
    then what this step matched before): its vector from the anchor is carried to the other side, and the
    nearest free image less than `within` pixels from there is taken. Step 4, on pages without any text
    anchor: nearest pairs first, however far.

    Step 3 depends on its own choices, so a page's middles are one fold; they lie in squares, and neither
    anchors nor images are paired. A null page matches nothing; null boxes are not matched.
    """
    sized = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    middle = lambda d: d.where(sized & F.col(page).isNotNull()).withColumns({"id": F.col("place"), "x": F.col("left") + F.col("w") / 2, "y": F.col("top") + F.col("h") / 2})
    a, b = middle(left), middle(right)
    kind = left.schema[page].dataType.simpleString()
    worded = lambda d: d.where(squeezed(F.col("text")) != "")
    rest = lambda d, gone, c: d.join(gone.select(page, F.explode(c).alias("id")), [page, "id"], "left_anti")
    steps = [written(greedy_pairs(scored_pairs(worded(a), worded(b), page, least), page, "l", "r", "score"))[0].select(page, F.array("l").alias("lefts"), F.array("r").alias("rights"))]
    one = steps[0].select(page, F.col("lefts")[0].alias("l"), F.col("rights")[0].alias("r"))
    a, b = rest(a, steps[0], "lefts"), rest(b, steps[0], "rights")
    steps.append(written(held_texts(a, b, page))[0])
    a, b = rest(a, steps[1], "lefts"), rest(b, steps[1], "rights")
    spot = lambda d, name, order, *more: d.select(page, F.lit(name).alias("kind"), F.lit(order).alias("turn"), F.col("place").cast("long").alias("place"), *[F.col(c).cast("double").alias(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
    where = lambda d, i, x, y: dealt(middle(d).select(page, F.col("place").alias(i), F.col("x").alias(x), F.col("y").alias(y)))
    known = one.join(where(left, "l", "x", "y"), [page, "l"]).join(where(right, "r", "x2", "y2"), [page, "r"]).withColumn("place", F.col("l"))
    rows = spot(anchors, "anchor", 0).unionByName(spot(known, "anchor", 1)).unionByName(spot(a, "left", 2)).unionByName(spot(b, "right", 3))

    def fold(items: list) -> list[tuple]:
        return [(getattr(items[0], page), *pair) for pair in _projected(items, within)]

    number = left.schema["place"].dataType.simpleString()
    three, _ = written(folded(rows, page, ["turn", "place"], fold, f"{page} {kind}, l {number}, r {number}"))
    steps.append(three.select(page, F.array("l").alias("lefts"), F.array("r").alias("rights")))
    bare = lambda d, gone, c: rest(d, gone, c).join(anchors.select(page), page, "left_anti").select(page, F.col("id").alias(c[0]), F.col("x").alias(f"{c[0]}x"), F.col("y").alias(f"{c[0]}y"))
    far = bare(a, steps[2], "lefts").join(dealt(bare(b, steps[2], "rights")), page)
    four = greedy_pairs(far.withColumn("score", -F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))), page, "l", "r", "score")
    steps.append(four.select(page, F.array("l").alias("lefts"), F.array("r").alias("rights")))
    out = [d.select(page, F.lit(k).alias("step"), "lefts", "rights") for k, d in enumerate(steps, 1)]
    return reduce(DataFrame.unionByName, out)
