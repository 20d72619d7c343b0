"""Matches between two versions of small pages."""

import math
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from pagelens.operators import matching
from pagelens.plans import matches

LEAF = "page int, id string, parent string, text string, left double, top double, w double, h double"


def test_text_matches(spark):
    leaf = lambda i, text, x, y, parent="p": (1, i, parent, text, float(x), float(y), 50.0, 10.0)
    left = [leaf("a", "Exactly the same", 0, 0), leaf("b", "first half second half", 0, 100), leaf("c", "one two three", 0, 200), leaf("d", "short", 0, 300), leaf("e", "apart", 0, 400)]
    right = [leaf("A", "Exactly  the same", 5, 5), leaf("B1", "first half ", 0, 100, "q"), leaf("B2", "second half", 60, 100, "q"), leaf("C1", "one", 0, 200, "r"), leaf("C2", "three", 60, 200, "s"), leaf("D", "a short text", 0, 700, "t")]
    out = matching.text_matches(spark.createDataFrame(left, LEAF), spark.createDataFrame(right, LEAF), "page").collect()
    assert sorted((r["step"], r["lefts"], r["rights"]) for r in out) == [(1, ["a"], ["A"]), (2, ["b"], ["B1", "B2"]), (3, ["c"], ["C1", "C2"]), (3, ["d"], ["D"])]
    none = spark.createDataFrame([], LEAF)
    assert matching.text_matches(none, none, "page").count() == 0


def test_merged_groups(spark):
    pairs = [(1, 0, ["1"], ["A"]), (1, 1, ["1", "2"], ["B"]), (1, 2, ["3"], ["B"]), (1, 3, ["4"], ["D"])]
    df = spark.createDataFrame(pairs, "page int, place int, lefts array<string>, rights array<string>")
    out = [(r["lefts"], r["rights"]) for r in matching.merged_groups(df, "page").orderBy("grp").collect()]
    assert out == [(["1", "2", "3"], ["A", "B"]), (["4"], ["D"])]


IMAGE = "page int, place long, text string, left double, top double, w double, h double"


def brute_images(left, right, anchors, least=0.9, within=200.0):
    """One page by plain lists: rows are (place, text, left, top, w, h), anchors (x, y, x2, y2) in order."""
    mid = lambda r: (r[2] + r[4] / 2, r[3] + r[5] / 2)
    far = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    near = lambda p, q: 1 - min(far(p, q) / 1000, 1)
    norm = lambda t: re.sub(r"\s+", " ", t).strip()
    one, taken = {}, set()
    scored = [(SequenceMatcher(None, norm(a[1]), norm(b[1])).ratio(), a, b) for a in left for b in right if norm(a[1]) and norm(b[1])]
    for s, a, b in sorted(((s * 0.8 + near(mid(a), mid(b)) * 0.2, a, b) for s, a, b in scored if s >= least), key=lambda e: (-e[0], e[1][0], e[2][0])):
        if a[0] not in one and b[0] not in taken:
            one[a[0]] = b[0]
            taken.add(b[0])
    out = [(1, [a], [b]) for a, b in one.items()]
    low = lambda r: norm(r[1]).lower()
    rest_l, rest_r = [a for a in left if a[0] not in one], [b for b in right if b[0] not in taken]
    pairs = [(min(len(low(a)), len(low(b))) / max(len(low(a)), len(low(b))) * 0.7 + near(mid(a), mid(b)) * 0.3, a, b) for a in rest_l for b in rest_r if low(a) and low(b) and low(a) != low(b) and (low(a) in low(b) or low(b) in low(a))]
    groups, remains, used = {}, {}, {"l": set(), "r": set()}
    for _, a, b in sorted(pairs, key=lambda e: (-e[0], e[1][0], e[2][0])):
        side, holder, other, part = ("l", a, "r", b) if low(b) in low(a) else ("r", b, "l", a)
        key = (side, holder[0])
        if part[0] in used[other] or (holder[0] in used[side] and key not in groups) or low(part) not in remains.get(key, low(holder)):
            continue
        groups.setdefault(key, []).append(part)
        used[other].add(part[0])
        used[side].add(holder[0])
        remains[key] = remains.get(key, low(holder)).replace(low(part), "", 1).strip()
    for (side, holder), parts in groups.items():
        parts = [p[0] for p in sorted(parts, key=lambda p: (p[3], p[2], p[0]))]
        out.append((2, [holder], parts) if side == "l" else (2, parts, [holder]))
    gone, taken = set(one) | used["l"], taken | used["r"]
    where = {r[0]: mid(r) for r in right}
    known = [(p[:2], p[2:]) for p in anchors] + [(mid(a), where[one[a[0]]]) for a in left if a[0] in one]
    for a in left:
        free = [b for b in right if b[0] not in taken]
        if a[0] in gone or not known or not free:
            continue
        here, there = min(known, key=lambda k: far(mid(a), k[0]))
        at = (there[0] + mid(a)[0] - here[0], there[1] + mid(a)[1] - here[1])
        b = min(free, key=lambda b: far(at, mid(b)))
        if far(at, mid(b)) < within:
            out.append((3, [a[0]], [b[0]]))
            gone.add(a[0])
            taken.add(b[0])
            known.append((mid(a), mid(b)))
    if not anchors:
        for _, a, b in sorted((far(mid(a), mid(b)), a[0], b[0]) for a in left for b in right):
            if a not in gone and b not in taken:
                out.append((4, [a], [b]))
                gone.add(a)
                taken.add(b)
    return sorted(out)


def by_page(rows, *columns):
    out = defaultdict(list)
    for r in rows:
        out[r["page"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("texts,anchored", [(True, True), (False, True), (True, False), (False, False)])
def test_image_matches(spark, texts, anchored):
    """A page of 200 leaves a side against plain lists, and a page beside it whose images are out of reach."""
    rng = random.Random(7)
    word = lambda: rng.choice(["", "logo", "team at work", "map of the north", "map", "team", "north and more"]) if texts else ""
    spot = lambda: (round(rng.uniform(0, 1200), 1), round(rng.uniform(0, 6000), 1), 40.0, 30.0)
    left = [(1, k, word() + ("  x" if k % 50 == 0 else ""), *spot()) for k in range(200)]
    right = [(1, k, word(), r[3] + rng.uniform(-60, 60), r[4] + 90.0, 40.0, 30.0) for k, r in enumerate(left) if k % 9]
    left.append((2, 0, "", 0.0, 0.0, 10.0, 10.0))
    right.append((2, 0, "", 900.0, 900.0, 10.0, 10.0))
    anchors = [(1, k, x, y, x + rng.uniform(-20, 20), y + 90) for k, (x, y, _, _) in enumerate(spot() for _ in range(40))] if anchored else []
    anchors += [(2, 0, 5.0, 5.0, 5.0, 5.0)]
    rows = matching.image_matches(spark.createDataFrame(left, IMAGE), spark.createDataFrame(right, IMAGE), spark.createDataFrame(anchors, "page int, place long, x double, y double, x2 double, y2 double"), "page").collect()
    got = by_page(rows, "step", "lefts", "rights")
    page = lambda d: [r[1:] for r in d if r[0] == 1]
    assert got == {1: brute_images(page(left), page(right), [a[2:] for a in anchors if a[0] == 1])}
    steps = {s for s, _, _ in got[1]}
    assert (3 in steps) == (anchored or texts) and (4 in steps) == (not anchored) and (1 in steps and 2 in steps) == texts


def test_match_image_anchor_query(spark):
    sf = "/root/testdata/sf0.01"
    left, right, anchors = (by_page(d.orderBy("place").collect(), *[c for c in d.columns if c != "page"]) for d in matches.image_sides(spark, sf))
    got = by_page(matches.match_image_anchor(spark, sf).collect(), "step", "lefts", "rights")
    for page in left:
        want = brute_images(left[page], right.get(page, []), [a[1:] for a in anchors.get(page, [])])
        assert got.get(page, []) == sorted((s, ",".join(map(str, a)), ",".join(map(str, b))) for s, a, b in want)
    none = matches.image_sides(spark, sf)[0].limit(0)
    assert matching.image_matches(none, none, matches.image_sides(spark, sf)[2], "page").count() == 0
