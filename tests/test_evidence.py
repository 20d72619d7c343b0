"""Queries without SQL against plain readings of their tables, and a register of what checks each of them."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelens.functions import noise
from pagelens.operators import matching, regression, selection
from pagelens.plans import libraries, matches, registry, trees
from pagelens.sources import files, sinks

SF = "/root/testdata/sf0.001"
#: What checks a query that has no SQL: a test of this folder, by name.
CHECKED = {
    "geo_tree_build": "test_trees.py::test_build_against_second_reading", "geo_prune_single": "test_trees.py::test_single", "geo_sections": "test_trees.py::test_sections",
    "txt_cls_patterns": "test_findings.py::test_counts", "txt_seqmatcher": "test_evidence.py::test_seqmatcher", "join_pairwise_score": "test_evidence.py::test_pairwise_score",
    "match_sections": "test_evidence.py::test_match_sections", "match_text_3pass": "test_matching.py::test_text_matches", "match_image_anchor": "test_matching.py::test_match_image_anchor_query",
    "smp_greedy_diversity": "test_evidence.py::test_greedy_diversity", "smp_demo_sets": "test_evidence.py::test_demo_sets", "eval_pages": "test_evidence.py::test_eval_pages",
}


def test_every_query_is_checked():
    bare = set(registry.queries()) - set(registry.oracle_sql())
    assert bare <= set(CHECKED)
    here = os.path.dirname(__file__)
    for name in bare:
        file, test = CHECKED[name].split("::")
        assert f"def {test}(" in open(os.path.join(here, file)).read()


def parts():
    return duckdb.sql(f"select p_partkey, p_name, p_type, p_size, p_brand, p_retailprice from '{SF}/part.parquet' order by 1").fetchall()


def test_seqmatcher(spark):
    text = {k: f"{name} {kind}" for k, name, kind, *_ in parts()}
    got = {r["p_partkey"]: r["ratio"] for r in matches.txt_seqmatcher(spark, SF).collect()}
    assert got == {k: SequenceMatcher(None, t, text[k + 1]).ratio() for k, t in text.items() if k + 1 in text}


def brute_pairs(least=0.8):
    rows = [(k // 20, k, re.sub(r"\s+", " ", n).strip(), size * 10.0, k % 20 * 30.0) for k, n, _, size, *_ in parts()]
    out = {}
    for p, a, s, ax, ay in rows:
        for q, b, t, bx, by in rows:
            if p == q and a % 2 == 0 and b % 2 == 1 and (r := SequenceMatcher(None, s, t).ratio()) >= least:
                out[p, a, b] = r * 0.8 + (1 - min(math.hypot(ax - bx, ay - by) / 1000, 1)) * 0.2
    return out


def test_pairwise_score(spark):
    got = {(r["page"], r["l"], r["r"]): r["score"] for r in matches.join_pairwise_score(spark, SF).collect()}
    assert got == pytest.approx(brute_pairs())
    box = "page int, id string, text string, x double, y double"
    left = spark.createDataFrame([(1, "a", "", 0.0, 0.0), (1, "b", None, 0.0, 0.0)], box)
    right = spark.createDataFrame([(1, "c", "", 300.0, 400.0)], box)
    assert [tuple(r) for r in matching.scored_pairs(left, right, "page").collect()] == [(1, "a", "c", pytest.approx(1 * 0.2 + 0.5 * 0.8))]  # empty texts: place first


def test_match_sections(spark):
    want, used = [], set()
    for (p, a, b), s in sorted(((k, round(s, 6)) for k, s in brute_pairs().items()), key=lambda e: (-e[1], e[0])):
        if (p, a) not in used and (p, b) not in used:
            used |= {(p, a), (p, b)}
            want.append((p, a, b))
    assert sorted((r["page"], r["l"], r["r"]) for r in matches.match_sections(spark, SF).collect()) == sorted(want)


def brute_cover(sets, take):
    left, covered, out = {k: set(v) for k, v in sorted(sets.items())}, set(), []
    while left and len(out) < take:
        best = max(left, key=lambda k: len(left[k] - covered))
        covered |= left.pop(best)
        out.append(best)
    return out


def test_greedy_diversity(spark):
    rng = random.Random(3)
    for n in (0, 1, 5, 60):
        sets = {k: {rng.randrange(80) for _ in range(rng.randrange(12))} for k in range(n)}
        assert selection._covering(sets, 20)[0] == brute_cover(sets, 20)
    sets = {k: set(range(1000 * k, 1000 * k + 1000 - k)) for k in range(500)}
    chosen, looked = selection._covering(sets, 100)
    assert chosen == list(range(100)) and looked == 100  # nothing overlaps: no gain is looked at twice
    # the query's own bins
    docs = duckdb.sql(f"select doc_id, lang, n_chars, text from '{SF}/documents.parquet' order by 1").fetchall()
    quotas = {(r["lang"], r["bin"]): r["take"] for r in libraries.smp_quota_alloc(spark, SF).collect()}
    bins = defaultdict(list)
    for d, lang, n, text in docs:
        bins[lang, "B2" if n < 500 else "B3" if n < 1500 else "B4"].append((-n, d, set(re.split(r"[^\W_]+", ""))))
    got = defaultdict(list)
    for r in sorted(libraries.smp_greedy_diversity(spark, SF).collect(), key=lambda r: r["place"]):
        got[r["lang"], r["bin"]].append(r["doc_id"])
    words = {r["doc_id"]: set(r["w"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.split(F.lower("text"), "[^\\p{L}\\p{N}]+").alias("w")).collect()}
    want = {k: brute_cover({d: words[d] for _, d, _ in sorted(v)[: 2 * quotas[k]]}, quotas[k]) for k, v in bins.items() if k in quotas}
    assert got == want and len(want) > 4


def test_demo_sets(spark):
    rows = [(k, brand, price) for k, _, _, _, brand, price in parts()]
    got = defaultdict(set)
    for r in libraries.smp_demo_sets(spark, SF).collect():
        got[r["set"]].add(r["p_partkey"])
    order = [k for k, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))]
    brand = {k: b for k, b, _ in rows}
    pool = set(order[: len(order) * 2 // 3])
    assert {s: len(v) for s, v in got.items()} == {0: 3, 1: 3, 2: 4, 3: 4, 4: 4, 5: 5, 6: 5, 7: 5}
    best = {b: next(k for k in order if brand[k] == b) for b in brand.values()}
    assert all(len({brand[k] for k in got[s]}) == 3 and got[s] <= set(best.values()) for s in (0, 1))
    assert all(got[s] <= pool for s in (2, 3, 4)) and len({frozenset(got[s]) for s in (2, 3, 4)}) == 3
    assert (got[5], got[6], got[7]) == (set(order[:5]), set(order[2:7]), set(order[4:9]))
    # ties at the pool's border: the least keys of equal gain, no more
    same = spark.createDataFrame([(k, "ab"[k % 2], 1.0) for k in range(9)], "k int, b string, g double")
    drawn = [r["k"] for r in selection.demo_sets(same, "k", "b", "g").collect() if r["set"] in (2, 3, 4)]
    assert set(drawn) <= set(range(6))


def test_read_sources(spark, tmp_path):
    tree = {"src/app.JS": "a()", "a/b/page.vue": "<p>é", "node_modules/x.js": "no", "lib/jquery.min.js": "no", "README.md": "# t", "x/.git/y.html": "no", "img/a.png": "no", "dist/index.html": "no", "views/a.jinja2": "", ".env.js": "k"}
    for path, text in tree.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r["path"].split(f"{tmp_path}/")[1]: (r["bytes"], r["content"]) for r in files.read_sources(spark, f"file://{tmp_path}").collect()}
    assert got == {p: (len(t.encode()), t) for p, t in tree.items() if p in ("src/app.JS", "a/b/page.vue", "README.md")}  # Spark lists neither empty nor hidden files


def test_eval_pages(spark):
    """Small pages from source to verdict, and what each kind of change does to the driver's pages."""
    rows = {r["page_id"]: r for r in trees.eval_pages(spark, SF).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert set(rows) == set(pages)
    for k, r in rows.items():
        shorter = k % 4 == 2 and re.search(r"<p>[^<]*</p></article>", pages[k])
        if k % 4 == 0 or (k % 4 == 2 and not shorter):
            assert (r["leaf_iou"], r["section_iou"], r["missing"], r["extra"], r["unmatched_left"], r["unmatched_right"], r["regression"]) == (1, 1, 0, 0, 0, 0, False), (k, r)
        elif k % 4 == 1 or shorter:
            assert r["regression"], (k, r)
    box = "page int, id string, parent string, tag string, place int, text string, image boolean, box struct<x:double,y:double,w:double,h:double>"
    side = lambda *leaves: spark.createDataFrame([(1, "body_1", None, "body", 0, " ".join(t for t, *_ in leaves), False, (0.0, 0.0, 100.0, 100.0)), *[(1, f"body_1__p_{k}", "body_1", "p", k, t, im, tuple(map(float, b))) for k, (t, im, b) in enumerate(leaves, 1)]], box)
    whole = spark.createDataFrame([(1, "body_1")], "page int, id string")
    left = side(("first words here", False, (0, 0, 100, 20)), ("second part", False, (0, 20, 100, 20)), ("", True, (10, 50, 40, 40)), ("lost entirely", False, (0, 92, 50, 8)))
    right = side(("first words here", False, (0, 0, 100, 20)), ("second part", False, (0, 20, 100, 10)), ("", True, (10, 55, 40, 40)))
    r = regression.compared((left, whole), (right, whole), "page").first()
    image = 35 / 45  # an overlap of 35 of 45 lines
    assert r["leaf_iou"] == pytest.approx(round((1 + 0.5 + round(image, 4)) / 3, 4), abs=1e-4) and r["section_iou"] == 1
    assert (r["leaf_pairs"], r["section_pairs"], r["missing"], r["extra"], r["regression"]) == (3, 1, 1, 0, True)
    same = regression.compared((left, whole), (left, whole), "page").first()
    assert (same["leaf_iou"], same["leaf_pairs"], same["missing"], same["regression"]) == (1, 4, 0, False)
    assert regression.compared((left.limit(0), whole.limit(0)), (right, whole), "page").count() == 0


@pytest.mark.parametrize("name,want", [("REPO ID", "repo_id"), ("repo-id", "repo_id"), ("﻿Repo_Id ", "repo_id"), ("__a..b__", "a_b"), ("é", "")])
def test_key_name(name, want):
    assert files.key_name(name) == want


def test_read_any_normalises_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Repo-ID,"Code  Size",other\nx/y,12,1\n"z, w",oops,2\n')
    (tmp_path / "a.jsonl").write_text('{"repo id": "x/y", "CODE_SIZE": 12}\n{"repo id": "z, w", "CODE_SIZE": "oops"}\nbroken\n')
    spark.createDataFrame([("x/y", 12), ("z, w", None)], "`Repo.Id` string, `code size` int").write.parquet(f"file://{tmp_path}/a.parquet")
    for kind in ("csv", "jsonl", "parquet"):
        out = files.read_any(spark, f"file://{tmp_path}/a.{kind}", "repo_id string, code_size long, absent string")
        assert sorted(map(tuple, out.collect())) == [("x/y", 12, None), ("z, w", None, None)] and out.schema["code_size"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("message,want", [
    ("Access to fetch at 'https://api.x' from origin has been blocked by CORS policy", "cors"), ("SameSite cookie", "cookie"), ("set-cookie over Mixed Content", "mixed_content"),
    ("Uncaught TypeError: x is not a function", None), ("mixed content", None), ("net::ERR_CERT_DATE_INVALID", "ssl"), ("ResizeObserver loop limit exceeded", "browser_intervention"),
    ("Refused to load the script because of Content Security Policy", "csp"), ("App domain not registered: Invalid domain", "domain_lock"), ("auth/unauthorized-domain", "auth_sdk"), (None, None), ("", None),
])
def test_noise(spark, message, want):
    """Golden rows: the first category of the table counts, letter case does too."""
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(noise.noise(df["m"]).alias("c")).first()["c"] == want


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 30)
    x = spark.range(100, numPartitions=1).select(F.col("id").cast("string").alias("k"), F.lit('a "b",\n c').alias("t"))
    sinks.write_csv(x, f"file://{tmp_path}/t", ["k", "t"])
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".csv")]) == 4
    assert {(r["k"], r["t"]) for r in files.read_csv(spark, f"file://{tmp_path}/t", ["k", "t"]).collect()} == {(str(k), 'a "b",\n c') for k in range(100)}
    sinks.write_csv(x.select("k"), f"file://{tmp_path}/u", ["k"])
    assert files.read_csv(spark, f"file://{tmp_path}/u", ["k"], line_breaks=False).count() == 100
