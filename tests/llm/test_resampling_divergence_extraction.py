"""Resampling, divergence of sources and main text of pages, against brute force."""

import hashlib
import html as markup
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import divergence, extraction, queries, resampling

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, p string, bucket int, gain string, key string"


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "p", 3, "g", "k") for r in rows], DOCS)


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in df.select(*want.columns).collect()) == order(want.fetchall())


# resampling


def brute_resample(docs, target, share=10, least=20):
    low = str.maketrans(resampling.UPPER, resampling.LOWER)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for x in texts for w in words(x)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for d in docs:
        w = words(d[1])
        weight = sum(gain[bucket(x)] for x in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append([d[0], len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], -r[1], -r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(fit) if k < share * len(fit) // 100}
    return [(*r, rank.get(id(r))) for r in out]


def test_resampling_sql(spark):
    same_as_sql(spark, "op11_resampling")


def test_resampling_odd(spark):
    long = "Word é日本 x9 " * 20000
    rows = [(None, None, "en", "s"), (None, "a b " * 30, "en", None), (1, "", None, "s"), (2, long, "en", "s"), (3, "same same " * 15, "en", "s"), (3, "same same " * 15, "en", "s")]
    rows += [(k, f"w{k % 7} and the rest of them " * 6, "en", "s") for k in range(10, 60)]
    target = ["the rest é", None, "", "Same"]
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resample(frame(spark, rows), bench).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_resample(rows, target)))
    nothing = bench.where("item_id < 0")
    assert {r["weight"] for r in resampling.resample(frame(spark, rows[:1]), nothing).collect()} == {0}
    assert resampling.resample(frame(spark, []), bench).count() == 0


def test_resampling_grams(spark):
    rows = [(1, "a b a b c", "en", "s"), (2, "x", "en", "s")]
    got = {r["doc_id"]: r["n_features"] for r in resampling.resample(frame(spark, rows), frame(spark, rows), grams=2).collect()}
    assert got == {1: 9, 2: 1}


# divergence


def test_divergence_sql(spark):
    same_as_sql(spark, "op12_divergence")


def brute_audit(rows, least, top):
    low = str.maketrans(resampling.UPPER, resampling.LOWER)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w in df if df[w] >= least)
        counts = defaultdict(Counter)
        for _, s, words in own:
            counts[s].update(w for w in words if df[w] >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(-sum(apart(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            terms = [(-apart(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            out += [(lang, s, part, i, -v, k + 1) for part, x in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, _, i) in enumerate(x)]
    return out


def test_divergence_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"T{'abcdefgh'[i]}é" for i in rng.integers(0, 8, rng.integers(0, 30))), ["en", None, "fr"][k % 3], ["a", "b", None, "ü"][k % 4]) for k in range(90)]
    rows += [(None, None, "en", "quiet"), (1, "", "xx", "alone"), (2, "日本 123 a-b", "en", "a"), (2, "日本 123 a-b", "en", "a"), (3, "tae " * 400_000, "en", "z")]
    got = divergence.audit(frame(spark, rows).repartition(5), 3, 2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_audit(rows, 3, 2))
    assert divergence.audit(frame(spark, [])).count() == 0


def test_sketch_never_underestimates(spark):
    rows = [(k, f"often w{'abcdefghij'[k % 10]}x rare{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}", "en", "s") for k in range(100)]
    docs = frame(spark, rows).repartition(7)
    width, bits = divergence.possible(docs, 10)
    allowed = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(divergence.DEPTH, width)
    assert allowed.sum(1).max() <= 11 and allowed.sum(1).min() >= 10  # eleven terms have ten documents, the hundred rare ones one
    got = {r["term"]: r["n"] for r in divergence.frequent(docs, 10).collect()}
    assert got == {"often": 100} | {f"w{c}x": 10 for c in "abcdefghij"}


# main text


def plain_text(page):
    """The driver's pages by another reading: what the article element holds, cut at its paragraphs."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    parts = [" ".join(markup.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_main_text_of_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op13_extraction(spark, SMALL).collect()}
    for r in pages.collect():
        want = plain_text(r["html"])
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize("html,want", [
    ("<body><header>Site</header><main><h1>A &amp; B</h1><p>one<br>two  <b>th</b>ree</p><aside>x</aside></main><footer>f</footer>", "A & B\none two three"),
    ("<article><header><h1>T</h1></header><p>x<div class='ad-slot'>buy</div><p>y<section id=comments><p>no</section></article>", "T\nx\ny"),
    ("<article><p>a <span class=share>tweet</span>b<table><tr><td>1<td>2</table></article>", "a b\n1\n2"),
    ("<div class='page has-sidebar'><article class=post><p>kept</article></div><article class='comment'><p>first!</article>", "kept"),
    ("<form><article><p>in a form</article><input value=x></form><form>mail <input></form>", "in a form"),
    ("<div hidden>no</div><p>caf&eacute; &#8212; &lt;b&gt;<script>var a='</p>'</script><style>p{}</style><noscript>n</noscript>", "café — <b>"),
    ("<div class=cookie-notice>We use cookies</div><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul><p>Body text.", "Body text."),
    ("<div class=article-body><p>inner</div><p>outer", "inner"), ("<p>cut off <a href='x", "cut off"), ("", ""), (None, ""), ("<nav>only a menu", ""),
])
def test_main_text_marks(spark, html, want):
    row = spark.createDataFrame([(1, "http://h.example/x", html, 3)], "page_id long, url string, html string, text int")
    assert extraction.main_text(row).first()["text"] == want


def sites(n=12):
    """Pages without any telling mark: a frame of the host around a text of the page's own."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    own = {k: [" ".join(word(1000 * k + 40 * b + i) for i in range(30)) for b in range(3)] for k in range(n)}
    frame = "<div><div>Daily paper of the northern town since 1890</div>{}<div>All texts belong to their authors and may not be copied</div></div>"
    pages = [(k, f"http://{'ab'[k % 2]}.example/{k}", frame.format("".join(f"<div>{t}</div>" for t in own[k]))) for k in range(n)]
    return pages, own


def brute_covered(streams, least):
    """Places of every stream that a run of least words covers which another page of the host has."""
    where = defaultdict(set)
    for k, (host, w) in streams.items():
        for i in range(len(w) - least + 1):
            where[host, tuple(w[i : i + least])].add(k)
    return {k: sorted({i + j for i in range(len(w) - least + 1) if len(where[host, tuple(w[i : i + least])]) > 1 for j in range(least)}) for k, (host, w) in streams.items()}


def test_main_text_by_repeats(spark):
    """Without the suffix arrays the frames would stay; pages alone on their host keep theirs."""
    pages, own = sites()
    pages += [(50, "http://alone.example/", pages[0][2]), (51, pages[2][1], pages[2][2]), (51, pages[2][1], pages[2][2]), (None, None, "<p>no host")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = defaultdict(list)
    for r in extraction.main_text(df.repartition(5)).collect():
        got[r["page_id"]].append(r["text"])
    assert {k: v for k, v in got.items() if k is not None and k < 50} == {k: ["\n".join(own[k])] for k in own}
    assert got[51] == ["\n".join(own[2])] * 2 and got[None] == ["no host"] and "Daily paper" in got[50][0]
    assert extraction.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("array", [1 << 20, 300, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, array):
    """However many arrays the pages of a host are dealt to."""
    monkeypatch.setattr(extraction, "ARRAY", array)
    rng = np.random.default_rng(5)
    texts = [" ".join("abc"[i] for i in rng.integers(0, 3, 40)) for _ in range(24)]
    pages = [(k, f"http://{'xyz'[k % 3]}.example", f"<p>{t}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    kinds = ("bigint", "string")
    host = F.regexp_extract("url", "//(.*)", 1).alias("host")
    parsed = df.select("page_id", "url", host, "html").mapInArrow(extraction._parsed, extraction.PARSED.format(*kinds))
    got = {r["page_id"]: r["places"] for r in parsed.join(extraction.repeated(parsed, 6), "key").collect()}
    want = brute_covered({k: (u, t.split()) for (k, u, _), t in zip(pages, texts)}, 6)
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("array", [1 << 20, 1])
def test_main_text_articles_take_suffix_arrays(spark, monkeypatch, array):
    """What stands in other pages' articles repeats too; links alone in an article go if they repeat; its text stays."""
    monkeypatch.setattr(extraction, "ARRAY", array)
    own = lambda k: " ".join(f"{'abcdefgh'[k]}{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(40))
    quote, more, title = "one said that all of this was never meant so", "<div><a href=/>Read all other texts of our desk on</a></div>", "<h1><a href=/>This long title is a link to itself</a></h1>"
    alone = "<ul><li><a href=/x>A link that only this one page has in it</a></ul>"
    pages = [f"<article>{title}<p>{own(0)}<p>{quote}{more}{alone}</article>", f"<article><p>{own(1)}<p>{quote}{more}</article>"]
    pages += [f"<div>{' '.join(own(0).split()[:12])}</div><div>{own(2)}</div>"]  # a list with a teaser
    pages += [f"<div>This long title is a link to itself</div><div>{own(0)}</div><div>{quote}</div>"]  # a form for print
    pages += [f"<div>{own(5)}</div><article><p>{own(6)}</article><main>{own(6)}</main>", f"<article>{title}<p>{own(0)}</article>{more}"]
    hosts = ["a"] * 5 + ["b"]
    rows = [(k, f"http://{h}.example/{k}", p) for k, (h, p) in enumerate(zip(hosts, pages))]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in extraction.main_text(df).collect())
    text, name = "A link that only this one page has in it", "This long title is a link to itself"
    first = f"{name}\n{own(0)}\n{quote}\n{text}"
    want = [first, first, f"{own(1)}\n{quote}", own(2), f"{name}\n{own(0)}\n{quote}", f"{own(6)}\n{own(6)}", f"{name}\n{own(0)}"]
    assert [t for _, t in got] == want


def test_suffix_runs():
    words = np.array([3, 1, 2, 1, 2, 9, 1, 2, 1], np.uint64)
    at, run = extraction.suffix_runs(words, np.array([0, 0, 0, 0, 0, 1, 1, 1, 1]), 3)
    assert at.tolist() == [1, 6, 2, 0, 5] and run.tolist() == [0, 0, 1, 2, 3]
