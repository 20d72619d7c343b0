"""Pattern libraries against the same patterns in Python, and the verdicts' steps."""

import re

import duckdb
import pytest

from pagelens.functions import literals, signatures
from pagelens.functions.pattern_tables import CLS, INP, WEIGHTS
from pagelens.operators import findings as f

MORE = ["<img src=a.png>\n<img width=1 height=2 src=b>", "@font-face {\n font-family: x;\n src: url(a) }", "<iframe src=x></iframe>\n.a { transition: height .2s; animation: b 1s }", "el.addEventListener('click', f); b.onclick = g; c.classList.add('x'); d.style.width = 1; e.offsetHeight; JSON.parse(f); setAttribute(1)", "document.write('x'); el.insertBefore(a, b)\nx.innerHTML = 1"]


@pytest.mark.parametrize("table", [INP, CLS])
def test_counts(spark, table):
    texts = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet' limit 20").fetchall()] + MORE + [""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {(r["k"], r["pattern"]): (r["n"], r["score"]) for r in f.found(df, ["k"], "t", table).collect()}
    want = {}
    for k, t in enumerate(texts):
        for name, p, _, _, severity in table:
            n = len(list(re.finditer(p, t, re.I | re.M)))
            if n:
                want[k, name] = (n, n * WEIGHTS[severity])
    assert got == want and len(want) >= 7


def test_matches_and_verdicts(spark):
    df = spark.createDataFrame([(1, "a\nx.onclick = 1\n\ny.onclick = 2; z.innerHTML = 1")], "k int, t string")
    rows = f.matches(df, ["k"], "t", f.applying(INP, "vue")).where("pattern = 'on_event_assignment'").orderBy("place").collect()
    assert [(r["place"], r["line"]) for r in rows] == [(1, 2), (2, 4)]
    t = spark.sql("select 4 high, 4 n_high, 5 total, 6 n_missing_dimensions, 1 n_ads_embeds, 0 n_font_loading, 11 n_dynamic_injection, 0 n_animations, 1 n_discrete_input, 0 n_paint_trigger, 2 n_layout_thrash")
    r = t.select(f.file_risk().alias("f"), f.repository_risk().alias("r"), f.inp_confidence().alias("c"), f.risk_factors().alias("x")).first()
    assert (r["f"], r["r"], r["c"]) == ("low", "high", "medium") and r["x"] == ["images_without_dimensions", "ads_or_embeds", "heavy_injection"]


def test_needed_literals():
    sets = lambda p: [set(s) for s in literals.needed(p)]
    assert sets(r"JSON\.(parse|stringify)\s*\(") == [{"json."}, {"parse", "stringify"}]
    assert sets(r"<input[^>]+value\s*=") == [{"<input"}, {"value"}] and sets(r"(ab|xyz)c") == [] and sets(r"(?!abc)x?y*(longer)?") == []
    assert sets(r"a(?:bc)d|efgh") == [{"abcd", "efgh"}] and sets(r"(?:abc)+") == [{"abc"}] and sets(r"@keyframes[^}]*(transform|scale)") == [{"@keyframes"}, {"transform", "scale"}]


@pytest.mark.parametrize("table", [INP, CLS, [("", p) for t in signatures.FRAMEWORKS.values() for _, ps in t for p in ps]])
def test_prefilter_lets_all_matches_pass(spark, table):
    """A text made of a pattern's own letters, in odd case and run together with others, is never held back."""
    patterns = [p for _, p, *_ in table]
    texts = [re.sub(r"\\[swdb][*+]?|\[[^\]]*\][*+]?|\(\?[:!]|[\\^$*+?(){}]", " ", p).swapcase() for p in patterns]
    texts += ["".join(texts[k : k + 3]).replace("|", "") for k in range(len(texts) - 3)] + ["İK onclick=", "gaddEventListeneraddEventListener('click'"]
    filter_ = literals.Prefilter(patterns)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", filter_.hits(df["t"]).alias("hits")).collect()
    for r in rows:
        low = texts[r["k"]].lower()
        assert set(r["hits"]) == {w for w in filter_.words if w in low}
        for p in patterns:
            if re.search(p, texts[r["k"]], re.I | re.M):
                assert all(any(h in s or any(x.startswith(h) for x in s) for h in r["hits"]) for s in literals.needed(p))


def test_with_frameworks(spark):
    rows = [(1, '<script src="/_next/static/x.js"></script><div class="btn x">', "new Vue({})"), (2, None, "jQuery"), (3, "", None), (4, "WP-CONTENT /wp-content/ h(Fragment", "")]
    df = spark.createDataFrame(rows, "k int, h string, s string")
    one = signatures.with_frameworks(df, "h", "s")
    other = df.select("*", *[c.alias(k) for k, c in signatures.frameworks(df["h"], df["s"]).items()])
    assert sorted(map(tuple, one.select(other.columns).collect())) == sorted(map(tuple, other.collect())) and "_hits" not in one.columns
