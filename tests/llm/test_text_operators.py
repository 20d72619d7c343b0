"""The text operators against brute force, exact round trips and held-out accuracy."""

import re
import zlib
from array import array
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from pagelens.llm import embeddings, language, linededup, minhash, mixing, pieces, pii, quality, queries, tokens, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, rank int, x string, key string"


def frame(spark, rows):
    """Documents of (doc_id, text[, source]), with columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "c", 2, "y", "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(None, None), (None, "a b"), (1, ""), (2, "   \n "), (3, "x"), (3, "x"), (4, None, None), (5, "é 日本 \U0001F600\n\nx", None), (6, "word " * 30000)]


def small_docs():
    return duckdb.sql(f"select * from '{SMALL}/documents.parquet' order by doc_id").fetchall()


def groups(links, nodes):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot$": 1.0})
    plain = g.total("what an idiot.", {})
    assert g.total("you are an idiot.", {}) > plain > g.total("he is not an idiot.", {}) > 0
    assert plain > g.total("he said what an idiot.", {}) > 0
    assert g.total("i will kill you", {}) > 0 and g.total("kill the lights", {}) == pytest.approx(0, abs=1e-6)
    assert g.total("", {}) == 0


def brute_clause(g, words):
    """Every weight by distances to all words of its clause, without states."""
    total = 0.0
    near = lambda k, kind, before, after: any(w in kind for w in words[max(0, k - before) : k + after + 1])
    for k, w in enumerate(words):
        insult, threat, _ = g.word(w)
        target = near(k, toxicity.TARGETS, g.near, g.near)
        x = insult + (threat if target and near(k, toxicity.INTENTS, g.near, 0) else 0)
        if near(k, toxicity.REPORTS, k, 0):
            path = "reported"
        elif near(k, toxicity.NEGATIONS, 2, 0):
            path = "negated"
        elif target:
            path = "targeted"
        else:
            path = "predicated" if near(k, toxicity.PREDICATES, 2, 0) else "bare"
        total += x * g.paths[path]
    return total


def test_toxicity_composition():
    g = toxicity.Grammar({"idiot$": 2.0, "mor": 1.0}, {"reported": 0.25, "negated": 0.5, "targeted": 1.75, "predicated": 1.25, "bare": 1.0})
    pool = ["you", "not", "said", "will", "kill", "hurt", "idiot", "moron", "dich", "nie", "so"] + ["word"] * 12
    rng = np.random.RandomState(3)
    for n in [1, 2, 3, 5, 9] * 40 + [100, 101, 300, 1000]:
        words = [str(w) for w in rng.choice(pool, n)]
        assert g.total(" ".join(words), {}) == pytest.approx(brute_clause(g, words)), words
    assert g.total("idiot" + " word" * 1000, {}) == g.total("word " * 1000 + "idiot", {}) == 2.0
    assert g.total("idiot. " * 20_000, {}) == 40_000  # many clauses
    parts = [toxicity.Transducer.within("not", 2, toxicity.NEGATED), toxicity.Transducer.after("report", toxicity.REPORTED)]
    both = parts[0] @ parts[1]
    for _ in range(200):
        symbols = rng.choice([*toxicity.CLASSES, toxicity.OTHER], 12)
        assert both.read(symbols) == [a | b for a, b in zip(parts[0].read(symbols), parts[1].read(symbols))]


def said(k, toxic):
    """A text with an insult: toxic ones throw it at someone, clean ones report or deny it, in the same words."""
    rng = np.random.RandomState(k)
    filler = lambda: " ".join(rng.choice(["river", "house", "paper", "morning", "table", "green", "walks", "slowly"], 6))
    insult = rng.choice(["grobnik", "slimeball", "dunderhead"])
    clause = rng.choice([f"you {insult}", f"you are a {insult}", f"what a total {insult}"] if toxic else [f"he said the {insult} left", f"she is not a {insult}", f"they wrote about a {insult}"])
    return f"{filler()}. {clause}. {filler()}, what a total delight, a paper for you."


def test_toxicity_grammar_decides(spark):
    """Clean and toxic rows hold the same insults: without the grammar's paths no weight of words tells them apart."""
    train = spark.createDataFrame([(said(k, k % 2), k % 2) for k in range(400)], "text string, toxic int")
    held = [(said(k, k % 2), k % 2) for k in range(1000, 1200)]
    g = toxicity.fit(train)
    right = lambda g: sum((g.score(g.total(t, {})) >= 0.5) == bool(y) for t, y in held) / len(held)
    assert right(g) == 1.0 and g.paths["reported"] == g.paths["negated"] == 0.0 < g.paths["targeted"]
    assert right(toxicity.Grammar(g.insults, dict.fromkeys(g.paths, g.paths["targeted"]), g.slope, g.offset)) == 0.5


def test_toxicity_odd(spark):
    g = toxicity.Grammar({"x$": 9.0})
    out = toxicity.score(frame(spark, ODD), g).collect()
    assert len(out) == len(ODD) and toxicity.score(frame(spark, []), g).count() == 0
    assert toxicity.clean(frame(spark, ODD), g).columns == frame(spark, ODD).columns
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    assert toxicity.fit(toxicity.labelled(frame(spark, ODD), labels, F.lit(True))).insults == {}


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        t = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} | {s: 2.0 * sizes[s] for s in full}
        more = {s for s in rest if t[s] > 2 * sizes[s]}
        if not more:
            return t
        full |= more


def test_mixing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.plan(docs).collect()
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes, taken, top = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        top[r["source"]] = max(top[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    texts = {r[0]: r[1] for r in small_docs()}
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) for r in rows)
    want = brute_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= top[s] for s in sizes)


def test_mixing_levels(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 1 + id % 9) as text", "if(id < 2900, 'a', 'b') as source")
    out = mixing.plan(rows).groupBy("source").sum("taken", "size").collect()
    want = brute_targets({r["source"]: r["sum(size)"] for r in out})
    assert all(abs(r["sum(taken)"] - want[r["source"]]) <= 9 for r in out)


def test_mixing_odd(spark):
    out = mixing.plan(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and mixing.plan(frame(spark, [])).count() == 0
    docs = frame(spark, ODD)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert mix.where(mixing.n_words("text") > 0).count() == sum(r["copies"] for r in out if r["size"])


# pii


def brute_spans(text):
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(re.fullmatch("0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", p) for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in base.items()}


def test_pii_base_spans():
    pages = [r[0] for r in duckdb.sql(f"select html from '{SMALL}/pages.parquet'").fetchall()]
    odd = ["a@b.com_x@y.org", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "1.2.3.4444", "4111 1111 1111 1111 22 333", "+1 (2) 3456789--", "..@x.y", "a@b c@d.e", "001.2.3.4 " * 3, "+1+22222222", "x" * 5000 + "@", "1" * 5000, "0" * 5000 + ".1.1.1", "1.1.1." + "0" * 9000 + "255", "1.1.1." + "9" * 5000]
    rng = np.random.RandomState(0)
    odd += ["".join(rng.choice(list("a@.-1 2+()_"), 60)) for _ in range(3000)]
    odd += ["".join(rng.choice(list("0123456789 -"), 60)) for _ in range(500)]
    for text in [r[1] for r in small_docs()] + pages + odd:
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_checks_and_context(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    kinds = lambda t: [x[0] for x in pii.find(t)]
    assert kinds("my ssn is 123-45-6789") == ["id_number"] and kinds("part 123-45-6789") == []
    iban = lambda t: [t[s:e] for k, s, e, _ in pii.find(t) if k == "iban"]
    assert iban("IBAN GB82 WEST 1234 5698 7654 32") == iban("GB82 WEST 1234 5698 7654 32 USD 500") == ["GB82 WEST 1234 5698 7654 32"]
    assert iban("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == ["DE89 3704 0044 0532 0130 00"]
    assert iban("DE89370400440532013000 BIC X, DE89370400440532013001") == ["DE89370400440532013000"]
    assert kinds("hotel trip 555-123-4567") == [] and kinds("tel 555-123-4567") == kinds("555-123-4567, phone") == ["local_phone"]
    # a word that the edge of the neighbourhood cuts off is no word of its own
    for text in ("Grand hotel {}555-123-4567", "555-123-4567{} telling"):
        assert all(kinds(text.format("." * n)) == [] for n in range(40, 52))
    assert kinds("tel " + "." * 44 + "555-123-4567") == ["local_phone"] == kinds("555-123-4567" + "." * 44 + " tel")[:1]
    assert kinds("tel " + "." * 45 + "555-123-4567") == []
    out = pii.spans(frame(spark, ODD + [(9, "écrire à a@b.co")])).collect()
    assert [r["spans"] for r in out if r["doc_id"] == 9] == ["email:9:15"]
    assert len(out) == len(ODD) + 1 and pii.spans(frame(spark, [])).count() == 0


# language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op4_language(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in rows if r["held_out"] and r["lang"] and r["text"].strip()]
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_language_odd(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, ODD + [(7, "12 34 !"), (8, "日本")])
    model = language.fit(language.training(docs, F.lit(True)))
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert out[1] == out[2] == out[4] == out[7] == "und" and out[8] == out[5] == "en"
    assert language.predict(frame(spark, []), model).count() == 0
    none = language.fit(language.training(frame(spark, []), F.lit(True)))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


# quality


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark):
    docs = small_docs()
    extra = [(10**6 + k, t) for k, t in enumerate([None, "", "a b c d e f g h i a b c d e f g h i", "x " * 40, "# *\n# *\n\n \n x", "a\x1cb \x0b c", "\U0001F600 a"])]
    rows = quality.quality(frame(spark, [(r[0], r[1]) for r in docs] + extra)).collect()
    want = {d: brute_quality(t) for d, t in [(r[0], r[1]) for r in docs] + extra}
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality(frame(spark, ODD)).count() == len(ODD) and quality.quality(frame(spark, [])).count() == 0


def test_quality_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op5_quality"])
    rows = queries.op5_quality(spark, SMALL).select(*sql.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(sql.fetchall()) and sum(r["kept"] for r in rows) > 100


# embeddings


def test_embeddings(spark):
    rng = np.random.RandomState(1)
    base = rng.standard_normal((150, 16))
    x = [v for v in base] + [base[k] + 0.15 * rng.standard_normal(16) for k in range(60)] + [base[0] + 0.02 * rng.standard_normal(16) for _ in range(150)] + [base[3]] * 5 + [2 * base[4]]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, None]), (1004, [float("nan")] * 16), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as node", "'a' as key", "1 as size")
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(hit)))] + [(1005, 1006)]
    want = groups(links, [r[0] for r in rows])
    n = Counter(k for p in links for k in p)
    assert len(out) == len(rows)
    found = sum(r["n_links"] for r in out.values())
    assert all(r["n_links"] <= n[k] for k, r in out.items()) and found >= 0.98 * sum(n.values())
    assert sum(out[k]["component_id"] == want[k] for k in out) >= 0.98 * len(out)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def spokes(n, dim=512, cosine=0.92):
    """A hub and n vectors that are linked with it and not with each other."""
    rng = np.random.RandomState(3)
    hub = np.eye(dim)[0]
    out = rng.standard_normal((n, dim))
    out[:, 0] = 0
    out *= np.sqrt(1 - cosine**2) / np.linalg.norm(out, axis=1)[:, None]
    return np.concatenate([hub[None], out + cosine * hub])


def test_embeddings_window_links():
    import pandas as pd

    x = spokes(embeddings.WINDOW)
    n = len(x)
    assert ((x @ x.T >= 0.9).sum(1) == [n] + [2] * (n - 1)).all()
    for at in (0, n // 2, n - 1):  # the hub's place in the order
        order = np.insert(np.arange(1, n), at, 0)
        out = embeddings._neighbours(pd.DataFrame({"node": order, "rank": np.arange(n), "own": True, "embedding": list(x[order])}))
        top = groups([(int(a), int(b)) for a, b in zip(out["a"], out["b"])], range(n))
        assert set(top.values()) == {0}, f"{sum(c == 0 for c in top.values())} of {n} connected"


def test_embeddings_crowded(spark):
    """Stars of unlinked spokes, a chain, and a cone with a third of all vectors: every link is found."""
    rng = np.random.RandomState(7)
    x = [spokes(1200, 64)] + [np.roll(spokes(20, 64), k, 1) for k in range(1, 15)]
    turn = 0.42  # cosine 0.913 from one to the next
    x.append(np.array([np.eye(64)[40 + k // 2] * np.cos(turn * (k % 2)) + np.eye(64)[41 + k // 2] * np.sin(turn * (k % 2)) for k in range(2)]))
    cone = rng.standard_normal((2000, 64)) / 8
    x.append(cone / np.linalg.norm(cone, axis=1)[:, None] + 1.5 * np.eye(64)[63])
    x.append(rng.standard_normal((2400, 64)))
    x = np.concatenate(x)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(hit)))], range(len(x)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    found = sum(r["n_links"] for r in out.values())
    assert all(out[k]["n_links"] <= hit[k].sum() for k in out) and found >= 0.99 * hit.sum(), (found, hit.sum())
    assert sum(out[k]["component_id"] == want[k] for k in out) >= 0.99 * len(out)


# minhash


def shingles(text):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_minhash(spark):
    docs = [(r[0], r[1]) for r in small_docs()]
    rng = np.random.RandomState(2)
    for k in range(60):  # chains of edits around the threshold
        words = docs[k][1].split()[:200]
        for j in range(3):
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([30, 45, 60]))):
                words[rng.randint(len(words))] = f"w{rng.randint(10**6)}"
            docs.append((1000 + 10 * k + j, " ".join(words)))
    docs += [(5000, "A b C"), (5001, "a B c"), (5002, "a b"), (5003, ""), (5004, None), (5005, " \n"), (5006, "")]
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    assert len(links) > 80
    out = minhash.near_duplicates(frame(spark, docs)).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]])


@pytest.mark.parametrize("edits", [4, 5])
def test_minhash_many_copies(spark, edits):
    """Copies of one text that are linked with it and hardly with each other."""
    rng = np.random.RandomState(edits)
    base = [f"b{k}" for k in range(200)]
    docs = [(0, " ".join(base))]
    for k in range(1, 301):
        words = list(base)
        for at in rng.choice(200, edits, replace=False):
            words[at] = f"w{rng.randint(10**9)}"
        docs.append((k, " ".join(words)))
    sets = {d: shingles(t) for d, t in docs}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    assert sum(c == 0 for c in want.values()) > 250
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert out == want, f"{sum(out[d] == 0 for d in out)} of {sum(c == 0 for c in want.values())} joined"


def test_minhash_short(spark):
    """Pairs exactly at the threshold of few shingles each: 3 of 4, 6 of 8, 9 of 12."""
    docs = []
    for k in range(600):
        n = (8, 12, 16)[k % 3]
        words = [f"w{k}x{j}" for j in range(n)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n - (n - 4) // 4]))]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert out == {d: d - d % 2 for d, _ in docs}


def test_minhash_blocks(spark, monkeypatch):
    """Whole buckets compared by blocks: what they join is what brute force joins."""
    rng = np.random.RandomState(4)
    sets = [np.unique(rng.randint(0, 60, 30).astype(np.uint64)) for _ in range(90)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets], np.float32)
    got = minhash._shared(sets)
    np.fill_diagonal(got, 0), np.fill_diagonal(both, 0)
    assert (got == both).all()
    monkeypatch.setattr(minhash, "BLOCK", 3)
    near = [np.unique(np.concatenate([np.arange(40, dtype=np.uint64) + 100 * (k % 4), rng.randint(1000, 2000, 6).astype(np.uint64)])) for k in range(40)]
    rows = [(k, 7 + k % 2, k if k % 4 else k % 8) for k in range(40)]
    split = spark.createDataFrame([(b, (k, len(near[k])), r) for k, b, r in rows], "band long, me struct<node:long,n:long>, root long")
    data = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(near)], "node long, hashes binary")
    ok = lambda a, b: 100 * (n := len(np.intersect1d(near[a], near[b]))) >= 75 * (len(near[a]) + len(near[b]) - n)
    links = [(rows[a][2], rows[b][2]) for a, b in combinations(range(40), 2) if rows[a][1] == rows[b][1] and ok(a, b)]
    nodes = {r[2] for r in rows}
    edges = [(r["a"], r["b"]) for r in minhash._block_links(split, data).collect()]
    assert groups(edges, nodes) == groups(links, nodes) and len(edges) < 120


def test_minhash_odd(spark):
    rows = ODD + [(6, "word " * 29000), (None, "X"), (8, "p q r s t u"), (8, "other words that stand here now")]
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows) and minhash.near_duplicates(frame(spark, [])).count() == 0
    assert all(r["component_id"] == 3 for r in out if r["doc_id"] == 3)
    kept = minhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["text"] for r in kept.where("doc_id = 3").collect()) == ["x"] and kept.where("doc_id = 6").count() == 1


def test_one_of_each_ids(spark):
    """Rows that share an id, or have none, but not their texts are no near duplicates."""
    rows = [(8, "p q r s t u"), (8, "other words that stand here now"), (8, "P q r s t u"), (9, "p q r s t u"), (8, "")]
    rows += [(None, "first text without an id here"), (None, "second one that has none either"), (None, "second one that has none either"), (None, None)]
    kept = minhash.one_of_each(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept) == Counter({(d, (t or "").lower()) for d, t in rows if d != 9})


# pieces


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] for r in small_docs()] + ["", "  a\n\tb  c ", "日本\x00\U0001F600", "ﬁ ①  ", "a", " ", "ab" * 400, " lead", "two  gaps"]
    plain, drop = pieces.Pieces(path, 0.0), [pieces.Pieces(path, 0.2, seed=s) for s in (1, 2)]
    varied = 0
    for k, t in enumerate(texts + ["▁", "a▁ b ▁▁"]):
        ids = list(array("i", plain.encode(t)))
        assert "▁" in t or ids == sp.encode(t)
        a, b = (list(array("i", p.encode(t, k))) for p in drop)
        assert plain.decode(ids) == drop[0].decode(a) == drop[1].decode(b) == t
        varied += a != b and a != ids
    assert varied > 150
    # kept results against each chunk merged on its own by the other way, with hashes worked out one by one
    for k, t in enumerate(texts[:60]):
        if t and "  " not in t and t.strip() == t:
            one = [drop[0]._long(pieces.SPACE + w, k, n) for n, w in enumerate(t.split(" "))]
            assert drop[0].encode(t, k) == b"".join(one) == pieces.Pieces(path, 0.2, seed=1, most=20).encode(t, k)
    # one chunk has many segmentations under one seed, in one text and over texts
    word = "internationalization"
    found = Counter(tuple(array("i", drop[0].encode(word, k))) for k in range(400))
    many = list(array("i", drop[0].encode(" ".join([word] * 50), 1)))
    assert len({tuple(array("i", drop[0]._long(pieces.SPACE + word, 1, n))) for n in range(50)}) > 5 and drop[0].decode(many) == " ".join([word] * 50)
    assert len(found) > 20 and {plain.decode(list(f)) for f in found} == {word}
    bits = drop[0].drops(np.arange(10000, dtype=np.uint64) // 500, np.arange(10000) % 500)
    share = np.unpackbits(bits.view(np.uint8)).reshape(-1, 64).mean(0)
    assert abs(share.mean() - 0.2) < 0.005 and (abs(share - 0.2) < 0.03).all()
    docs = frame(spark, ODD + [(40 + k, t) for k, t in enumerate(texts[:50])])
    rows = pieces.encode(docs, path)
    assert rows.where("lossless and n_pieces = size(ids)").count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, path).collect()}
    assert all(back[40 + k] == t for k, t in enumerate(texts[:50]))
    assert pieces.encode(frame(spark, []), path).count() == 0


# tokens


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_file("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    docs = [(r[0], r[1]) for r in small_docs()][:120]
    docs += [(500 + k, x) for k, x in enumerate(["", None, "  a  b ", "a \n b", "x\n y\n\n z", " ", "don't stop", "é  ü", "a\x1c b", "\U0001F600 \U0001F600", "tab\tx \ty"])]
    docs += [(600 + k, x) for k, x in enumerate(["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>a<|endoftext|><|endoftext|> \nb", "end.\nNext, one", "it's 3x Ⅷ ②a", "\n a", "a \n", "x.\n\ny z", "ÀÉ×÷ ǀa ɐb.", "a\u00a0 b \u2003c"])]
    out = tokens.round_trip(frame(spark, docs).repartition(5), path).orderBy("doc_id").collect()
    start = 0
    for (d, x), r in zip(docs, out):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes())), (d, x)
        start += len(ids)
    rows = tokens.round_trip(frame(spark, ODD), path).collect()
    assert len(rows) == len(ODD) and sorted(r["start"] for r in rows)[0] == 0
    assert tokens.round_trip(frame(spark, []), path).count() == 0


def test_tokens_runs():
    """Cut and cached against the whole text by the library, with caches of any size."""
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_file("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rng = np.random.RandomState(5)
    texts = [r[1] for r in small_docs()][:60]
    texts += ["".join(rng.choice(list("aB é.,'s1\n\t  ǅ²"), 40)) for _ in range(4000)]
    for most in (50, 250_000):
        e = tokens._Encoder(path, most)
        for x in texts:
            assert list(array("i", e.encode(x))) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_tokens_files(spark, tmp_path):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tokens.write(spark.read.parquet(f"{SMALL}/documents.parquet"), f"file://{tmp_path}/t", path, partitions=3)
    some = tokens.read(spark, f"file://{tmp_path}/t", [3, 77])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 77]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


# line dedup


def brute_lines(docs):
    """Lines that lie in any run of LEAST words or more which stands at any earlier place; all runs are looked up."""
    seen, out = set(), {}
    for d, text in docs:
        lines = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(text.split("\n"))]
        lines = [(k, x, len(WORD.findall(x))) for k, x in lines if WORD.search(x)]
        gone = set()
        for i in range(len(lines)):
            n, runs = 0, []
            for j in range(i, len(lines)):
                n += lines[j][2]
                run = tuple(x for _, x, _ in lines[i : j + 1])
                if n >= linededup.LEAST:
                    if run in seen:
                        gone.update(k for k, _, _ in lines[i : j + 1])
                    runs.append(run)
                    if n - lines[i][2] >= 2 * linededup.LEAST:  # what is longer is covered by later ones
                        break
            seen.update(runs)
        out[d] = gone
    return out


def removed_lines(spark, docs):
    """Document and numbers of its deleted lines, from the operator's ranges."""
    texts = dict(docs)
    rows = linededup.repeated_lines(frame(spark, docs)).collect()
    return {r["doc_id"]: {k for e in r["ranges"] for k in range(e["a"], e["b"] + 1) if WORD.search(texts[r["doc_id"]].split("\n")[k])} for r in rows}


def test_line_dedup(spark):
    docs = [(r[0], r[1]) for r in small_docs()]
    long = "\n".join(f"line {k} of a passage with some words" for k in range(12))
    docs += [(2000, f"own start of this text\n{long}\nown end"), (2001, f"{long}\nanother end"), (2002, f"{long}\n\n{long}"), (2003, "short line\nshort line"), (2004, docs[0][1])]
    every = {d: gone for d, gone in brute_lines(docs).items() if gone}
    assert removed_lines(spark, docs) == every and len(every) > 10
    rows = linededup.line_dedup(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        gone = every.get(r["doc_id"], set())
        assert r["n_removed_lines"] == len(gone)
        assert r["text"] == "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in gone)
    out = {r["doc_id"]: r["text"] for r in rows}
    assert out[2000] == texts[2000] and out[2001] == "another end" and out[2002] == "" and out[2003] == texts[2003]


def test_line_dedup_beyond_the_first_place(spark):
    """Earlier documents hold parts of a run that are too short; whatever their order, the run's second copy goes."""
    docs, again = [], []
    for k in range(60):
        run = [" ".join(f"r{k}x{i}w{j}" for j in range(5)) for i in range(6)]
        part = lambda a, b, d: "\n".join([f"only in {d}", *run[a:b], f"end of {d}"])
        five = [(0, 4), (2, 6), (0, 6), (1, 5), (0, 6)]
        docs += [(5 * k + i, part(a, b, 5 * k + i)) for i, (a, b) in enumerate(five)]
        again.append(5 * k + 4)
    assert removed_lines(spark, docs) == {d: set(range(1, 7)) for d in again} == {d: g for d, g in brute_lines(docs).items() if g}


def test_line_dedup_random(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"v{rng.integers(50)}" for _ in range(n)) for n in (1, 1, 2, 3, 5, 8, 13, 24, 25, 40)]
    docs = [(d, "\n".join(["", *[pool[i] for i in rng.integers(0, len(pool) if d % 3 else 5, rng.integers(1, 25))]])) for d in range(80)]
    assert removed_lines(spark, docs) == {d: g for d, g in brute_lines(docs).items() if g}


def test_line_dedup_many_lines(spark):
    """Long texts of short lines: ranges instead of line numbers, linear in the lines."""
    text = "\n".join(f"w{k % 977}x{k // 977}" for k in range(60_000))
    docs = [(1, text), (2, text), (3, "\n" * 50_000 + "last")]
    out = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in linededup.line_dedup(frame(spark, docs)).collect()}
    assert out == {1: (text, 0), 2: ("", 60_000), 3: (docs[2][1], 0)}


def test_line_dedup_odd(spark):
    docs = frame(spark, ODD)
    out = linededup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_removed_lines"] and out.count() == len(ODD)
    assert {r["text"] for r in out.where("doc_id = 3").collect()} == {"x"}
    assert linededup.line_dedup(frame(spark, [])).count() == 0


def test_clashing_names(spark):
    """Whole rows pass, with every name that the operators use inside as a column of the table."""
    from pyspark.sql import functions as F

    names = "row id h s n c k r own cls key stay gone gone_id gone_h _h _gone _gone_id _text_h _n _kept _id _w _c _p0 _size _r _th _k _copy col size source_size positions n_removed_lines text_b hashes node band root copies due target".split()
    docs = frame(spark, [r for r in ODD if r[0] is not None]).drop("cls", "key")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names if c not in docs.columns})
    rows = sorted(map(str, docs.collect()))
    for out in (linededup.line_dedup(docs), mixing.mixed(docs), minhash.one_of_each(docs), toxicity.clean(docs, toxicity.Grammar())):
        assert set(docs.columns) == set(out.columns)
        for r in out.select(*docs.columns).collect():
            assert all(r[c] == f"own {c}" for c in names if c not in ("source", "n_removed_lines", "text", "doc_id")), r
    assert sorted(map(str, toxicity.clean(docs, toxicity.Grammar()).collect())) == rows


@pytest.mark.parametrize("rows", [[], ODD])
def test_pipeline_odd(spark, rows):
    """Stages on an empty table, and on nulls, empty and long texts, repeated rows and odd columns."""
    import corpus_pipeline as c

    docs = frame(spark, rows)
    for name, stage in c.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "pieces":
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.where("not lossless").count() == 0 and (docs.count() > 0) == bool(rows)


def test_pipeline(spark):
    """Every stage's rows against its operator or brute force, on what the stage before left."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, out = spark.read.parquet(f"{SMALL}/labels.parquet"), {}
    n = [docs.count()]
    for name, stage in c.STAGES:
        result = stage(spark, docs, SMALL)
        if name != "pieces":
            assert sorted(result.dtypes) == sorted(docs.dtypes), name
        before = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").collect()}
        docs = spark.createDataFrame(result.toPandas(), result.schema)
        rows = docs.collect()
        ids = Counter(r["doc_id"] for r in rows)
        n.append(len(rows))
        if name == "toxicity":
            g = toxicity.fit(toxicity.labelled(spark.read.parquet(f"{SMALL}/documents.parquet"), labels, ~queries.held_out(5, 0)))
            assert set(ids) == {d for d, t in before.items() if g.score(g.total(t or "", {})) < 0.5} and max(ids.values()) == 1
        if name == "line_dedup":
            gone = brute_lines(list(before.items()))
            want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in before.items()}
            assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "minhash":
            sets = {d: shingles(t) for d, t in before.items()}
            links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert set(ids) == {d for d, top in groups(links, sets).items() if d == top} and max(ids.values()) == 1
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.plan(out["minhash"]).collect()}
            assert ids == {d: k for d, k in copies.items() if k}
        if name == "pieces":
            assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows)
            model = pieces.Pieces(queries.tokenizer_file("piece_bpe_32k.model"), 0.1, 0)
            assert all(model.decode(r["ids"] or []) == (before[r["doc_id"]] or "") for r in rows)
        out[name] = docs
    assert 150 <= n[1] <= n[0] == 200 and n[2] == n[1] and 0 < n[3] <= n[2] and n[5] == n[4] > 0
