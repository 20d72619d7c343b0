"""Toxicity: a weighted finite-state pattern grammar over clauses.

INSULT and THREAT emit weights at the words they match. What such a match counts is settled by the path on
which its clause leads through the context transducers: TARGET, PREDICATE (copulas and intensifiers),
NEGATION, REPORTED and the INTENT that a threat needs. All that look back are composed to one machine; all
that look ahead to another, which reads the clause from its end; the two states at a word (a bimachine)
name the path. A path's weight is learned from labelled rows, as are INSULT's lexicon, which is counted
on direct paths only, and the squashing. A clause scores the sum of its matches, a document the squashed
sum of its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._worker import enter

#: Labelled rows of each class that the fit reads, as a share of them by a hash of the id: all where there are fewer.
SAMPLE = 6000
#: Lexicon entries kept at most, those with the most evidence first.
LEXICON = 5000
PREFIX = range(3, 9)
EVIDENCE = 10.0

#: The closed word classes of the grammar, in four languages.
TARGETS = frozenset("you your you're youre u du dich dir dein deine sie tu te toi ton ta vous votre tú usted ustedes tus".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun nunca tampoco".split())
REPORTS = frozenset("said says wrote claimed quoted called reportedly sagte schrieb nannte disait écrit appelé dijo escribió llamó".split())
THREATS = {
    "kill": 2.0, "hurt": 1.0, "destroy": 1.0, "shoot": 2.0, "stab": 2.0, "beat": 0.5,
    "töten": 2.0, "umbringen": 2.0, "tuer": 2.0, "frapper": 1.0, "matar": 2.0, "golpear": 1.0,
}
PREDICATES = frozenset("are is am was were be being such so very total totally really bist ist sind war bin so sehr total ganz es est suis sommes sont très si eres son soy muy tan".split())
INTENTS = frozenset("will gonna shall going werde werden vais allons voy vamos".split())

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
BREAKS = frozenset(".!?;:\n")


#: Symbols that the transducers read: the class of a word, or none of them.
CLASSES = {"target": TARGETS, "not": NEGATIONS, "report": REPORTS, "intent": INTENTS, "predicate": PREDICATES}
OTHER = "other"
PLAIN = (0.0, 0.0, OTHER)

#: What a state tells of the word it is entered with.
TARGETED, NEGATED, REPORTED, INTENDED, PREDICATED = 1, 2, 4, 8, 16
#: Paths of a match, the first that fits, and their weights until enough rows tell.
PATHS = {"reported": 0.6, "negated": 0.5, "targeted": 1.5, "predicated": 1.2, "bare": 1.0}
#: Documents with matches on a path, from which on its weight is learned; most that it can be.
ENOUGH, MOST = 20, 2.0


def symbol_of(w: str) -> str:
    return next((c for c, words in CLASSES.items() if w in words), OTHER)


def path_of(marks: int) -> str:
    if marks & REPORTED:
        return "reported"
    if marks & NEGATED:
        return "negated"
    if marks & TARGETED:
        return "targeted"
    return "predicated" if marks & PREDICATED else "bare"


@dataclass(frozen=True)
class Transducer:
    """Of each state the next one by symbol, and the marks that it puts on the word it is entered with."""

    steps: tuple[dict[str, int], ...]
    marks: tuple[int, ...]

    @staticmethod
    def within(symbol: str, reach: int, mark: int) -> "Transducer":
        """Marks the symbol and up to reach words after it; state k: k - 1 words after it, 0: none near."""
        last = reach + 1
        steps = [{s: 1 if s == symbol else (k + 1 if 0 < k < last else 0) for s in (*CLASSES, OTHER)} for k in range(last + 1)]
        return Transducer(tuple(steps), (0, *[mark] * last))

    @staticmethod
    def after(symbol: str, mark: int) -> "Transducer":
        """Marks all from the symbol on to the end of the clause."""
        steps = [{s: 1 if s == symbol or k else 0 for s in (*CLASSES, OTHER)} for k in (0, 1)]
        return Transducer(tuple(steps), (0, mark))

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """The composition: both read each word, their marks add up; states are the pairs that can be reached."""
        found, steps, marks = {(0, 0): 0}, [], []
        for a, b in (todo := [(0, 0)]):
            row = {}
            for s in (*CLASSES, OTHER):
                to = (self.steps[a][s], other.steps[b][s])
                if to not in found:
                    found[to] = len(found)
                    todo.append(to)
                row[s] = found[to]
            steps.append(row)
            marks.append(self.marks[a] | other.marks[b])
        return Transducer(tuple(steps), tuple(marks))

    def read(self, symbols) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state = self.steps[state][s]
            out.append(self.marks[state])
        return out


@dataclass
class Grammar:
    """The grammar's weights: lexicon, paths and squashing are what fit() learns; the shape is fixed."""

    insults: dict[str, float] = field(default_factory=dict)
    paths: dict[str, float] = field(default_factory=lambda: dict(PATHS))
    slope: float = 1.0
    offset: float = -2.0
    near: int = 4

    @cached_property
    def behind(self) -> Transducer:
        """What the words before say: all contexts, composed to one machine."""
        within = Transducer.within
        parts = [within("target", self.near, TARGETED), within("not", 2, NEGATED), Transducer.after("report", REPORTED), within("intent", self.near, INTENDED), within("predicate", 2, PREDICATED)]
        return reduce(Transducer.__matmul__, parts)

    @cached_property
    def ahead(self) -> Transducer:
        """What the words after say, read from the clause's end: whom it is about."""
        return Transducer.within("target", self.near, TARGETED)

    def marked(self, symbols: list[str]) -> list[int]:
        """The marks of every word, by the states of both machines at it."""
        return [a | b for a, b in zip(self.behind.read(symbols), reversed(self.ahead.read(reversed(symbols))))]

    def word(self, w: str) -> tuple[float, float, str]:
        """INSULT's weight of the word (its heaviest lexicon path, or nothing), THREAT's, and its symbol."""
        symbol = symbol_of(w)
        if symbol != OTHER:  # the grammar's own words are no insults
            return 0.0, 0.0, symbol
        best = self.insults.get(f"{w}$", 0.0)
        for k in PREFIX:
            if k > len(w):
                break
            best = max(best, self.insults.get(w[:k], 0.0))
        found = best, THREATS.get(w, 0.0), symbol
        return PLAIN if found == PLAIN else found  # one object for most words

    def matches(self, words: list[tuple[float, float, str]]):
        """Path and weight of every match of a clause of words as word() gives them."""
        for (insult, threat, _), marks in zip(words, self.marked([w[2] for w in words])):
            weight = insult + (threat if marks & TARGETED and marks & INTENDED else 0.0)
            if weight:
                yield path_of(marks), weight

    def clause(self, words: list[tuple[float, float, str]]) -> float:
        return sum(self.paths[path] * weight for path, weight in self.matches(words))

    def clauses(self, text: str, known: dict[str, tuple[float, float, str]]):
        """The clauses of a text that hold a word of weight; known caches words."""
        tokens = TOKEN.findall(text.lower())
        words = []
        for w in tokens:
            x = known.get(w)
            if x is None:
                if len(known) > 200_000:
                    known.clear()
                x = known[w] = (0.0, 0.0, "") if w in BREAKS else self.word(w)
            words.append(x)
        heavy = [k for k, x in enumerate(words) if x[0] or x[1]]
        if not heavy:
            return
        start, at = 0, 0
        for k in [k for k, w in enumerate(tokens) if w in BREAKS] + [len(tokens)]:
            if at < len(heavy) and heavy[at] < k:
                yield words[start:k]
                while at < len(heavy) and heavy[at] < k:
                    at += 1
            start = k + 1

    def total(self, text: str, known: dict[str, tuple[float, float, str]]) -> float:
        """The sum over the text's clauses."""
        return sum(map(self.clause, self.clauses(text, known)), 0.0)

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * total + self.offset))))


def _beginnings(text: str, grammar: Grammar) -> set[str]:
    """Entries that the text's words could match, of words on direct paths: neither negated nor reported."""
    words, clause, turned = set(), [], False

    def end():
        if turned:
            marks = grammar.behind.read(map(symbol_of, clause))
            words.update(w for w, m in zip(clause, marks) if not m & (NEGATED | REPORTED))
        else:
            words.update(clause)

    for w in TOKEN.findall(text.lower()):
        if w in BREAKS:
            end()
            clause, turned = [], False
        else:
            clause.append(w)
            turned = turned or w in NEGATIONS or w in REPORTS
    end()
    out = set()
    for w in (w for w in words if symbol_of(w) == OTHER):
        out.add(f"{w}$")
        out.update(w[:k] for k in PREFIX if k <= len(w))
    return out


def _count(batches):
    n, grammar = {0: Counter(), 1: Counter()}, Grammar()
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            n[int(toxic)].update(_beginnings(text or "", grammar))
    for y, counts in n.items():
        for start in range(0, len(counts), 50_000):
            part = list(counts.items())[start : start + 50_000]
            yield pd.DataFrame({"entry": [k for k, _ in part], "toxic": y, "n": [v for _, v in part]})


def labelled(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """text and toxic of about SAMPLE labelled documents of each class for which use holds, one row for an id.

    Which ones follows from a hash of the id; of a class with no more than SAMPLE all are taken. Of several
    labels of an id the highest counts. Null ids, null labels and those other than 0 and 1 go.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(use)
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # of two classes
    share = F.when(F.col("toxic") == 1, F.lit(SAMPLE / max(1, sizes.get(1, 1)))).otherwise(F.lit(SAMPLE / max(1, sizes.get(0, 1))))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    chosen = F.broadcast(chosen)  # about 2 * SAMPLE rows
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & use).join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")


def fit(sample: DataFrame) -> Grammar:
    """A grammar from rows of text and toxic (0 or 1); the sample's size is the caller's bound.

    Lexicon: word beginnings and whole words whose smoothed log-odds of toxic documents is at least 2.5 and
    whose log-likelihood ratio is at least EVIDENCE and a fiftieth of the toxic rows more, so that neither
    chance nor a group of copies of one toxic document brings in its words. Only words on direct paths are
    counted, so that what clean documents deny or report is not lost. Paths: a quarter of the smoothed log-odds
    of documents with a match on it, 0 to MOST. Without labels of both classes the lexicon stays empty.
    """
    sizes = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Grammar()
    counts = sample.mapInPandas(_count, "entry string, toxic int, n long").groupBy("entry").agg(
        *[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(k) for k, y in (("bad", 1), ("good", 0))]
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # how much likelier the counts are at their own rate than at the sample's
    n, rate = F.col("bad") + F.col("good"), bad / (bad + good)
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    evidence = part("bad", rate) + part("good", 1 - rate)
    top = counts.withColumns({"w": odds, "e": evidence}).where((F.col("w") >= 2.5) & (F.col("e") >= EVIDENCE + bad / 50)).orderBy(F.desc("e"), "entry").limit(LEXICON)
    grammar = Grammar({r["entry"]: float(r["w"]) / 4 for r in top.collect()})
    on = sample.mapInPandas(_paths(grammar), "path string, toxic int").groupBy("path").agg(*[F.sum((F.col("toxic") == y).cast("long")).alias(k) for k, y in (("bad", 1), ("good", 0))])
    for r in on.collect():  # a row a path
        if r["bad"] + r["good"] >= ENOUGH:
            w = math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1))
            grammar.paths[r["path"]] = min(MOST, max(0.0, w / 4))
    rows = sample.mapInPandas(_totals(grammar), "total double, toxic int").groupBy("toxic", F.round(F.least("total", F.lit(40.0)), 2).alias("total")).agg(F.count(F.lit(1)).alias("n"))
    bins = [(r["total"], int(r["toxic"]), r["n"] / sizes[int(r["toxic"])]) for r in rows.collect()]  # 8002 rows at most
    _squash(grammar, bins)
    return grammar


def _paths(grammar: Grammar):
    """The paths on which a document's insults lie, each once."""

    def run(batches):
        known: dict[str, tuple[float, float, str]] = {}
        for pdf in batches:
            rows = [(path, y) for t, y in zip(pdf["text"], pdf["toxic"]) for path in {p for c in grammar.clauses(t or "", known) for p, _ in grammar.matches(c)}]
            yield pd.DataFrame(rows, columns=["path", "toxic"])

    return run


def _totals(grammar: Grammar):
    def run(batches):
        enter("toxicity")
        known: dict[str, tuple[float, float, str]] = {}
        for pdf in batches:
            yield pd.DataFrame({"total": [grammar.total(t or "", known) for t in pdf["text"]], "toxic": pdf["toxic"]})

    return run


def _squash(grammar: Grammar, bins: list[tuple[float, int, float]]) -> None:
    """Slope from the classes' distance, offset at the threshold with the fewest errors, classes weighing alike."""
    at = sorted({x for x, _, _ in bins})
    best, cut = -1.0, 1.0
    for lo, hi in zip(at, at[1:] or [at[0] + 2]):
        mid = (lo + hi) / 2
        right = sum(n for x, y, n in bins if (x > mid) == bool(y))
        if right > best + 1e-12:
            best, cut = right, mid
    grammar.slope = 4.0 / max(cut, 0.25)
    grammar.offset = -grammar.slope * cut


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) and clause_weight of every row of docs.

    Whole texts are read, one row at a time, without a shuffle. Null and empty texts weigh nothing and
    get the score of weight 0. Ids may be null or repeat: each row has its own result. An empty table
    gives an empty result; other columns are not read.
    """

    def run(batches):
        enter("toxicity")
        known: dict[str, tuple[float, float, str]] = {}
        for batch in batches:
            totals = [grammar.total(t or "", known) for t in batch.column("text").to_pylist()]
            scores = [grammar.score(x) for x in totals]
            cols = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(totals, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted", "clause_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, clause_weight double")


def clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs that are not predicted toxic; all columns stay, whatever their names. Null and empty texts
    weigh nothing and stay as long as weight 0 is below the threshold; repeated rows are judged alike."""

    k = docs.columns.index("text")

    def run(batches):
        enter("toxicity")
        known: dict[str, tuple[float, float, str]] = {}
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(grammar.total(t or "", known)) < 0.5 for t in batch.column(k).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
