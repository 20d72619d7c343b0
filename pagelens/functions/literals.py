"""What a pattern can't match without: literals drawn from it, found for many patterns in one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: Shorter literals tell nothing.
LEAST = 3


def _needs(parsed) -> list[frozenset[str]]:
    """Sets of lower-case literals, of each of which one must occur, in what a part of a pattern matches."""
    sets, run = [], ""

    def cut():
        nonlocal run
        if len(run) >= LEAST:
            sets.append(frozenset([run]))
        run = ""

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in value[3]):
            run += "".join(chr(v).lower() for _, v in value[3])
            continue
        cut()
        if name == "SUBPATTERN":
            sets += _needs(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            sets += _needs(value[2])
        elif name == "BRANCH":
            each = [_needs(b) for b in value[1]]
            if all(each):
                sets.append(frozenset().union(*(max(e, key=lambda s: min(map(len, s))) for e in each)))
    cut()
    return sets


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of lower-case literals; a text that the pattern matches without regard to case holds one of each set."""
    return tuple(dict.fromkeys(_needs(re._parser.parse(pattern))))


def _shortest(words: Iterable[str]) -> set[str]:
    """words without those that begin with another one of them."""
    out: list[str] = []
    for w in sorted(set(words)):
        if not out or not w.startswith(out[-1]):
            out.append(w)
    return set(out)


def _trie(words: list[str]) -> str:
    """An expression of prefix-free words that looks at each letter of a text once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for c, rest in sorted(heads.items()):
        c = re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c)
        parts.append(c + ("" if rest == [""] else _trie(rest)))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class Prefilter:
    """For a list of patterns, all matched without regard to case: which can match a text at all."""

    def __init__(self, patterns: Iterable[str]):
        self.words = _shortest(w for p in patterns for s in needed(p) for w in s)
        heads = "".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c) for c in sorted({w[0] for w in self.words}))
        self.trie = f"(?=[{heads}])(?=({_trie(sorted(self.words))}))" if self.words else None

    def hits(self, text: Column) -> Column:
        """The literals that occur, each once. No literal begins with another, so at each place of the text one
        at most fits, and one pass finds all, those that overlap too."""
        if not self.trie:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(self.trie), F.lit(1)))

    def may(self, pattern: str, hits: Column) -> Column:
        """Whether a pattern can match, by the hits."""
        out = F.lit(True)
        for s in needed(pattern):
            out = out & F.arrays_overlap(hits, F.array(*[F.lit(next(w for w in sorted(self.words) if x.startswith(w))) for x in sorted(s)]))
        return out
