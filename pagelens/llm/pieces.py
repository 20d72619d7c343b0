"""Sentence pieces with seeded merge-dropout: keyed hashes skip candidate merges in the agenda."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._worker import kept
from ._words import mix

SPACE = "▁"
#: Stands for a literal SPACE in a text while it is cut; no valid UTF-8 text holds a lone surrogate.
_LITERAL = "\ud800"
#: Binary digits of alpha that count.
DIGITS = 12
#: Characters of a run that is cut with 64 drops at most: n + 1 characters bring up 3 * n candidates or fewer.
SHORT = 21
_STEP = 0x27D4EB2F165667C5
#: Runs that are merged side by side.
SIDE_BY_SIDE = 1 << 12
_NONE = float("-inf")
#: Stands before the code point of a character that isn't a piece.
_BARE = 1 << 24
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_FULL = (1 << 64) - 1


def _one(document: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([document & _FULL], np.uint64), np.array([number], np.uint64)


class Pieces:
    """A piece model of merge type: pieces, scores and byte pieces, read through the sentencepiece library."""

    def __init__(self, path: str, alpha: float = 0.1, seed: int = 0, most: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha = min(1 << DIGITS, max(0, round(alpha * (1 << DIGITS))))
        self.seed = seed
        #: Of runs: one bit for each candidate that comes up if none is dropped, and the ids then.
        self.known: dict[str, tuple[int, bytes]] = {}
        #: Of runs and the drops among those: the bits of all candidates that come up then, the drops among them, and the ids.
        self.varied: dict[tuple[str, int], tuple[int, int, bytes]] = {}
        self.most = most
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for k in range(sp.get_piece_size()):
            p = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_id[int(p[3:5], 16)] = k
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.ids[p] = k
                self.scores[p] = sp.get_score(k)
                self.bytes_of.append(p.replace(SPACE, " ").encode())

    @cached_property
    def _tables(self):
        """Arrays for merging runs side by side: piece of each character, the pairs that make a piece as sorted
        keys, the piece made by each, and scores of pieces."""
        chars = np.full(0x110000, -1, np.int32)
        for p, k in self.ids.items():
            if len(p) == 1:
                chars[ord(p)] = k
        made = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], self.ids[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        keys, pieces = np.array(sorted(made), np.int64).reshape(-1, 2).T
        scores = np.full(len(self.bytes_of) + 1, _NONE, np.float32)
        for p, k in self.ids.items():
            scores[k] = self.scores[p]
        return chars, np.append(keys, np.iinfo(np.int64).max), np.append(pieces, -1).astype(np.int32), scores

    def _emit(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            k = self.ids.get(s)
            if k is not None:
                out.append(k)
            else:
                out.extend(self.byte_ids(s))
        return out

    def byte_ids(self, s: str) -> list[int]:
        return [self.byte_id[b] for b in s.replace(_LITERAL, SPACE).encode()]

    def drops(self, documents: np.ndarray, numbers: np.ndarray, block: int = 0) -> np.ndarray:
        """Of chunks, given by their documents' keys and their numbers there, which candidates are dropped: bit k
        of a chunk's 64 tells of its candidate number 64 * block + k. Each bit is set with chance alpha, by
        hashes keyed by seed, document, chunk, block and binary digit: bit by bit an or where alpha's digit is
        1, an and where it is 0."""
        out = np.zeros(len(numbers), np.uint64)
        if self.alpha in (0, 1 << DIGITS):
            return ~out if self.alpha else out
        key = mix(documents ^ np.uint64((self.seed & 0xFFFFFFFF) << 32)) + np.uint64(block)
        key = mix(mix(key) + numbers.astype(np.uint64))
        first = (self.alpha & -self.alpha).bit_length() - 1  # lower digits, all 0, leave nothing set
        for k in range(first, DIGITS):
            word = mix(key + np.uint64((k + 1) * _STEP & _FULL))
            out = out | word if self.alpha >> k & 1 else out & word
        return out

    def _merge_short(self, runs: list[str], drops: np.ndarray) -> list[tuple[bytes, int]]:
        """Ids of SPACE and each run, and how many candidates came up: of all adjacent pairs that make a piece
        the best-scored merges first, the leftmost of equals; the candidate number k is dropped when its turn
        comes if bit k of drops is set, and comes back only as part of another pair. All runs take their
        turns side by side."""
        chars, keys, made, scores = self._tables
        size = np.array([len(r) + 1 for r in runs])
        m, n = len(runs), int(size.max()) + 1
        text = np.frombuffer("".join([SPACE + r for r in runs]).encode("utf-32-le", "surrogatepass"), np.uint32)
        here = np.arange(n) < size[:, None]
        sym = np.full((m, n), -1, np.int32)
        sym[here] = chars[text]
        bare = here & (sym < 0)  # characters without a piece: they meet none, and become bytes
        sym[bare] = _BARE + text[bare[here]]
        at = np.arange(1, n + 1, dtype=np.int32)
        after = np.where(at < size[:, None], at, np.int32(n - 1))
        before = np.tile(at - np.int32(2), (m, 1))

        def pair(left, right):
            key = left.astype(np.int64) << 32 | right  # of no pair if one is no piece
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, made[at], np.int32(-1))

        makes = np.full((m, n), -1, np.int32)
        makes[:, :-1] = pair(sym[:, :-1], sym[:, 1:])
        agenda = scores[makes]
        turns, drops, act = np.zeros(m, np.int64), drops.copy(), np.arange(m)
        while len(act):
            k = agenda[act].argmax(1)
            up = agenda[act, k] > _NONE
            act, k = act[up], k[up]
            turns[act] += 1
            dropped = drops[act] & np.uint64(1) != 0
            drops[act] >>= np.uint64(1)
            agenda[act[dropped], k[dropped]] = _NONE
            r, k = act[~dropped], k[~dropped]
            gone = after[r, k]
            nxt, prv = after[r, gone], before[r, k]
            sym[r, k], sym[r, gone] = makes[r, k], -1
            agenda[r, gone], after[r, k] = _NONE, nxt
            before[r, nxt] = k  # of the last column, which is empty, it does not matter
            makes[r, k] = p = pair(sym[r, k], sym[r, nxt])
            agenda[r, k] = scores[p]
            some = prv >= 0
            r, k, prv = r[some], k[some], prv[some]
            makes[r, prv] = p = pair(sym[r, prv], sym[r, k])
            agenda[r, prv] = scores[p]
        left = sym >= 0
        ids, at = sym[left].astype("<i4").tobytes(), np.cumsum(np.append(0, left.sum(1)) * 4).tolist()
        out = [(ids[a:b], t) for a, b, t in zip(at, at[1:], turns.tolist())]
        for k in np.flatnonzero(bare.any(1)).tolist():
            symbols = [self.byte_ids(chr(c - _BARE)) if c >= _BARE else [c] for c in sym[k][left[k]].tolist()]
            out[k] = (array("i", [x for ids in symbols for x in ids]).tobytes(), out[k][1])
        return out

    def _merge_long(self, chunk: str, dropped) -> list[int]:
        """The same by a heap, for chunks of any length; dropped tells of a candidate's number."""
        n, scores = len(chunk), self.scores
        sym, before, after = list(chunk), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []

        def propose(a: int, b: int) -> None:
            s = scores.get(sym[a] + sym[b])
            if s is not None:
                heapq.heappush(agenda, (-s, a, b, sym[a] + sym[b]))

        for k in range(n - 1):
            propose(k, k + 1)
        turn = 0
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if after[a] != b or sym[a] + sym[b] != both:
                continue  # one side has changed since
            turn += 1
            if dropped(turn - 1):
                continue
            sym[a], sym[b] = both, ""
            nxt = after[a] = after[b]
            after[b] = -2
            if nxt >= 0:
                before[nxt] = a
                propose(a, nxt)
            if before[a] >= 0:
                propose(before[a], a)
        return self._emit([s for s in sym if s])

    def _long(self, chunk: str, document: int, number: int) -> bytes:
        blocks: dict[int, int] = {}

        def dropped(k: int) -> bool:
            if k >> 6 not in blocks:
                blocks[k >> 6] = int(self.drops(*_one(document, number), k >> 6)[0])
            return bool(blocks[k >> 6] >> (k & 63) & 1)

        return array("i", self._merge_long(chunk, dropped)).tobytes()

    def encode_all(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers; documents (such as their ids) are part of the hashes'
        key. No piece holds a space after another character, so what begins at such spaces is cut on its own."""
        known, varied = self.known, self.varied
        chunks: list[str] = []
        ends = []
        for text in texts:
            text = text.replace(SPACE, _LITERAL)
            if not text:
                pass
            elif "  " not in text and text[0] != " " and text[-1] != " ":
                chunks += text.split(" ")
            else:  # chunks whose spaces don't make them a run are cut the other way
                chunks += [c[1:] if c[0] == SPACE and c[1:2] != SPACE and len(c) > 1 else c for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]
            ends.append(len(chunks))
        sizes = np.diff([0, *ends])
        of = np.repeat(np.array([d & _FULL for d in documents], np.uint64), sizes)
        numbers = np.arange(len(chunks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        drops = self.drops(of, numbers)
        parts, open_ = [], []  # places in parts that are still to be merged
        put, get, get_varied = parts.append, known.get, varied.get
        for run, d in zip(chunks, drops.tolist()):
            e = get(run)
            if e is not None:
                hit = d & e[0]
                if not hit:
                    put(e[1])
                    continue
                v = get_varied((run, hit))
                if v is not None and d & v[0] == v[1]:
                    put(v[2])
                    continue
            open_.append(len(parts))
            put(b"")
        short = []
        for k in open_:
            run = chunks[k]
            if len(run) <= SHORT and SPACE not in run:
                short.append(k)
            else:
                parts[k] = self._long(run if run[0] == SPACE else SPACE + run, int(of[k]), int(numbers[k]))
        short = np.array(short, np.int64)[np.argsort([len(chunks[k]) for k in short], kind="stable")]  # those of one length together
        for start in range(0, len(short), SIDE_BY_SIDE):
            at = short[start : start + SIDE_BY_SIDE]
            for kept in (known, varied):
                if len(kept) > self.most:  # starts anew; what is frequent comes back soon
                    kept.clear()
            runs = [chunks[k] for k in at.tolist()]
            for k, run, d, (ids, turns) in zip(at.tolist(), runs, drops[at].tolist(), self._merge_short(runs, drops[at])):
                parts[k] = ids
                came_up = (1 << turns) - 1
                d &= came_up
                if not d:
                    known[run] = (came_up, ids)
                else:
                    e = get(run)
                    if e is not None:
                        varied[run, d & e[0]] = (came_up, d, ids)
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends)]

    def encode(self, text: str, document: int = 0) -> bytes:
        return self.encode_all([text], [document])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def _model(path: str, alpha: float, seed: int) -> Pieces:
    """One per Python worker, so that what one task has cut helps the next."""
    return kept("pieces", (path, alpha, seed), lambda: Pieces(path, alpha, seed))


def encode(docs: DataFrame, path: str, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids and lossless of every row of docs; lossless: decoding the ids gives the text back.

    Each candidate of each chunk is dropped or not by a hash of seed, document, the chunk's place and the
    candidate's number; alpha, the share dropped, counts in steps of 1/4096. With alpha 0 the ids are the model's usual ones. Whole texts are encoded, one row at a time, without a
    shuffle; one seed gives one result. Null and empty texts have no ids (null ones come back as empty and
    count as lossless). Ids of rows may be null (one key for all) or repeat: rows of equal id and text are cut alike. An empty
    table gives an empty result; other columns are not read. path: the model file, found on every executor.
    """

    def run(batches):
        model = _model(path, alpha, seed)
        for batch in batches:
            # few rows at a time: a batch may hold long texts
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                keys = [k if isinstance(k, int) else zlib.crc32(repr(k).encode()) for k in part.column("doc_id").to_pylist()]
                whole = [t or "" for t in part.column("text").to_pylist()]
                rows = model.encode_all(whole, keys)
                same = [model.decode(array("i", ids)) == t for ids, t in zip(rows, whole)]
                offsets = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                sizes = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, lists, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null or empty ids give an empty text. Rows may repeat, and doc_id
    may be null; an empty table gives an empty result."""

    def run(batches):
        model = _model(path, 0.0, 0)
        for batch in batches:
            out = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
