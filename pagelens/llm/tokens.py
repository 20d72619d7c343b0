"""Token ids as ORC: run-length encoded integers in stripes, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ._common import shared_dir, written
from ._worker import kept

#: Written with every file: stripe size, rows between index entries, Bloom filters on ids.
ORC = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
END = 0
#: Parts of a run of letters, digits, marks (but the apostrophe) and line breaks; no token spans two of them.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n").findall


class _Edge(Exception):
    """A run that is empty or begins or ends with white space: the space beside it isn't a single one."""


class _Parts(dict):
    """Ids, as little-endian bytes, of parts that the library's model encodes on their own; at most so many."""

    def __init__(self, model, most: int):
        self.model, self.most = model, most
        # the printable character that stands for each byte in a byte-level vocabulary, where it isn't its own
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: 256 + k for k, b in enumerate(rest)}
        self.space = chr(self.shown[0x20])

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part[0] == " ":
            shown = self.space + part[1:]
        else:
            shown = part.encode().decode("latin-1").translate(self.shown)
        ids = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) < self.most:
            self[part] = ids
        return ids


class _Encoder(dict):
    """Ids, as little-endian bytes, of a space and the run that follows it; all from the tokenizers library.

    No token of a byte-level vocabulary of this kind begins before a single space that stands between two
    characters that aren't white space, so a text can be cut there and equal cuts be encoded once. At most
    so many cuts and so many parts are kept: frequent ones come early. When many have come since that were
    not kept, both start anew.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.passed, self.parts = most, 0, _Parts(self.tokenizer.model, most * 3 // 4)

    def plain(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def cut(self, run: str, space: str = " ") -> bytes:
        """Ids of a run, with the space before it or without."""
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Edge
        found = _PARTS(run)
        if "\n\n" in run or sum(map(len, found)) < len(run):
            return self.plain(space + run)
        ids = self.parts[space + found[0]]
        return ids + b"".join(map(self.parts.__getitem__, found[1:])) if len(found) > 1 else ids

    def __missing__(self, run: str) -> bytes:
        ids = self.cut(run)
        if len(self) < self.most:
            if len(run) <= 40:
                self[run] = ids
        else:
            self.passed += 1
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):  # an added token counts wherever it stands, so nothing is cut
            return self.plain(text)
        if self.passed > 6 * self.most:
            self.clear()
            self.parts.clear()
            self.passed = 0
        first, *runs = text.split(" ")
        try:
            return self.cut(first, "") + b"".join(map(self.__getitem__, runs))
        except _Edge:
            return self._joined(text)

    def _joined(self, text: str) -> bytes:
        """The same for a text with spaces beside other white space or at its ends: those stay with a neighbour."""
        runs: list[str] = []
        for r in text.split(" "):
            if runs and r and not r[0].isspace() and runs[-1] and not runs[-1][-1].isspace():
                runs.append(r)
            elif runs:
                runs[-1] += " " + r
            else:
                runs.append(r)
        return self.plain(runs[0]) + b"".join(self.plain(" " + r) if " " in r or r[-1:].isspace() else self[r] for r in runs[1:])


def _encoder(path: str) -> _Encoder:
    """One per Python worker, so that what one task has cut helps the next."""
    return kept("tokens", path, lambda: _Encoder(path))


def _encoded(path: str, end: int):
    def run(batches):
        encoder, tail = _encoder(path), np.array([end], "<i4").tobytes()
        for batch in batches:
            for start in range(0, len(batch), 500):  # few rows at a time: a batch may hold long texts
                part = batch.slice(start, 500)
                ids = [encoder.encode(t) + tail for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), lists], names=["doc_id", "row", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None, end: int = END) -> None:
    """Writes doc_id, row and ids of every row of docs as ORC, in ascending doc_id order, null ids first.

    Rows of one doc_id are ordered by a hash of the text, then the text. row numbers the rows in that
    order, file after file (the file's number in its high bits). Each document ends with the id end; null
    and empty texts have that one only. The content of an added token (such as <|endoftext|>) in a text
    becomes that token, as the library does by default.
    """
    n = partitions or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    x = x.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    x = x.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    x.mapInArrow(_encoded(tokenizer, end), f"doc_id {kind}, row long, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """doc_id, row and ids; with doc_ids, a filter that stripe statistics and Bloom filters can answer
    (a null in it finds nothing). Rows that share an id all come; null ids come only without a filter."""
    rows = spark.read.orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "row", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files; start: ids of all before it.

    Stripes are read in parallel; ids are summed within each file and only one row per file is gathered.
    Rows that share an id, or have none, each have their own start. Texts without a token have the end id
    alone. An empty table gives an empty result.
    """
    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    x = rows.select("doc_id", "row", "ids").mapInArrow(_digests, f"doc_id {kind}, row long, n_tokens long, ids_crc32 long")
    x = written(x.withColumn("_file", F.shiftright("row", 33)), "digests")
    files = x.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy("_file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    x = x.join(files, "_file").withColumn("start", F.col("_o") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return x.select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs written to the shared folder by write(), as index() reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return index(spark, path)
