"""Language ID: cosine to the nearest of several centroids per language, over TF-IDF of hashed n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import written
from ._words import texts

#: Labelled rows of each language that the fit reads, as a share of them by a hash of the row: all where there are fewer.
SAMPLE = 400
#: Languages up to this number are broadcast with their sizes.
MOST_LANGUAGES = 10_000
CENTROIDS = 4
ROUNDS = 12
BINS = 4096
#: A document farther from all centroids than this share of the training documents is marked rejected.
REJECT = 0.001

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


def grams(data: np.ndarray) -> np.ndarray | None:
    """Counts of hashed byte trigrams and bigrams, case and ASCII non-letters folded; None without a letter."""
    x = _FOLD[data]
    if not (x != 32).any():
        return None
    if (x >= 128).any():
        if not (x[x < 128] != 32).any() and not any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace")):
            return None
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two ^ np.uint32(0x5BD1E995), three])
    return np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=BINS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-12)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject: float  # least cosine that is not rejected


def training(docs: DataFrame, use: Column) -> DataFrame:
    """text and lang of about SAMPLE documents of each language for which use holds.

    Which ones follows from a hash of id and text, so that texts are filtered where they are read and only
    those chosen move. Of a language with no more than SAMPLE all are taken; equal rows count once.
    """
    h = F.xxhash64("doc_id", "text")
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & use)
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("_n")), "languages")
    few = sizes.count() <= MOST_LANGUAGES
    rows = rows.select("lang", "text", h.alias("_h")).join(F.broadcast(sizes) if few else sizes, "lang")
    rows = rows.where((F.col("_n") <= SAMPLE) | (F.pmod("_h", F.lit(1 << 40)) * F.col("_n") < F.lit(float(SAMPLE << 40))))
    return rows.dropDuplicates(["lang", "_h"]).select("lang", "text")


def _vectors(batches):
    for batch in batches:
        lang, out = [], []
        for name, data in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            c = grams(data)
            if c is not None:
                lang.append(name)
                out.append(c.astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.list_(pa.float32()))], names=["lang", "counts"])


def _clusters(idf: np.ndarray):
    """Spherical k-means of one language's sample; farthest-first seeds from the mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = tfidf(np.stack(pdf["counts"].to_numpy()), idf)
        x = x[np.lexsort(x.T[:8])]
        seeds = [x.mean(0)]
        for _ in range(min(CENTROIDS, len(x)) - 1):
            seeds.append(x[np.max(x @ np.stack(seeds).T, axis=1).argmin()])
        c = np.stack(seeds)
        for _ in range(ROUNDS):
            c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
            own = (x @ c.T).argmax(1)
            c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
        near = float(np.quantile((x @ c.T).max(1), REJECT))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [v.tolist() for v in c.astype(np.float32)], "near": near})

    return run


def fit(sample: DataFrame) -> Model:
    """Centroids from rows of text and lang; SAMPLE bounds each language's rows, CENTROIDS what is collected."""
    v = written(sample.select("lang", "text").mapInArrow(_vectors, "lang string, counts array<float>"), "samples")
    n = v.count()
    df = np.zeros(BINS)
    for r in v.select(F.posexplode("counts").alias("k", "c")).where("c > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["k"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 1
    rows = v.groupBy("lang").applyInPandas(_clusters(idf), "lang string, centroid array<float>, near double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, BINS))
    return Model([r["lang"] for r in rows], centroids, idf, min((r["near"] for r in rows), default=0.0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected of every row of docs.

    Whole texts are read, one row at a time, without a shuffle. A null text or one without a letter is
    und with score 0; so is every text if nothing was learned. rejected marks documents farther from
    every centroid than REJECT of the training documents were. Of equally near centroids the first language
    in order counts. Ids may be null or repeat: each row has
    its own result. An empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        langs = np.array(model.langs + ["und"], object)
        for batch in batches:
            name, score = [], []
            for data in texts(batch.column("text")):
                c = grams(data) if len(data) and len(model.langs) else None
                if c is None:
                    name.append("und")
                    score.append(0.0)
                    continue
                near = model.centroids @ tfidf(c, model.idf)
                k = int(near.argmax())
                name.append(langs[k])
                score.append(float(min(1.0, max(0.0, near[k]))))
            away = [n == "und" or s < model.reject for n, s in zip(name, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(away, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
