"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Null and empty texts pass every stage: they are not toxic, hold no line, link with nothing, weigh no word and
have no pieces. Of repeated rows one stays (minhash stage), but all without a word. Empty tables give empty
results. Columns keep their names and values up to the last stage, but for text and n_chars, which follow
what line dedup deletes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.llm import linededup, minhash, mixing, pieces, toxicity
from pagelens.llm._common import held_out, shared_dir, table
from pagelens.llm.queries import tokenizer_file


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not predict toxic; it is learned as in op1_toxicity."""
    grammar = toxicity.fit(toxicity.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(5, 0)))
    return toxicity.clean(docs, grammar)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without line runs that stand earlier in the corpus."""
    out = linededup.line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document as sentence pieces, with merge-dropout."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash", minhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Learned scores, minwise buckets and keyed hashes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, every stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
