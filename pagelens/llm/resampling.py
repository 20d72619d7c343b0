"""Importance resampling towards a target text: hashed n-gram buckets, gains of buckets, Gumbel ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ._common import prefix_sums, written

#: A word, once A-Z are lower-cased (Java regex).
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of features; also the most rows that the broadcast table of gains can have.
BUCKETS = 10_000
#: Longest run of words that is a feature, per cent of the eligible documents drawn, their least words, seed.
GRAMS, SHARE, LEAST, SEED = 1, 10, 20, 2024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def _buckets(w: Column, grams: int) -> Column:
    """The bucket of every run of 1 to grams words, repeats counted."""
    if grams == 1:
        return F.transform(w, lambda x: F.crc32(x) % BUCKETS)
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))
    some = [F.when(F.size(w) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, grams + 1)]
    return F.transform(F.concat(*some), lambda x: F.crc32(x) % BUCKETS)


def bucket_counts(texts: DataFrame, grams: int = GRAMS) -> DataFrame:
    """How many features of column text fall into each bucket: columns bucket and n."""
    found = texts.select(F.explode(_buckets(words(F.col("text")), grams)).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS) -> DataFrame:
    """Columns bucket and gain: 1000 times the log ratio of target share and own share, each with one count
    more a bucket, rounded down. Only buckets that docs use; at most BUCKETS rows."""
    own, want = written(bucket_counts(docs, grams), "bucket-counts"), bucket_counts(target, grams)
    both = own.withColumnRenamed("n", "s").join(want.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["t"])
    sums = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).join(want.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("s_all") + BUCKETS) / ((d("s") + 1) * (d("t_all") + BUCKETS))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # sums is one row


def scored(docs: DataFrame, target: DataFrame, grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs.

    The text is read twice: for the counts of buckets, and for the sum of gains. Features are joined with
    the table of gains (at most BUCKETS rows) where they are made, and summed by row before any shuffle.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("_w"))
    rows = rows.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), _buckets(F.col("_w"), grams).alias("_b"))
    rows = rows.select("doc_id", "_row", "n_words", F.size("_b").cast("long").alias("n_features"), F.explode_outer("_b").alias("bucket"))
    rows = rows.join(F.broadcast(gains(docs, target, grams)), "bucket", "left")
    sums = rows.groupBy("_row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("_g"))
    n = F.col("n_features")
    weight = F.when(n == 0, F.lit(0).cast("long")).otherwise(((F.col("_g") - F.pmod(F.col("_g"), n)) / n).cast("long"))  # exact
    return sums.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + luck).alias("score"))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null unless the document is drawn.

    A document's weight is the floored mean gain of its features (0 without any), its score adds a Gumbel
    draw keyed by seed and doc_id, so that the highest scores are a sample in proportion to the weights,
    without replacement. Of documents with at least `least` words, share per cent are drawn; ties go to
    smaller doc_id, then to more features and higher weight. Ranks come from range partitions, each offset
    by the rows before it, so no task sorts all rows.

    Null texts have no word and no feature, and are never drawn; a null doc_id is keyed as empty text and
    sorts first. Rows with equal ids are rows of their own. An empty target has no feature in any bucket.
    An empty table gives an empty result. Columns of docs other than doc_id and text are not read.
    """
    rows = written(scored(docs.select("doc_id", "text"), target.select("text"), grams, seed), "scores")
    fit = F.col("n_words") >= least
    places = prefix_sums(rows.where(fit).withColumn("_one", F.lit(1).cast("long")), [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight")], {"_before": "_one"})
    drawn = rows.agg(F.expr(f"coalesce(sum(cast(n_words >= {least} AS long)), 0) * {share} div 100").alias("_drawn"))
    rank = F.when(F.col("_before") < F.col("_drawn"), (F.col("_before") + 1).cast("long"))
    ranked = places.join(F.broadcast(drawn)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))  # one row
    rest = rows.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
