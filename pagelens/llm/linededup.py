"""Line dedup by winnowing: fingerprints of line runs, joined positions, matches followed both ways to all earlier places."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ._common import SPACE, WORD, written

#: A fingerprint stands for the shortest run of whole lines with at least this many words.
GRAM = 20
#: Of the grams that begin within so many words, the one with the least hash is a fingerprint. A run of
#: GRAM + SPAN - 1 = 25 words or more then always holds one.
SPAN = 6
#: Words of a repeated run at least; shorter ones stay.
LEAST = GRAM + SPAN - 1

_ROW = ["doc_id", "_h"]


def _runs(docs: DataFrame) -> DataFrame:
    """For each line with a word the shortest runs of whole lines with LEAST words that begin and that end with it:
    run (hashes), a and b (first and last line), and g, the fingerprint that the run holds.

    A line's own gram is the shortest run from it with GRAM words; of the grams that begin within SPAN words of
    a line, the one with the least hash is the fingerprint which the line selects. It lies within LEAST words,
    so within the run that begins with the line, and within any longer one.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.regexp_replace("line", f"^{SPACE}+|{SPACE}+$", "")
    lines = lines.select(*_ROW, "pos", F.xxhash64(line).alias("x"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).where("n > 0")
    # rows with one id and text are one document; all that follows stays within these partitions
    lines = lines.repartition(n, *_ROW).dropDuplicates([*_ROW, "pos"])
    doc = W.partitionBy(*_ROW)
    lines = lines.withColumn("to", F.sum("n").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.col("to") - F.col("n"))
    ahead = lambda k: doc.orderBy("at").rangeBetween(0, k - 1)
    lines = lines.withColumns({"gram": F.collect_list("x").over(ahead(GRAM)), "held": F.max("to").over(ahead(GRAM)) - F.col("at"), "next": F.collect_list("x").over(ahead(LEAST)), "end": F.max(F.struct("to", "pos")).over(ahead(LEAST))})
    own = F.when(F.col("held") >= GRAM, F.struct(F.xxhash64("gram").alias("g1"), "pos"))
    lines = lines.withColumn("own", own).drop("gram").withColumn("g", F.min("own").over(ahead(SPAN)))
    back = doc.orderBy("to").rangeBetween(1 - LEAST, 0)
    lines = lines.withColumns({"last": F.collect_list("x").over(back), "begin": F.first(F.struct("at", "pos", "g")).over(back)})
    name = lambda c, seed: F.struct(F.xxhash64(F.lit(seed), c).alias("r1"), F.xxhash64(F.lit(seed + 2), c).alias("r2"))
    first = F.when(F.col("end.to") - F.col("at") >= LEAST, F.struct(name("next", 0).alias("run"), F.col("pos").alias("a"), F.col("end.pos").alias("b"), "g"))
    second = F.when(F.col("to") - F.col("begin.at") >= LEAST, F.struct(name("last", 1).alias("run"), F.col("begin.pos").alias("a"), F.col("pos").alias("b"), F.col("begin.g").alias("g")))
    return lines.select(*_ROW, F.explode(F.array_compact(F.array(first, second))).alias("e")).select(*_ROW, "e.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text) and ranges: first and last numbers of the runs of lines that repeat earlier ones.

    Positions of equal fingerprints are joined first, which leaves few runs: of those around a fingerprint
    that stands at several places, a run is deleted if it is found at any earlier place. What a match holds
    beyond a fingerprint, either way, is covered by runs that begin or end with each of its lines.
    """
    found = written(_runs(docs.select("doc_id", "text").where(F.col("text").isNotNull())), "line-runs")
    spot = F.struct(*_ROW, F.col("g.pos").alias("pos"))
    marks = found.groupBy(F.col("g.g1").alias("g1")).agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("g1")
    near = found.withColumn("g1", F.col("g.g1")).join(marks, "g1", "left_semi").select(*_ROW, "run", "a", "b")
    place = F.struct(*_ROW, "a")
    first = near.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("run", "first")
    later = near.join(first, "run").where(place != F.col("first")).select(*_ROW, "a", "b").distinct()
    # runs that meet become one range
    doc = W.partitionBy(*_ROW).orderBy("a", "b")
    later = later.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    later = later.withColumn("island", F.sum("new").over(doc))
    ranges = later.groupBy(*_ROW, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return ranges.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated line runs deleted from text, and n_removed_lines added; all rows and columns stay.

    Documents are ordered by doc_id (null first), then by a hash of the text. Lines are cut at \\n and compared
    without white space at their ends; those without a word are neither counted nor deleted. A line is
    deleted exactly if it lies in a run of whole lines, with LEAST words or more, that is found at an earlier
    place too, in the same document or another one. So a deleted line equals one that stands earlier, the
    earliest copy of a line is never deleted, and shorter repeated runs stay. Rows with equal id and text
    count as one document and all get its result. Null texts stay null, empty ones empty; a text of which
    every line repeats becomes empty. An empty table gives an empty result. A column named n_removed_lines
    is replaced; names of other columns do not matter, as rows are carried whole.
    """
    gone = repeated_lines(docs)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("_h").alias("gone_h"), F.col("ranges").alias("gone"))
    cols = [c for c in docs.columns if c != "n_removed_lines"]
    x = docs.select(F.struct(*cols).alias("row"))
    x = x.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("row.text") == F.col("gone_h")), "left")
    before = lambda k: F.coalesce(F.get("gone", k - 1)["b"], F.lit(-1))
    many = lambda flag, k: F.array_repeat(F.lit(flag), k)
    drops = F.flatten(F.transform("gone", lambda r, k: F.concat(many(False, r["a"] - before(k) - 1), many(True, r["b"] - r["a"] + 1))))
    word = WORD.rstrip("+")
    left = F.array_compact(F.zip_with(F.split("row.text", "\n"), drops, lambda line, drop: F.when(~F.coalesce(drop, F.lit(False)) | ~line.rlike(word), line)))
    x = x.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.split("row.text", "\n")) - F.size("left"))
    return x.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in cols], removed.alias("n_removed_lines"))
