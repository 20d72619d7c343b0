"""Readers of stored artefacts: delimited, JSON, event streams, trees of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, columns: list[str], line_breaks: bool = True) -> DataFrame:
    """A headed CSV with every value a string; cells may be quoted, hold line breaks and be of any length. A file is one
    task's, as only its start tells where a row begins; where no cell holds a line break, line_breaks=False
    lets large files be split."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, multiLine=line_breaks, quote='"', escape='"', maxCharsPerColumn=-1)


def read_ranked(spark: SparkSession, path: str, top: int) -> DataFrame:
    """Headless rank,domain lines; the first top of them, ranked by their place in the files, whatever they say."""
    x = spark.read.schema("said string, domain string").csv(path)
    x = x.select("domain", line_place().alias("place")).orderBy("place").limit(top)  # top rows
    return x.select(F.row_number().over(W.orderBy("place")).alias("rank"), "domain")


def line_place() -> Column:
    """What orders the lines of text files: file, part of the file, line."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_first_of_each(spark: SparkSession, path: str, columns: list[str], key: str, valid: str) -> DataFrame:
    """Comma-separated lines without a header, a byte order mark before a line or not: the first line of each key
    that fully matches the pattern valid. Lines that the parser rejects are cut at commas instead; surplus
    parts go, missing ones are null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    x = spark.read.schema(f"{schema}, bad string").option("columnNameOfCorruptRecord", "bad").csv(path, quote='"', escape='"')
    parts = F.split("bad", ",")
    x = x.select(line_place().alias("place"), *[F.when(F.col("bad").isNull(), F.col(c)).otherwise(F.get(parts, F.lit(k))).alias(c) for k, c in enumerate(columns)])
    x = x.withColumn(key, F.regexp_replace(key, "^\ufeff", "")).where(F.col(key).rlike(f"^(?:{valid})$"))
    return x.groupBy(key).agg(F.min_by(F.struct(*[c for c in columns if c != key]), "place").alias("r")).select(key, "r.*")


def read_counts(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """name and count of tab-separated lines; # starts a comment, thousands may be grouped by commas.

    Lines whose count is no number are left out, as are counts outside the open range from low to high.
    """
    x = spark.read.schema("name string, count string").csv(path, sep="\t", comment="#")
    x = x.select("name", F.regexp_replace("count", ",", "").try_cast("bigint").alias("count"))
    return x.where((F.col("count") > low) & (F.col("count") < high))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of whole-file JSON arrays."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A record per line; a malformed line fails the read if strict, else it is dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def key_name(name: str) -> str:
    """A field's name in one shape: lower case, runs of other characters than letters and digits as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower().lstrip("\ufeff")).strip("_")


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, JSONL or Parquet by the ending of the path, as one shape: fields are found under any spelling of their
    names (see key_name()), of several the first; missing ones are null."""
    kind, want = path.rsplit(".", 1)[-1].lower(), StructType.fromDDL(schema)
    x = spark.read
    if kind == "csv":
        x = x.csv(path, header=True, quote='"', escape='"')
    else:
        x = x.parquet(path) if kind == "parquet" else x.json(path, mode="DROPMALFORMED", primitivesAsString=True)
    own = {}
    for c in x.columns:
        own.setdefault(key_name(c), c)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    at = lambda f: quoted(own[key_name(f.name)]) if key_name(f.name) in own else F.lit(None)
    return x.select(*[at(f).try_cast(f.dataType).alias(f.name) for f in want.fields])


def read_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The JSON records of a pattern's files, with the name of each one's file."""
    return spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_path"))


def read_tree(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """path and size of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def json_after_noise(text: Column, schema: str) -> Column:
    """The object that begins at the first brace of a text; null if there is none."""
    return F.from_json(F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{"))), schema)


def sitemap_urls(xml: Column, host: Column | None = None, most: int | None = None) -> Column:
    """Distinct values of loc elements, in order; with host only pages of that host (no feeds and sitemaps), with
    most only the first ones."""
    urls = F.transform(F.regexp_extract_all(xml, F.lit("(?s)<loc>(.*?)</loc>"), F.lit(1)), F.trim)
    if host is not None:
        urls = F.filter(urls, lambda u: (F.regexp_extract(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1) == host) & ~F.lower(u).rlike("\\.(xml|rss|atom)$"))
    urls = F.array_distinct(urls)
    return urls if most is None else F.slice(urls, 1, most)


def sse_events(body: Column, schema: str) -> Column:
    """The JSON payloads of a server-sent-event body, in order; other lines and unreadable payloads go."""
    data = F.filter(F.split(body, "\n"), lambda line: F.startswith(line, F.lit("data:")))
    return F.filter(F.transform(data, lambda line: F.from_json(F.trim(F.substr(line, F.lit(6))), schema)), lambda e: e.isNotNull())


# Endings of source files, and folders that hold none.
SOURCE_ENDINGS = "js jsx ts tsx vue svelte html htm css scss sass less md mdx qmd liquid njk ejs hbs handlebars jinja jinja2 j2 erb php".split()
NO_SOURCES = "node_modules .git dist build .next .nuxt __pycache__ .pytest_cache .venv venv env vendor bower_components .cache coverage".split()


def is_source(path: Column) -> Column:
    """Whether a path names a source file to be read: by its ending, outside certain folders, not minified."""
    name = F.substring_index(path, "/", -1)
    ending = F.regexp_extract(F.lower(name), "[^.]\\.([^.]+)$", 1)
    outside = ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NO_SOURCES)))
    return ending.isin(SOURCE_ENDINGS) & outside & ~F.contains(name, F.lit(".min."))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and content (text) of the source files below a folder. Empty files, and those whose names begin with
    a dot or an underscore, are not listed by Spark's readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(is_source(F.col("path"))).select("path", F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))
