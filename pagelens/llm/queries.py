"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, embeddings, extraction, language, linededup, minhash, mixing, pieces, pii, quality, resampling, tokens, toxicity
from ._common import held_out, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(5, 0)
    grammar = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), ~out))
    return toxicity.score(docs, grammar).withColumn("held_out", out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(3, 1)
    return language.predict(docs, language.fit(language.training(docs, ~out))).withColumn("held_out", out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixing, op3_pii, op4_language, op5_quality, op6_embeddings, op7_minhash, op8_pieces, op9_tokens, op10_linededup, op11_resampling, op12_divergence, op13_extraction)
}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLE_SQL: dict[str, str] = {
    "op5_quality": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
 n AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY 1),
 m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words,
   len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM w LEFT JOIN n USING (doc_id)),
 f AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20
  AND n_symbols / word_chars <= 0.3 AND n_stop / n_words >= 0.005 AND n_dup_lines / len(l) <= 0.5 AS kept FROM f""",
    "op11_resampling": r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
 dw AS (SELECT r, unnest(w) AS x FROM d),
 bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
 v AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION ALL SELECT x FROM bw)),
 b AS (SELECT x, xor(list_reduce(list_transform(range(1, len(h), 2), lambda k: ('0x' || h[k:k + 1])::UBIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket FROM v, crc),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (x) GROUP BY 1),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
 m AS (SELECT r, sum(gain)::BIGINT AS g FROM dw JOIN b USING (x) JOIN g USING (bucket) GROUP BY 1),
 z AS (SELECT doc_id, r, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (m.g - ((m.g % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
   floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS luck FROM d LEFT JOIN m USING (r)),
 o AS (SELECT *, weight + luck AS score, n_features >= 20 AS fit FROM z),
 p AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY weight + luck DESC, doc_id) AS k, count(*) FILTER (fit) OVER () * 10 // 100 AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= n THEN k END AS rank FROM p""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
 c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 s AS (SELECT DISTINCT lang, source FROM d),
 a AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 g AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p FROM a JOIN v USING (lang)),
 l AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 2 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2) JOIN v USING (lang)),
 f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
 e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM s x JOIN s y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM g JOIN l USING (lang, term) WHERE n > 0 AND p > q),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM e)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10""",
}
