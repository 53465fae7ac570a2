"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplane.llm import bpe, html, licenses, lines, media, minhash, mixture, packing, periodic, pii, quality, urls, whitening
from strataplane.llm.common import table, words


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.drop_boilerplate(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = f"""
WITH page AS (SELECT DISTINCT coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
seen AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT DISTINCT host, t, unnest(string_split(t, chr(10))) AS line FROM page)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY host, line),
bad AS (SELECT host, list(line) AS lines FROM seen JOIN total USING (host) WHERE n >= {lines.LEAST_PAGES} AND n > {lines.RATIO} * pages GROUP BY host),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS own,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad.lines, []), x)) AS kept
  FROM documents LEFT JOIN bad ON coalesce(source, '') = host)
SELECT doc_id, coalesce(len(own), 0)::BIGINT AS n_lines, coalesce(len(own) - len(kept), 0)::BIGINT AS n_dropped,
       length(array_to_string(kept, chr(10)))::BIGINT AS n_chars, sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM cut
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each licence paragraph of ``documents``."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.read(media.store(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.UNIT, media.UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; each window holds the sources in their share of all tokens."""
    docs = table(spark, sf_dir, "documents")
    return mixture.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every usable row of ``embeddings``."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): words joined by one space; in a tenth of the documents, by doc_id, a tail repeats a stretch of the text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    own = own.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    a = F.expr("g % greatest(n, 1)")
    own = own.withColumn("a", a).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))])")
    return own.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), tail).otherwise(F.col("w")), " ").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, their longest one, and digests of the runs and of the text without repeats."""
    got = periodic.find(with_repeats(table(spark, sf_dir, "documents")))
    top = periodic.longest(F.col("runs"))
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_lossless_webp": op7_lossless_webp,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filters": op9_url_filters,
    "op10_quality_rules": op10_quality_rules,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE = {"op4_line_dedup": OP4_SQL}
