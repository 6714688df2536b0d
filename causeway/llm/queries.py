"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, embedding_dedup, line_dedup, merkle, piece_codec, quality, secret_scan, simhash, spelling, substring_dedup, toxicity, url_filter
from .common import held_out, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.classify(docs, labels, "toxic", ~held_out("doc_id", 3, 1))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.digest().alias("items_sha256"), "contaminated", F.size("near_items").cast("bigint").alias("n_near"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.classify(docs, labels, "quality", ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold neither fetch days nor lists, so both follow from ids and hosts by a rule; see url_filter.SQL."""
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", (F.col("page_id") * 7919 % 1460).alias("day"))
    keys = captures.select(url_filter.host(F.col("url")).alias("host")).where("host <> ''").distinct().select(F.explode(url_filter.keys(F.col("host"))).alias("key")).distinct()
    r = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("bigint")
    log = keys.select("key", r.alias("r")).where("r % 3 = 0").select("key", F.expr("if((r div 7) % 5 = 0, 'allow', 'block')").alias("list"), "r", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"))
    entries = log.select("key", "list", F.expr("r % 300 + n * (40 + r % 100)").alias("day"), F.expr("n % 2 = 0").alias("added"))
    return url_filter.evaluate(captures, entries, 1459).withColumnRenamed("id", "page_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_decontaminate, op4_simhash, op5_embeddings, op6_line_dedup, op7_bpe, op8_substring_dedup, op9_quality, op10_url_filter, op11_spelling_variants, op12_merkle_manifest, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.SQL, "op10_url_filter": url_filter.SQL, "op11_spelling_variants": spelling.SQL, "op12_merkle_manifest": merkle.SQL}
