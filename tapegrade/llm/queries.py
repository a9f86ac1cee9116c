"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_pieces, license_scan, minhash, mixing, multi_index, ngram_jaccard, quality_model, quality_rules, suffix_dedup, token_alignment, toxicity, url_filter, whitening


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(table: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet")


documents, embeddings, pages, labels = map(_read, ("documents", "embeddings", "pages", "labels"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(pages(spark, sf_dir), url_filter.RULES)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_rows(embeddings(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_bpe_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pieces.round_trips(documents(spark, sf_dir), tokenizer_path())


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_known", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), "license")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.score_documents(docs, quality_model.train(docs, labels(spark, sf_dir)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path(), sides="|", between=";")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=80, width=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_url_filters, op3_multi_index, op4_mixing, op5_bpe_pieces, op6_ngram_jaccard, op7_toxicity, op8_license_scan, op9_quality_rules, op10_quality_model, op11_token_alignment, op12_whitening, op13_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filter.ORACLE, "op8_license_scan": license_scan.oracle(), "op9_quality_rules": quality_rules.ORACLE}
