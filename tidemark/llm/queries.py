"""Registered queries of the text operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (crossalign, decontaminate, htmltext, language, licenses, orderhash, packing,
               prefixtrie, quality, secrets, simhash, toxicity, urlfilter)
from .common import table

LANGUAGE_VOCABULARY = "piece_bpe_32k.model"
PACKING_VOCABULARY = "byte_bpe_50k.json"


def _remainder(k: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path(PACKING_VOCABULARY))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_order_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, sf_dir, "documents"))


def language_labels(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", *(columns or ("text",)), "lang").filter(
        F.coalesce(_remainder(4) != 2, F.lit(False)))


def language_model(docs: DataFrame) -> language.Model:
    return language.train(language_labels(docs), public_tokenizers.path(LANGUAGE_VOCABULARY))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").filter(_remainder(5) != 0).select("doc_id", "quality")
    found = quality.score(docs, quality.train(docs, known))
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"),
                        "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").filter(_remainder(3) != 1).select("doc_id", "toxic")
    found = toxicity.find(docs, toxicity.train(docs, known))
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"),
                        "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                        "n_toxic", "spans")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossalign.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_VOCABULARY),
        public_tokenizers.path(LANGUAGE_VOCABULARY))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_main_text, op2_secret_scan, op3_decontaminate, op4_url_filter, op5_licenses, op6_pack,
        op7_simhash, op8_order_hash, op9_language, op10_quality, op11_toxicity, op12_token_links,
        op13_prefix_trie)
}
ORACLE: dict[str, str] = {}
