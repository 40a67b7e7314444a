"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_counts, dominance, langid, licenses, media, mixing, neardup, packing, quality, secrets, substrings, topk, vectorcodes
from .common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return topk.search(docs, asked)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(spark.read.parquet(f"{sf_dir}/sales.parquet"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_quality, op3_topk_search, op4_media, op5_pack, op6_near_duplicates, op7_language, op8_licenses, op9_mix, op10_token_counts, op11_vector_codes, op12_dominance, op13_substrings)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": topk.SEARCH_SQL, "op9_mix": mixing.REPORT_SQL, "op11_vector_codes": vectorcodes.CODES_SQL, "op12_dominance": dominance.SALES_SQL, "op13_substrings": substrings.REPORT_SQL}
