"""A corpus pipeline: language, near duplicates, secrets, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read back as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import langid, mixing, neardup, packing, secrets
from palimpsest.llm.common import discard, documents, stage_table

#: Score from which on a text's predicted language replaces the one that its row bears.
SURE = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without any letter go (null and empty ones too).

    ``lang`` is what the mixture goes by: where it is missing, it is filled with the language predicted, and where the text is in another
    one with a score of ``SURE`` at least, that one replaces it. Where no row has a language, all lettered texts stay as they are.
    Repeated rows are judged each by itself.
    """
    return langid.determined(docs, langid.train(docs), sure=SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id, and one row of each id.

    Texts without words and rows without an id have no copies and stay. All columns stay, whatever their names.
    """
    return neardup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` following the text; null and empty texts stay."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: targets go to sources, and within a source to the languages of the first stage."""
    return mixing.mix(docs, part_col="lang")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack),
]

#: Language models, sketches and tokenizers are beyond SQL; a brute-force version is compared in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        done = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the stage before; the input isn't staged
        docs = done
    return docs
