"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns packed pieces. Stages
are written as Parquet to the shared folder and read again, so a lost executor costs a stage's tasks and never the run.

* language: documents without a language go (no text or no letter); a missing ``lang`` is filled with the predicted one
* near duplicates: one document of each group stays, the one with the smallest doc_id (five-word shingles, 0.8)
* decontamination: words of benchmark items leave the text with what stands between them, documents stay
* personal data: spans are replaced by their kind in angle brackets, documents stay
* packing: pieces of at most 2048 tokens in as few sequences as the rounds find, each with its ids (little-endian unsigned
  32-bit) beside their checksum

``n_chars`` follows a changed text. Null texts go in the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import decontamination, language, near_duplicates, packing, pii
from memberlens.llm.queries import table, vocabulary
from memberlens.sources.tables import stored

#: No SQL: two stages are learned models and one packs by rounds. tests/llm compares with a plain version.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = language.predict(docs, language.fit(docs), keep=tuple(docs.columns)).where(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(docs, keep=tuple(docs.columns))
    return found.where("kept").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns),
                                          change=decontamination.without_spans)
    return counted(found).select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(docs, pii.fit(docs), keep=tuple(docs.columns), change=pii.masked)
    return counted(found).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(docs, vocabulary("word_bpe_49k.json"))


def counted(found: DataFrame) -> DataFrame:
    """``n_chars`` follows the texts that were changed, those with spans."""
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
