"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeledger.llm import decontaminate, language, nearcopies, packing, pii, simhash
from homeledger.llm.text import fold
from homeledger.session import materialize

# Documents without a letter, or whose likeliest language is less likely than this, are rejected. Short and
# mixed texts in a known language score higher.
MIN_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found; a null or letterless text has none."""
    model = language.fit(docs.filter(fold("doc_id", 3) != 1))
    found = language.predict(docs, model, docs.columns)
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, that of the smallest id."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; keeps every document."""
    return pii.redact(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what shares four fifths of its five-word shingles with a document that stays.

    Such copies mostly differ in more bits than a SimHash group allows. The texts are compared as they are packed, with
    personal data replaced; a dropped test item takes no clean copies with it, as the stages before settle it.
    """
    return nearcopies.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises the documents and packs them; one row per piece of a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("near_copies", near_copy_stage),
    ("packing", packing_stage),
]

# Models, fingerprints and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
