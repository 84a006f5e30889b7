"""Five stages from raw documents to tokenised ones, each written as Parquet and read again as the next one's input.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document (the smallest doc_id) of each class of near-duplicates stays.
3. decontamination: benchmark passages are cut out; a document that is mostly such passages goes.
4. secrets: secrets are replaced by a mask.
5. tokens: the texts as byte-level BPE ids, with digests of ids and of what they decode to.

SQL cannot express the trained classifier nor the tokeniser, so ORACLE_SQL is None; the tests hold run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import byte_bpe, decontaminate, quality, secrets, simhash
from kmerloom.llm.common import fresh_path, scratch, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go. Null, empty and blank texts get what the model's bias says; ids do not matter."""
    return quality.keep_good(docs, quality.model_of(spark, sf_dir))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, null and blank texts being one class; repeated and null ids join no classes."""
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and blank texts hold no passages and stay; with an empty benchmark all stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; null texts stay null."""
    return secrets.redact(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have no ids."""
    return byte_bpe.digests(docs)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("tokens", _tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        # what a stage writes on its way goes once its result is written
        with scratch(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
