"""A corpus prepared in five stages, each an operator of kadastra.llm: quality, near-duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents. Nulls, empty texts and empty tables are handled as the operators say.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.bpe import encode_documents
from kadastra.llm.common import shared_folder
from kadastra.llm.mixing import mix, word_count
from kadastra.llm.pii import find_personal_data, train_model
from kadastra.llm.ranking import score_documents, train_quality
from kadastra.llm.vptree import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the given labels."""
    return score_documents(docs.select(*COLUMNS), train_quality(spark, sf_dir), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the least doc_id; rows that share it are one."""
    return keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    return find_personal_data(docs, train_model(docs), redacted=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the rates are rounded to copies, and copies are rows."""
    sized = mix(docs.select(*COLUMNS), word_count(F.col("text")))
    return sized.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and hashes of the ids and of the decoded bytes of each row."""
    return encode_documents(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier, the components and the entropy balance can't be stated in SQL; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents; each result is written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
