"""The corpus pipeline: documents in, token ids out.

Each stage reads what its predecessor kept, written as Parquet, and all but the last return the columns of
documents. A document's n_chars follows its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, minhash, mixing, pii, toxicity
from gridlake.llm.common import cut, table
from gridlake.llm.queries import SHARE, WEIGHTS, importance, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut. The model learns from the labelled documents of the input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return minhash.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(docs, WEIGHTS, SHARE, importance=importance())
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.select(*docs.columns, copies.alias("_copy")).drop("_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 of each row."""
    return bpe.encode_documents(docs, vocabulary(), results=["ids", "n_tokens", "ids_sha256"])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: No SQL for the pipeline: it learns models and aligns texts. Tests hold it against a stage by stage version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
