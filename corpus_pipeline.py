"""A training-data pipeline over `documents`, in stages that are written as Parquet and read again.

Toxic documents go, one document of each near-duplicate class stays, personal data gets surrogates, the
sources are mixed to their targets, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import jaccard, mixing, packing, pii, toxicity
from pointmill.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that compression distance calls toxic; learns from labels of its own documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # names that no column of documents has, so that none is replaced
    scored = toxicity.score(docs, model, score_col="__toxicity", predicted_col="__toxic")
    return scored.where(F.col("__toxic") == 0).drop("__toxicity", "__toxic")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of the n-gram Jaccard join."""
    return jaccard.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text; n_chars, where the table has it, follows the new text."""
    done = pii.replace_pii(docs, pii.session_key(spark))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(dict(docs.dtypes).get("n_chars", "int"))}
    return done.select(*[new.get(c, F.col("r")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target sizes."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document, cut where longer than a sequence, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression lengths and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
