"""From raw documents to a deduplicated, mixed and tokenised corpus.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), keeps the columns of ``documents`` (but the last) and
works on everything that its predecessor kept. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from byline.llm import bpe, exact, mixing, ordermin, toxicity
from byline.llm.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay. The classifier learns from the labelled rows of the folder's tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)
    return toxicity.score(docs, model, score_col="_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least doc_id."""
    return ordermin.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(mixing.mixed(docs)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; they are decoded again, and must give the text back."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix), ("bpe", tokenise)]
#: The classifier, the sketches and the tokenizer have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
