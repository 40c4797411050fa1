"""The training-data pipeline over ``documents``: each stage applies one operator to all its predecessor kept.

Filtering stages drop the documents they reject and keep the others as they are; rows without a ``doc_id`` can't be named
in a decision and stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.jaccard_join import drop_near_duplicates
from tideframe.llm.language_id import identify, suffix_of
from tideframe.llm.packing import pack
from tideframe.llm.shared import small, stored
from tideframe.llm.substring_dedup import remove_repeats
from tideframe.llm.toxicity import toxicity_scores
from tideframe.llm.training import fold


def _without(docs: DataFrame, decisions: DataFrame, rejected: str, name: str) -> DataFrame:
    gone = stored(decisions.where(rejected).select("doc_id").distinct(), name)
    return docs.join(small(gone, 16), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; null and empty texts, and texts without letters, go."""
    found = identify(docs, "text", F.col("lang"), F.col("source"), suffix_of(F.col("source")))
    return _without(docs, found, "rejected", "rejected-languages")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labelled ones outside the held-out fold.

    Without any labelled document nothing can be told from anything, so all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 4) != 2)).isEmpty():
        return docs
    return _without(docs, toxicity_scores(docs, labels, fold("doc_id", 4) != 2), "predicted = 1", "rejected-toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, 0.8).

    Empty texts have no duplicates and stay; rows that repeat a kept id stay.
    """
    return drop_near_duplicates(docs, 5, 80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages of 50 words or more that a document of a smaller id has too.

    A text that loses nothing stays as it is; of the others the kept words are joined by one space.
    """
    out = remove_repeats(docs, 50, carry=tuple(c for c in docs.columns if c != "doc_id"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens; a null text is the end id alone."""
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 1024, 2)


STAGES = [("language ID", language), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("best-fit packing", packing)]

#: SQL can't express the trained stages. tests/llm/test_pipeline_rows.py holds each stage's rows on a small table: near
#: duplicates, passages and pieces against plain Python, languages against planted junk, toxicity against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what one returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
