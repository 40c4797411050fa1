"""Bounded, deterministic samples of labelled documents, and models trained in one task of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents that ``use`` admits: those with the smallest id hashes.

    Labels other than 0 and 1 are ignored; of the rows that repeat an id the smallest text counts, once for each label it
    has. Only ids and labels are ordered; the at most ``most`` chosen ones are broadcast to the texts.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).where(use & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    chosen = rows.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def train(sample: DataFrame, featurise: Callable, fit: Callable, schema: str) -> bytes | None:
    """Featurise in all tasks, fit in one: ``fit`` gets the features of the bounded sample and gives the model as bytes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        rows = pa.Table.from_batches(found) if found else None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], ["model"])

    found = sample.mapInArrow(featurise, schema).repartition(1).mapInArrow(job, "model binary").first()
    return bytes(found["model"]) if found else None
