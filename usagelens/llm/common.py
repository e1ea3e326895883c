"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null doc_id where ids are compared; such rows sort last.
NO_ID = 2**63 - 1
#: Rows that are turned into Python objects together.
TOGETHER = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with columns that tell rows apart.

    ``_id`` is doc_id with NO_ID for null; ``_row`` hashes the text, so that rows
    that share an id but not a text stay apart. Other columns are left behind,
    whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_row"), "text"
    )


def id_back(column: str = "_id") -> Column:
    """doc_id from ``_id``."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A mapInArrow function from one over a few rows; results of Python objects stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield make(batch.slice(at, TOGETHER))

    return run
