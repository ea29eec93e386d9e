"""Joins and set operations.

Small dimension tables (four categories) are broadcast because their size is
fixed. Every other join is left to the planner: AQE turns it into a broadcast
only when the runtime size is under the threshold, and splits skewed
partitions of the large side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpass.schema import CATEGORIES


def join_back(preds: DataFrame, rows: DataFrame, key: str = "request_id") -> DataFrame:
    """Predictions joined to their original rows by an explicit id."""
    return preds.join(rows, key, "inner")


def skip_rejected(arrivals: DataFrame, rejected: DataFrame, key: str = "request_id") -> DataFrame:
    """Drop arrivals whose id was already rejected (anti join on the id only)."""
    return arrivals.join(rejected.select(key).distinct(), key, "left_anti")


def valid_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string")


def keep_valid(df: DataFrame, valid: DataFrame, col: str = "category") -> DataFrame:
    """Semi join to a table of valid values; Spark broadcasts it by its size."""
    v = valid.select(F.col(valid.columns[0]).alias("__valid"))
    return df.join(v, F.col(col) == F.col("__valid"), "left_semi")


def append_rows(log: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows to a log by column name (missing columns become null)."""
    return log.unionByName(new, allowMissingColumns=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Extend a list of documents across readers."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per distinct text, keeping the lowest id, with the number of copies.

    Grouped on a SHA-256 of the text, so the shuffle carries 32-byte keys, not
    whole texts; ``min``/``count`` combine map-side, so one very common text
    does not load a single task.
    """
    return (docs.groupBy(F.sha2(F.col(text), 256).alias("__h"))
            .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
            .drop("__h"))
