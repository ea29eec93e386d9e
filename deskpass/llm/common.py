"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpass.session import scratch_path

BATCH_BYTES = "32m"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage on storage that all executors share, so a lost executor costs
    no recomputation of what came before, and gives later plans true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch that a Python task holds (long texts), where Spark offers it."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch",):
        try:
            spark.conf.set(key, BATCH_BYTES)
        except Exception:  # noqa: BLE001  older Spark without the setting
            return


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def col(name: str):
    """A column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
