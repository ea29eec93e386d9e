"""File sources and sinks.

Paths are Spark paths (local, HDFS or object store). Writers never overwrite
a path that the same plan reads: they write a fresh folder and return it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.functions.render import to_json_line
from deskpass.schema import BATCH_LOG, CONVERSATION_LOG, REQUESTS


# CSV dialect of the decision log: header row, nulls as \\N so that an empty
# reject reason ('') and a missing one (null) survive a round trip. Line breaks
# are written as ~n and ~r (and ~ as ~t), so every record is one line and large
# files can be split when they are read.
CSV_OPTIONS = {"header": "true", "nullValue": "\\N", "escape": '"'}
_BREAKS = [("~", "~t"), ("\n", "~n"), ("\r", "~r")]


def _strings(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            for old, new in pairs:
                c = F.replace(c, F.lit(old), F.lit(new))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_log(spark: SparkSession, path: str | list[str], schema: T.StructType = BATCH_LOG) -> DataFrame:
    """Read decision rows written as CSV in the log's dialect (see ``decision_log``)."""
    return _strings(spark.read.schema(schema).options(**CSV_OPTIONS).csv(path), [(b, a) for a, b in _BREAKS[::-1]])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType = REQUESTS, header: bool = True, **options: str) -> DataFrame:
    """Request history with a declared schema (no inference). CSV fields may hold quotes (doubled) and line breaks."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = r.option("header", header).option("escape", '"').option("multiLine", True)
    return r.options(**options).format(fmt).load(path)


def _as_text(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.col("modificationTime").alias("modified_at"),
                      F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def _binary(spark: SparkSession, folder: str, glob: str, recursive: bool = True) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", recursive).load(folder))


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """A folder of text documents, one row per file: (path, modified_at, text).

    Files are read as bytes, so ``path`` is the same plain path as in
    ``file_listing`` (spaces, ``%`` and non-ASCII names included). ``text`` is
    null for a file that is not UTF-8; ``read_with_errors`` (S13) reports it. A
    file that can't be read at all fails the job here, and is reported there.
    """
    return _as_text(_binary(spark, folder, glob, recursive))


def file_listing(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(path, modified_at) of every matching file, without reading contents."""
    return _binary(spark, folder, glob).select("path", F.col("modificationTime").alias("modified_at"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """S3: files that are new or modified since the manifest (path, modified_at)."""
    m = manifest.select(F.col("path").alias("__p"), F.col("modified_at").alias("__m"))
    j = files.join(m, files.path == m.__p, "left")
    return j.filter(F.col("__m").isNull() | (F.col("modified_at") > F.col("__m"))).drop("__p", "__m")


def update_manifest(manifest: DataFrame, loaded: DataFrame, version: int = 0) -> DataFrame:
    """S3: manifest after loading ``loaded`` in run ``version`` (latest time per path and the run that loaded it)."""
    new = loaded.select("path", "modified_at", F.lit(version).alias("version"))
    both = manifest.select("path", "modified_at", "version").unionByName(new)
    return (both.groupBy("path").agg(F.max(F.struct("modified_at", "version")).alias("x"))
            .select("path", "x.modified_at", "x.version"))


def append_decisions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows; each job commits its own files (no lost updates)."""
    df.write.mode("append").format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """JSON Lines, non-ASCII kept, nulls written as null."""
    cols = cols or df.columns
    df.select(to_json_line(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def write_conversations(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Conversation log partitioned by day key (one folder per day). A day's rows meet in one task (several, if they
    are many), so files grow with the days and bytes written, not with tasks times days."""
    (df.withColumn("log_date", F.date_format(F.col(ts), "yyyyMMdd")).hint("rebalance", "log_date")
     .write.mode("append").partitionBy("log_date").json(path))


def load_conversations(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Read the log back; of a single day only its folder is listed."""
    schema = T.StructType(CONVERSATION_LOG.fields + [T.StructField("log_date", T.StringType())])
    reader = spark.read.schema(schema)
    if day is None:
        return reader.json(path)
    own = f"{path.rstrip('/')}/log_date={day}"
    if not _exists(spark, own):
        return reader.json(path).filter(F.col("log_date") == day)  # a day without rows: its folder is pruned away
    return reader.option("basePath", path).json(own).filter(F.col("log_date") == day)


def save_index(index: DataFrame, path: str) -> None:
    """Persist the vector index (chunk_id, text, embedding) as Parquet."""
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Load the index; a missing index is an error, not an empty result."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"vector index missing: {path} (build it first)")
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """The whole fitted pipeline (vectoriser and classifier together)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Reload a fitted pipeline."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def read_with_errors(spark: SparkSession, folder: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(documents, errors). Files are read as bytes and decoded per row: a file
    that is not valid UTF-8 becomes an error row instead of failing the job, and so
    does a listed file that reading gave nothing for (removed, truncated, no access)."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
           .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(folder))
    decoded = _as_text(raw)
    ok = decoded.filter(F.col("text").isNotNull())
    bad = decoded.filter(F.col("text").isNull()).select("path", F.lit("not valid UTF-8 text").alias("error"))
    lost = (file_listing(spark, folder, glob).select("path")
            .join(raw.filter(F.col("content").isNotNull()).select(F.col("path").alias("__read")),
                  F.col("path") == F.col("__read"), "left_anti")
            .select("path", F.lit("could not be read").alias("error")))
    return ok, bad.unionByName(lost)
