"""Incremental indexing and retraining (ST5, ST6).

ST5 keeps a manifest ``(path, modified_at)`` next to the index: each run
lists the folder, keeps files that are new or newer than the manifest,
chunks and embeds only those, and writes their rows and a new manifest version. (The streaming file source remembers names, not
times, so a file rewritten under the same name would be missed by it.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.operators import metrics
from deskpass.operators.text import chunk_windows
from deskpass.operators.vectors import embed_texts
from deskpass.schema import MANIFEST
from deskpass.session import scratch_path
from deskpass.sources import files
from deskpass.sources.decision_log import Conflict, DecisionLog


def index_changed(spark: SparkSession, folder: str, state_dir: str, version: int,
                  glob: str = "*.txt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST5: one incremental indexing run; returns (index, indexed files, errors) of this version.

    Only files that are new or changed are read: the scan is cut by the earliest
    change, then by path. Their chunks are written to ``state_dir/index/version=<n>``,
    earlier versions stay as they are, and the manifest says which version holds a
    file's rows. A file enters the manifest only once it was read, so what can't be
    read is reported and tried again by the next run; the rows written tell what was, no file is read a second time. Files that are no longer there
    leave the manifest, and with it the index (their rows go at the next ``compact``).
    """
    manifest = _manifest(spark, state_dir, version - 1)
    listing = files.file_listing(spark, folder, glob)
    changed = files.changed_files(listing, manifest)
    since = changed.agg(F.min("modified_at")).first()[0]
    ok, bad = files.read_with_errors(spark, folder, glob)
    if since is not None:
        ok = ok.filter(F.col("modified_at") >= F.lit(since))
    docs = ok.join(changed.select("path"), "path", "left_semi")
    bad = bad.join(changed.select("path"), "path", "left_semi")
    chunks = chunk_windows(docs, "text").select("path", "modified_at", "chunk_no", F.col("chunk").alias("text"))
    fresh = embed_texts(chunks, "text", "embedding")
    rows = f"{state_dir}/index/version={version}"
    fresh.write.mode("overwrite").parquet(rows)
    done = spark.read.schema(fresh.schema).parquet(rows).select("path", "modified_at").distinct()  # a file has a chunk at least
    new = f"{state_dir}/manifest/v={version}"
    there = manifest.join(listing.select("path"), "path", "left_semi")
    files.update_manifest(there, done, version).write.mode("overwrite").parquet(new)
    known = spark.read.schema(MANIFEST).parquet(new)
    index = current_index(spark, state_dir, known, fresh.schema)
    return index, known.filter(F.col("version") == version), bad


def _manifest(spark: SparkSession, state_dir: str, version: int) -> DataFrame:
    path = f"{state_dir}/manifest/v={version}"
    return (spark.read.schema(MANIFEST).parquet(path) if files._exists(spark, path)
            else spark.createDataFrame([], MANIFEST))


def _stored(spark: SparkSession, state_dir: str, schema) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])).parquet(f"{state_dir}/index")


def current_index(spark: SparkSession, state_dir: str, manifest: DataFrame, schema) -> DataFrame:
    """The rows of every file's latest version; only folders of versions that still hold one are read."""
    live = [r.version for r in manifest.select("version").distinct().collect()]  # as many as runs since the last compaction
    rows = _stored(spark, state_dir, schema).where(F.col("version").isin(live) if live else F.lit(False))
    return rows.join(manifest.select("path", "version"), ["path", "version"], "left_semi").drop("version")


def dead_share(spark: SparkSession, state_dir: str, version: int, schema) -> float:
    """Share of the rows in the folders that version ``version`` reads that are no longer of the index."""
    manifest = _manifest(spark, state_dir, version)
    live = [r.version for r in manifest.select("version").distinct().collect()]
    held = _stored(spark, state_dir, schema).where(F.col("version").isin(live) if live else F.lit(False)).count()
    return 1 - current_index(spark, state_dir, manifest, schema).count() / held if held else 0.0


def compact(spark: SparkSession, state_dir: str, version: int, schema, most_dead: float = 0.25) -> tuple[DataFrame, bool]:
    """ST5: after run ``version - 1``, write the index as one folder of version ``version`` if more than ``most_dead`` of
    the rows read are dead; returns (index, whether it was done). Rows, times and embeddings stay as they are; readers
    of an earlier version keep its folders, which are not removed here."""
    manifest = _manifest(spark, state_dir, version - 1)
    index = current_index(spark, state_dir, manifest, schema)
    if dead_share(spark, state_dir, version - 1, schema) <= most_dead:
        return index, False
    index.write.mode("overwrite").parquet(f"{state_dir}/index/version={version}")
    new = f"{state_dir}/manifest/v={version}"
    manifest.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(new)
    return current_index(spark, state_dir, spark.read.schema(MANIFEST).parquet(new), schema), True


def collect_training(stream: DataFrame, table: str, checkpoint: str) -> None:
    """ST6, step 1: append arriving labelled rows to the training table (AvailableNow)."""
    q = (stream.writeStream.format("parquet").option("path", table)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def refit(spark: SparkSession, table: str, pipeline, model_root: str, version: int):
    """ST6, step 2: batch refit on the whole training table, saved under a new version."""
    model = pipeline.fit(spark.read.parquet(table))
    path = f"{model_root}/v={version}"
    files.save_model(model, path)
    return model, path


POINTER = T.StructType([T.StructField("model", T.StringType())])


def live_model(spark: SparkSession, model_root: str) -> str | None:
    """Path of the published model that scorers load, None before the first."""
    rows = DecisionLog(spark, f"{model_root}/live", POINTER, "json").read().collect()  # one row at most
    return rows[0].model if rows else None


def quality_report(model_path: str, rows: DataFrame, keep: list[str], label: str = "label") -> DataFrame:
    """M9's per-class rows, macro F1 and accuracy of a saved model on held-out ``rows``: (name, precision, recall, f1, support)."""
    scored = files.load_model(model_path).transform(rows).select(*keep, F.col("prediction"))
    path = scratch_path(rows.sparkSession, "quality")
    scored.write.parquet(path)
    return metrics.report(rows.sparkSession.read.parquet(path), label, "prediction")


def publish(spark: SparkSession, candidate: str, model_root: str, rows: DataFrame, keep: list[str], label: str = "label",
            least_gain: float = 0.0) -> tuple[DataFrame, bool]:
    """ST6, step 3: the candidate goes live only if its macro F1 on the same held-out rows is no worse than the live
    model's (by ``least_gain`` better, if given). Returns the reports of both (model, name, ...) and whether it went live.

    The pointer to the live model is a log of one row with atomic commits: scorers see the old model or the new one, and
    if somebody published meanwhile, the candidate is compared again with that model."""
    while True:
        log = DecisionLog(spark, f"{model_root}/live", POINTER, "json")
        now = log.load().collect()
        mine = quality_report(candidate, rows, keep, label).withColumn("model", F.lit("candidate"))
        if not now:
            reports, good = mine, True
        else:
            theirs = quality_report(now[0].model, rows, keep, label).withColumn("model", F.lit("live"))
            reports = mine.unionByName(theirs)
            f1 = {r.model: r.f1 for r in reports.where("name = 'macro'").select("model", "f1").collect()}
            good = (f1["candidate"] or 0.0) >= (f1["live"] or 0.0) + least_gain
        if not good:
            return reports, False
        try:
            log.save(spark.createDataFrame([(candidate,)], POINTER))
            return reports, True
        except Conflict:
            continue
