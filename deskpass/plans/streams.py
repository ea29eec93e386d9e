"""Streaming checks: each stream is fed the table slice by slice, restarted from
its checkpoint after every slice, and must equal the batch result (ST1–ST6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.plans.files import N_FILES_SQL, docs_as_files, touch_first
from deskpass.plans.registry import ORACLE, register
from deskpass.plans.sessions import exchanges
from deskpass.session import scratch_path
from deskpass.sources.tables import rule_request_view, table
from deskpass.streaming import decisions as SD
from deskpass.streaming import sessions as SS
from deskpass.streaming import indexing as SI


def _run_per_slice(spark, parts, feed, start):
    """Feed one slice, run the stream to the end (``AvailableNow``, no file cap: the
    whole slice is one micro-batch), then the next slice, restarting from the
    checkpoint each time."""
    for part in parts:
        SD.feed_files([part], feed)
        start().awaitTermination()


def _arrivals(spark, d):
    return rule_request_view(spark, d).select("request_id", "request_raw", "reason")


def _st1(spark, d, replay: bool):
    base = scratch_path(spark, "st1")
    feed, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    arrivals = _arrivals(spark, d)
    parts = SD.slices(arrivals, "request_id", SD.key_bounds(arrivals, "request_id", 4))
    stream = lambda: spark.readStream.schema(arrivals.schema).parquet(feed)
    _run_per_slice(spark, parts, feed, lambda: SD.decide_stream(stream(), sink, ck))
    if replay:  # a retried micro-batch rewrites only its own partition
        first = spark.read.parquet(feed).join(
            spark.read.parquet(sink).filter("batch_id = 0").select("request_id"), "request_id", "left_semi")
        SD.write_partition(SD.decide_batch(first), sink, 0)
    return spark.read.parquet(sink).select("request_id", "category", "decision", "reject_reason")


@register("ST1_decide_stream")
def st1(spark, d):
    return _st1(spark, d, replay=False)


@register("ST3_idempotent_append")
def st3(spark, d):
    return _st1(spark, d, replay=True)


@register("ST2_skip_rejected_stream")
def st2(spark, d):
    base = scratch_path(spark, "st2")
    feed, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    parts = SD.slices(ev, "event_id", SD.key_bounds(ev, "event_id", 4))
    stream = lambda: spark.readStream.schema(ev.schema).parquet(feed)
    _run_per_slice(spark, parts, feed, lambda: SD.skip_rejected_stream(spark, stream(), sink, ck))
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@register("ST4_session_memory_stream")
def st4(spark, d):
    base = scratch_path(spark, "st4")
    feed, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    ex = exchanges(spark, d)
    parts = SD.slices(ex, "turn", [2, 4])

    def start():
        s = spark.readStream.schema(ex.schema).parquet(feed)
        mem = SS.session_memory(s)
        return (mem.writeStream.foreachBatch(lambda b, i: SD.write_partition(b, sink, i))
                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    _run_per_slice(spark, parts, feed, start)
    out = spark.read.parquet(sink)
    last = out.groupBy("conv_id").agg(F.max_by(F.struct("n_kept", "context"), "batch_id").alias("s"))
    return last.select("conv_id", F.col("s.n_kept").alias("n_kept"), F.col("s.context").alias("context"))


# Idle sessions: half the mean distance of a user's events; the feed comes in four equal spans of time, every tenth
# row one span late (within the watermark's delay), and of the first span every 97th at the end (behind the watermark).
_SPANS = """
with e as (select event_id, user_id, ts, min(ts) over () as first_ts, max(ts) over () as last_ts,
    (epoch_us(max(ts) over ()) - epoch_us(min(ts) over ())) // 1000000 as width from events where ts is not null and user_id is not null),
facts as (select max(width) as width, max(last_ts) as last_ts, count(*) as n, count(distinct user_id) as users from e),
rows as (select e.*, least(3, (epoch_us(ts) - epoch_us(first_ts)) // 1000000 * 4 // greatest(1, e.width)) as span from e),
kept as (select r.*, (f.width * f.users // f.n) // 2 as gap, f.width // 4 * 2 as delay from rows r, facts f where not (span = 0 and event_id % 97 = 5)),
marked as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > gap * 1000000 then 1 else 0 end as new
  from kept window w as (partition by user_id order by ts, event_id)),
numbered as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s,
  row_number() over (partition by user_id order by ts desc, event_id desc) as from_end from marked)"""
_EXPIRED_SQL = _SPANS + """
select user_id as key, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as n,
  list_aggregate(list_slice(list(event_id order by ts desc, event_id desc), 1, 5), 'sum')::bigint as last_ids
from numbered group by user_id, s, gap, delay, last_ts
having epoch_us(max(ts)) + gap * 1000000 < epoch_us(last_ts) - delay * 1000000"""


@register("ST4_expired_sessions", _EXPIRED_SQL)
def st4_expired(spark, d):
    """Sessions of users that the watermark has closed, from a feed with rows out of order and rows too late."""
    base = scratch_path(spark, "st4x")
    feed, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    ev = table(spark, d, "events").select("event_id", "user_id", "ts").where("ts is not null and user_id is not null")
    f = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"),
               F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).first()
    width = (f.hi - f.lo) // 1_000_000
    gap, delay = (width * f.users // f.n) // 2, width // 4 * 2
    at = F.unix_micros(F.col("ts").cast("timestamp")) - f.lo
    span = F.least(F.lit(3), F.floor(F.floor(at / 1_000_000) * 4 / max(1, width)))
    late = F.when((span == 0) & (F.col("event_id") % 97 == 5), F.lit(4)).otherwise(F.least(F.lit(3), span + (F.col("event_id") % 10 == 3).cast("int")))
    fed = ev.withColumn("slice", late)
    parts = [fed.where(F.col("slice") == k).drop("slice") for k in range(5)]

    def start():
        closed = SS.expiring_sessions(spark.readStream.schema(ev.schema).parquet(feed), "user_id", "ts", "event_id", gap, f"{delay} seconds")
        return (closed.writeStream.foreachBatch(lambda b, i: SD.write_partition(b, sink, i))
                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    _run_per_slice(spark, parts, feed, start)
    micros = lambda c: F.unix_micros(F.col(c)).alias(c)
    total = F.aggregate("last_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("last_ids")
    return spark.read.parquet(sink).select("key", micros("started"), micros("ended"), "n", total)


@register("ST5_incremental_index", f"select {N_FILES_SQL} as files, cast(1 as bigint) as indexed_again, "
          f"{N_FILES_SQL} as files_whole from documents")
def st5(spark, d):
    base = scratch_path(spark, "st5")
    folder, state = f"{base}/docs", f"{base}/state"
    docs_as_files(spark, d, folder)
    SI.index_changed(spark, folder, state, 1)
    touch_first(spark, folder)
    index, changed, _ = SI.index_changed(spark, folder, state, 2)
    return (index.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_no").alias("last"))
            .join(changed.select("path", F.lit(1).alias("again")), "path", "left")
            .agg(F.count(F.lit(1)).alias("files"), F.count("again").alias("indexed_again"),
                 F.sum((F.col("chunks") == F.col("last") + 1).cast("long")).alias("files_whole")))


@register("ST5_removed_and_compacted", f"""select {N_FILES_SQL} as files_before, true as some_removed, true as removed_are_gone,
  true as equals_fresh_build, true as compacted, true as fewer_rows_read, true as came_back from documents""")
def st5_removed(spark, d):
    """A folder of which files are removed, changed and brought back (as the pattern lists them), the index compacted in
    between: at every step the index is that of a fresh build."""
    base = scratch_path(spark, "st5r")
    folder, state = f"{base}/docs", f"{base}/state"
    docs_as_files(spark, d, folder)
    whole, less = "part-*", "part-????[13579]-*"

    def chunks(index):
        return index.select("path", "chunk_no", F.xxhash64("text").alias("h"))

    def same(index, glob, name):
        fresh, _, _ = SI.index_changed(spark, folder, f"{base}/{name}", 1, glob)
        both = chunks(index).withColumn("n", F.lit(1)).unionByName(chunks(fresh).withColumn("n", F.lit(-1)))
        return both.groupBy("path", "chunk_no", "h").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()  # as often on both sides

    index, _, _ = SI.index_changed(spark, folder, state, 1, whole)
    before, schema = index.select("path").distinct().count(), index.schema
    touch_first(spark, folder)
    index, _, _ = SI.index_changed(spark, folder, state, 2, less)
    after = index.select("path").distinct().count()
    gone = index.join(SI.files.file_listing(spark, folder, less).select("path"), "path", "left_anti").limit(1).count() == 0
    equal = same(index, less, "fresh-less")
    dead = SI.dead_share(spark, state, 2, schema)
    index, done = SI.compact(spark, state, 3, schema, 0.0)
    equal = equal and same(index, less, "fresh-compact")
    smaller = SI.dead_share(spark, state, 3, schema) == 0 < dead
    index, _, _ = SI.index_changed(spark, folder, state, 4, whole)
    back = index.select("path").distinct().count() == before and same(index, whole, "fresh-back")
    return spark.createDataFrame([(before, 0 < after < before, gone, equal, done, smaller, back)],
                                 "files_before long, some_removed boolean, removed_are_gone boolean, equals_fresh_build boolean, "
                                 "compacted boolean, fewer_rows_read boolean, came_back boolean")


@register("ST6_collect_and_refit")
def st6(spark, d):
    from deskpass.operators import ml as ML
    from deskpass.plans.models import labelled
    base = scratch_path(spark, "st6")
    feed, tbl, ck, models = f"{base}/in", f"{base}/train", f"{base}/ck", f"{base}/models"
    rows = labelled(spark, d).filter(F.col("label").isNotNull())
    train = rows.filter(~F.col("is_test")).select("request_id", "model_text", "label")
    parts = SD.slices(train, "request_id", SD.key_bounds(train, "request_id", 3))
    stream = lambda: spark.readStream.schema(train.schema).parquet(feed)
    SD.feed_files(parts, feed)
    SI.collect_training(stream(), tbl, ck)
    model, _ = SI.refit(spark, tbl, ML.text_forest("model_text", "label"), models, 1)
    return model.transform(rows.filter("is_test")).select("request_id", "label", "prediction")


# Three models of known quality: answers are wrong for so many per cent of the ids, by their hash.
_FLIPS = {"first": 30, "better": 10, "worse": 40}


def _flip_model(per_cent):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    hashed = "cast(conv(substring(md5(cast(doc_id as string)), 1, 15), 16, 10) as bigint)"
    wrong = f"SELECT *, cast(CASE WHEN {hashed} % 100 < {per_cent} THEN 1 - quality ELSE quality END as double) AS prediction FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=wrong)])


def _publication_sql():
    from deskpass.plans.metrics import HASH_SQL, _per_class_sql

    def one(step, model, flip, live):
        return f"""select * from (with p as (select quality as label, case when {HASH_SQL.format(k='doc_id')} % 100 < {flip}
    then 1 - quality else quality end as prediction from labels){_per_class_sql("p", "label", "prediction")}
  select '{step}' as step, '{model}' as model, {live} as went_live, name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from (
    select cast(c as varchar) as name, precision, recall, f1 from f
    union all select 'macro', avg(precision), avg(recall), avg(f1) from f
    union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) from f
    union all select 'accuracy', null, null, avg(case when label = prediction then 1.0 else 0.0 end) from p))"""
    f = _FLIPS
    return "\nunion all ".join([one("first", "candidate", f["first"], "true"), one("better", "candidate", f["better"], "true"),
                                one("better", "live", f["first"], "true"), one("worse", "candidate", f["worse"], "false"),
                                one("worse", "live", f["better"], "false")])


@register("ST6_guarded_publication", _publication_sql())
def st6_publication(spark, d):
    """Three candidates for publication, each scored beside the live model on the same rows: the reports and who went live."""
    from deskpass.sources import files
    root = scratch_path(spark, "publication")
    rows = table(spark, d, "labels").select("doc_id", "quality", F.col("quality").cast("double").alias("label"))
    out = None
    for step, flip in _FLIPS.items():
        files.save_model(_flip_model(flip), f"{root}/{step}")
        reports, live = SI.publish(spark, f"{root}/{step}", root, rows, ["label"])
        part = reports.select(F.lit(step).alias("step"), "model", F.lit(live).alias("went_live"),
                              F.regexp_replace("name", "\\.0$", "").alias("name"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
        out = part if out is None else out.unionByName(part)
    return out


def _same_as(name, batch_name):
    def link():
        from deskpass.plans import rules, sessions  # noqa: F401  (ensure batch oracles are registered)
        if batch_name in ORACLE:
            ORACLE[name] = ORACLE[batch_name]
    return link


# A stream must equal its batch counterpart, so it shares that oracle.
for _n, _b in [("ST1_decide_stream", "R1_three_outcome"), ("ST3_idempotent_append", "R1_three_outcome"),
               ("ST2_skip_rejected_stream", "W6_until_first_reject"),
               ("ST4_session_memory_stream", "W2_context_text")]:
    _same_as(_n, _b)()
