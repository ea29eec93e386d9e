"""Source and sink round trips (S1–S6, S8–S10, S13, U3): write what Spark derives
from the driver tables into the shared scratch folder, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskpass.functions import rules as RU
from deskpass.functions.render import training_record
from deskpass.operators.relational import union_all
from deskpass.plans.registry import register
from deskpass.plans.requests import requests_with_category
from deskpass.plans.sessions import PAIRS_SQL, exchanges
from deskpass.plans.sqlbits import CATS, POLICY_SQL, with_views
from deskpass.schema import BATCH_LOG, CATEGORIES, FORM_LOG, MANIFEST, REQUESTS
from deskpass.session import scratch_path
from deskpass.sources import files as FS
from deskpass.sources.decision_log import Conflict, DecisionLog
from deskpass.sources.tables import REQUEST_VIEW_SQL, request_view, table


@register("S1_read_requests", REQUEST_VIEW_SQL)
def s1(spark, d):
    base = scratch_path(spark, "s1")
    request_view(spark, d).write.parquet(f"{base}/parquet")
    return FS.read_requests(spark, f"{base}/parquet", "parquet", REQUESTS)


@register("S1_read_requests_json", REQUEST_VIEW_SQL)
def s1_json(spark, d):
    base = scratch_path(spark, "s1j")
    request_view(spark, d).write.json(f"{base}/json")
    return FS.read_requests(spark, f"{base}/json", "json", REQUESTS)


@register("S1_read_requests_csv", REQUEST_VIEW_SQL)
def s1_csv(spark, d):
    """A CSV history: header, quotes and line breaks inside texts, nulls apart from empty texts."""
    base = scratch_path(spark, "s1c")
    request_view(spark, d).write.options(**FS.CSV_OPTIONS, quoteAll=True).csv(f"{base}/csv")
    return FS.read_requests(spark, f"{base}/csv", "csv", REQUESTS, nullValue=FS.CSV_OPTIONS["nullValue"])


DOCS_PER_FILE = 1000
N_FILES_SQL = f"cast(greatest(8, ceil(count(*) / {DOCS_PER_FILE}.0)) as bigint)"


def docs_as_files(spark, d, folder):
    """Documents written as text files whose number grows with the table (about
    ``DOCS_PER_FILE`` documents each), so no file holds a fixed share of it."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n_files = max(8, -(-docs.count() // DOCS_PER_FILE))
    docs.repartition(n_files, "doc_id").select("text").write.text(folder)


@register("S2_read_corpus", f"select {N_FILES_SQL} as n_files, cast(sum(length(text) + 1) as bigint) as n_chars from documents")
def s2(spark, d):
    base = scratch_path(spark, "s2")
    docs_as_files(spark, d, f"{base}/docs")
    corpus = FS.read_corpus(spark, f"{base}/docs", "*.txt")
    return corpus.agg(F.count_distinct("path").alias("n_files"), F.sum(F.char_length("text")).alias("n_chars"))


@register("U3_union_readers", f"""select 'files' as reader, {N_FILES_SQL} as n_rows, cast(sum(length(text) + 1) as bigint) as n_chars
from documents union all select 'table', count(*), cast(sum(length(text)) as bigint) from documents""")
def u3(spark, d):
    base = scratch_path(spark, "u3")
    docs_as_files(spark, d, f"{base}/docs")
    from_files = FS.read_corpus(spark, f"{base}/docs", "*.txt").select(F.col("path").alias("source"), "text")
    from_table = table(spark, d, "documents").select(F.concat(F.lit("table:"), F.col("source")).alias("source"), "text")
    both = union_all([from_files, from_table])
    reader = F.when(F.col("source").startswith("table:"), "table").otherwise("files")
    return both.groupBy(reader.alias("reader")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.char_length("text")).alias("n_chars"))


def touch_first(spark, folder):
    """Give the first file of ``folder`` a later modification time."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = min(s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().endswith(".txt"))
    p = jvm.org.apache.hadoop.fs.Path(first)
    fs.setTimes(p, fs.getFileStatus(p).getModificationTime() + 60_000, -1)


@register("S3_changed_files", f"""select 'new' as state, {N_FILES_SQL} as n_files from documents
union all select 'unchanged', {N_FILES_SQL} - 1 from documents union all select 'modified', cast(1 as bigint)""")
def s3(spark, d):
    base = scratch_path(spark, "s3")
    docs_as_files(spark, d, f"{base}/docs")
    first = FS.changed_files(FS.file_listing(spark, f"{base}/docs", "*.txt"), spark.createDataFrame([], MANIFEST))
    FS.update_manifest(spark.createDataFrame([], MANIFEST), first, 1).write.parquet(f"{base}/manifest")
    manifest = spark.read.parquet(f"{base}/manifest")
    touch_first(spark, f"{base}/docs")
    listing = FS.file_listing(spark, f"{base}/docs", "*.txt")
    second = FS.changed_files(listing, manifest)
    states = [manifest.select(F.lit("new").alias("state")), second.select(F.lit("modified").alias("state")),
              listing.join(second.select("path"), "path", "left_anti").select(F.lit("unchanged").alias("state"))]
    return union_all(states).groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))


def _batch_log(spark, d):
    v = requests_with_category(spark, d, rules=True)
    dec = RU.decide(v, "lenient")
    return dec.select(F.col("request_id").cast("string").alias("row_id"), F.col("category"),
                      F.col("reason"), F.col("decision"), F.col("reject_reason"),
                      F.lit("2024-01-01 09:00:00").alias("saved_at"))


def _log_sql(extra: str = "") -> str:
    return with_views(f"""
select cast(request_id as varchar) as row_id, ({POLICY_SQL['lenient']()}).decision as decision{extra} from r""",
                      rule_view=True)


def _log_sql_full() -> str:
    return with_views(f"""
, dd as (select request_id, category, reason, {POLICY_SQL['lenient']()} as res from r)
select cast(request_id as varchar) as row_id, category, reason, res.decision as decision,
  res.reject_reason as reject_reason from dd""", rule_view=True)


def _log_cycle(spark, d, path):
    """Load (or create), append, save; rows before."""
    log = DecisionLog(spark, path, BATCH_LOG)
    rows = log.load()
    before = rows.count()
    log.save(rows.unionByName(_batch_log(spark, d)))
    return before


@register("S4_load_or_create_log", _log_sql(", cast(0 as bigint) as rows_before, n_log as rows_between")
          + ", (select count(*) as n_log from r) c, (values (1), (2)) twice(t)")
def s4(spark, d):
    """Two runs: the first creates the log, the second appends to what the first saved."""
    path = f"{scratch_path(spark, 's4')}/log"
    n0 = _log_cycle(spark, d, path)
    n1 = _log_cycle(spark, d, path)
    return DecisionLog(spark, path, BATCH_LOG).load().select("row_id", "decision", F.lit(n0).cast("long").alias("rows_before"), F.lit(n1).cast("long").alias("rows_between"))


@register("S5_save_log_csv", _log_sql_full() + ", (values (1), (2)) twice(t)")
def s5(spark, d):
    """The log saved over itself with new rows, whole texts with line breaks included."""
    path = f"{scratch_path(spark, 's5')}/log"
    for _ in range(2):
        log = DecisionLog(spark, path)
        log.save(log.load().unionByName(_batch_log(spark, d)))
    return log.read().select("row_id", "category", "reason", "decision", "reject_reason")


FORM_TIME = "2024-01-01 09:00:00"


@register("S6_append_decisions", with_views(f"""
, dd as (select strptime('{FORM_TIME}', '%Y-%m-%d %H:%M:%S') as logged_at, category as request_type, reason,
  ({POLICY_SQL['three']()}).decision as decision from r)
select * from dd union all select * from dd""", rule_view=True))
def s6(spark, d):
    """The form's decision log: time, type, reason, decision, appended by two jobs."""
    base = scratch_path(spark, "s6")
    v = requests_with_category(spark, d, rules=True)
    dec = RU.decide(v, "three").select(F.lit(FORM_TIME).cast("timestamp").alias("logged_at"),
                                       F.col("category").alias("request_type"), "reason", "decision")
    one, other = (DecisionLog(spark, f"{base}/log", FORM_LOG, "parquet") for _ in range(2))
    one.append(dec)
    other.append(dec)
    return one.read().withColumn("logged_at", F.col("logged_at").cast("timestamp_ntz"))


@register("S5_interleaved_writers", _log_sql_full().replace("select cast(request_id", "select w.writer, cast(request_id")
          + ", (values ('first'), ('second'), ('appended')) w(writer)")
def s5_interleaved(spark, d):
    """Two runs that load the log at the same time and a job that appends meanwhile: all rows are there, whoever saves last."""
    schema = T.StructType([T.StructField("writer", T.StringType()), *BATCH_LOG.fields])
    path = f"{scratch_path(spark, 's5i')}/log"
    new = _batch_log(spark, d)
    one, two = DecisionLog(spark, path, schema), DecisionLog(spark, path, schema)
    mine, theirs = one.load(), two.load()
    DecisionLog(spark, path, schema).append(new.withColumn("writer", F.lit("appended")))
    one.save(mine.unionByName(new.withColumn("writer", F.lit("first"))))
    try:
        two.save(theirs.unionByName(new.withColumn("writer", F.lit("second"))))
    except Conflict:
        two.update(lambda rows: rows.unionByName(new.withColumn("writer", F.lit("second"))))
    return two.read().select("writer", "row_id", "category", "reason", "decision", "reject_reason")


@register("S7_write_jsonl", with_views(
    "select to_json({'prompt': '요청: ' || coalesce(request_raw, 'nan') || ', 요청 사유: ' "
    "|| coalesce(reason, 'nan'), 'completion': coalesce(status, 'nan') || ': ' || coalesce(approver_note, 'nan')})"
    " as value from r"))
def s7_file(spark, d):
    base = scratch_path(spark, "s7")
    rec = request_view(spark, d).select(training_record("request_raw", "reason", "status", "approver_note").alias("r"))
    FS.write_jsonl(rec.select("r.prompt", "r.completion"), f"{base}/jsonl")
    return spark.read.text(f"{base}/jsonl")


def _log_rows(spark, d):
    ex = exchanges(spark, d)
    ts = F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(0, conv_id, turn, 0)")
    return ex.select(F.col("conv_id").cast("string").alias("session_id"), ts.alias("ts"), "question", "answer")


@register("S8_conversation_log_day", f"""select cast(conv_id as varchar) as session_id, question, answer
from ({PAIRS_SQL}) p
where strftime(timestamp '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn), '%Y%m%d') = '20240102'""")
def s8(spark, d):
    base = scratch_path(spark, "s8")
    FS.write_conversations(_log_rows(spark, d), f"{base}/log")
    day = FS.load_conversations(spark, f"{base}/log", "20240102")
    return day.select("session_id", "question", "answer")


@register("S9_write_cleaned", with_views(
    f"select request_id, category, status from r where status in ('승인됨', '거절됨') and category in {CATS}"))
def s9(spark, d):
    base = scratch_path(spark, "s9")
    v = requests_with_category(spark, d, status=True)
    cleaned = (v.dropna(subset=["status"]).filter(F.col("status").isin("승인됨", "거절됨"))
               .filter(F.col("category").isin(CATEGORIES)).select("request_id", "category", "status"))
    FS.append_decisions(cleaned, f"{base}/cleaned")
    return spark.read.parquet(f"{base}/cleaned")


@register("S13_bad_files_to_errors", f"""select 'read' as state, {N_FILES_SQL} as n_files,
  cast(sum(length(text) + 1) as bigint) as n_chars from documents
union all select 'not valid UTF-8 text', {N_FILES_SQL}, null from documents where regexp_matches(text, '[^\\x00-\\x7F]')""")
def s13(spark, d):
    """Documents as UTF-8 files plus the non-ASCII ones re-encoded as Latin-1: files
    that are not valid UTF-8 go to the errors table, the rest load."""
    base = scratch_path(spark, "s13")
    docs_as_files(spark, d, f"{base}/docs/good")
    other = table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").rlike("[^\\x00-\\x7F]"))
    n = max(8, -(-other.count() // DOCS_PER_FILE))
    (other.repartition(n, "doc_id").select("text").write.option("encoding", "ISO-8859-1").option("quoteAll", False)
     .option("escapeQuotes", False).csv(f"{base}/docs/latin1"))
    ok, bad = FS.read_with_errors(spark, f"{base}/docs", "*.*")
    both = ok.select(F.lit("read").alias("state"), F.char_length("text").cast("long").alias("n")).unionByName(
        bad.select(F.col("error").alias("state"), F.lit(None).cast("long").alias("n")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_chars"))


@register("S10_write_predictions", with_views("""
, p as (select doc_id, case when ('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint % 100 < 10
          then 1 - quality else quality end as prediction from labels)
select r.request_id, r.reason, r.status as actual_status,
  case p.prediction when 1 then '승인됨' when 0 then '거절됨' end as predicted_status
from p join r on p.doc_id = r.request_id"""))
def s10(spark, d):
    """Predictions table (reason, actual, predicted) written and read back."""
    from deskpass.functions.labels import decode_status
    from deskpass.operators.relational import join_back
    from deskpass.plans.metrics import fixed_predictions
    base = scratch_path(spark, "s10")
    preds = fixed_predictions(spark, d).select(F.col("doc_id").alias("request_id"), "prediction")
    table_ = join_back(preds, request_view(spark, d), "request_id").select(
        "request_id", "reason", F.col("status").alias("actual_status"),
        decode_status("prediction").alias("predicted_status"))
    FS.append_decisions(table_, f"{base}/predictions")
    return spark.read.parquet(f"{base}/predictions")
