"""Chunking, TF-IDF and corpus counts over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.operators import text as TX
from deskpass.operators import vocabulary as VO
from deskpass.operators.metrics import holdout_flag
from deskpass.plans.metrics import HASH_SQL
from deskpass.plans.registry import register
from deskpass.schema import CHUNK_OVERLAP, CHUNK_OVERLAP_SMALL, CHUNK_SIZE
from deskpass.session import scratch_path
from deskpass.sources.tables import table


def _t1_sql(size, overlap):
    step = size - overlap
    return f"""select doc_id, cast((s.start - 1) // {step} as integer) as chunk_no, cast(s.start as integer) as start,
  substr(text, cast(s.start as integer), {size}) as chunk
from documents d, generate_series(1, greatest(1, length(d.text) - {overlap}), {step}) s(start)"""


def _t1(size, overlap):
    def fn(spark, d):
        docs = table(spark, d, "documents").select("doc_id", "text")
        return TX.chunk_windows(docs, "text", size, overlap).select("doc_id", "chunk_no", "start", "chunk")
    return fn


register("T1_chunk_1000_200", _t1_sql(CHUNK_SIZE, CHUNK_OVERLAP))(_t1(CHUNK_SIZE, CHUNK_OVERLAP))
register("T1_chunk_1000_50", _t1_sql(CHUNK_SIZE, CHUNK_OVERLAP_SMALL))(_t1(CHUNK_SIZE, CHUNK_OVERLAP_SMALL))


@register("T2_separator_chunks")
def t2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return TX.chunk_separators(docs, "text").select("doc_id", "chunk_no", "chunk")


TOK_SQL = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))"


def _tfidf_sql(fit_where: str, apply_where: str) -> str:
    return f"""with fit as (select doc_id, text from documents where {fit_where}),
tf_fit as (select doc_id, term, count(*) as tf from (select doc_id, {TOK_SQL} as term from fit) x group by all),
idf as (select term, count(*) as df, ln((1 + (select count(*) from fit)) / (1 + count(*))) + 1 as idf
        from tf_fit group by term),
app as (select doc_id, text from documents where {apply_where}),
tf as (select doc_id, term, count(*) as tf from (select doc_id, {TOK_SQL} as term from app) x group by all),
w as (select doc_id, term, tf * idf as w from tf join idf using (term))
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w"""


@register("T3_tfidf", _tfidf_sql("true", "true"))
def t3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return TX.tfidf(docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


_TEST = HASH_SQL.format(k="doc_id") + " % 100 < 20"


@register("T4_apply_vocabulary", _tfidf_sql(f"not ({_TEST})", _TEST))
def t4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    test = holdout_flag("doc_id")
    path = scratch_path(spark, "vocabulary")
    VO.save_vocabulary(TX.fit_idf(docs.filter(~test)), path)  # every term of the fitted documents has its own row
    idf = VO.load_vocabulary(spark, path)
    return TX.apply_idf(docs.filter(test), idf).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("A11_document_frequency", f"""with tf as (select doc_id, term, count(*) as tf
  from (select doc_id, {TOK_SQL} as term from documents) x group by all)
select term, count(*) as df, round(ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1, 6) as idf
from tf group by term""")
def a11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    idf = TX.fit_idf(docs)
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@register("A8_docs_and_chunks", f"""with c as ({_t1_sql(CHUNK_SIZE, CHUNK_OVERLAP)})
select d.source, count(distinct d.doc_id) as n_docs, count(*) as n_chunks
from documents d join c on c.doc_id = d.doc_id group by d.source""")
def a8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    n_docs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    chunks = TX.chunk_windows(docs, "text").groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"))
    return n_docs.join(chunks, "source", "inner")
