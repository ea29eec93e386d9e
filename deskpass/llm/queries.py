"""Queries of the training-data operators over the driver tables (op1 to op13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op5_adaptive_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.quality import quality_verdicts
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query("op2_simhash_anchors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op7_wrapper_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.wrappers import extract_articles
    return extract_articles(table(spark, sf_dir, "pages"))


@query("op10_segmentation_langid")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    from deskpass.llm.decontam import LEAST, LITERALS, UNITS, WORD_PATTERN
    units = ", ".join(f"'{u}'" for u in UNITS)
    k = range(5)

    def windows(table_name: str, key: str) -> str:
        return f"""
  select {key}, txt, pos,
    {", ".join(f"v[pos + {i + 1}] as v{i}" for i in k)}, {", ".join(f"s[pos + {i + 1}] as s{i}" for i in k)}
  from (select *, unnest(range(0, len(v) - 4)) as pos from (
    select {key}, txt, list_transform(t, lambda x: lower(x)) as v,
      list_transform(t, lambda x: case when regexp_matches(x[1], '\\p{{N}}') then 1
        when lower(x) in ({units}) then 2 when x[1] <> lower(x[1]) then 3 else 0 end) as s
    from (select distinct {key}, text as txt, regexp_extract_all(text, '{WORD_PATTERN}') as t from {table_name})) where len(v) >= 5)"""

    def template() -> str:
        return "concat_ws(' ', " + ", ".join(f"case s{i} when 0 then v{i} else '#' || s{i} end" for i in k) + ")"

    literals = " + ".join(f"(s{i} = 0)::int" for i in k)
    slots = " union all ".join(
        f"select doc_id, dtxt, item_id, itxt, shift, item_at, item_at + {i} as place, i{i} as mine, d{i} as theirs from hits where z{i} > 0" for i in k)
    return f"""
with dw as (select *, {template()} as w from ({windows('documents', 'doc_id')}) where {literals} >= {LITERALS}),
iw0 as (select *, {template()} as w from ({windows('benchmark', 'item_id')}) where {literals} >= {LITERALS}),
iw as (select *, count(*) over (partition by item_id, txt) as n_windows from (
  select *, row_number() over (partition by item_id, txt, w order by pos) as nth from iw0) where nth = 1),
hits as (select d.doc_id, d.txt as dtxt, i.item_id, i.txt as itxt, i.n_windows, i.pos as item_at, d.pos - i.pos as shift,
  {", ".join(f"d.v{i} as d{i}, i.v{i} as i{i}, i.s{i} as z{i}" for i in k)} from dw d join iw i using (w)),
slots as ({slots}),
votes as (select doc_id, dtxt, item_id, itxt, shift, mine, theirs, count(distinct place) as n, min(place) as first_place
  from slots group by all),
usual as (select * from (select *, row_number() over (partition by doc_id, dtxt, item_id, itxt, shift, mine
  order by n desc, first_place) as r from votes) where r = 1),
odd as (select distinct s.doc_id, s.dtxt, s.item_id, s.itxt, s.shift, s.item_at from slots s join usual u
  using (doc_id, dtxt, item_id, itxt, shift, mine) where s.theirs <> u.theirs),
good as (select h.* from hits h anti join odd using (doc_id, dtxt, item_id, itxt, shift, item_at))
select distinct doc_id, item_id, n_windows, n_matched, coverage from (
  select doc_id, dtxt, item_id, itxt, max(n_windows) as n_windows, count(distinct item_at) as n_matched,
    round(count(distinct item_at) / max(n_windows), 6) as coverage
  from good group by doc_id, dtxt, item_id, itxt) where n_matched >= {LEAST} * n_windows"""


@query("op9_template_decontamination", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.decontam import contaminated
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "coverage").distinct()


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.surrogates import replace_pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, count_col="n_entities")


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"))


OP3_SQL = """
with rows as (
  select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
    ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
sized as (
  select d, h >> (60 - d) as p, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows
  from rows, range(0, 41) t(d) group by all having sum(n_bytes) <= {limit} or count(*) = 1),
first as (
  select r.doc_id, r.n_bytes, min(s.d) as depth from rows r, sized s where s.p = r.h >> (60 - s.d) group by all)
select f.doc_id, f.n_bytes, substr(lpad(bin(r.h), 60, '0'), 1, f.depth::int) as shard, f.depth::int as depth,
  s.shard_rows, s.shard_bytes, s.shard_bytes > {limit} as oversize
from first f join rows r using (doc_id, n_bytes) join sized s on s.d = f.depth and s.p = r.h >> (60 - f.depth)
"""


def _op3_sql() -> str:
    from deskpass.llm.sharding import LIMIT
    return OP3_SQL.format(limit=LIMIT)


@query("op3_extendible_shards", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.sharding import assign_shards
    return assign_shards(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op1_paragraph_repeats")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.substring import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_forced_boundary_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.bpe import token_digests
    return token_digests(table(spark, sf_dir, "documents"))


OP12_SQL = """
with rows as (select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from rows where id % 100 = 0),
scores as (select a.id as anchor_id, a.label as anchor_label, b.id, b.label, list_inner_product(a.v, b.v)::bigint as score
  from anchors a join rows b on a.id <> b.id),
positives as (select * from (select anchor_id, id as positive_id, score as positive_score,
    row_number() over (partition by anchor_id order by score desc, id) as r from scores where label = anchor_label) where r <= 5),
found as (select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
  from positives p join scores s on p.anchor_id = s.anchor_id and s.label <> s.anchor_label
    and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 5
"""


@query("op12_anchor_tree_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


def _op13_sql() -> str:
    from deskpass.llm.divergence import LEAST_DOCS, SCALE, TOP
    return f"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
lowered as (select lang, source, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from docs),
kept as (select lang, term from (select lang, unnest(list_distinct(w)) as term from lowered) group by all having count(*) >= {LEAST_DOCS}),
counts as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from lowered)
  join kept using (lang, term) group by all),
groups as (select distinct lang, source from docs),
sizes as (select lang, count(*) as v from kept group by all),
totals as (select lang, source, sum(n) as total from counts group by all),
every as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, coalesce(t.total, 0) as total, s.v from groups g
  join kept k using (lang) join sizes s using (lang) left join counts c using (lang, source, term) left join totals t using (lang, source)),
shares as (select lang, source, term, n, 1 + ({SCALE} * (n + 1)::hugeint) // (total + v)::hugeint as p from every),
whole as (select lang, term, 1 + ({SCALE} * (sum(n) + 1)::hugeint) // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang))::hugeint as p
  from every group by lang, term),
pairs as (select g.lang, g.source, h.source as item, coalesce(x.value, 0) as value from groups g join groups h
  on g.lang = h.lang and g.source <> h.source left join (select a.lang, a.source, b.source as item,
    sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by all) x on x.lang = g.lang and x.source = g.source and x.item = h.source),
terms as (select a.lang, a.source, a.term as item, (a.p - b.p) * (a.p - b.p) // b.p as value from shares a
  join whole b using (lang, term) where a.n > 0 and a.p > b.p),
found as (select *, 'pair' as part from pairs union all by name select *, 'term' as part from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found)
where part = 'pair' or rank <= {TOP}"""


@query("op13_pair_task_divergence", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskpass.llm.divergence import divergence_audit
    return divergence_audit(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
