"""Joins and set operations over the request view and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.functions import rules as RU
from deskpass.functions.labels import decode_status
from deskpass.operators import relational as OP
from deskpass.plans.metrics import fixed_predictions, FIXED_PRED_SQL
from deskpass.plans.registry import register
from deskpass.plans.requests import requests_with_category
from deskpass.plans.sqlbits import POLICY_SQL, with_views
from deskpass.schema import REJECT
from deskpass.sources.tables import request_view, table


@register("J1_predictions_join", with_views(f"""
, p as ({FIXED_PRED_SQL})
select r.request_id, r.status, case p.prediction when 1 then '승인됨' when 0 then '거절됨' end as predicted_status
from p join r on p.doc_id = r.request_id"""))
def j1(spark, d):
    preds = fixed_predictions(spark, d).select(F.col("doc_id").alias("request_id"), "prediction")
    j = OP.join_back(preds, request_view(spark, d), "request_id")
    return j.select("request_id", "status", decode_status("prediction").alias("predicted_status"))


@register("J2_skip_rejected", with_views(f"""
, rej as (select request_id from (select request_id, ({POLICY_SQL['lenient']()}).decision as decision from r) x
          where decision = '거절')
select r.request_id, r.status from r where not exists (select 1 from rej where rej.request_id = r.request_id)""",
                                         rule_view=True))
def j2(spark, d):
    rejected = (RU.decide(requests_with_category(spark, d, rules=True), "lenient")
                .filter(F.col("decision") == REJECT).select("request_id"))
    v = requests_with_category(spark, d, rules=True, status=True).select("request_id", "status")
    return OP.skip_rejected(v, rejected, "request_id")


@register("J5_valid_semi_join", with_views("""
select request_id, category from r where category in (select * from (values
  ('(비업무)개인시간_흡연 등'), ('(업무)회의'), ('(업무)기타업무'), ('(업무)출장,이동,외근')) v(c))"""))
def j5(spark, d):
    v = requests_with_category(spark, d)
    return OP.keep_valid(v, OP.valid_categories(spark), "category").select("request_id", "category")


@register("U1_append_log", with_views(f"""
select request_id, 'three' as policy, ({POLICY_SQL['three']()}).decision as decision from r
union all
select request_id, 'lenient' as policy, ({POLICY_SQL['lenient']()}).decision as decision from r""", rule_view=True))
def u1(spark, d):
    v = requests_with_category(spark, d, rules=True)
    log = RU.decide(v, "three").select("request_id", F.lit("three").alias("policy"), "decision")
    new = RU.decide(v, "lenient").select("request_id", F.lit("lenient").alias("policy"), "decision")
    return OP.append_rows(log, new)  # a log and what is appended to it: two decisions of each text, no shuffle


@register("U2_dedup_texts", "select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def u2(spark, d):
    return OP.dedup_texts(table(spark, d, "documents"), "text", "doc_id")
