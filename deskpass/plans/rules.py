"""Policies over the request view (R1–R10, J7) and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskpass.functions import rules as RU
from deskpass.functions import render as RD
from deskpass.functions.labels import is_blank
from deskpass.operators import terms as TM
from deskpass.plans.registry import register
from deskpass.plans.requests import requests_with_category
from deskpass.plans.sqlbits import (ATT, CATS, POLICY_SQL, ROOM, TOK, alt, blank, q, with_views)
from deskpass.schema import CATEGORIES, PERSONAL_TERMS, REJECT
from deskpass.sources.tables import table


def decided(spark, d, policy="three", valid_only=False) -> DataFrame:
    v = requests_with_category(spark, d, rules=True)
    if valid_only:
        v = v.filter(F.col("category").isin(CATEGORIES))
    return RU.decide(v, policy)


def flagship(spark, d) -> DataFrame:
    """What share of requests per category does the three-outcome policy approve, reject, hold?"""
    counts = (decided(spark, d, valid_only=True)
              .groupBy("category", "decision").agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("category"))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


FLAGSHIP_SQL = with_views(f"""
, dd as (select category, ({POLICY_SQL['three']()}).decision as decision from r where category in {CATS})
select category, decision, count(*) as n,
       round(count(*) / sum(count(*)) over (partition by category), 6) as share
from dd group by category, decision""", rule_view=True)

register("flagship_policy_share", FLAGSHIP_SQL)(flagship)


def _policy_query(policy: str, name: str):
    sql = with_views(f"""
, dd as (select request_id, category, {POLICY_SQL[policy]()} as res from r)
select request_id, category, res.decision as decision, res.reject_reason as reject_reason from dd""",
                     rule_view=True)

    @register(name, sql)
    def fn(spark, d):
        return decided(spark, d, policy).select("request_id", "category", "decision", "reject_reason")
    return fn


_policy_query("three", "R1_three_outcome")
_policy_query("strict", "R2a_strict_two_outcome")
_policy_query("strict_docnum", "R2b_strict_docnum")
_policy_query("lenient", "R3_lenient_two_outcome")
_policy_query("match", "R4_category_match")


@register("R5_doc_number", with_views(f"""
select request_id,
  len(list_filter({TOK}, lambda t: regexp_matches(t, '^AUTON[0-9]+'))) > 0 as doc_number,
  contains(reason, 'AUTON') as doc_number_loose
from r""", rule_view=True))
def r5(spark, d):
    v = requests_with_category(spark, d, rules=True)
    tok = RU.reason_tokens("reason")
    return v.select("request_id", RU.has_doc_number(tok).alias("doc_number"),
                    RU.has_doc_number_loose("reason").alias("doc_number_loose"))


@register("R6_term_lookup", with_views(f"""
select request_id, regexp_matches(reason, {q(ROOM)}) as has_place,
  regexp_matches(reason, {q(ATT)}) as has_attendee,
  regexp_matches(reason, {q(alt(PERSONAL_TERMS))}) as has_personal
from r""", rule_view=True))
def r6(spark, d):
    v = requests_with_category(spark, d, rules=True)
    r = F.col("reason")
    return v.select("request_id", RU.match_any(r, RU.ROOM_TERMS).alias("has_place"),
                    RU.match_any(r, RU.attendee_terms()).alias("has_attendee"),
                    RU.match_any(r, PERSONAL_TERMS).alias("has_personal"))


def _term_table(spark, d):
    """Terms of any number: the benchmark's longer words and the customers' names."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("term"))
    return (words.select("term", F.lit("word").alias("kind"))
            .unionByName(table(spark, d, "customer").select(F.col("c_name").alias("term"), F.lit("customer").alias("kind"))).distinct())


_TERMS_SQL = with_views("""
, terms as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) as term, 'word' as kind from benchmark
  union select c_name, 'customer' from customer)
select r.request_id, count(*) as n_terms, count(distinct t.kind) as n_kinds, min(t.term) as first_term
from r join terms t on contains(r.reason, t.term) group by r.request_id""", rule_view=True)


def _terms_found(spark, d, find):
    v = requests_with_category(spark, d, rules=True).select("request_id", "reason")
    terms = _term_table(spark, d).select("term", F.struct("kind", "term").alias("label"))
    found = find(v, terms, "request_id", "reason")
    return found.groupBy(F.col("key").alias("request_id")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_distinct("label.kind").alias("n_kinds"), F.min("label.term").alias("first_term"))


@register("R6_term_table", _TERMS_SQL)
def r6_term_table(spark, d):
    """R6 with a table of terms: one pass per text, whatever their number."""
    return _terms_found(spark, d, TM.term_matches)


@register("R6_term_table_joined", _TERMS_SQL)
def r6_term_table_joined(spark, d):
    """The same in the form that tables beyond the broadcast take: substrings joined to anchors."""
    return _terms_found(spark, d, TM.joined_matches)


@register("R7_missing_reason_hold", with_views(f"""
, dd as (select request_id, category, ({POLICY_SQL['lenient']()}).decision as decision from r where {blank('reason')})
select request_id, category, decision from dd""", rule_view=True))
def r7(spark, d):
    v = requests_with_category(spark, d, rules=True).filter(is_blank("reason"))
    return RU.decide(v, "lenient").select("request_id", "category", "decision")


@register("R8_reject_reasons", with_views(f"""
, dd as (select category, {POLICY_SQL['three']()} as res from r)
select category, res.reject_reason as reject_reason, count(*) as n
from dd where res.decision = '거절' group by category, res.reject_reason""", rule_view=True))
def r8(spark, d):
    dd = decided(spark, d, "three").filter(F.col("decision") == REJECT)
    return dd.groupBy("category", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def _r10_sql():
    cols = ", ".join(f"({POLICY_SQL[p]()}).decision as d_{p}" for p in RU.POLICIES)
    s = lambda a, b: f"sum(case when d_{a} = d_{b} then 1 else 0 end)"
    return with_views(f"""
, dd as (select category, {cols} from r)
select category, count(*) as n,
  {s('three', 'strict')} as agree_three_strict,
  {s('strict', 'strict_docnum')} as agree_strict_docnum,
  {s('strict', 'lenient')} as agree_strict_lenient,
  {s('three', 'match')} as agree_three_match,
  sum(case when d_strict = d_strict_docnum and d_strict = d_lenient then 1 else 0 end) as agree_two_outcome
from dd group by category""", rule_view=True)


@register("R10_policy_agreement", _r10_sql())
def r10(spark, d):
    v = requests_with_category(spark, d, rules=True)
    return RU.policy_agreement(RU.decide_all(v))


@register("J7_policy_join", with_views(f"""
select request_id, r.category, p.policy_class from r left join (values
  ({q(CATEGORIES[0])}, 'personal'), ({q(CATEGORIES[1])}, 'meeting'),
  ({q(CATEGORIES[2])}, 'other_work'), ({q(CATEGORIES[3])}, 'trip')) p(category, policy_class)
  on r.category = p.category"""))
def j7(spark, d):
    v = requests_with_category(spark, d)
    return RU.with_policy(v, spark).select("request_id", "category", "policy_class")


@register("P15_parse_decision", with_views(f"""
, dd as (select request_id, category, {POLICY_SQL['lenient']()} as res from r),
  t as (select request_id, '- 결정: ' || res.decision || '\n- 사유: ' || res.reject_reason as decision_text from dd)
select request_id, decision_text,
  case when contains(decision_text, '결정: 승인') then '승인'
       when contains(decision_text, '결정: 거절') then '거절' else '' end as decision,
  case when contains(decision_text, '결정: 승인') then ''
       when contains(decision_text, '결정: 거절') and contains(decision_text, '- 사유: ')
         then regexp_replace(string_split(decision_text, '- 사유: ')[2], '^\\s+|\\s+$', '', 'g')
       else '' end as reject_reason
from t""", rule_view=True))
def p15(spark, d):
    dd = decided(spark, d, "lenient")
    text = F.concat(F.lit("- 결정: "), F.col("decision"), F.lit("\n- 사유: "), F.col("reject_reason"))
    parsed = RD.parse_decision(text)
    return dd.select("request_id", text.alias("decision_text"),
                     parsed.getField("decision").alias("decision"),
                     parsed.getField("reject_reason").alias("reject_reason"))
