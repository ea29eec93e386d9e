"""Metrics, balance and the hold-out report on a fixed predictor.

The fixed predictor flips the ``labels.quality`` label for ids whose hash
falls in the lowest tenth, so the metrics have something to measure.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.operators import metrics as M
from deskpass.plans.registry import register
from deskpass.sources.tables import table

HASH_SQL = "('0x' || substr(md5(cast({k} as varchar)), 1, 15))::bigint"
FIXED_PRED_SQL = (f"select doc_id, quality as label, case when {HASH_SQL.format(k='doc_id')} % 100 < 10 "
                  "then 1 - quality else quality end as prediction, "
                  f"quality * 2 + toxic as cls, case when {HASH_SQL.format(k='doc_id')} % 100 < 15 "
                  "then (quality * 2 + toxic + 1) % 4 else quality * 2 + toxic end as cls_pred, "
                  f"{HASH_SQL.format(k='doc_id')} % 100 < 20 as is_test from labels")


def fixed_predictions(spark, d):
    lab = table(spark, d, "labels")
    pm = F.pmod(M.id_hash("doc_id"), F.lit(100))
    cls = F.col("quality") * 2 + F.col("toxic")
    return lab.select(
        "doc_id", F.col("quality").alias("label"),
        F.when(pm < 10, 1 - F.col("quality")).otherwise(F.col("quality")).alias("prediction"),
        cls.alias("cls"), F.when(pm < 15, F.pmod(cls + 1, F.lit(4))).otherwise(cls).alias("cls_pred"),
        M.holdout_flag("doc_id").alias("is_test"))


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("A1_accuracy", f"with p as ({FIXED_PRED_SQL}) select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from p")
def a1(spark, d):
    return M.accuracy(fixed_predictions(spark, d)).select(_r("accuracy"))


def _per_class_sql(src: str, label: str, pred: str) -> str:
    return f"""
, cm as (select {label} as label, {pred} as prediction, count(*) as n from {src} group by all),
cl as (select distinct c from (select label as c from cm union all select prediction from cm)),
s as (select c,
   coalesce((select sum(n) from cm where label = c), 0) as support,
   coalesce((select sum(n) from cm where prediction = c), 0) as predicted,
   coalesce((select sum(n) from cm where label = c and prediction = c), 0) as tp from cl),
m as (select c, support, case when predicted = 0 then 0.0 else tp / predicted end as precision,
   case when support = 0 then 0.0 else tp / support end as recall from s),
f as (select c, support, precision, recall, case when precision + recall = 0 then 0.0
   else 2 * precision * recall / (precision + recall) end as f1 from m)"""


A2_SQL = (f"with p as ({FIXED_PRED_SQL})" + _per_class_sql("p", "cls", "cls_pred")
          + "\nselect c as class, round(precision, 6) as precision, round(recall, 6) as recall, "
          "round(f1, 6) as f1, cast(support as bigint) as support from f")


@register("A2_per_class_report", A2_SQL)
def a2(spark, d):
    rep = M.per_class(fixed_predictions(spark, d), "cls", "cls_pred")
    return rep.select("class", _r("precision"), _r("recall"), _r("f1"), "support")


A3_SQL = (f"with p as ({FIXED_PRED_SQL})" + _per_class_sql("p", "cls", "cls_pred") + """
select 'macro' as average, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f
union all
select 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6) from f""")


@register("A3_macro_weighted", A3_SQL)
def a3(spark, d):
    rep = M.per_class(fixed_predictions(spark, d), "cls", "cls_pred")
    return M.averages(rep).select("average", _r("precision"), _r("recall"), _r("f1"))


@register("A4_confusion_matrix", f"""with p as ({FIXED_PRED_SQL})
select cls as label, """ + ", ".join(
    f"cast(sum(case when cls_pred = {i} then 1 else 0 end) as bigint) as \"{i}\"" for i in range(4))
    + " from p group by cls")
def a4(spark, d):
    return M.confusion_matrix(fixed_predictions(spark, d), [0, 1, 2, 3], "cls", "cls_pred")


@register("A5_class_distribution", "select quality, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share "
          "from labels group by quality")
def a5(spark, d):
    return M.class_distribution(table(spark, d, "labels"), "quality").select("quality", "n", _r("share"))


@register("A9_class_weights", """with c as (select quality, count(*) as nc from labels group by quality)
select l.doc_id, l.quality, round((select sum(nc) from c) / ((select count(*) from c) * c.nc), 6) as weight
from labels l join c on l.quality = c.quality""")
def a9(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return M.class_weights(lab, "quality").select("doc_id", "quality", _r("weight"))


_H = HASH_SQL.format(k="doc_id")


@register("A10_undersample", f"""with c as (select quality, count(*) as n from labels group by quality)
select doc_id, quality from (select doc_id, quality,
  row_number() over (partition by quality order by {_H}, doc_id) as rk from labels) x
where rk <= (select min(n) from c)""")
def a10(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return M.undersample(lab, "quality", "doc_id").select("doc_id", "quality")


@register("A10_oversample", f"""with c as (select quality, count(*) as n from labels group by quality),
s as (select quality, (select max(n) from c) // n as rep, (select max(n) from c) % n as rem from c),
l as (select doc_id, l.quality, rep, rem, row_number() over (partition by l.quality order by {_H}, doc_id) as rk
      from labels l join s on l.quality = s.quality)
select doc_id, quality, g.copy_no from l, generate_series(1, rep) g(copy_no)
union all
select doc_id, quality, rep + 1 as copy_no from l where rk <= rem""")
def a10b(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return M.oversample(lab, "quality", "doc_id").select("doc_id", "quality", "copy_no")


@register("M1_holdout_split", f"select doc_id, {_H} % 100 < 20 as is_test from labels")
def m1(spark, d):
    return table(spark, d, "labels").select("doc_id", M.holdout_flag("doc_id").alias("is_test"))


M9_SQL = (f"with p0 as ({FIXED_PRED_SQL}), p as (select * from p0 where is_test)"
          + _per_class_sql("p", "label", "prediction") + """
select cast(c as varchar) as name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f
union all
select 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) from f
union all
select 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6) from f
union all
select 'accuracy', null, null, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) from p""")


@register("M9_holdout_report", M9_SQL)
def m9(spark, d):
    test = fixed_predictions(spark, d).filter("is_test")
    rep = M.per_class(test, "label", "prediction")
    rows = rep.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1")
    avg = M.averages(rep).select(F.col("average").alias("name"), "precision", "recall", "f1")
    acc = M.accuracy(test).select(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                                  F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"))
    return rows.unionByName(avg).unionByName(acc).select("name", _r("precision"), _r("recall"), _r("f1"))
