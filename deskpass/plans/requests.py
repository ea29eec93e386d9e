"""Projections, filters and scalar functions over the request view."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.functions import labels as L
from deskpass.functions import render as R
from deskpass.functions import text as X
from deskpass.functions import times as TM
from deskpass.plans.registry import register
from deskpass.plans.sqlbits import CATS, last_segment, q, strip, with_views
from deskpass.schema import CATEGORIES, CAT_PERSONAL, REQUIRED_MESSAGE, SOURCE_COLUMNS
from deskpass.sources.tables import request_view, table


def requests_with_category(spark, sf_dir, rules=False, status=False):
    """Requests and their category; ``status=True`` adds the status (a join), ``rules=True`` the worked examples."""
    from deskpass.sources.tables import rule_request_view
    view = rule_request_view if rules else request_view
    return view(spark, sf_dir, status).withColumn("category", X.last_segment("request_raw"))


@register("P1_keep_columns", with_views("select request_raw, reason, status from r"))
def p1(spark, d):
    return request_view(spark, d).select("request_raw", "reason", "status")


@register("P2_last_segment", with_views(
    "select request_id, request_raw, category, "
    "case when contains(request_raw, '/') then category else request_raw end as category_loose from r"))
def p2(spark, d):
    return requests_with_category(spark, d).select(
        "request_id", "request_raw", "category",
        X.last_segment_loose("request_raw").alias("category_loose"))


@register("P3a_binary_label", with_views(
    "select request_id, status, case status when '승인됨' then 1 when '거절됨' then 0 end as label, "
    "case case status when '승인됨' then 1 when '거절됨' then 0 end when 1 then '승인됨' when 0 then '거절됨' end"
    " as status_back from r"))
def p3a(spark, d):
    v = request_view(spark, d).withColumn("label", L.encode_status("status"))
    return v.select("request_id", "status", "label", L.decode_status("label").alias("status_back"))


@register("P3b_status_code", with_views(
    "select request_id, status, case status when '승인됨' then 0 when '거절됨' then 1 "
    "when '취소됨' then 2 when '대기중' then 3 end as code, "
    "case when status in ('승인됨','거절됨','취소됨','대기중') then status end as status_back from r"))
def p3b(spark, d):
    v = request_view(spark, d).withColumn("code", L.status_code("status"))
    return v.select("request_id", "status", "code", L.decode_status_code("code").alias("status_back"))


@register("P4_drop_null_status", with_views(
    "select request_id, status from r where status is not null"))
def p4(spark, d):
    return request_view(spark, d).dropna(subset=["status"]).select("request_id", "status")


@register("P5_null_label_rows", with_views(
    "select request_id, status from r where status is null or status not in ('승인됨', '거절됨')"))
def p5(spark, d):
    v = request_view(spark, d)
    return v.filter(L.encode_status("status").isNull()).select("request_id", "status")


@register("P6_valid_categories", with_views(
    f"select request_id, category from r where category in {CATS}"))
def p6(spark, d):
    return (requests_with_category(spark, d).filter(F.col("category").isin(CATEGORIES))
            .select("request_id", "category"))


@register("P7_model_text", with_views(
    "select request_id, category || ' ' || coalesce(reason, '') as model_text from r"))
def p7(spark, d):
    v = requests_with_category(spark, d)
    return v.select("request_id", L.model_text("category", "reason").alias("model_text"))


@register("P8_reason_length", with_views(
    "select request_id, cast(length(reason) as integer) as reason_len from r"))
def p8(spark, d):
    return request_view(spark, d, status=False).select("request_id", X.char_length("reason").alias("reason_len"))


@register("P9_duplicate_flag", with_views(
    "select request_id, coalesce(cast(contains(approver_note, '중복') as integer), 0) as dup_flag from r"))
def p9(spark, d):
    return request_view(spark, d, status=False).select("request_id", L.duplicate_flag("approver_note").alias("dup_flag"))


_P10_COLS = ["request_raw", "reason", "status", "approver_note"]
_P10_LABELS = [SOURCE_COLUMNS[c] for c in _P10_COLS]


def _p10_sql():
    parts = [f"case when {c} is not null then {q(n + ': ')} || {c} end" for c, n in zip(_P10_COLS, _P10_LABELS)]
    return with_views(f"select request_id, concat_ws(' ', {', '.join(parts)}) as row_text from r")


@register("P10_row_to_text", _p10_sql())
def p10(spark, d):
    return request_view(spark, d).select("request_id", R.row_to_text(_P10_COLS, _P10_LABELS).alias("row_text"))


@register("P11_row_values_text", with_views(
    "select request_id, concat_ws(' ', " + ", ".join(f"coalesce({c}, 'nan')" for c in _P10_COLS)
    + ") as values_text from r"))
def p11(spark, d):
    return request_view(spark, d).select("request_id", R.row_values_text(_P10_COLS).alias("values_text"))


@register("P12_training_record", with_views(
    "select request_id, '요청: ' || coalesce(request_raw, 'nan') || ', 요청 사유: ' || coalesce(reason, 'nan') as prompt, "
    "coalesce(status, 'nan') || ': ' || coalesce(approver_note, 'nan') as completion from r"))
def p12(spark, d):
    v = request_view(spark, d)
    rec = R.training_record("request_raw", "reason", "status", "approver_note")
    return v.select("request_id", rec.getField("prompt").alias("prompt"),
                    rec.getField("completion").alias("completion"))


@register("S7_jsonl_text", with_views(
    "select request_id, to_json({'prompt': '요청: ' || coalesce(request_raw, 'nan') || ', 요청 사유: ' "
    "|| coalesce(reason, 'nan'), 'completion': coalesce(status, 'nan') || ': ' || coalesce(approver_note, 'nan')})"
    " as json_line from r"))
def s7(spark, d):
    v = request_view(spark, d)
    rec = R.training_record("request_raw", "reason", "status", "approver_note")
    return v.select("request_id", R.to_json_line(rec).alias("json_line"))


CHAT_SYSTEM = "직원 요청을 승인, 거절, 보류 중 하나로 판단합니다."


@register("P13_chat_record", with_views(
    "select request_id, to_json({'messages': [{'role': 'system', 'content': " + q(CHAT_SYSTEM) + "}, "
    "{'role': 'user', 'content': '요청: ' || coalesce(request_raw, 'nan') || ', 요청 사유: ' || coalesce(reason, 'nan')}, "
    "{'role': 'assistant', 'content': coalesce(status, 'nan') || ': ' || coalesce(approver_note, 'nan')}]}) "
    "as json_line from r"))
def p13(spark, d):
    v = request_view(spark, d)
    rec = R.training_record("request_raw", "reason", "status", "approver_note")
    chat = R.chat_record(CHAT_SYSTEM, rec.getField("prompt"), rec.getField("completion"))
    return v.select("request_id", R.to_json_line(chat).alias("json_line"))


# Decision prompt (own wording); holes are filled per row, never twice.
DECISION_TEMPLATE = ("직원 요청을 승인, 거절, 보류 중 하나로 판단하세요.\n"
                     "### 문서 정보\n{context}\n"
                     "요청 종류: {request_type}\n요청 사유: {request_reason}\n결정:")


@register("P14_render_prompt", with_views(
    "select request_id, '직원 요청을 승인, 거절, 보류 중 하나로 판단하세요.\n### 문서 정보\n' "
    "|| coalesce(approver_note, '') || '\n요청 종류: ' || coalesce(category, '') || '\n요청 사유: ' "
    "|| coalesce(reason, '') || '\n결정:' as prompt from r"))
def p14(spark, d):
    v = requests_with_category(spark, d)
    p = R.render_prompt(DECISION_TEMPLATE, context="approver_note", request_type="category",
                        request_reason="reason")
    return v.select("request_id", p.alias("prompt"))


@register("P16_strip_form_suffix", with_views(
    f"select request_id, category || case when category = {q(CAT_PERSONAL)} then ' (휴게 O)' else ' (휴게 X)' end"
    " as form_value, category as form_stripped from r where category is not null"))
def p16(spark, d):
    v = requests_with_category(spark, d).filter(F.col("category").isNotNull())
    form = F.concat("category", F.when(F.col("category") == CAT_PERSONAL, F.lit(" (휴게 O)"))
                    .otherwise(F.lit(" (휴게 X)")))
    return v.select("request_id", form.alias("form_value"),
                    X.strip_form_suffix(form).alias("form_stripped"))


@register("P17_validate_required", with_views(
    f"select request_id, case when category is null or {strip('category')} = '' or reason is null "
    f"or {strip('reason')} = '' then {q(REQUIRED_MESSAGE)} end as message from r"))
def p17(spark, d):
    v = requests_with_category(spark, d)
    return v.select("request_id", L.validate_required("category", "reason").alias("message"))


@register("P18_py_strip", with_views(
    f"select request_id, {strip('reason')} as reason_stripped, {last_segment('request_raw')} as category from r"))
def p18(spark, d):
    v = request_view(spark, d, status=False)
    return v.select("request_id", X.py_strip("reason").alias("reason_stripped"),
                    X.last_segment("request_raw").alias("category"))


@register("P19_ts_text", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_local, "
          "strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M:%S') as ts_kst from events")
def p19(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", TM.ts_text("ts").alias("ts_local"), TM.ts_text_zoned("ts").alias("ts_kst"))


@register("P20_iso_day", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when strftime(ts, '%f') = '000000' "
          "then '' else '.' || strftime(ts, '%f') end as iso, strftime(ts, '%Y%m%d') as day from events")
def p20(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", TM.iso_text("ts").alias("iso"), TM.day_key("ts").alias("day"))


@register("P21_session_id")
def p21(spark, d):
    conv = table(spark, d, "conversations").select("conv_id").distinct()
    return conv.select("conv_id", TM.session_id().alias("session_id"))


@register("P22_nfkc")
def p22(spark, d):
    """Page text with its markup's compatibility characters in composed form (titles hold some in every language)."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", X.nfkc(F.col("url")).alias("url_nfkc"), F.char_length(X.nfkc(F.col("html"))).alias("html_chars"))


@register("P23_clean_text", "select doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), "
          "'\\s+', ' ', 'g')) as clean from documents")
def p23(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", X.clean_text("text").alias("clean"))


@register("P24_try_parse", "select event_id, part, try_cast(v as integer) as k, v is null as absent, "
          "v is not null and try_cast(v as integer) is null as parse_error from ("
          "select event_id, 'props' as part, json_extract_string(props, '$.k') as v from events union all "
          "select event_id, 'type' as part, event_type as v from events)")
def p24(spark, d):
    """Values that parse (a JSON key), are absent (the key is missing) and fail (event types as numbers)."""
    ev = table(spark, d, "events")
    both = ev.select("event_id", F.explode(F.array(
        F.struct(F.lit("props").alias("part"), F.get_json_object("props", "$.k").alias("v")),
        F.struct(F.lit("type").alias("part"), F.col("event_type").alias("v")))).alias("x")).select("event_id", "x.*")
    k = F.col("v").try_cast("int")
    return both.select("event_id", "part", k.alias("k"), F.col("v").isNull().alias("absent"),
                       (F.col("v").isNotNull() & k.isNull()).alias("parse_error"))
