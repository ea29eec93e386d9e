"""Driver tables and the request views derived from them (FIXTURES.md §2).

The reference ships no request history, so requests are derived from
``documents`` ⟕ ``labels``. Reasons keep the whole document text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpass.schema import CATEGORIES, CAT_MEETING, CAT_OTHER, CAT_PERSONAL, CAT_TRIP

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the fixture: category by doc_id % 5 and the worked-example
# reasons by doc_id % 14, in this order.
FIXTURE_CATEGORY_ORDER = [CAT_PERSONAL, CAT_MEETING, CAT_OTHER, CAT_TRIP, "(기타)미분류"]
EXAMPLE_REASONS = [
    "화장실 고도화 미팅, 우드룸, 홍길동",
    "흡연 방지 회의, 5층, 홍길동",
    "회의 참석",
    "회의",
    "흡연",
    "화장실",
    "문서 검토",
    "시간 필요",
    "거래처 자료 전달 업무",
    "업무 요청",
    "업무 관련 요청",
    "AUTON20240101, 서울 본사 미팅",
    "출장 요청",
    "서울 출장",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet; Catalyst prunes columns and pushes filters into the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def request_view(spark: SparkSession, sf_dir: str, status: bool = True) -> DataFrame:
    """D1 stand-in: request_id, request_raw, reason, status, approver_note.

    One row per document; labels (unique per doc_id) give the approve/reject
    status. Nulls, blanks and a trailing-slash style are produced by id rules so
    every null path is exercised. ``status=False`` leaves the status out and with
    it the join to ``labels``, so texts stay where they were scanned.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    raw = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("lang"), F.lit("/ "), _pick(k % 5, FIXTURE_CATEGORY_ORDER)))
    reason = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    note = (F.when(k % 7 == 0, F.lit("중복 요청"))
            .when(k % 5 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("source")))
    cols = [k.alias("request_id"), raw.alias("request_raw"), reason.alias("reason"), note.alias("approver_note")]
    if not status:
        return d.select(*cols)
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = (F.when(F.col("quality") == 1, F.lit("승인됨"))
             .when(F.col("quality") == 0, F.lit("거절됨"))
             .when(k % 3 == 0, F.lit("취소됨"))
             .when(k % 3 == 1, F.lit("대기중")))
    return j.select(*cols[:3], state.alias("status"), cols[3])


def _examples() -> list[tuple[int, str, str]]:
    """The worked examples as requests of every category: (negative id, request, reason)."""
    n = len(EXAMPLE_REASONS)
    return [(-(1 + c * n + k), f"ko/ {category}", reason)
            for c, category in enumerate(FIXTURE_CATEGORY_ORDER) for k, reason in enumerate(EXAMPLE_REASONS)]


def rule_request_view(spark: SparkSession, sf_dir: str, status: bool = False) -> DataFrame:
    """Request view plus the worked examples as further rows (a fixed number, negative ids, no status or note)."""
    more = spark.createDataFrame(_examples(), "request_id long, request_raw string, reason string")
    return request_view(spark, sf_dir, status).unionByName(more, allowMissingColumns=True)


# Oracle SQL for the same views (DuckDB dialect), used by the plans.
REQUEST_VIEW_SQL = """
select d.doc_id as request_id,
  case when d.doc_id % 11 = 0 then null
       else concat(d.lang, '/ ', case d.doc_id % 5
         when 0 then '(비업무)개인시간_흡연 등' when 1 then '(업무)회의'
         when 2 then '(업무)기타업무' when 3 then '(업무)출장,이동,외근'
         else '(기타)미분류' end) end as request_raw,
  case when d.doc_id % 17 = 0 then null else d.text end as reason,
  case when l.quality = 1 then '승인됨' when l.quality = 0 then '거절됨'
       when d.doc_id % 3 = 0 then '취소됨' when d.doc_id % 3 = 1 then '대기중'
       else null end as status,
  case when d.doc_id % 7 = 0 then '중복 요청'
       when d.doc_id % 5 = 0 then null else d.source end as approver_note
from documents d left join labels l on d.doc_id = l.doc_id
"""


def _example_values_sql() -> str:
    return ",\n  ".join(f"({i}, '{raw}', '{reason}', null, null)" for i, raw, reason in _examples())


RULE_VIEW_SQL = f"""
select * from ({REQUEST_VIEW_SQL})
union all select * from (values
  {_example_values_sql()}) ex(request_id, request_raw, reason, status, approver_note)
"""

assert FIXTURE_CATEGORY_ORDER[:4] == CATEGORIES
