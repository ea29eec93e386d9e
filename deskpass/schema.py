"""Data model (D1–D14) and the fixed values results depend on.

Column names are internal English names; the Korean names of the original
request spreadsheets are kept in ``SOURCE_COLUMNS`` for readers of such files.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values used by the source scripts for
# results to agree; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# The four valid request categories.
CATEGORIES = ["(비업무)개인시간_흡연 등", "(업무)회의", "(업무)기타업무", "(업무)출장,이동,외근"]
CAT_PERSONAL, CAT_MEETING, CAT_OTHER, CAT_TRIP = CATEGORIES

# Request statuses in the history table.
STATUSES = ["승인됨", "거절됨", "취소됨", "대기중"]
APPROVED, REJECTED, CANCELLED, PENDING = STATUSES

# Binary label: approve = 1, reject = 0 (see SURVEY §1.5).
BINARY_LABEL = {"승인됨": 1, "거절됨": 0}
# Four-status code used by the multi-class model.
STATUS_CODE = {"승인됨": 0, "거절됨": 1, "취소됨": 2, "대기중": 3}

# Decisions.
DECISIONS = ["승인", "거절", "보류"]
APPROVE, REJECT, HOLD = DECISIONS

# Message for blank required inputs.
REQUIRED_MESSAGE = "요청 카테고리와 사유는 필수 항목입니다."

# Suffix that form values carry and history values do not.
FORM_SUFFIX_PATTERN = r" \(휴게 [OX]\)$"

# Meeting-room and place terms.
ROOM_TERMS = ["[0-9]+층", "로지", "ROSY", "CLOVER", "클로버", "우드", "WOOD", "오션", "OCEAN",
              "외부장소", "자리", "데스크", "타운홀"]
# Attendee titles; personal names are a parameter (placeholder name only).
TITLE_TERMS = ["팀장", "이사", "대표"]
DEFAULT_NAMES = ["홍길동"]
# Trip places (a parameter; these are the ones in the worked examples).
TRIP_PLACES = ["서울", "본사"]
# Personal activities, and work words that make a personal request a reject.
PERSONAL_TERMS = ["흡연", "화장실", "담배"]
WORK_TERMS = ["회의", "미팅", "업무", "문서", "검토", "자료", "출장", "외근", "방문"]
# Generic words that do not count as content.
OTHER_GENERIC = ["업무", "요청", "관련"]
TRIP_GENERIC = ["출장", "외근", "이동", "요청"]
MEETING_GENERIC = ["회의", "미팅", "참석", "요청"]
MEETING_TERMS = ["회의", "미팅"]
TRIP_TERMS = ["출장", "외근", "이동"]
OTHER_TERMS = ["업무", "문서", "검토", "자료"]
# Document number: prefix then digits.
DOC_NUMBER_PATTERN = "^AUTON[0-9]+"
DOC_NUMBER_LOOSE = "AUTON"
# Token separator for reasons.
TOKEN_SPLIT = "[, ]+"

# Decision-text markers.
DECISION_APPROVE_MARK = "결정: 승인"
DECISION_REJECT_MARK = "결정: 거절"
REASON_MARK = "- 사유: "

# Conversation context line.
CONTEXT_LINE = "[대화 {i}] 질문: {q}, 답변: {a}"

# Training-record formats.
PROMPT_FORMAT = "요청: {request}, 요청 사유: {reason}"
COMPLETION_FORMAT = "{status}: {note}"
NULL_TEXT = "nan"

# Chunk settings.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
CHUNK_OVERLAP_SMALL = 50

# Retrieval and memory sizes.
TOP_K = 3
TOP_K_WIDE = 5
SESSION_MEMORY = 5

# Zone of the batch decision log.
LOG_ZONE = "Asia/Seoul"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_FORMAT = "yyyyMMdd"

# Hold-out split: 20% test, seed 42.
TEST_PERCENT = 20
SEED = 42

# Column names in the source spreadsheets.
SOURCE_COLUMNS = {
    "request_raw": "요청",
    "request_type": "요청 종류",
    "reason": "요청 사유",
    "status": "상태",
    "approver_note": "승인권자 노트",
}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("request_raw", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("approver_note", T.StringType()),
])

CONVERSATION_LOG = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

FORM_LOG = T.StructType([
    T.StructField("logged_at", T.TimestampType()),
    T.StructField("request_type", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("decision", T.StringType()),
])

BATCH_LOG = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("reject_reason", T.StringType()),
    T.StructField("saved_at", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("version", T.IntegerType()),
])
