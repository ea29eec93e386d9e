"""Policies: the 14 worked examples (names replaced), missing reasons, decision parsing."""

import pytest
from pyspark.sql import functions as F

from deskpass.functions import rules as RU
from deskpass.functions.render import parse_decision
from deskpass.schema import CAT_MEETING, CAT_OTHER, CAT_PERSONAL, CAT_TRIP

WORKED = [
    (CAT_MEETING, "화장실 고도화 미팅, 우드룸, 홍길동", "승인"),
    (CAT_MEETING, "흡연 방지 회의, 5층, 홍길동", "승인"),
    (CAT_MEETING, "회의 참석", "거절"),
    (CAT_MEETING, "회의", "보류"),
    (CAT_PERSONAL, "흡연", "승인"),
    (CAT_PERSONAL, "화장실", "승인"),
    (CAT_PERSONAL, "문서 검토", "거절"),
    (CAT_PERSONAL, "시간 필요", "보류"),
    (CAT_OTHER, "거래처 자료 전달 업무", "승인"),
    (CAT_OTHER, "업무 요청", "거절"),
    (CAT_OTHER, "업무 관련 요청", "보류"),
    (CAT_TRIP, "AUTON20240101, 서울 본사 미팅", "승인"),
    (CAT_TRIP, "출장 요청", "거절"),
    (CAT_TRIP, "서울 출장", "보류"),
]


def _decide(spark, rows, policy):
    df = spark.createDataFrame(rows, "category string, reason string")
    return [r.decision for r in RU.decide(df, policy).collect()]


def test_worked_examples_three_outcome(spark):
    got = _decide(spark, [(c, r) for c, r, _ in WORKED], "three")
    assert got == [d for _, _, d in WORKED]


@pytest.mark.parametrize("policy", RU.POLICIES)
def test_missing_reason_is_hold(spark, policy):
    got = _decide(spark, [(CAT_MEETING, None), (CAT_TRIP, ""), (CAT_OTHER, " \t\n")], policy)
    assert got == ["보류", "보류", "보류"]


@pytest.mark.parametrize("policy", ["strict", "strict_docnum", "lenient"])
def test_two_outcome_policies_never_hold_with_reason(spark, policy):
    rows = [(c, r) for c, r, _ in WORKED] + [("(기타)미분류", "아무 사유"), (None, "사유")]
    got = _decide(spark, rows, policy)
    assert set(got) <= {"승인", "거절"}
    assert got[-2:] == ["거절", "거절"]


def test_strict_vs_docnum_route(spark):
    rows = [(CAT_TRIP, "AUTON123"), (CAT_TRIP, "서울 거래처 방문")]
    assert _decide(spark, rows, "strict") == ["거절", "승인"]
    assert _decide(spark, rows, "strict_docnum") == ["승인", "승인"]


def test_reject_reasons_name_the_condition(spark):
    df = spark.createDataFrame([(CAT_MEETING, "회의 참석"), (CAT_PERSONAL, "문서 검토")], "category string, reason string")
    out = RU.decide(df, "three").collect()
    assert [r.reject_reason for r in out] == [RU.MSG_NO_PLACE, RU.MSG_WORK_REASON]


def test_match_any_equals_regex(spark):
    texts = ["3층 회의실", "층", "ROSY room", "no place", "12층", None, "외부장소에서"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = [r[0] for r in df.select(RU.match_any("t", RU.ROOM_TERMS)).collect()]
    b = [r[0] for r in df.select(F.col("t").rlike(RU.alt(RU.ROOM_TERMS))).collect()]
    assert a == b


def test_doc_number(spark):
    df = spark.createDataFrame([("AUTON20240101, 서울",), ("번호 AUTON",), ("AUTONX1",)], "reason string")
    tok = RU.reason_tokens("reason")
    got = [(r[0], r[1]) for r in df.select(RU.has_doc_number(tok), RU.has_doc_number_loose("reason")).collect()]
    assert got == [(True, True), (False, True), (False, True)]


def test_rules_then_model(spark):
    df = spark.createDataFrame([("승인", "거절"), ("보류", "승인"), (None, "거절")], "rule string, model string")
    assert [r[0] for r in df.select(RU.rules_then_model("rule", "model")).collect()] == ["승인", "승인", "거절"]


@pytest.mark.parametrize("text,decision,reason", [
    ("- 결정: 승인\n- 사유: ", "승인", ""),
    ("- 결정: 거절\n- 사유: 장소 누락", "거절", "장소 누락"),
    ("- 결정: 거절", "거절", ""),
    ("판단 불가", "", ""),
])
def test_parse_decision(spark, text, decision, reason):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(parse_decision("t").alias("p")).collect()[0].p
    assert (r.decision, r.reject_reason) == (decision, reason)


def test_pattern_terms_equal_rlike(spark):
    texts = ["3층 회의", "d층", "1회의실", "제1회의실", "b", "ab", "5층", "[0-9]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (["\\d+층"], ["[0-9]{1,2}층"], ["a|b"], ["(제)?1회의실"], ["[0-9]+층", "회의"]):
        got = df.select(RU.match_any("t", terms), F.col("t").rlike(RU.alt(terms))).collect()
        assert all(a == b for a, b in got)


def test_names_may_be_any_iterable(spark):
    df = spark.createDataFrame([("(업무)회의", "고도화 미팅, 우드룸, 김새롬")], "category string, reason string")
    for _ in range(2):
        out = RU.decide(df, "three", names=(n for n in ["김새롬"])).first()
        assert out.decision == "승인"


def test_each_model_beats_always_approving(spark):
    from deskpass.operators import ml as ML
    rows = [(i, f"request {'good fine' if i % 5 else 'bad wrong'} {i % 7}", float(i % 5 != 0), None if i % 2 else "(업무)회의",
             float(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, label double, category string, flag double")
    for p in (ML.text_forest("t"), ML.text_logistic("t", n_rows=200), ML.feature_forest("category", ["flag"]), ML.text_boosted("t", max_iter=3)):
        out = ML.predict(p.fit(df), df, ["label"]).collect()
        assert len(out) == 200 and all(r.label == r.prediction for r in out)


def test_tree_learners_get_kept_rows_in_bounded_partitions(spark, monkeypatch):
    from pyspark.sql import types as T

    from deskpass.operators import ml as ML
    made = spark.sparkContext.accumulator(0)

    @F.udf(T.StringType())
    def text(i):
        made.add(1)
        return f"request {'good fine' if i % 5 else 'bad wrong'} {i % 7}"

    df = spark.range(0, 200, 1, 2).select(text("id").alias("t"), (F.col("id") % 5 != 0).cast("double").alias("label"))
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), sorted(rows.columns), [rows.count() for _ in range(3)]))

    monkeypatch.setattr(ML, "PARTITION_BYTES", 10 * 4 * 16)
    ML.OnKeptRows(Learner(), ["t", "label"], 16).fit(df)
    assert seen == [(20, ["label", "t"], [200] * 3)] and made.value == 200
    monkeypatch.undo()
    ML.OnKeptRows(Learner(), ["t", "label"], 16).fit(df)
    assert seen[1][0] == 2  # few rows stay where they are
    # the texts of a forest: read to choose the terms and once for its rows, not for every pass over these
    made.value = 0
    ML.text_forest("t").fit(df)
    assert made.value <= 3 * 200


def test_tree_learners_get_no_more_partitions_than_their_rows_need(spark, monkeypatch):
    """Every task of a tree learner hands on the sums of all nodes, so rows in many small partitions cost as many sums."""
    from deskpass.operators import ml as ML
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), sorted(r.label for r in rows.collect())))

    df = spark.range(0, 200, 1, 50).select(F.col("id").cast("string").alias("t"), F.col("id").cast("double").alias("label"))
    monkeypatch.setattr(ML, "PARTITION_BYTES", 25 * 4 * 16)
    ML.OnKeptRows(Learner(), ["t", "label"], 16).fit(df)
    monkeypatch.setattr(ML, "PARTITION_BYTES", 100 * 4 * 16)
    ML.OnKeptRows(Learner(), ["t", "label"], 16).fit(df)
    every = [float(i) for i in range(200)]
    assert seen == [(8, every), (spark.sparkContext.defaultParallelism, every)]
