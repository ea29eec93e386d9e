"""Many terms in many texts: both forms against one search per term."""

import random

import pytest
from pyspark.sql import functions as F

from deskpass.functions import rules as RU
from deskpass.operators import terms as TM

FORMS = [TM.scanned_matches, TM.joined_matches, lambda *a: TM.joined_matches(*a, stretch=7)]


def fixture(spark, n_terms=300):
    rng = random.Random(4)
    letter = lambda: rng.choice("abcd층𝒳é ")
    word = lambda n: "".join(letter() for _ in range(n))
    terms = [(word(rng.randint(1, 9)), f"L{rng.randrange(5)}") for _ in range(n_terms)] + [(None, "L0"), ("", "L1"), ("a.b|c", "L2"), ("aaaa", None)]
    terms += terms[:20]
    texts = [(k, word(rng.randint(0, 120))) for k in range(120)] + [(500, None), (501, ""), (3, "x a.b|c y"), (502, "ab" * 5000), (None, "abc"), (503, "line\nbreak a.b|c\n")]
    return (spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, label string"), texts, terms)


@pytest.mark.parametrize("form", FORMS, ids=["scan", "join", "join in short stretches"])
def test_matches_equal_one_search_per_term(spark, form):
    texts, terms, t, w = fixture(spark)
    got = sorted(map(str, ((r.key, r.label) for r in form(texts, terms).collect())))
    want = sorted(map(str, {(k, lab) for k, x in t if x is not None for term, lab in w if term and term in x}))
    assert got == want
    assert form(texts.limit(0), terms).count() == 0 and form(texts, terms.limit(0)).count() == 0


def test_a_hundred_thousand_terms(spark):
    staff = spark.range(100_000).select(F.concat(F.lit("직원"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("term"), F.lit("staff").alias("label"))
    texts = spark.range(400).select("id", F.concat(F.lit("회의 3층 "), F.when(F.col("id") % 4 == 0, F.concat(F.lit("직원"), F.lpad((F.col("id") * 300).cast("string"), 6, "0")))
                                                   .otherwise(F.lit("직원 없음"))).alias("text"))
    want = {k for k in range(400) if k % 4 == 0 and k * 300 < 100_000}
    for limit in (TM.AUTOMATON_BYTES, 0):
        got = {r.key for r in TM.term_matches(texts, staff, automaton_bytes=limit).collect()}
        assert got == want
    flags = {r.key: r.staff for r in TM.match_flags(texts, staff, ["staff"]).collect()}
    assert flags == {k: k in want for k in range(400)}


def test_policy_with_a_staff_table_equals_the_list(spark):
    names = ["김철수", "이영희", "Kim.*"]
    rows = [(k, "(업무)회의", r) for k, r in enumerate(["회의 3층 김철수", "회의 3층", "3층 회의 팀장", "3층 Kim.* 주간회의", None, "", "로지 이영희 회의 자료", "김철수"])]
    rows += [(100 + k, c, "3층 김철수 회의") for k, c in enumerate(["(업무)기타업무", "(비업무)개인시간_흡연 등", None])]
    d = spark.createDataFrame(rows, "id long, category string, reason string")
    staff = spark.createDataFrame([(n,) for n in names], "term string")
    by_list = RU.decide(d, "three", names=[n for n in names if "*" not in n] + ["Kim\\.\\*"])
    key = lambda df: sorted((r.id, r.decision, r.reject_reason) for r in df.collect())
    got = RU.decide_with_staff(d, staff, "id")
    assert got.columns == by_list.columns and key(got) == key(by_list)


def test_joined_terms_with_short_anchors_and_without_shuffled_texts(spark):
    texts, terms, t, w = fixture(spark)
    want = sorted(map(str, {(k, lab) for k, x in t if x is not None for term, lab in w if term and term in x}))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = TM.joined_matches(texts, terms)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "Join" in x and "stretch" in x]
        assert sorted(map(str, ((r.key, r.label) for r in got.collect()))) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    short = TM.joined_matches(texts, terms, stretch=30, anchor_bytes=0)  # anchors of one character
    assert sorted(map(str, ((r.key, r.label) for r in short.collect()))) == want
