"""Written approval policies as column expressions.

The source turns each prose policy into a per-request model call; here each
policy is a nested ``when`` over the request row, so a whole request table is
decided in one projection (no shuffle). Helper columns are built once and
dropped again.
"""

from __future__ import annotations

from typing import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpass.functions.labels import is_blank
from deskpass.functions.text import _c
from deskpass.schema import (APPROVE, CAT_MEETING, CAT_OTHER, CAT_PERSONAL, CAT_TRIP,
                             CATEGORIES, DEFAULT_NAMES, DOC_NUMBER_LOOSE, DOC_NUMBER_PATTERN,
                             HOLD, MEETING_GENERIC, MEETING_TERMS, OTHER_GENERIC, OTHER_TERMS,
                             PERSONAL_TERMS, REJECT, ROOM_TERMS, TITLE_TERMS, TOKEN_SPLIT,
                             TRIP_GENERIC, TRIP_PLACES, TRIP_TERMS, WORK_TERMS)

# Reject reasons (R8); wording chosen here, one per failed condition.
MSG_NO_PLACE = "장소 누락"
MSG_NO_ATTENDEE = "참석자 누락"
MSG_NO_CONTENT = "내용 누락"
MSG_THIN = "내용 부족"
MSG_WORK_REASON = "업무 사유"
MSG_VAGUE = "사유 불충분"
MSG_UNKNOWN = "알 수 없는 카테고리"
MSG_MISMATCH = "카테고리와 사유 불일치"

POLICIES = ("three", "strict", "strict_docnum", "lenient", "match")


def alt(terms: Iterable[str]) -> str:
    return "|".join(terms)


_META = set("[](){}.*+?^$|\\")
# Literal text that a pattern term of the schema can't match without.
GUARDS = {"[0-9]+층": "층"}


def match_any(c: Column | str, terms: Iterable[str], guards: dict[str, str] = GUARDS) -> Column:
    """True when the text contains any term; same result as ``rlike(alt(terms))``.

    Literal terms become ``contains`` (a byte search), so long texts are not run
    through a many-way regex alternation at every position. Pattern terms run as
    they are; where ``guards`` names a literal text that a pattern needs, only
    on texts that contain it.
    """
    c = _c(c)
    expr = None
    for t in terms:
        if any(ch in _META for ch in t):
            e = (c.contains(guards[t]) & c.rlike(t)) if t in guards else c.rlike(t)
        else:
            e = c.contains(t)
        expr = e if expr is None else (expr | e)
    return expr if expr is not None else F.lit(False)


def attendee_terms(names: Iterable[str] = DEFAULT_NAMES) -> list[str]:
    return list(TITLE_TERMS) + list(names)


def reason_tokens(reason: Column | str) -> Column:
    """Tokens of a reason: split on commas and spaces, blanks removed."""
    return F.filter(F.split(_c(reason), TOKEN_SPLIT), lambda t: t != "")


def has_doc_number(tokens: Column) -> Column:
    """A token starting with the document prefix followed by digits."""
    return F.exists(tokens, lambda t: t.startswith(DOC_NUMBER_LOOSE) & t.rlike(DOC_NUMBER_PATTERN))


def has_doc_number_loose(reason: Column | str) -> Column:
    """R5, loose form: the reason contains the prefix anywhere."""
    return _c(reason).contains(DOC_NUMBER_LOOSE)


def _count_outside(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: ~t.isin(*words)))


def _exists_outside(tokens: Column, words: list[str]) -> Column:
    return F.exists(tokens, lambda t: ~t.isin(*words))


def _decision(d: Column, why: Column | None = None) -> Column:
    return F.struct(d.alias("decision"), (why if why is not None else F.lit("")).alias("reject_reason"))


def _ok(): return _decision(F.lit(APPROVE))
def _hold(): return _decision(F.lit(HOLD))
def _no(why: Column | str): return _decision(F.lit(REJECT), F.lit(why) if isinstance(why, str) else why)


def policy_three(category: Column, reason: Column, tokens: Column,
                 names: Iterable[str] = DEFAULT_NAMES, trip_places: Iterable[str] = TRIP_PLACES,
                 attendee: Column | None = None) -> Column:
    """R1 (+R5–R8): three-outcome policy with the worked examples' reading.

    ``attendee`` says whether the reason names one; without it ``names`` and the titles are looked up.

    Meeting: <=1 token → hold; place, attendee and >=3 tokens → approve; else reject.
    Personal: personal activity → approve; work word → reject; else hold.
    Other work: <=1 token → hold; any token besides 업무/요청/관련 → approve;
    mentions 관련 → hold; else reject.
    Trip: document number, place and >=3 tokens besides 출장/외근/이동/요청 → approve;
    place without document number → hold; else reject.
    """
    n = F.size(tokens)
    place = match_any(reason, ROOM_TERMS)
    attendee = match_any(reason, attendee_terms(names)) if attendee is None else attendee
    trip_place = match_any(reason, trip_places)
    docnum = has_doc_number(tokens)
    meeting = (F.when(n <= 1, _hold())
               .when(place & attendee & (n >= 3), _ok())
               .otherwise(_no(F.when(~place, F.lit(MSG_NO_PLACE))
                              .when(~attendee, F.lit(MSG_NO_ATTENDEE))
                              .otherwise(F.lit(MSG_THIN)))))
    personal = (F.when(match_any(reason, PERSONAL_TERMS), _ok())
                .when(match_any(reason, WORK_TERMS), _no(MSG_WORK_REASON))
                .otherwise(_hold()))
    other = (F.when(n <= 1, _hold())
             .when(_exists_outside(tokens, OTHER_GENERIC), _ok())
             .when(reason.contains("관련"), _hold())
             .otherwise(_no(MSG_VAGUE)))
    trip = (F.when(docnum & trip_place & (_count_outside(tokens, TRIP_GENERIC) >= 3), _ok())
            .when(trip_place & ~docnum, _hold())
            .otherwise(_no(F.when(~trip_place, F.lit(MSG_NO_PLACE)).otherwise(F.lit(MSG_THIN)))))
    return (F.when(is_blank(reason), _hold())
            .when(category == CAT_MEETING, meeting)
            .when(category == CAT_PERSONAL, personal)
            .when(category == CAT_OTHER, other)
            .when(category == CAT_TRIP, trip)
            .otherwise(_hold()))


def _two_outcome(category: Column, reason: Column, tokens: Column, names: Iterable[str],
                 trip_places: Iterable[str], need_attendee: bool, docnum_route: bool,
                 lenient_trip: bool) -> Column:
    att = attendee_terms(names)
    trip_places = list(trip_places)
    place = match_any(reason, ROOM_TERMS)
    attendee = match_any(reason, att)
    trip_place = match_any(reason, trip_places)
    meeting_content = F.exists(tokens, lambda t: ~t.isin(*MEETING_GENERIC) & ~match_any(t, ROOM_TERMS)
                               & ~match_any(t, att))
    trip_content = F.exists(tokens, lambda t: ~t.isin(*TRIP_GENERIC) & ~match_any(t, trip_places))
    meeting_ok = place & meeting_content & (attendee if need_attendee else F.lit(True))
    meeting_why = F.when(~place, F.lit(MSG_NO_PLACE)).when(~meeting_content, F.lit(MSG_NO_CONTENT))
    if need_attendee:
        meeting_why = meeting_why.when(~attendee, F.lit(MSG_NO_ATTENDEE))
    if lenient_trip:
        trip_ok = trip_place | match_any(reason, TRIP_TERMS)
        trip_why = F.lit(MSG_NO_PLACE)
    else:
        trip_ok = trip_place & trip_content
        if docnum_route:
            trip_ok = trip_ok | has_doc_number_loose(reason)
        trip_why = F.when(~trip_place, F.lit(MSG_NO_PLACE)).otherwise(F.lit(MSG_NO_CONTENT))
    return (F.when(is_blank(reason), _hold())
            .when(category == CAT_PERSONAL, _ok())
            .when(category == CAT_MEETING, F.when(meeting_ok, _ok()).otherwise(_no(meeting_why)))
            .when(category == CAT_OTHER, _ok())
            .when(category == CAT_TRIP, F.when(trip_ok, _ok()).otherwise(_no(trip_why)))
            .otherwise(_no(MSG_UNKNOWN)))


def policy_strict(category, reason, tokens, names=DEFAULT_NAMES, trip_places=TRIP_PLACES) -> Column:
    """Meeting needs place, content and attendee; trip needs place and content."""
    return _two_outcome(category, reason, tokens, names, trip_places, True, False, False)


def policy_strict_docnum(category, reason, tokens, names=DEFAULT_NAMES, trip_places=TRIP_PLACES) -> Column:
    """As R2a, and a trip with a document number is approved."""
    return _two_outcome(category, reason, tokens, names, trip_places, True, True, False)


def policy_lenient(category, reason, tokens, names=DEFAULT_NAMES, trip_places=TRIP_PLACES) -> Column:
    """Meeting needs place and content; trip needs a place or trip words."""
    return _two_outcome(category, reason, tokens, names, trip_places, False, False, True)


def reason_class(reason: Column) -> Column:
    """Keyword class of a reason, first match wins: personal, meeting, trip, other work."""
    return (F.when(match_any(reason, PERSONAL_TERMS), F.lit(CAT_PERSONAL))
            .when(match_any(reason, MEETING_TERMS), F.lit(CAT_MEETING))
            .when(match_any(reason, TRIP_TERMS), F.lit(CAT_TRIP))
            .when(match_any(reason, OTHER_TERMS), F.lit(CAT_OTHER)))


def policy_match(category, reason, tokens=None, names=DEFAULT_NAMES, trip_places=TRIP_PLACES) -> Column:
    """Reason class equals the category → approve; differs → reject; unknown → hold."""
    cls = reason_class(reason)
    return (F.when(is_blank(reason), _hold())
            .when(cls.isNull(), _hold())
            .when(cls == category, _ok())
            .otherwise(_no(MSG_MISMATCH)))


_POLICY_FUNCS = {
    "three": policy_three,
    "strict": policy_strict,
    "strict_docnum": policy_strict_docnum,
    "lenient": policy_lenient,
    "match": policy_match,
}


# Per session (and gone with it): the built expressions.
_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def policy_column(policy: str, category: str, reason: str, tokens: str,
                  names: Iterable[str] = DEFAULT_NAMES, trip_places: Iterable[str] = TRIP_PLACES) -> Column:
    """The decision struct of ``policy`` over the named columns.

    A policy is an unresolved expression of several hundred nodes, and every
    node is one call into the JVM to build; the tree does not depend on any
    DataFrame, so it is built once per session and shared by its plans.
    """
    names, trip_places = tuple(names), tuple(trip_places)
    key = (policy, category, reason, tokens, names, trip_places)
    built = _BUILT.setdefault(SparkSession.active(), {})
    if key not in built:
        built[key] = _POLICY_FUNCS[policy](F.col(category), F.col(reason), F.col(tokens), names=names,
                                           trip_places=trip_places)
    return built[key]


def decide(df: DataFrame, policy: str = "three", category: str = "category", reason: str = "reason",
           out: str = "decision", reason_out: str | None = "reject_reason",
           names: Iterable[str] = DEFAULT_NAMES, trip_places: Iterable[str] = TRIP_PLACES) -> DataFrame:
    """Apply one policy to a request table; adds ``out`` (and ``reason_out``)."""
    tok = f"__tok_{out}"
    res = f"__res_{out}"
    df = df.withColumn(tok, reason_tokens(reason))
    df = df.withColumn(res, policy_column(policy, category, reason, tok, names, trip_places))
    outs = {out: F.col(f"{res}.decision")}
    if reason_out:
        outs[reason_out] = F.col(f"{res}.reject_reason")
    return df.withColumns(outs).drop(tok, res)


def decide_with_staff(df: DataFrame, staff: DataFrame, key: str, category: str = "category", reason: str = "reason",
                      out: str = "decision", reason_out: str = "reject_reason") -> DataFrame:
    """R1 with the attendees' names in a table (term): of any size, one pass per text (see ``operators.terms``).

    ``key`` tells the rows of ``df`` apart."""
    from deskpass.operators.terms import match_flags
    terms = staff.select("term").unionByName(df.sparkSession.createDataFrame([(t,) for t in TITLE_TERMS], "term string"))
    flags = match_flags(df, terms.select("term", F.lit("__staff").alias("label")), ["__staff"], key, reason).withColumnRenamed("key", "__key")
    j = df.withColumn("__tok", reason_tokens(reason)).join(flags, F.col(key).eqNullSafe(F.col("__key")))
    res = policy_three(F.col(category), F.col(reason), F.col("__tok"), attendee=F.col("__staff"))
    j = j.withColumn("__res", res)
    return j.withColumns({out: F.col("__res.decision"), reason_out: F.col("__res.reject_reason")}).drop("__tok", "__key", "__staff", "__res")


def decide_all(df: DataFrame, category: str = "category", reason: str = "reason",
               names: Iterable[str] = DEFAULT_NAMES, trip_places: Iterable[str] = TRIP_PLACES) -> DataFrame:
    """One decision column per policy (``d_<policy>``), tokens split once."""
    names, trip_places = tuple(names), tuple(trip_places)
    df = df.withColumn("__tok", reason_tokens(reason))
    df = df.withColumns({f"d_{p}": policy_column(p, category, reason, "__tok", names, trip_places)
                         .getField("decision") for p in _POLICY_FUNCS})
    return df.drop("__tok")


def policy_agreement(decided: DataFrame, category: str = "category") -> DataFrame:
    """Per category, how often the policies agree."""
    same = lambda a, b: F.sum((F.col(a) == F.col(b)).cast("long"))
    return decided.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        same("d_three", "d_strict").alias("agree_three_strict"),
        same("d_strict", "d_strict_docnum").alias("agree_strict_docnum"),
        same("d_strict", "d_lenient").alias("agree_strict_lenient"),
        same("d_three", "d_match").alias("agree_three_match"),
        F.sum(((F.col("d_strict") == F.col("d_strict_docnum")) & (F.col("d_strict") == F.col("d_lenient"))
               ).cast("long")).alias("agree_two_outcome"),
    )


def rules_then_model(rule: Column | str, model: Column | str) -> Column:
    """Keep the rule's answer unless it is a hold (or missing); then use the model's."""
    rule = _c(rule)
    return F.when(rule.isNull() | (rule == HOLD), _c(model)).otherwise(rule)


def policy_table(spark: SparkSession) -> DataFrame:
    """The policy dimension, one row per category (four rows, fixed size)."""
    rows = [
        (CAT_PERSONAL, "personal", True),
        (CAT_MEETING, "meeting", True),
        (CAT_OTHER, "other_work", True),
        (CAT_TRIP, "trip", True),
    ]
    return spark.createDataFrame(rows, "category string, policy_class string, allows_hold boolean")


def with_policy(requests: DataFrame, spark: SparkSession, category: str = "category") -> DataFrame:
    """Attach the policy row of each request's category (a broadcast of four rows)."""
    pol = policy_table(spark).withColumnRenamed("category", "__pcat")
    return (requests.join(F.broadcast(pol), F.col(category) == F.col("__pcat"), "left")
            .drop("__pcat"))


assert set(CATEGORIES) == {CAT_PERSONAL, CAT_MEETING, CAT_OTHER, CAT_TRIP}
