"""DuckDB SQL fragments for the oracles, built from the same fixed term lists."""

from __future__ import annotations

from deskpass.functions.rules import (MSG_MISMATCH, MSG_NO_ATTENDEE, MSG_NO_CONTENT, MSG_NO_PLACE,
                                      MSG_THIN, MSG_UNKNOWN, MSG_VAGUE, MSG_WORK_REASON, alt)
from deskpass.schema import (CAT_MEETING, CAT_OTHER, CAT_PERSONAL, CAT_TRIP, CATEGORIES,
                             DEFAULT_NAMES, MEETING_GENERIC, MEETING_TERMS, OTHER_GENERIC,
                             OTHER_TERMS, PERSONAL_TERMS, ROOM_TERMS, TITLE_TERMS, TRIP_GENERIC,
                             TRIP_PLACES, TRIP_TERMS, WORK_TERMS)
from deskpass.sources.tables import REQUEST_VIEW_SQL, RULE_VIEW_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


CATS = inlist(CATEGORIES)
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def last_segment(x: str) -> str:
    return strip(f"string_split({x}, '/')[-1]")


def blank(x: str) -> str:
    return f"({x} is null or {strip(x)} = '')"


def with_views(body: str, rule_view: bool = False) -> str:
    """``r`` = request view (with category); ``body`` selects from it."""
    view = RULE_VIEW_SQL if rule_view else REQUEST_VIEW_SQL
    return (f"with r0 as ({view}),\n r as (select *, {last_segment('request_raw')} as category from r0)\n"
            + body)


TOK = "list_filter(regexp_split_to_array(reason, '[, ]+'), lambda t: t <> '')"
ROOM = alt(ROOM_TERMS)
ATT = alt(list(TITLE_TERMS) + list(DEFAULT_NAMES))
TRIP_PLACE = alt(TRIP_PLACES)


def _dec(d: str, why: str = "''") -> str:
    return f"{{'decision': {q(d)}, 'reject_reason': {why}}}"


def three_sql() -> str:
    n = f"len({TOK})"
    place = f"regexp_matches(reason, {q(ROOM)})"
    att = f"regexp_matches(reason, {q(ATT)})"
    tplace = f"regexp_matches(reason, {q(TRIP_PLACE)})"
    docnum = f"len(list_filter({TOK}, lambda t: regexp_matches(t, '^AUTON[0-9]+'))) > 0"
    return f"""case
  when {blank('reason')} then {_dec('보류')}
  when category = {q(CAT_MEETING)} then case
     when {n} <= 1 then {_dec('보류')}
     when {place} and {att} and {n} >= 3 then {_dec('승인')}
     else {_dec('거절', f"case when not {place} then {q(MSG_NO_PLACE)} when not {att} then {q(MSG_NO_ATTENDEE)} else {q(MSG_THIN)} end")} end
  when category = {q(CAT_PERSONAL)} then case
     when regexp_matches(reason, {q(alt(PERSONAL_TERMS))}) then {_dec('승인')}
     when regexp_matches(reason, {q(alt(WORK_TERMS))}) then {_dec('거절', q(MSG_WORK_REASON))}
     else {_dec('보류')} end
  when category = {q(CAT_OTHER)} then case
     when {n} <= 1 then {_dec('보류')}
     when len(list_filter({TOK}, lambda t: t not in {inlist(OTHER_GENERIC)})) > 0 then {_dec('승인')}
     when contains(reason, '관련') then {_dec('보류')}
     else {_dec('거절', q(MSG_VAGUE))} end
  when category = {q(CAT_TRIP)} then case
     when ({docnum}) and {tplace} and len(list_filter({TOK}, lambda t: t not in {inlist(TRIP_GENERIC)})) >= 3 then {_dec('승인')}
     when {tplace} and not ({docnum}) then {_dec('보류')}
     else {_dec('거절', f"case when not {tplace} then {q(MSG_NO_PLACE)} else {q(MSG_THIN)} end")} end
  else {_dec('보류')} end"""


def two_sql(need_attendee: bool, docnum_route: bool, lenient_trip: bool) -> str:
    place = f"regexp_matches(reason, {q(ROOM)})"
    att = f"regexp_matches(reason, {q(ATT)})"
    tplace = f"regexp_matches(reason, {q(TRIP_PLACE)})"
    mcontent = (f"len(list_filter({TOK}, lambda t: not regexp_matches(t, {q(ROOM)}) and "
                f"not regexp_matches(t, {q(ATT)}) and t not in {inlist(MEETING_GENERIC)})) > 0")
    tcontent = (f"len(list_filter({TOK}, lambda t: not regexp_matches(t, {q(TRIP_PLACE)}) and "
                f"t not in {inlist(TRIP_GENERIC)})) > 0")
    m_ok = f"{place} and ({mcontent})" + (f" and {att}" if need_attendee else "")
    m_why = f"case when not {place} then {q(MSG_NO_PLACE)} when not ({mcontent}) then {q(MSG_NO_CONTENT)}"
    m_why += (f" when not {att} then {q(MSG_NO_ATTENDEE)} end" if need_attendee else " end")
    if lenient_trip:
        t_ok = f"({tplace} or regexp_matches(reason, {q(alt(TRIP_TERMS))}))"
        t_why = q(MSG_NO_PLACE)
    else:
        t_ok = f"({tplace} and ({tcontent}))"
        if docnum_route:
            t_ok = f"({t_ok} or contains(reason, 'AUTON'))"
        t_why = f"case when not {tplace} then {q(MSG_NO_PLACE)} else {q(MSG_NO_CONTENT)} end"
    return f"""case
  when {blank('reason')} then {_dec('보류')}
  when category = {q(CAT_PERSONAL)} then {_dec('승인')}
  when category = {q(CAT_MEETING)} then case when {m_ok} then {_dec('승인')} else {_dec('거절', m_why)} end
  when category = {q(CAT_OTHER)} then {_dec('승인')}
  when category = {q(CAT_TRIP)} then case when {t_ok} then {_dec('승인')} else {_dec('거절', t_why)} end
  else {_dec('거절', q(MSG_UNKNOWN))} end"""


def match_sql() -> str:
    cls = f"""case when regexp_matches(reason, {q(alt(PERSONAL_TERMS))}) then {q(CAT_PERSONAL)}
       when regexp_matches(reason, {q(alt(MEETING_TERMS))}) then {q(CAT_MEETING)}
       when regexp_matches(reason, {q(alt(TRIP_TERMS))}) then {q(CAT_TRIP)}
       when regexp_matches(reason, {q(alt(OTHER_TERMS))}) then {q(CAT_OTHER)} end"""
    return f"""case
  when {blank('reason')} then {_dec('보류')}
  when ({cls}) is null then {_dec('보류')}
  when ({cls}) = category then {_dec('승인')}
  else {_dec('거절', q(MSG_MISMATCH))} end"""


POLICY_SQL = {
    "three": three_sql,
    "strict": lambda: two_sql(True, False, False),
    "strict_docnum": lambda: two_sql(True, True, False),
    "lenient": lambda: two_sql(False, False, True),
    "match": match_sql,
}
