"""Conversation and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskpass.operators import sessions as S
from deskpass.plans.registry import register
from deskpass.sources.tables import table

# Turns joined per run before a conversation's runs are joined.
TURN_RUN = 1024

PAIRS_SQL = """select q.conv_id, q.turn, q.text as question, a.text as answer
from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
where q.role = 'user' and a.role = 'assistant'"""


def exchanges(spark, d):
    return S.pair_turns(table(spark, d, "conversations"))


@register("W5_pair_turns", PAIRS_SQL)
def w5(spark, d):
    return exchanges(spark, d)


RECENT_SQL = f"""select conv_id, turn, question, answer from (select *,
  row_number() over (partition by conv_id order by turn desc) as rk from ({PAIRS_SQL}) p) x where rk <= 5"""


@register("W1_recent_exchanges", RECENT_SQL)
def w1(spark, d):
    return S.recent(exchanges(spark, d), "conv_id", "turn", 5)


@register("W2_context_text", f"""select conv_id, count(*) as n_kept,
  string_agg('[대화 ' || i || '] 질문: ' || question || ', 답변: ' || answer || chr(10), '' order by i) as context
from (select *, row_number() over (partition by conv_id order by turn) as i from ({RECENT_SQL}) r) x
group by conv_id""")
def w2(spark, d):
    return S.context_lines(S.recent(exchanges(spark, d), "conv_id", "turn", 5), "conv_id", "turn")


@register("W4_first_user_turn", """select conv_id, arg_min(text, turn) as first_text from conversations
where role = 'user' and text is not null and regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
group by conv_id""")
def w4(spark, d):
    conv = table(spark, d, "conversations").filter(F.col("role") == "user")
    return S.first_non_blank(conv, "conv_id", "turn", "text")


@register("W6_until_first_reject", """select event_id, user_id, event_type from (select *,
  max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and 1 preceding) as seen from events) x
where seen is null or seen = 0""")
def w6(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    kept = S.until_first(ev, "user_id", F.col("event_type") == "error", ["ts", "event_id"])
    return kept.select("event_id", "user_id", "event_type")


@register("A6_join_turns", """select conv_id, string_agg(text, chr(10) order by turn) as document
from conversations group by conv_id""")
def a6(spark, d):
    return S.ordered_join(table(spark, d, "conversations"), ["conv_id"], "turn", "text", "\n", "document",
                          block=TURN_RUN)
