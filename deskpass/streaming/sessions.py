"""Per-session memory over a stream of exchanges (ST4).

State per session is at most ``n`` (turn, question, answer) entries; each
trigger emits the session's current count, last turn and rendered context.
With ``idle_timeout_ms`` set (continuous, processing-time triggers), idle
sessions are dropped after that much processing time. Leave it unset for
``Trigger.AvailableNow`` runs: a processing-time timeout makes Spark keep
scheduling empty batches, so such a run would never finish.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deskpass.schema import CONTEXT_LINE, SESSION_MEMORY

OUTPUT_SCHEMA = "conv_id long, n_kept long, last_turn long, context string"
STATE_SCHEMA = "turns array<long>, questions array<string>, answers array<string>"


def render_context(questions, answers) -> str:
    return "".join(CONTEXT_LINE.format(i=i, q=q, a=a) + "\n"
                   for i, (q, a) in enumerate(zip(questions, answers), start=1))


def _keep_last(n: int, idle_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, qs, ans = ([], [], [])
        if state.exists:
            t, q, a = state.get
            turns, qs, ans = list(t), list(q), list(a)
        # Arrow chunks of a busy session arrive one at a time; keep only the
        # last n after each, so memory stays at n + one chunk however many
        # rows the session has in this trigger.
        for pdf in pdfs:
            if len(pdf) > n:
                pdf = pdf.nlargest(n, "turn")
            turns += pdf["turn"].tolist()
            qs += pdf["question"].tolist()
            ans += pdf["answer"].tolist()
            order = sorted(range(len(turns)), key=lambda i: turns[i])[-n:]
            turns = [int(turns[i]) for i in order]
            qs = [qs[i] for i in order]
            ans = [ans[i] for i in order]
        if not turns:
            return
        state.update((turns, qs, ans))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [int(key[0])], "n_kept": [len(turns)],
                            "last_turn": [turns[-1]], "context": [render_context(qs, ans)]})
    return fn


def session_memory(exchanges: DataFrame, n: int = SESSION_MEMORY, idle_timeout_ms: int | None = None,
                   key: str = "conv_id") -> DataFrame:
    """ST4: streaming (or batch-shaped) exchanges → per-session last-``n`` memory."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms else GroupStateTimeout.NoTimeout
    return exchanges.groupBy(key).applyInPandasWithState(
        _keep_last(n, idle_timeout_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


# --- sessions that expire by event time --------------------------------------

CLOSED_SCHEMA = "key long, started timestamp, ended timestamp, n long, last_ids array<long>"
OPEN_SCHEMA = ("keys array<long>, started array<long>, ended array<long>, n array<long>, last_at array<array<long>>, "
               "last_id array<array<long>>")
# Keys are dealt to so many state groups: a call of the state handler costs milliseconds, whatever it is given, so it is
# given the keys of a group at once.
STATE_GROUPS = 1024


def _merge_sessions(sessions: list[list], gap: int, keep: int) -> list[list]:
    """Sessions (started, ended, n, last entries) in order of time, those that lie within ``gap`` joined."""
    out: list[list] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] - out[-1][1] <= gap:
            o = out[-1]
            out[-1] = [o[0], max(o[1], s[1]), o[2] + s[2], sorted(o[3] + s[3])[-keep:]]
        else:
            out.append(s)
    return out


def _sessions_of(keys: np.ndarray, t: np.ndarray, ids: np.ndarray, gap: int, keep: int) -> dict[int, list[list]]:
    """Sessions per key of rows in any order: one sort, however many keys and sessions there are."""
    order = np.lexsort((ids, t, keys))
    keys, t, ids = keys[order], t[order], ids[order]
    ends = np.append(np.flatnonzero((np.diff(t) > gap) | (np.diff(keys) != 0)) + 1, len(t))
    names, times, numbers = keys.tolist(), t.tolist(), ids.tolist()
    out: dict[int, list[list]] = {}
    a = 0
    for b in ends.tolist() if len(t) else ():
        last = max(a, b - keep)
        out.setdefault(names[a], []).append([times[a], times[b - 1], b - a, list(zip(times[last:b], numbers[last:b]))])
        a = b
    return out


def _close_idle(gap: int, keep: int):
    """State handler of a group of keys: the open sessions of each, with start, end, count and last entries (times in microseconds)."""
    def fn(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened: dict[int, list[list]] = {}
        for k, a, b, n, at, ids in zip(*state.get) if state.exists else ():
            opened.setdefault(k, []).append([a, b, n, sorted(zip(at, ids))])
        if not state.hasTimedOut:
            for pdf in pdfs:  # each Arrow chunk becomes its sessions before the next is read
                new = _sessions_of(pdf["key"].to_numpy(np.int64), pdf["ts"].to_numpy("datetime64[us]").view(np.int64), pdf["id"].to_numpy(np.int64), gap, keep)
                for k, own in new.items():
                    opened[k] = _merge_sessions(opened[k] + own, gap, keep) if k in opened else own
        mark = state.getCurrentWatermarkMs() * 1000
        done, left = [], []
        for k, own in opened.items():
            for s in own:
                (done if s[1] + gap < mark else left).append((k, *s))
        if left:
            keys, started, ended, n, last = zip(*left)
            state.update((list(keys), list(started), list(ended), list(n), [[a for a, _ in x] for x in last], [[b for _, b in x] for x in last]))
            state.setTimeoutTimestamp(max(-(-(min(ended) + gap) // 1000), mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if done:
            keys, started, ended, n, last = zip(*done)
            yield pd.DataFrame({"key": keys, "started": np.array(started, "datetime64[us]"), "ended": np.array(ended, "datetime64[us]"), "n": n,
                                "last_ids": [[b for _, b in x] for x in last]})
    return fn


def expiring_sessions(rows: DataFrame, key: str, ts: str, row_id: str, gap_seconds: int, delay: str, keep: int = SESSION_MEMORY,
                      groups: int = STATE_GROUPS) -> DataFrame:
    """ST4: rows of a stream → sessions (key, started, ended, n, last_ids), each emitted once it can get no more rows.

    A session is a key's rows with no more than ``gap_seconds`` from one to the next by event time, in whatever order
    they arrive. State is the open sessions of the keys of a group (one of ``groups`` by the key's hash, more for more
    open sessions), each no larger than its last ``keep`` rows; the watermark (``delay``
    behind the latest time) emits and drops a session once it passes the session's end by the gap, by a timer if no
    row comes. Rows behind the watermark are late and take no part; nor do rows without key, time or id."""
    x = rows.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(row_id).cast("long").alias("id"))
    x = x.where("key is not null and ts is not null and id is not null").withWatermark("ts", delay)
    x = x.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return x.groupBy("group").applyInPandasWithState(_close_idle(gap_seconds * 1_000_000, keep), CLOSED_SCHEMA, OPEN_SCHEMA, "append",
                                                   GroupStateTimeout.EventTimeTimeout)
