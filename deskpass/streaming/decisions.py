"""Streaming decisions (ST1–ST3).

The same column functions decide batch tables and stream micro-batches.
Sinks are ``foreachBatch`` writers that overwrite the ``batch_id`` partition
they own, so a micro-batch that is run again after a failure replaces its
own output instead of duplicating it; the checkpoint records which files
each batch consumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deskpass.functions import rules as RU
from deskpass.functions.text import last_segment


def write_partition(df: DataFrame, path: str, batch_id: int) -> None:
    """ST3: idempotent append — (re)write exactly this batch's partition."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def decide_batch(df: DataFrame, policy: str = "three") -> DataFrame:
    """ST1 body: category from the raw request, then the policy."""
    d = df.withColumn("category", last_segment("request_raw"))
    return RU.decide(d, policy).select("request_id", "category", "decision", "reject_reason")


def decide_stream(stream: DataFrame, sink: str, checkpoint: str, policy: str = "three",
                  available_now: bool = True) -> StreamingQuery:
    """ST1 + ST3: decide every arriving request and append to the decision log."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_partition(decide_batch(batch, policy), sink, batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


# Ids are dealt to so many state groups: a call of the state handler costs milliseconds, whatever it is given, so it is
# given the ids of a group at once.
STATE_GROUPS = 1024
HELD_ROWS = 65_536


def _until_reject(schema: T.StructType, reject_col: str, order: list[str], key: str | None = None, missing: dict[str, str] | None = None):
    """State handler of a group of ids, those of column ``key`` (None, or a group without ids: its rows are one id's):
    the rejected ids are all that is kept. ``missing``: for columns whose nulls were filled, the columns that tell them."""
    names, missing = schema.names, missing or {}

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = key is None or pd.isna(group[0])
        gone = list(state.get[0]) if state.exists else []
        if one and state.exists:
            return  # rejected by an earlier batch: nothing of it is read
        held, n, most = [], 0, HELD_ROWS
        for f in frames:  # Arrow chunks, in no order
            if gone:
                f = f[~f[key].isin(gone)]
            if len(f):
                held.append(f)
                n += len(f)
            if n > most:  # rows after the first reject known so far go
                held = [_cut(held, reject_col, order, None if one else key, missing)[0]]
                n = len(held[0])
                most = max(HELD_ROWS, 2 * n)
        if not held:
            return
        kept, rejected = _cut(held, reject_col, order, None if one else key, missing)
        if len(rejected):
            state.update((gone + ([] if one else rejected.tolist()),))
        yield kept[[*names, *missing.values()]]

    return run


def _cut(held: list[pd.DataFrame], reject_col: str, order: list[str], key: str | None, missing: dict[str, str]) -> tuple[pd.DataFrame, np.ndarray]:
    """(rows that come no later in ``order``, missing values first, than their id's first reject; the rejected ids)."""
    f = held[0] if len(held) == 1 else pd.concat(held)
    code, ids = (np.zeros(len(f), np.int64), np.array([None])) if key is None else pd.factorize(f[key])
    rank = np.zeros(len(f), np.int64)
    for c in order:
        at, values = pd.factorize(f[c], sort=True)
        if c in missing:
            at = np.where(f[missing[c]].to_numpy(bool), -1, at)
        rank = np.unique(rank * (len(values) + 1) + at + 1, return_inverse=True)[1]
    bad = f[reject_col].to_numpy(bool)
    first = np.full(len(ids), len(f), np.int64)
    np.minimum.at(first, code[bad], rank[bad])
    return f[rank <= first[code]], np.asarray(ids)[first < len(f)]


def skip_rejected(stream: DataFrame, rejected: Column, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"),
                  groups: int = STATE_GROUPS) -> DataFrame:
    """ST2: each id's rows up to and including its first rejection, over the whole life of the stream.

    Keyed state holds the rejected ids of a group (one of ``groups`` by the id's hash, more for more ids; ids that are
    neither whole numbers nor plain strings have a group each) and is never dropped, so a reject is not forgotten. A batch
    reads the ids rejected before in the groups of its own rows, no rows of the history (on ``ROCKSDB`` they are not held in
    memory either). Batches come one after the other; within one, ``order`` decides. Rows without an id are one id."""
    out = stream.schema
    flag = "__rejected"
    kind = out[key].dataType
    rows = stream.withColumn(flag, F.coalesce(rejected, F.lit(False)))
    # a frame turns whole numbers among nulls into doubles, which don't hold every long
    missing = {f.name: f"__no_{i}" for i, f in enumerate(out) if isinstance(f.dataType, T.LongType)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = rows.withColumns({to: quoted(c).isNull() for c, to in missing.items()})
    many = isinstance(kind, T.IntegralType) or kind == T.StringType()
    if many:  # rows without an id are a group of their own
        rows = rows.withColumn("__group", F.when(quoted(key).isNotNull(), F.pmod(F.xxhash64(quoted(key)), F.lit(groups))))
    by = "__group" if many else key
    rows = rows.withColumns({c: F.coalesce(quoted(c), F.lit(0).cast("long")) for c in missing if c != by})
    wide = T.StructType(list(out))
    for to in missing.values():
        wide = wide.add(to, "boolean")
    state = T.StructType().add("rejected", T.ArrayType(kind if many else T.BooleanType()))
    kept = rows.groupBy(by).applyInPandasWithState(
        _until_reject(out, flag, list(order), key if many else None, missing), wide, state, "append", GroupStateTimeout.NoTimeout)
    return kept.select(*[F.when(~F.col(missing[c]), quoted(c)).alias(c) if c in missing else quoted(c) for c in out.names])


def skip_rejected_stream(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str, rejected: Column | None = None,
                         key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """ST2 + ST3: skip an id once it has been rejected; approved or held ids may come again."""
    rejected = rejected if rejected is not None else (F.col("event_type") == "error")
    kept = skip_rejected(stream, rejected, key, order)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)  # read when the query starts, and kept in its checkpoint
    try:
        return (kept.writeStream.foreachBatch(lambda batch, batch_id: write_partition(batch, sink, batch_id))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before)


def slices(df: DataFrame, key: str, bounds: list) -> list[DataFrame]:
    """Cut ``df`` by ``key`` at ``bounds`` into consecutive slices."""
    edges = [None] + list(bounds) + [None]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(key) >= lo)
        if hi is not None:
            part = part.filter(F.col(key) < hi)
        out.append(part)
    return out


def feed_files(parts: list[DataFrame], folder: str) -> None:
    """Test feed: append the slices in order, each with its own partitioning (many
    files for a large slice; nothing is funnelled through one task)."""
    for part in parts:
        part.write.mode("append").parquet(folder)


def key_bounds(df: DataFrame, key: str, n: int) -> list:
    """n-1 cut points of ``key`` (approximate quantiles; the cut only sets slice sizes)."""
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.approxQuantile(key, probs, 0.001)))
