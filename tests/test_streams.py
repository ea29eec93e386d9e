"""Streaming equals batch (restart included) and the sinks are idempotent."""

from deskpass.plans.registry import QUERIES, load_all
from tests.conftest import SF_SMALL

load_all()


def _set(df):
    return sorted(tuple(r) for r in df.collect())


def test_decide_stream_equals_batch(spark):
    stream = QUERIES["ST1_decide_stream"](spark, SF_SMALL)
    batch = QUERIES["R1_three_outcome"](spark, SF_SMALL).select(*stream.columns)
    assert _set(stream) == _set(batch)


def test_replayed_batch_does_not_duplicate(spark):
    out = QUERIES["ST3_idempotent_append"](spark, SF_SMALL)
    assert out.count() == out.select("request_id").distinct().count()


def test_skip_rejected_equals_batch(spark):
    stream = QUERIES["ST2_skip_rejected_stream"](spark, SF_SMALL)
    batch = QUERIES["W6_until_first_reject"](spark, SF_SMALL).select(*stream.columns)
    assert _set(stream) == _set(batch)


def test_session_memory_equals_batch(spark):
    stream = QUERIES["ST4_session_memory_stream"](spark, SF_SMALL)
    batch = QUERIES["W2_context_text"](spark, SF_SMALL).select(*stream.columns)
    assert _set(stream) == _set(batch)


class _State:
    """Stand-in for ``GroupState`` with the members the handler uses."""

    def __init__(self):
        self.exists, self.hasTimedOut, self._value = False, False, None

    @property
    def get(self):
        return self._value

    def update(self, value):
        self.exists, self._value = True, value

    def setTimeoutDuration(self, ms):
        pass

    def remove(self):
        self.exists, self._value = False, None


def test_session_memory_keeps_last_n_of_a_busy_session():
    """One session with many rows in one trigger, in shuffled Arrow chunks: only the
    last five turns are kept, and a later trigger continues from the state."""
    import random

    import pandas as pd

    from deskpass.streaming.sessions import _keep_last

    turns = list(range(0, 20_000, 2))
    random.Random(7).shuffle(turns)
    rows = pd.DataFrame({"turn": turns, "question": [f"q{t}" for t in turns],
                         "answer": [f"a{t}" for t in turns]})
    chunks = [rows.iloc[i:i + 1024] for i in range(0, len(rows), 1024)]
    handler, state = _keep_last(5, None), _State()
    out = list(handler((1,), iter(chunks), state))
    assert len(out) == 1 and out[0]["n_kept"][0] == 5 and out[0]["last_turn"][0] == 19_998
    assert list(state.get[0]) == [19_990, 19_992, 19_994, 19_996, 19_998]
    more = pd.DataFrame({"turn": [20_000, 5], "question": ["q+", "q-"], "answer": ["a+", "a-"]})
    out = list(handler((1,), iter([more]), state))
    assert list(state.get[0]) == [19_992, 19_994, 19_996, 19_998, 20_000]
    assert out[0]["context"][0].splitlines()[-1] == "[대화 5] 질문: q+, 답변: a+"


EVENT = "event_id long, user_id long, event_type string, ts timestamp"


def _events(n=300, seed=1):
    import datetime
    import random
    rng = random.Random(seed)
    t0 = datetime.datetime(2024, 1, 1)
    return [(k, rng.choice([1, 1, 1, 2, 3, 4, None]), "error" if rng.random() < .02 else "click",
             None if rng.random() < .02 else t0 + datetime.timedelta(seconds=k // 3)) for k in range(n)]


def _first_reject(rows):
    """W6 over batches in their order: rows of an id up to and with its first reject."""
    import datetime
    low = datetime.datetime.min
    gone, out = set(), set()
    for batch in rows:
        for r in sorted(batch, key=lambda r: (r[3] or low, r[0])):
            if r[1] not in gone:
                out.add(r[0])
                if r[2] == "error":
                    gone.add(r[1])
    return out


def test_rejects_are_never_forgotten_whatever_the_slicing(spark):
    from deskpass.session import scratch_path
    from deskpass.streaming import decisions as SD
    rows = _events()
    for cuts in ([0, 300], [0, 10, 11, 150, 300], [0, 0, 100, 200, 290, 300]):
        base = scratch_path(spark, "rejects")
        batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        for batch in batches:  # a restart from the checkpoint after every slice
            SD.feed_files([spark.createDataFrame(batch, EVENT).repartition(3)], f"{base}/in")
            SD.skip_rejected_stream(spark, spark.readStream.schema(EVENT).parquet(f"{base}/in"), f"{base}/out", f"{base}/ck").awaitTermination()
        got = [r.event_id for r in spark.read.parquet(f"{base}/out").collect()]
        assert len(got) == len(set(got)) and set(got) == _first_reject(batches)


def test_reject_handler_with_chunks_in_any_order():
    import random

    import pandas as pd
    from deskpass.streaming import decisions as SD
    rng = random.Random(3)
    for _ in range(50):
        rows = [(k, 7, "error" if rng.random() < .05 else "click", rng.choice([None, *range(6)])) for k in range(40)]
        frame = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts"]).sample(frac=1, random_state=rng.randrange(99))
        frame["bad"] = frame["event_type"] == "error"

        class Schema:
            names = ["event_id", "user_id", "event_type", "ts"]

        run, state = SD._until_reject(Schema, "bad", ["ts", "event_id"]), _State()
        out = [f for f in run((7,), (frame.iloc[i:i + 7] for i in range(0, 40, 7)), state)]
        order = sorted(rows, key=lambda r: (-1 if r[3] is None else r[3], r[0]))
        stop = next((i for i, r in enumerate(order) if r[2] == "error"), None)
        assert {i for f in out for i in f["event_id"]} == {r[0] for r in (order if stop is None else order[:stop + 1])}
        assert state.exists == (stop is not None)
        if state.exists:
            assert list(run((7,), iter([frame]), state)) == []


def test_rejects_of_many_ids_in_one_call(monkeypatch):
    """ST2: the handler of a state group is called once for all its ids, in chunks of any order."""
    import random

    import pandas as pd
    from deskpass.streaming import decisions as SD
    monkeypatch.setattr(SD, "HELD_ROWS", 50)
    rng = random.Random(5)

    class Schema:
        names = ["event_id", "user_id", "event_type", "ts"]

    for _ in range(20):
        rows = [(k, rng.randrange(12) + (1 << 60), "error" if rng.random() < .05 else "click", rng.choice([None, *range(40)])) for k in range(600)]
        run, state, gone = SD._until_reject(Schema, "bad", ["ts", "event_id"], "user_id"), _State(), set()
        for batch in (rows[:300], rows[300:]):
            frame = pd.DataFrame(batch, columns=Schema.names).sample(frac=1, random_state=rng.randrange(99))
            frame["bad"] = frame["event_type"] == "error"
            got = [i for f in run((3,), (frame.iloc[i:i + 40] for i in range(0, 300, 40)), state) for i in f["event_id"]]
            want = []
            for user in sorted({r[1] for r in batch} - gone):
                own = sorted((r for r in batch if r[1] == user), key=lambda r: (-1 if r[3] is None else r[3], r[0]))
                stop = next((i for i, r in enumerate(own) if r[2] == "error"), None)
                want += [r[0] for r in (own if stop is None else own[:stop + 1])]
                gone |= {user} if stop is not None else set()
            assert sorted(got) == sorted(want)
            assert set(state.get[0]) == gone and len(state.get[0]) == len(gone)


def test_long_ids_beside_missing_ones_stay_exact(spark):
    """ST2: ids of one state group, beyond what a double holds, with rows without an event, a time or an id among them;
    and ids that are neither whole numbers nor strings."""
    from deskpass.session import scratch_path
    from deskpass.streaming import decisions as SD
    big = 1 << 60
    import datetime
    at = datetime.datetime(2024, 1, 1)
    first = [(big + 1, big + 1, "click", at), (None, big + 1, "error", at), (big + 3, big + 2, "click", None),
             (big + 5, big + 2, "error", at), (big + 4, big + 2, "click", at), (big + 6, big + 2, "click", at), (big + 7, None, "error", at)]
    second = [(big + 8, big + 1, "click", at), (big + 9, big + 3, "click", at), (big + 10, None, "click", at), (big + 11, big + 2, "error", at)]
    want = {(None, big + 1), (big + 3, big + 2), (big + 4, big + 2), (big + 5, big + 2), (big + 7, None), (big + 9, big + 3)}
    for kind, groups in (("long", 1), ("long", 1024), ("string", 1), ("decimal(20,0)", 1)):
        base = scratch_path(spark, "long-ids")
        schema = EVENT.replace("user_id long", f"user_id {kind}")
        for rows in (first, second):
            SD.feed_files([spark.createDataFrame(rows, EVENT).selectExpr("event_id", f"cast(user_id as {kind})", "event_type", "ts").coalesce(1)], f"{base}/in")
            kept = SD.skip_rejected(spark.readStream.schema(schema).parquet(f"{base}/in"), SD.F.expr("event_type = 'error'"), groups=groups)
            (kept.writeStream.foreachBatch(lambda b, i: SD.write_partition(b, f"{base}/out", i))
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination())
        out = spark.read.parquet(f"{base}/out")
        assert {(r.event_id, r.user_id) for r in out.selectExpr("event_id", "cast(user_id as long) user_id").collect()} == want, kind
        assert out.count() == len(want)


def test_every_file_is_indexed_or_reported(spark, tmp_path):
    import os
    import time

    from deskpass.streaming.indexing import index_changed
    folder, state = tmp_path / "docs", str(tmp_path / "state")
    folder.mkdir()
    names = ["plain.txt", "with space.txt", "한글 이름.txt", "100%25.txt"]
    for n in names:
        (folder / n).write_text("some words in a file", encoding="utf-8")
    (folder / "bad.txt").write_bytes("é".encode("latin-1"))
    short = lambda df: sorted(os.path.basename(r.path) for r in df.select("path").distinct().collect())
    index, done, bad = index_changed(spark, str(folder), state, 1)
    assert short(index) == short(done) == sorted(names) and short(bad) == ["bad.txt"]
    later = time.time() + 60
    (folder / "한글 이름.txt").write_text("changed words", encoding="utf-8")
    os.utime(folder / "한글 이름.txt", (later, later))
    (folder / "bad.txt").write_text("mended", encoding="utf-8")
    (folder / "added.txt").write_text("new file", encoding="utf-8")
    index, done, bad = index_changed(spark, str(folder), state, 2)
    assert short(done) == ["added.txt", "bad.txt", "한글 이름.txt"] and not bad.count()
    assert short(index) == sorted([*names, "bad.txt", "added.txt"])
    assert [r.text for r in index.collect() if "한글" in r.path] == ["changed words"]
    index, done, _ = index_changed(spark, str(folder), state, 3)
    assert not done.count() and len(short(index)) == 6


def test_open_sessions_merge_in_any_order():
    import random

    from deskpass.streaming.sessions import _merge_sessions
    rng = random.Random(4)
    for _ in range(200):
        times = [rng.randrange(60) for _ in range(rng.randint(1, 25))]
        rows = [[t, t, 1, [(t, k)]] for k, t in enumerate(times)]
        rng.shuffle(rows)
        opened = []
        for k in range(0, len(rows), 4):
            opened = _merge_sessions(opened + rows[k:k + 4], 3, 2)
        want, entries = [], sorted((t, k) for k, t in enumerate(times))
        for t, k in entries:
            if want and t - want[-1][1] <= 3:
                want[-1] = [want[-1][0], t, want[-1][2] + 1, want[-1][3] + [(t, k)]]
            else:
                want.append([t, t, 1, [(t, k)]])
        assert opened == [[a, b, n, e[-2:]] for a, b, n, e in want]


def test_a_worse_refit_is_not_published(spark):
    from pyspark.sql import functions as F

    from deskpass.operators import ml as ML
    from deskpass.session import scratch_path
    from deskpass.streaming import indexing as SI
    root = scratch_path(spark, "models")
    rows = [(k, ("late again " if k % 2 else "on time ") + f"n{k % 7}", float(k % 2)) for k in range(120)]
    train = spark.createDataFrame(rows, "id long, text string, label double")
    held = train.where("id % 5 = 0")
    fit = lambda df, v: (df.write.parquet(f"{root}/t{v}"), SI.refit(spark, f"{root}/t{v}", ML.text_logistic("text", "label", 120), root, v)[1])[1]
    good = fit(train.where("id % 5 <> 0"), 1)
    bad = fit(train.where("id % 5 <> 0").withColumn("label", 1 - F.col("label")), 2)
    assert SI.live_model(spark, root) is None
    assert SI.publish(spark, good, root, held, ["label"])[1] and SI.live_model(spark, root) == good
    reports, went = SI.publish(spark, bad, root, held, ["label"])
    assert not went and SI.live_model(spark, root) == good
    f1 = {r.model: r.f1 for r in reports.where("name = 'macro'").collect()}
    assert f1["live"] == 1.0 and f1["candidate"] == 0.0
    again = fit(train, 3)
    assert SI.publish(spark, again, root, held, ["label"])[1] and SI.live_model(spark, root) == again
    assert not SI.publish(spark, good, root, held, ["label"], least_gain=.1)[1]


def test_sessions_of_many_keys_in_one_call():
    """ST4: a state group's handler is called once for all its keys, in chunks of any order, and closes what is idle."""
    import random

    import pandas as pd
    from deskpass.streaming.sessions import _close_idle
    rng = random.Random(8)
    rows = [(rng.randrange(300), rng.randrange(4000), k) for k in range(6000)]
    frame = pd.DataFrame({"key": [r[0] for r in rows], "ts": pd.to_datetime([r[1] for r in rows], unit="us"), "id": [r[2] for r in rows]})

    class State(_State):
        hasTimedOut, mark = False, 0

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            self.at = at

        def remove(self):
            self.exists = False

    run, state = _close_idle(40, 2), State()
    out = list(run((0,), (frame.iloc[i:i + 700] for i in range(0, 6000, 700)), state))
    state.mark, state.hasTimedOut = 2, True  # milliseconds: half of the time
    out += list(run((0,), iter(()), state))
    state.mark = 5
    out += list(run((0,), iter(()), state))
    assert len(out) == 2 and not state.exists
    got = sorted((int(r.key), int(r.started.value) // 1000, int(r.ended.value) // 1000, r.n, tuple(r.last_ids)) for f in out for r in f.itertuples())
    want = []
    for key in range(300):
        own = []
        for _, t, i in sorted(r for r in rows if r[0] == key):
            if own and t - own[-1][-1][0] <= 40:
                own[-1].append((t, i))
            else:
                own.append([(t, i)])
        want += [(key, s[0][0], s[-1][0], len(s), tuple(i for _, i in s[-2:])) for s in own]
    assert got == sorted(want) and out[0]["ended"].max().value // 1000 + 40 < 2000


def test_a_run_reads_a_file_once(spark, tmp_path, monkeypatch):
    """ST5: the manifest comes from the rows written, not from reading the files again."""
    from pyspark.sql import functions as F

    from deskpass.streaming import indexing as SI
    folder = tmp_path / "docs"
    folder.mkdir()
    for k, text in enumerate([" ", "one two", "three " * 500]):
        (folder / f"{k}.txt").write_text(text)
    read, own = spark.sparkContext.accumulator(0), SI.files.read_with_errors

    @F.udf("string")
    def counted(path):
        read.add(1)
        return path

    def reading(*a):
        ok, bad = own(*a)
        return ok.withColumn("path", counted.asNondeterministic()("path")), bad

    monkeypatch.setattr(SI.files, "read_with_errors", reading)
    index, done, _ = SI.index_changed(spark, str(folder), str(tmp_path / "state"), 1)
    assert done.count() == 3 and index.select("path").distinct().count() == 3
    assert read.value == 3
