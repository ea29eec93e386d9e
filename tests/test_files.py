"""Source/sink behaviour: missing index, bad files, day partitions, CSV nulls."""

import pytest
from pyspark.sql import functions as F

from deskpass.plans.registry import QUERIES, load_all
from deskpass.session import scratch_path
from deskpass.schema import BATCH_LOG
from deskpass.sources import files as FS
from deskpass.sources.decision_log import Conflict, DecisionLog
from tests.conftest import SF_SMALL

load_all()


def test_missing_index_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        FS.load_index(spark, scratch_path(spark, "never-built"))


def test_bad_files_go_to_errors(spark, tmp_path):
    import os
    names = ["plain.txt", "with space.txt", "한글 이름.txt", "100%25.txt"]
    for n in names:
        (tmp_path / n).write_text("text 글", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes("é".encode("latin-1"))
    ok, bad = FS.read_with_errors(spark, str(tmp_path), "*.txt")
    assert sorted(os.path.basename(r.path) for r in ok.collect()) == sorted(names)
    assert [(os.path.basename(r.path), r.error) for r in bad.collect()] == [("bad.txt", "not valid UTF-8 text")]


def test_day_partition_is_pruned(spark):
    df = QUERIES["S8_conversation_log_day"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "20240102" in plan


def row(k, **more):
    return tuple({"row_id": str(k), "category": "c", "reason": "two\nlines ~n\r\\", "decision": "승인", "reject_reason": None, "saved_at": "t", **more}.values())


def rows(spark, *ids):
    return spark.createDataFrame([row(k) for k in ids], BATCH_LOG)


def ids(df):
    return sorted(r.row_id for r in df.collect())


@pytest.fixture
def opened(spark):
    path = f"{scratch_path(spark, 'log')}/log"
    return lambda: DecisionLog(spark, path)


def test_log_keeps_empty_and_null_apart(spark, opened):
    df = spark.createDataFrame([("1", "c", "r\nmore", "승인", "", "t"), ("2", None, None, "거절", "x, y", "t")], BATCH_LOG)
    log = opened()
    log.append(df)
    assert sorted(tuple(r) for r in log.read().collect()) == sorted(tuple(r) for r in df.collect())


def test_log_is_created_once_without_rows(opened):
    assert opened().load().count() == 0 and opened().load().columns == BATCH_LOG.names
    assert opened().version() == 0


def test_log_is_loaded_appended_and_saved(spark, opened):
    for n in range(3):
        log = opened()
        before = log.load()
        assert before.count() == n
        log.save(before.unionByName(rows(spark, n)))
    assert {r.reason for r in opened().read().collect()} == {"two\nlines ~n\r\\"}


def test_appends_of_two_writers_both_stay(spark, opened, monkeypatch):
    one, two = opened(), opened()
    one.load()
    real = two._try_commit
    calls = []

    def late(version, *rest):
        if not calls:  # the other writer takes the number between reading and committing
            one.append(rows(spark, 1))
        calls.append(version)
        return real(version, *rest)

    monkeypatch.setattr(two, "_try_commit", late)
    two.append(rows(spark, 2))
    assert len(calls) == 2 and ids(opened().read()) == ["1", "2"]


def test_a_save_keeps_what_was_appended_meanwhile(spark, opened):
    opened().append(rows(spark, 0))
    log = opened()
    mine = log.load()
    opened().append(rows(spark, 1))
    log.save(mine.unionByName(rows(spark, 2)))
    assert ids(opened().read()) == ["0", "1", "2"]


def test_two_saves_of_one_version_conflict(spark, opened):
    one, two = opened(), opened()
    a, b = one.load(), two.load()
    one.save(a.unionByName(rows(spark, 1)))
    with pytest.raises(Conflict):
        two.save(b.unionByName(rows(spark, 2)))
    two.update(lambda df: df.unionByName(rows(spark, 2)))
    assert ids(opened().read()) == ["1", "2"]


def test_a_save_that_is_too_late_leaves_no_data(spark, opened, monkeypatch):
    """Neither one that is too late already nor one that comes too late while it writes."""
    import os
    one, two, three = opened(), opened(), opened()
    a, b, c = one.load(), two.load(), three.load()
    one.save(a.unionByName(rows(spark, 1)))
    folders = lambda: {f for f in os.listdir(one.path) if f.startswith("data-")}
    with pytest.raises(Conflict):
        two.save(b.unionByName(rows(spark, 2)))
    assert folders() == set(one.loaded["folders"])
    write = three._write

    def slow(df):
        one.save(one.load().unionByName(rows(spark, 3)))
        return write(df)

    monkeypatch.setattr(three, "_write", slow)
    three.loaded = one.loaded
    with pytest.raises(Conflict):
        three.save(c.unionByName(rows(spark, 4)))
    assert {f for v in range(one.version() + 1) for f in one.commit(v)["folders"]} == folders() and ids(one.read()) == ["1", "3"]


def test_csv_logs_are_compressed_and_plain_ones_are_read(spark, opened):
    import os
    log = opened()
    log.append(spark.createDataFrame([row(k, reason="the same words " * 50) for k in range(400)], BATCH_LOG))
    name = log.commit(log.version())["folders"][0]
    assert sum(e.stat().st_size for e in os.scandir(f"{log.path}/{name}")) < 400 * 15 * 50 / 4
    plain = FS._strings(rows(spark, 900), FS._BREAKS)
    plain.write.options(**FS.CSV_OPTIONS).csv(f"{log.path}/data-plain")
    assert log._try_commit(log.version() + 1, [name, "data-plain"], -1)
    assert len(ids(log.read())) == 401 and {tuple(r) for r in log.read().where("row_id = 900").collect()} == {row(900)}


def test_readers_keep_their_version(spark, opened):
    opened().append(rows(spark, 0))
    reader = opened()
    pinned = reader.load()
    log = opened()
    log.load()
    log.save(rows(spark, 7))
    assert ids(pinned) == ["0"] and ids(reader.read(0)) == ["0"] and ids(reader.read()) == ["7"]


def test_a_writer_that_dies_leaves_nothing_to_read(spark, opened):
    log = opened()
    log.append(rows(spark, 0))
    log._write(rows(spark, 9))  # and no commit
    assert ids(opened().read()) == ["0"]


def test_compaction_changes_no_row(spark, opened):
    for k in range(4):
        opened().append(rows(spark, k))
    log = opened()
    log.compact(2)
    assert len(log.commit(log.version())["folders"]) == 1 and ids(log.read()) == ["0", "1", "2", "3"]


def test_csv_requests_are_read_with_their_schema(spark, tmp_path):
    """A CSV history with a header, quoted fields and missing values."""
    (tmp_path / "h.csv").write_text('request_id,request_raw,reason,status,approver_note\n1,"ko/ (업무)회의","3층, 팀장",승인됨,\n2,,"say ""hi""",,x\n', encoding="utf-8")
    got = FS.read_requests(spark, str(tmp_path), "csv")
    assert got.schema == FS.REQUESTS
    assert {tuple(r) for r in got.collect()} == {(1, "ko/ (업무)회의", "3층, 팀장", "승인됨", None), (2, None, 'say "hi"', None, "x")}


def test_a_day_of_the_conversation_log_is_few_files(spark, tmp_path):
    """Files grow with the days, not with the tasks that write them; one day is read from its folder."""
    from pyspark.sql import functions as F

    from deskpass.sources import files as FS
    ts = F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(id % 5 as int), 0, 0, 0)")
    log = spark.range(0, 200, 1, 16).select(F.col("id").cast("string").alias("session_id"), ts.alias("ts"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    path = str(tmp_path / "log")
    FS.write_conversations(log, path)
    assert len(list((tmp_path / "log").glob("log_date=*/*.json"))) == 5
    day = FS.load_conversations(spark, path, "20240102")
    assert sorted(int(r.session_id) for r in day.collect()) == list(range(1, 200, 5))
    assert {f.split("/")[-2] for f in day.inputFiles()} == {"log_date=20240102"} and {r.log_date for r in day.collect()} == {"20240102"}
    assert FS.load_conversations(spark, path, "20240109").count() == 0
    assert FS.load_conversations(spark, path).count() == 200
