"""Ordered joins in runs equal the one-step join, for a hot group and for null texts."""

from deskpass.operators import sessions as S


def test_ordered_join_in_runs_equals_one_step(spark):
    rows = [(1, t, None if t % 7 == 0 else f"t{t}") for t in range(2000)]       # hot group
    rows += [(2, t, f"u{t}") for t in (5, 3, 9)] + [(3, 0, None), (3, 1, None)]  # small; all null
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    flat = {r.conv_id: r.doc for r in S.ordered_join(df, ["conv_id"], "turn", "text", "\n", "doc").collect()}
    runs = {r.conv_id: r.doc for r in S.ordered_join(df, ["conv_id"], "turn", "text", "\n", "doc", block=64).collect()}
    assert runs == flat
    assert flat[1] == "\n".join(f"t{t}" for t in range(2000) if t % 7)
    assert flat[2] == "u3\nu5\nu9" and flat[3] is None


def test_keep_valid_same_whatever_join_spark_picks(spark):
    from deskpass.operators import relational as OP
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", None, "c", "a"])], "id long, category string")
    valid = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "v string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert sorted(r.id for r in OP.keep_valid(df, valid).collect()) == [0, 3, 4]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
