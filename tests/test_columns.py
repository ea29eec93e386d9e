"""Null, empty, trailing-slash, whitespace and short-array traps."""

from pyspark.sql import functions as F

from deskpass.functions import labels as L
from deskpass.functions import render as R
from deskpass.functions import text as X
from deskpass.functions import times as TM
from deskpass.operators.sessions import recent_array


def _col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {typ}")
    return [r[0] for r in df.select(expr).collect()]


def test_last_segment(spark):
    got = _col(spark, ["en/ (업무)회의", "a/b/ c ", "trailing/", None, "nochange ", "　x/　y　"],
               X.last_segment("c"))
    assert got == ["(업무)회의", "c", "", None, "nochange", "y"]


def test_last_segment_loose_keeps_value_without_slash(spark):
    assert _col(spark, [" a ", "x/ b"], X.last_segment_loose("c")) == [" a ", "b"]


def test_py_strip_unicode_whitespace(spark):
    assert _col(spark, ["\t a b \n", " x ", ""], X.py_strip("c")) == ["a b", "x", ""]


def test_model_text_nulls(spark):
    df = spark.createDataFrame([("cat", None), (None, "r"), ("cat", "r")], "a string, b string")
    got = [r[0] for r in df.select(L.model_text("a", "b")).collect()]
    assert got == ["cat ", None, "cat r"]


def test_status_codes(spark):
    got = _col(spark, ["승인됨", "거절됨", "취소됨", "NaN", None], L.encode_status("c"))
    assert got == [1, 0, None, None, None]
    got = _col(spark, ["승인됨", "거절됨", "취소됨", "대기중", "NaN", None], L.status_code("c"))
    assert got == [0, 1, 2, 3, None, None]


def test_duplicate_flag(spark):
    assert _col(spark, ["중복 요청", "other", None], L.duplicate_flag("c")) == [1, 0, 0]


def test_row_text_and_values(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert df.select(R.row_to_text(["x", "y", "z"])).first()[0] == "x: a z: 3"
    assert df.select(R.row_values_text(["x", "y", "z"])).first()[0] == "a nan 3"


def test_training_record_null_text(spark):
    df = spark.createDataFrame([(None, "r", "승인됨", None)], "a string, b string, c string, d string")
    rec = df.select(R.training_record("a", "b", "c", "d").alias("r")).first().r
    assert (rec.prompt, rec.completion) == ("요청: nan, 요청 사유: r", "승인됨: nan")


def test_json_line_keeps_nulls_and_non_ascii(spark):
    df = spark.createDataFrame([("한글", None)], "a string, b string")
    assert df.select(R.to_json_line(F.struct("a", "b"))).first()[0] == '{"a":"한글","b":null}'


def test_render_prompt_fills_once(spark):
    df = spark.createDataFrame([("{x}", "y")], "x string, y string")
    assert df.select(R.render_prompt("<{x}|{y}>", x="x", y="y")).first()[0] == "<{x}|y>"


def test_form_suffix_and_required(spark):
    assert _col(spark, ["(업무)회의 (휴게 X)", "(비업무)개인시간_흡연 등 (휴게 O)"], X.strip_form_suffix("c")) == [
        "(업무)회의", "(비업무)개인시간_흡연 등"]
    got = _col(spark, ["ok", " ", None], L.validate_required("c"))
    assert got[0] is None and got[1] == got[2] == "요청 카테고리와 사유는 필수 항목입니다."


def test_iso_text(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.179575' a, timestamp_ntz'2024-01-01 00:00:07' b")
    r = df.select(TM.iso_text("a"), TM.iso_text("b"), TM.day_key("a"), TM.ts_text_zoned("b")).first()
    assert tuple(r) == ("2024-01-01T00:00:07.179575", "2024-01-01T00:00:07", "20240101", "2024-01-01 09:00:07")


def test_recent_array_short_arrays(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5, 6, 7],), ([],)], "a array<int>")
    got = [r[0] for r in df.select(recent_array(F.col("a"), 5)).collect()]
    assert got == [[1, 2], [3, 4, 5, 6, 7], []]


def test_nfkc(spark):
    assert _col(spark, ["ｆｕｌｌ　ｗｉｄｔｈ", None], X.nfkc("c")) == ["full width", None]


def test_clean_text_symbols_and_whitespace(spark):
    """Symbols become spaces, every whitespace run (tab, CR/LF, vertical tab) one space, ends stripped;
    letters and digits of any script stay, characters outside the BMP included."""
    values = ["  Hello,\tworld!! ", "가나\r\n\x0b다 -- 123", "a😀b", "𝐀𝐁 x", "...", None]
    got = _col(spark, values, X.clean_text("c"))
    assert got == ["Hello world", "가나 다 123", "a b", "𝐀𝐁 x", "", None]
