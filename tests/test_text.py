"""Chunk windows cover the text; separator chunks respect the size; TF-IDF rows have norm 1."""

import math

from pyspark.sql import functions as F

from deskpass.operators import text as TX
from tests.conftest import SF_SMALL
from deskpass.sources.tables import table


def test_windows_cover_text(spark):
    texts = ["", "a" * 10, "b" * 1000, "c" * 1001, "d" * 1800, "e" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = TX.chunk_windows(df, "text", 1000, 200).select("doc_id", "start", "chunk").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.chunk))
    for i, t in enumerate(texts):
        chunks = sorted(by_doc[i])
        covered = set()
        for start, chunk in chunks:
            assert len(chunk) <= 1000
            assert t[start - 1:start - 1 + 1000] == chunk
            covered.update(range(start - 1, start - 1 + len(chunk)))
        assert covered == set(range(len(t)))


def test_windows_match_slices_for_any_overlap(spark):
    """Windows equal Python slices (code points) for overlaps below, at and above the step,
    across newlines, CR/LF, Hangul and characters outside the BMP; a null text gives one null chunk."""
    unit = "가나 다\r\nab😀c\n\n"
    texts = ["", "x", unit * 3, unit * 130, "😀" * 2345, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in [(1000, 200), (1000, 50), (1000, 0), (1000, 600), (7, 3), (10, 9)]:
        step = size - overlap
        got = {(r.doc_id, r.chunk_no): (r.start, r.chunk) for r in
               TX.chunk_windows(df, "text", size, overlap).select("doc_id", "chunk_no", "start", "chunk").collect()}
        want = {}
        for i, t in enumerate(texts):
            n = len(t) if t is not None else None
            last = max(1, n - overlap) if n is not None else 1
            for j, s in enumerate(range(1, last + 1, step)):
                want[(i, j)] = (s, t[s - 1:s - 1 + size] if t is not None else None)
        assert got == want, (size, overlap)


def test_separator_chunks(spark):
    text = ("".join(f"para {i} line one\nline {i} two " for i in range(40)) + "\n\n" + "".join(f"word{i} " for i in range(500))
            + "".join(f"x{i}" for i in range(900)) + " 끝\U0001f600")
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "short")], "id long, text string")
    got = {}
    for r in TX.chunk_separators(df, "text", 300, 50).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert set(got) == {1, 4} and got[4] == ["short"]
    at = 0
    for c in got[1]:
        assert 0 < len(c) <= 300 and c == c.strip()
        start = text.index(c)
        assert at - 51 <= start and not text[at:start].strip()  # only white space may lie between chunks
        at = start + len(c)
    assert at == len(text)
    assert all(c.endswith(("one", "two")) for c in got[1][:3])


def test_separator_chunks_spark(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    out = TX.chunk_separators(docs, "text")
    assert out.agg(F.max(F.char_length("chunk"))).first()[0] <= 1000
    assert out.select("doc_id").distinct().count() == docs.filter(F.length(F.trim("text")) > 0).count()


def test_tfidf_unit_norm(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    w = TX.tfidf(docs)
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(math.isclose(r.n, 1.0, rel_tol=1e-9) for r in norms)


def test_idf_formula(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa")], "doc_id long, text string")
    idf = {r.term: (r.df, r.idf) for r in TX.fit_idf(df).collect()}
    assert idf["aa"][0] == 3 and math.isclose(idf["aa"][1], math.log(4 / 4) + 1)
    assert idf["bb"][0] == 1 and math.isclose(idf["bb"][1], math.log(4 / 2) + 1)


def test_apply_unknown_terms_drop(spark):
    fit = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    new = spark.createDataFrame([(9, "aa zz zz")], "doc_id long, text string")
    got = {r.term for r in TX.apply_idf(new, TX.fit_idf(fit)).collect()}
    assert got == {"aa"}
