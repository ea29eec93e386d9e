"""The registered op queries and the pipeline over the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline
from deskpass.llm import queries
from tests.conftest import SF_SMALL

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_per_operator():
    ops = [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")]
    assert sorted(ops) == sorted(f"op{k}" for k in range(1, 14))
    assert set(queries.QUERIES) <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name, columns", [
    ("op2_simhash_anchors", ["doc_id", "fingerprint", "component_id"]),
    ("op5_adaptive_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    ("op6_best_fit_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    ("op7_wrapper_extraction", ["page_id", "url", "text", "n_chars"]),
    ("op11_forced_boundary_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ("op10_segmentation_langid", ["doc_id", "held_out", "lang_pred", "score"])])
def test_contract_columns(spark, name, columns):
    assert queries.QUERIES[name](spark, SF_SMALL).columns[:len(columns)] == columns


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == NAMES
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4]
    ran = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(map(key, ran)) == Counter(map(key, docs.collect()))
