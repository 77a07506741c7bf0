"""The registered queries: SQL of the same meaning, contract columns, whole tables."""

import pytest

import __spark_entry__ as entry
from oracle import connect, difference
from sigweave.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op2": ["query_id", "rank", "vec_id", "score"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5": ["doc_id", "held_out", "score", "predicted"], "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "size", "source_size", "target", "taken"], "op8": ["doc_id", "n_tokens", "log_likelihood"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op13": ["doc_id", "n_shingles", "component_id"]}


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    got = df.toPandas()
    if name in queries.SQL:
        assert difference(got, connect(SF).execute(queries.SQL[name]).df()) is None
    if "doc_id" in got:
        assert sorted(got["doc_id"]) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
