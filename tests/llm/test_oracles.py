"""The registered queries of the pipeline operators: those with SQL against DuckDB, the others by their contracts' columns."""

import os

import pytest
from oracle_compare import connection, same

from tallyspark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
COLUMNS = {
    "op1": {"doc_id", "held_out", "score", "predicted"},
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "item_id", "score"},
    "op4": {"doc_id", "n_shingles", "component_id"},
    "op5": {"doc_id", "text", "n_lines", "n_deleted"},
    "op6": {"page_id", "host", "path", "rule", "verdict"},
    "op7": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op8": {"page_id", "url", "text", "n_chars"},
    "op9": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op11": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op12": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query(spark, name):
    df = queries.all_queries()[name](spark, DATA)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    if name in queries.ORACLES:
        assert same(df, connection(DATA), queries.ORACLES[name]) == ""
    else:
        whole = "pages" if name.startswith(("op6", "op8")) else "documents"
        n = df.count()
        assert n > 0 if name.startswith("op3") else n >= spark.read.parquet(f"{DATA}/{whole}.parquet").count() if name.startswith("op11") else n == spark.read.parquet(f"{DATA}/{whole}.parquet").count()


def test_all_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.all_queries()) == list(range(1, 13))
