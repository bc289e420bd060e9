"""Registered queries: whole tables, contract columns, SQL where there is one."""

import pytest

from lumenstock.llm.queries import QUERIES, SQL
from tests.support import compare

COLUMNS = {
    "op1": {"vec_id", "n_links", "component_id", "kept"}, "op2": {"doc_id", "held_out", "score", "predicted"}, "op3": {"page_id", "text"},
    "op4": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op5": {"doc_id", "n_shingles", "component_id"},
    "op6": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op7": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op8": {"doc_id", "held_out", "score", "predicted"}, "op9": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op10": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op11": {"item_id", "rank", "doc_id", "score"}, "op12": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}
TABLE = {"op1": ("embeddings", "vec_id"), "op3": ("pages", "page_id"), "op11": ("benchmark", "item_id")}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    op = name.split("_")[0]
    df = QUERIES[name](spark, sf_dir)
    assert COLUMNS[op] <= set(df.columns)
    if op == "op12":  # one row per word
        assert df.count() == df.select("word").distinct().count() > 0
        return
    table, key = TABLE.get(op, ("documents", "doc_id"))
    if name in SQL:
        assert compare(spark, con, name, lambda *_: df, SQL[name], sf_dir)[0] == ""
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
