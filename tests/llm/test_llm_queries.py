"""Every query of the folder on the smallest tables: columns, row counts, and the SQL where there is any."""

import compare
import duckdb
import pytest

import __spark_entry__ as entry_points
from tastemill.llm.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_url_filters": "page_id host path rule verdict",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_ngram_jaccard_join": "doc_id class_id n_links",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_approximate_neighbours": "query_id rank vec_id score",
    "op11_multipart_credentials": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op12_importance_resampling": "doc_id n_features weight score rank",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}
SOURCE = {"op4_chat_formatting": ("conversations", "conv_id"), "op6_url_filters": ("pages", "page_id")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name == "op10_approximate_neighbours":
        assert len(rows) == 5 * len({r.query_id for r in rows}) > 0
        return
    table, key = SOURCE.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in duckdb.sql(f"SELECT {key} FROM read_parquet('{FOLDER}/{table}.parquet')").fetchall()}
    assert {r[key] for r in rows} == ids | ({-1} if table == "conversations" else set())
    if name != "op5_packing":
        assert len(rows) == len({r[key] for r in rows})


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), compare.connect(FOLDER), CHECKS[name]) == []


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and {*COLUMNS, "pipeline"} <= set(entry_points.queries())
