"""The registered queries on the smallest tables: SQL where there is some, columns of all."""

import glob
import hashlib
import os

import duckdb
import pytest

from sluice.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit kept_chars",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_telephony": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature pcm_sha256",
    "op10_language_id": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS.keys() - queries.oracle_sql().keys()))
def test_columns_and_rows(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    assert df.count() == duck.sql("select count(*) from documents").fetchall()[0][0]


def test_telephony_stores_its_pcm(spark, monkeypatch):
    stored = []
    keep = queries.kept
    monkeypatch.setattr(queries, "kept", lambda df, what="table": stored.append(keep(df, what)) or stored[-1])
    digests = {r.doc_id: r.pcm_sha256 for r in queries.op9_telephony(spark, DATA).collect()}
    (pcm,) = [t for t in stored if "pcm" in t.columns]
    assert {r.doc_id: hashlib.sha256(bytes(r.pcm)).hexdigest() for r in pcm.select("doc_id", "pcm").collect()} == digests and digests
