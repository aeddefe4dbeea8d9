"""Each registered operator query over the given tables: the contract's columns, a row for each input row
(or more where the contract says so), and the SQL where there is one."""

import os

import duckdb
import pytest

from fjordlake.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_license_scan": "doc_id bigint, license string, coverage double, start int, stop int",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)
    assert set(queries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(COLUMNS[name])
    got = df.collect()
    source, key = ("pages", "page_id") if name == "op10_url_filter" else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    assert sorted({r[0] for r in got} if name == "op9_license_scan" else [r[0] for r in got]) == ids
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
