"""The registered queries over the smallest tables: columns, rows and the oracle."""

from __future__ import annotations

import os

import duckdb
import pytest

from modsieve.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_html": ("pages", [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]),
    "op2_suffix_array": ("documents", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]),
    "op3_toxicity": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]),
    "op4_surrogates": ("documents", [("doc_id", "bigint"), ("text", "string")]),
    "op5_minhash": ("documents", [("doc_id", "bigint"), ("class_id", "bigint")]),
    "op6_neighbours": (None, [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]),
    "op7_language_model": ("documents", [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]),
    "op8_secrets": ("documents", [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]),
    "op9_mixing": (None, [("doc_id", "bigint"), ("source", "string")]),
    "op10_decontaminate": (None, [("doc_id", "bigint"), ("item_id", "bigint")]),
    "op11_periodic_runs": ("documents", [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]),
    "op12_merkle": ("documents", [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]),
    "op13_url_filters": ("pages", [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]),
}


def rows(name: str) -> int:
    return duckdb.connect().execute(f"SELECT count(*) FROM '{SF}/{name}.parquet'").fetchall()[0][0]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    df = Q.queries()[name](spark, SF)
    table, columns = COLUMNS[name]
    assert df.dtypes[: len(columns)] == columns
    got = df.collect()
    assert len(got) == rows(table) if table else got
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(Q.oracle_sql()[name]).fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
