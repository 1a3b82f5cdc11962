"""A few registered queries against their checking SQL on the smallest tables (all of them: tests/oracle_check.py)."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
NAMES = ["f2_work_type", "j10_infer_composer_links", "a9_group_consistency", "v6_top_edges", "v11_embedding_search", "w5_repeated_violations", "u5_merge_review", "f11_explain_search"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from oracle_check import TABLES, compare

    from ostinato.plans import all_queries

    queries, oracles = all_queries()
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{FOLDER}/{n}.parquet')")
    ok, note, _took = compare(spark, con, name, queries[name], oracles[name], FOLDER)
    assert ok, note


def test_every_query_has_a_checked_name():
    from ostinato.plans import all_queries

    queries, oracles = all_queries()
    assert set(oracles) <= set(queries) and len(queries) > 150
