import importlib
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    queries = importlib.reload(entry).queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) >= 45


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["token_frequency", "cleaned_frequency", "headword_index", "rule_step_passive_di", "review_scan_metrics", "parse_cases"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "part", "conversations", "events", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
