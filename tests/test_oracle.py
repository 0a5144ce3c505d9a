"""Registered queries against their SQL oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
KEYS = ["training_set_summary", "dedupe_by_sequence", "stratified_split", "family_split",
        "chunk_sequence", "mlm_mask", "embed_sequences", "classification_report",
        "regression_metrics", "read_fasta", "title_term_search", "point_mutate"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(dcols, cur.fetchall())[0]


def test_every_query_has_a_callable(spark):
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 90


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
