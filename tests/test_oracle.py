"""A representative subset of the driver's check: Spark query vs DuckDB oracle SQL at sf0.001."""

import duckdb
import pytest

from oracle_check import TABLES, digest

SUBSET = ["strip_text", "split_keywords", "rule_join", "rule_collapse", "rule_join_anchor", "rules_parse",
          "sim_top1", "sim_top1_grid", "cascade_full", "cascade_vectors", "error_rows", "chunk_progress"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, sf, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, sf)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]
