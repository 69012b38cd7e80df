import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.ledger.queries()) & set(entry.ledger.oracle_sql()) - {"window_sweep", "worst_case_f1"})


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
