import duckdb
import pytest

import __spark_entry__ as entry
from lookalike.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
