"""Queries against their SQL, on the smallest tables and on made messages."""

import duckdb
import pytest

from lookalike.llm import oracles, queries
from tests.conftest import SF


def tidy(x, columns):
    return x[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(oracles.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and tidy(got, columns).equals(tidy(want, columns))


def test_quoting_equals_sql(spark, tmp_path):
    rows = [(c, t, "u", x) for c in (1, 2) for t, x in enumerate(["Hello\nHow are you?", "X wrote:\n> How are  YOU?\nFine", ">> how are you?\n> fine\nGood\nX wrote:\nno quote", "> hello\n> good\nboth", None, "> > fine\nx > y"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = queries.QUERIES["op6_quoting"](spark, str(tmp_path)).toPandas(), con.execute(oracles.OP6).fetchdf()
    columns = sorted(got.columns)
    assert len(got) == 12 and tidy(got, columns).equals(tidy(want, columns))


def test_quoted_passages_equal_sql(spark, tmp_path):
    """A paragraph broken anew, a part of one, a passage against a later message with one of its lines, nested levels."""
    first = "The road is long\nand the night is cold.\n\nSecond part\nwith two lines"
    texts = [
        first,
        "Other words\nand the night is cold.\nmore",
        "> The road is\n> long and the\n> night is cold.\nyes",
        "> The road is long\n> and the night is cold.\nno",
        "> and the night is cold.\npart",
        ">> Second part with\n>> two lines\n> yes\n>\n> no\nboth",
        ">> Second part\n>> with two lines\ndeep only",
        "\n\n>\n\n",
    ]
    rows = [(c, t, "u", x) for c in (1, 2) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = queries.QUERIES["op6_quoting"](spark, str(tmp_path)).toPandas(), con.execute(oracles.OP6).fetchdf()
    columns = sorted(got.columns)
    assert tidy(got, columns).equals(tidy(want, columns))
    parents = dict(got[got.conv_id == 1][["turn", "parent_turn"]].to_numpy().tolist())
    # 2: broken anew, only the passage tells; 3: message 0 has the passage, the later 1 only a line; 4: the line alone
    assert parents == {0: -1, 1: -1, 2: 0, 3: 0, 4: 1, 5: 3, 6: 0, 7: -1}


def test_every_query(spark):
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    for f in queries.QUERIES.values():
        assert f(spark, SF).columns
