"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

from corpusmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return f"{float(x):.4f}" if isinstance(x, int | float) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(ours.columns) and len(ours)
        return
    theirs = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
