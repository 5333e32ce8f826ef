"""The queries that SQL can express, at the smallest size, beside DuckDB's results."""

import duckdb
import pytest

from bondweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted(str([r[names.index(c)] for c in cols]) for r in q.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want
