import duckdb
import pytest

from lockstep.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir), db.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=str)
