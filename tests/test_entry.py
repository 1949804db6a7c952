import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = ("clusters", "score_hypergeometric")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["other", "n_ab", "confidence"]


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in __spark_entry__.registry.ORACLE_SQL if n not in SLOW])
def test_against_sql(spark, oracle, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = oracle.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{top}/lockstep", tmp_path / "lockstep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'top_partners' in e.queries() and 'pipeline' not in e.queries() and 'op2_jaccard' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
