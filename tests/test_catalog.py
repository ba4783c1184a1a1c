"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cladeline.plans import catalog

from .conftest import DATA

TABLES = "region nation supplier customer part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return (0, "")
        return (1, round(float(x), 6)) if isinstance(x, (int, float, np.integer, np.floating, bool, np.bool_)) else (2, str(x))

    return sorted(tuple(map(plain, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, database, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = database.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_golden_totals(spark):
    assert abs(catalog.queries()["total_jc69"](spark, DATA).first()["total"] + 5582.940623) < 1e-3
    assert abs(next(r.log_likelihood for r in catalog.queries()["loglik_jc69"](spark, DATA).collect() if r.site == 0) + 10.932941) < 1e-6


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 512
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "cladeline", tmp_path / "cladeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'loglik_jc69' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
