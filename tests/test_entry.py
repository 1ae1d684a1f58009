import os

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.plans.oracles import ORACLES
from cohortlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_oracles_rows(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    with duckdb.connect() as con:
        for f in os.listdir(SF):
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
        wanted = con.execute(ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_package(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "cohortlens.llm.queries", None)  # as if it couldn't be imported
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
