"""Every registered query with a SQL twin, compared in DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() in (99, 198)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cur = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["score_requests", "tree_attribution", "linear_attribution", "top_factors"])
def test_every_row_is_scored_and_explained(spark, name):
    from riskloom.workload.tables import transactions

    made = contract.queries()[name](spark, SF)
    key = "request_id" if name == "score_requests" else "id"
    assert made.select(key).distinct().count() == transactions(spark, SF).select("id").distinct().count()


def test_search_runs_every_family_with_all_trials(spark, monkeypatch):
    from riskloom.plans import modelling, tuning

    asked = []

    def values(self, numbers, seed):
        asked.append((getattr(self, "family", "gbt"), list(numbers)))
        raise ValueError("not fitted in this test")

    monkeypatch.setattr(tuning.Boosting, "values", values)
    monkeypatch.setattr(tuning.Learners, "values", values)
    made = contract.queries()["tuned_search"](spark, SF)
    assert sorted(asked) == sorted((f, list(range(tuning.TRIALS))) for f in modelling.FAMILIES)
    assert made.count() == tuning.TRIALS * len(modelling.FAMILIES)
