"""Every registered query of the library beside its DuckDB SQL, on all rows at sf0.01."""

import pytest

import oracle
from tidemill import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert not oracle.differences(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs_without_the_llm_folders(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) and set(e.oracle_sql()) <= set(e.queries())


def test_known_grid_sizes(spark, sf):
    assert {r["count"] for r in QUERIES["candidate_grid"](spark, sf).groupBy("station_id").count().collect()} == {52}
    assert {r["count"] for r in QUERIES["subset_candidate_grid"](spark, sf).groupBy("station_id").count().collect()} == {78}


def test_all_horizons_are_scored(spark, sf):
    rows = QUERIES["metrics_per_horizon"](spark, sf).select("horizon").distinct().collect()
    assert {r["horizon"] for r in rows} == set(range(25))


def test_sealed_rows_are_the_test_rows(spark):
    large = "/root/testdata/sf0.1"  # sf0.01 has no complete test row
    got = QUERIES["sealed_test_rows"](spark, large).toPandas()
    assert len(got) == 48 and set(got["n"]) == {48}
    for name in ("sealed_test_rows", "sealed_test_vs_cv"):
        assert not oracle.differences(QUERIES[name](spark, large).toPandas(), oracle.connection(large).execute(SQL[name]).df())
