"""The feature contract, months of several years, and refusals of frames that don't fit."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import contract


def test_columns_must_be_those_of_the_contract_in_order():
    expected = [f"{s}__{b}" for s in ("a", "b") for b in contract.base_columns()]
    assert len(expected) == 2 * len(contract.base_columns()) and expected[0] == "a__water_level" and expected[1] == "a__imputed"
    contract.require_columns(list(expected), expected)
    cases = {
        "not of the form": [*expected[:-1], "temperature"], "repeated": [*expected, expected[3]], "missing": expected[1:], "unknown": [*expected, "c__water_level"],
        "in another order from a__imputed on": [expected[1], expected[0], *expected[2:]],
    }
    for reason, columns in cases.items():
        with pytest.raises(contract.ContractMismatch, match=reason):
            contract.require_columns(columns, expected)


def test_months_of_two_years_stay_apart(spark):
    hours = spark.sql("SELECT explode(sequence(timestamp_ntz'2023-12-30', timestamp_ntz'2025-01-02', INTERVAL 1 HOUR)) AS ts").filter("month(ts) <> 6")
    target = hours.select(F.lit("a").alias("station_id"), "ts", F.lit(1.0).alias("water_level"), (F.month("ts") == 3).alias("imputed"))
    other = hours.filter("ts >= '2024-02-01' and hour(ts) < 12").select(F.lit("b").alias("station_id"), "ts", F.lit(2.0).alias("water_level"), F.lit(False).alias("imputed"))
    eligible = hours.filter("year(ts) = 2025 and hour(ts) = 0").select("ts")
    got = {(r["row_name"], r["month"]): r["percent"] for r in contract.monthly_matrix(target.unionByName(other), eligible, "a").collect()}
    months = [datetime.date(2023, 12, 1), *(datetime.date(2024, m, 1) for m in range(1, 13)), datetime.date(2025, 1, 1)]
    assert set(got) == {(r, m) for r in ("a", "b", "eligible rows") for m in months}
    assert got["a", months[0]] == 100 and got["a", datetime.date(2024, 3, 1)] == 0 and got["b", datetime.date(2024, 1, 1)] == 0 and got["b", datetime.date(2024, 2, 1)] == 50
    assert all(got[r, datetime.date(2024, 6, 1)] is None for r in ("a", "b", "eligible rows"))  # the target has no hour in June
    assert got["eligible rows", datetime.date(2024, 1, 1)] == 0 and got["eligible rows", datetime.date(2025, 1, 1)] == pytest.approx(200 / 25)
    assert contract.monthly_matrix(target.limit(0), eligible, "a").count() == 0
