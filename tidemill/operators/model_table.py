"""Saved linear models as rows: what they were fitted on, in which order, and their coefficients."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"
TABLE = "schema_version string, execution string, station_id string, subset string, alpha double, log1p boolean, feature_columns array<string>, logged array<boolean>, target_columns array<string>, contract string, intercepts array<double>, coefficients array<array<double>>"


class ContractError(ValueError):
    """A saved model that doesn't fit what it would be used for."""


@dataclass(frozen=True)
class Contract:
    """What models are fitted and used on: the station, its ordered predictors, its ordered targets and the named subsets."""

    station_id: str
    feature_columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    subsets: dict[str, tuple[str, ...]]

    def digest(self, subset: str) -> str:
        """Of the station, the subset's columns and the targets; another order is another contract."""
        return hashlib.sha256("\n".join([self.station_id, subset, *self.subsets[subset], "", *self.target_columns]).encode()).hexdigest()

    def check(self) -> Contract:
        """Subsets must name columns of the contract, in its order and once each."""
        for name, columns in self.subsets.items():
            places = [self.feature_columns.index(c) for c in columns if c in self.feature_columns]
            if not columns or len(places) != len(columns) or places != sorted(set(places)):
                raise ContractError(f"subset {name} isn't in the order of the contract")
        return self


def save(spark: SparkSession, path: str, contract: Contract, execution: str, subset: str, alpha: float, log1p: bool, logged: list[bool], weights: np.ndarray) -> None:
    """Appends a model to the table at ``path``. ``weights`` has an intercept and a row for each column of the subset, a column for each
    target."""
    if subset not in contract.check().subsets:
        raise ContractError(f"{subset} is no subset of the contract")
    columns = contract.subsets[subset]
    if weights.shape != (1 + len(columns), len(contract.target_columns)) or len(logged) != len(columns) or not np.isfinite(weights).all():
        raise ContractError("coefficients must be finite, one for each column and target")
    row = (SCHEMA_VERSION, execution, contract.station_id, subset, float(alpha), bool(log1p), list(columns), [bool(x) for x in logged], list(contract.target_columns), contract.digest(subset), weights[0].tolist(), weights[1:].T.tolist())
    spark.createDataFrame([row], TABLE).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The saved models, if all of them fit the contract; ContractError says which doesn't and why."""
    contract.check()
    models = spark.read.schema(TABLE).parquet(path)
    for r in models.drop("intercepts", "coefficients").collect():  # a row for each saved model
        columns = contract.subsets.get(r["subset"])
        rules = {
            f"schema version {r['schema_version']} is not {SCHEMA_VERSION}": r["schema_version"] != SCHEMA_VERSION,
            "another station": r["station_id"] != contract.station_id,
            "other targets": tuple(r["target_columns"]) != contract.target_columns,
            f"unknown subset {r['subset']}": columns is None,
            "other columns, or in another order": columns is not None and tuple(r["feature_columns"]) != columns,
        }
        found = [reason for reason, broken in rules.items() if broken]
        if not found and r["contract"] != contract.digest(r["subset"]):
            found = ["another contract"]
        if found:
            raise ContractError(f"model {r['execution']}: {'; '.join(found)}")
    return models


def scored(models: DataFrame, rows: DataFrame, keys: list[str], columns: str = "columns") -> DataFrame:
    """``(keys, execution, horizon, prediction)`` of every model for ``rows(keys, columns)``, where ``columns`` maps names to values. A
    missing column or a forecast that isn't finite raises. Models are few rows, so they are broadcast."""
    both = rows.crossJoin(F.broadcast(models))
    value = lambda name: F.col(columns)[name]
    x = F.zip_with("feature_columns", "logged", lambda n, g: F.when(F.col("log1p") & g, F.log1p(value(n))).otherwise(value(n)))
    both = both.withColumn("_x", F.when(F.exists("feature_columns", lambda n: value(n).isNull()), F.raise_error(F.lit("a row lacks a column of the model")).cast("array<double>")).otherwise(x))
    each = both.select(*keys, "execution", "log1p", "_x", F.posexplode(F.arrays_zip("intercepts", "coefficients")).alias("h", "m"))
    linear = F.aggregate(F.zip_with("m.coefficients", "_x", lambda c, v: c * v), F.col("m.intercepts"), lambda s, v: s + v)
    out = each.select(*keys, "execution", (F.col("h") + 1).cast("long").alias("horizon"), F.when(F.col("log1p"), F.expm1(linear)).otherwise(linear).alias("prediction"))
    finite = ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    return out.withColumn("prediction", F.when(finite, F.col("prediction")).otherwise(F.raise_error(F.lit("a forecast of a saved model is not finite")).cast("double")))
