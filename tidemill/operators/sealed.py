"""The sealed test: scored once for each execution, by horizon and level regime, and refused where it must not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators.provenance import multiset_digest
from tidemill.plans.stored import stored

REGIMES = ("all", "q1", "q2", "q3", "q4", "alarm")
LOG = "execution string, model string, regime string, horizon long, n long, mae double, rmse double, me double, r2 double"
KEY = ["execution", "model", "regime", "horizon"]


class SealedError(ValueError):
    """A sealed test that must not be scored."""


def regimes_of(level, cutoffs, alarm) -> F.Column:
    """The regimes that a level belongs to: all, its training quarter, and alarm besides from that level on."""
    quarter = F.when(level <= cutoffs[0], "q1").when(level <= cutoffs[1], "q2").when(level <= cutoffs[2], "q3").otherwise("q4")
    return F.array_compact(F.array(F.lit("all"), quarter, F.when(level >= alarm, "alarm")))


def regime_scores(forecasts: DataFrame, cutoffs: tuple[float, float, float], alarm: float, horizons=ft.EVERY) -> DataFrame:
    """``(model, regime, horizon, n, mae, rmse, me, r2)`` of ``forecasts(model, horizon, prediction, actual)``.

    Horizon 0 stands for all of them together. Every model, regime and horizon has a row; those without forecasts have n 0 and no
    metrics. Cutoffs that aren't finite and ascending are rejected.
    """
    if not (all(c == c and abs(c) < float("inf") for c in (*cutoffs, alarm)) and cutoffs[0] <= cutoffs[1] <= cutoffs[2]):
        raise ValueError("cutoffs of regimes must be finite and ascending")
    rows = forecasts.withColumn("regime", F.explode(regimes_of(F.col("actual"), [F.lit(float(c)) for c in cutoffs], F.lit(float(alarm)))))
    both = rows.groupingSets([[F.col("model"), F.col("regime")], [F.col("model"), F.col("regime"), F.col("horizon")]], F.col("model"), F.col("regime"), F.col("horizon"))
    found = both.agg(*ft.metrics()).withColumn("horizon", F.coalesce("horizon", F.lit(0).cast("long")))
    every = forecasts.select("model").distinct().withColumn("regime", F.explode(F.array(*map(F.lit, REGIMES)))).withColumn("horizon", F.explode(F.array(*(F.lit(h).cast("long") for h in (0, *horizons)))))
    return every.join(found, ["model", "regime", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _claim(spark: SparkSession, store: str, execution: str, content: str) -> str | None:
    """Creates the execution's marker, in one step and only if it isn't there; else what the marker holds."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store}/markers/{execution}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Exception:
        if not fs.exists(path):
            raise
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return None


def logged(spark: SparkSession, store: str) -> DataFrame:
    """All sealed rows of a store; an empty table where none was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{store}/log")


def seal(forecasts: DataFrame, store: str, execution: str, cutoffs: tuple[float, float, float], alarm: float, horizons=ft.EVERY) -> DataFrame:
    """Scores an execution's test forecasts and appends its rows to the store's log; returns those rows.

    Refused (SealedError) if a forecast or level isn't finite, if there is none, if the execution was scored before, or if it was
    begun with other forecasts. The marker that claims an execution is created only if absent, and holds a digest of the
    forecasts: a job that was lost after it finds the claim to be its own and goes on, and rows that it had written already
    are not written again.
    """
    spark = forecasts.sparkSession
    columns = ["model", "issue_ts", "horizon", "prediction", "actual"]
    rows = stored(forecasts.select(*columns), "sealed-forecasts")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    n, bad = rows.agg(F.count("*"), F.count_if(~(finite("prediction") & finite("actual")))).first()
    if bad or not n:
        raise SealedError(f"{bad} of {n} forecasts are not finite" if bad else "there is no forecast to score")
    held = _claim(spark, store, execution, multiset_digest(rows, columns))
    if held and held != multiset_digest(rows, columns):
        raise SealedError(f"execution {execution} was begun with other forecasts")
    scores = stored(regime_scores(rows, cutoffs, alarm, horizons).withColumn("execution", F.lit(execution)).select(*(c.split()[0] for c in LOG.split(", "))), "sealed-scores")
    missing = stored(scores.join(logged(spark, store).select(KEY), KEY, "left_anti"), "sealed-missing")
    if held is not None and missing.isEmpty():
        raise SealedError(f"execution {execution} was scored before")
    missing.write.mode("append").parquet(f"{store}/log")
    return logged(spark, store).filter(F.col("execution") == execution)
