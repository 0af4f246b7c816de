"""Provenance of runs: digests of the rows that a model was trained on, and the checks that let executions be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import features as ft


class Disagreement(ValueError):
    """Executions that are compared were not trained on the same rows."""


def row_hashes(columns: list[str]) -> dict[str, Column]:
    """Two hashes of a row, null and zero being told apart, as decimals, so that sums of any number of rows stay exact."""
    packed = F.struct(*columns)
    held = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return {"_hash_a": F.xxhash64(packed, *held).cast("decimal(38,0)"), "_hash_b": F.xxhash64(*held, F.lit("second"), packed).cast("decimal(38,0)")}


def digest(a: Column, b: Column, n: Column) -> Column:
    """The text of a multiset: two sums of hashes and the number of rows. It doesn't depend on the order of rows, and those of
    disjoint parts add up."""
    return F.concat_ws(":", a.cast("string"), b.cast("string"), n.cast("string"))


def multiset_digest(rows: DataFrame, columns: list[str]) -> str:
    """The digest of all rows; equal multisets of rows have equal digests."""
    found = rows.select(*columns).withColumns(row_hashes(columns)).agg(F.coalesce(F.sum("_hash_a"), F.lit(0)).alias("_hash_a"), F.coalesce(F.sum("_hash_b"), F.lit(0)).alias("_hash_b"), F.count("*").alias("_n"))
    return found.select(digest(F.col("_hash_a"), F.col("_hash_b"), F.col("_n"))).first()[0]


def fold_digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, fold, n_rows, train_digest)``: the digest of each fold's training rows, from ``rows(keys, pos, n, columns)``.

    Each row is hashed once and goes to the segment between two cuts; sums of segments add up to folds.
    """
    cuts = ft.fold_bounds(F.col("n"))
    segment = F.size(F.filter(cuts, lambda b: b["train_end"] <= F.col("pos"))).cast("long")
    parts = rows.withColumns(row_hashes(columns)).groupBy(*keys, segment.alias("fold")).agg(F.sum("_hash_a").alias("_hash_a"), F.sum("_hash_b").alias("_hash_b"), F.count("*").alias("_n"))
    # a fold trains on its own segment and all before it; segments without rows take part as zeros
    every = rows.select(*keys).distinct().withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ft.FOLDS - 1).cast("long"))))
    parts = every.join(parts, [*keys, "fold"], "left")
    so_far = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    return parts.select(*keys, "fold", total("_n").alias("n_rows"), digest(total("_hash_a"), total("_hash_b"), total("_n")).alias("train_digest"))


def agreement(digests: DataFrame, reference: str) -> DataFrame:
    """``(model, fold, n_rows, agrees)``: whether each model's digest of a fold is that of the ``reference`` model."""
    own = digests.filter(F.col("model") == reference).select("fold", F.col("train_digest").alias("wanted"))
    return digests.join(own, "fold", "left").select("model", "fold", "n_rows", F.coalesce(F.col("train_digest") == F.col("wanted"), F.lit(False)).alias("agrees"))


def require_agreement(digests: DataFrame) -> DataFrame:
    """``digests(model, fold, train_digest)`` if all models agree on each fold, else Disagreement with the first fold."""
    bad = digests.groupBy("fold").agg(F.collect_set("train_digest").alias("d"), F.sort_array(F.collect_set("model")).alias("m")).filter(F.size("d") > 1).orderBy("fold").first()
    if bad:
        raise Disagreement(f"models {bad['m']} were trained on different rows of fold {bad['fold']}")
    return digests


def _positive(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\+?0*[1-9][0-9]*$"), F.lit(False))


def violations(sealed: DataFrame, candidates: DataFrame, identity: list[str], shared: list[str], cv_metrics: list[str], test_metrics: list[str]) -> DataFrame:
    """``(experiment, execution, run_id, violations)`` of each sealed run: why its execution can't be taken, an empty array if it can.

    Both tables have ``run_id, experiment, status, end_time, tags, params, metrics``. The sealed run must name its execution, have
    ended, hold all parameters of ``identity``, match exactly one candidate of its execution that didn't fail in them, agree with
    it on the ``shared`` parameters, have a positive horizon and cohort, and both must hold finite values of their metrics.
    """
    uuid = F.col("tags")["execution_uuid"]
    key = F.array(*(F.col("params")[c] for c in identity))
    finite = lambda metrics, names: F.forall(F.array(*map(F.lit, names)), lambda m: F.coalesce(metrics[m].isNotNull() & ~F.isnan(metrics[m]) & (F.abs(metrics[m]) < float("inf")), F.lit(False)))
    able = candidates.filter("status <> 'FAILED'").groupBy("experiment", uuid.alias("execution"), key.alias("key")).agg(F.count("*").alias("matches"), F.any_value(F.struct("end_time", "params", "metrics")).alias("c"))
    own = sealed.select("experiment", "run_id", "end_time", "params", "metrics", uuid.alias("execution"), key.alias("key"))
    both = own.join(able, ["experiment", "execution", "key"], "left")
    p, c = F.col("params"), F.col("c")
    rules = {
        "no execution": F.coalesce(F.col("execution"), F.lit("")) == "",
        "no completion time": F.col("end_time").isNull(),
        "parameters missing": F.exists("key", lambda x: x.isNull()),
        "not one candidate": F.coalesce(F.col("matches"), F.lit(0)) != 1,
        "candidate has no completion time": c.isNotNull() & c["end_time"].isNull(),
        **{f"disagrees on {s}": p[s].isNull() | (c.isNotNull() & ~F.coalesce(p[s] == c["params"][s], F.lit(False))) for s in shared},
        "horizon not positive": ~_positive(p["forecast_horizon_hours"]),
        "cohort not positive": ~_positive(p["scored_issue_times"]),
        "candidate metrics not finite": c.isNotNull() & ~finite(c["metrics"], cv_metrics),
        "test metrics not finite": ~finite(F.col("metrics"), test_metrics),
    }
    found = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return both.select("experiment", "execution", "run_id", found.alias("violations"))
