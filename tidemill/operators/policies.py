"""Selection of candidates by a policy for each kind of model, policies being data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# What breaks ties after the metric, in order, and how a logged value is read. ``less`` and ``more`` are numbers of which
# the smaller or the larger wins, ``bounded`` numbers of which None is the largest, ``false_first`` booleans, ``text`` the text itself,
# ``sum:a,b`` the sum of two numbers, ``order:a,b`` the place in a list of values.
POLICIES: dict[str, list[tuple[str, str]]] = {
    "ridge": [("feature_count", "less"), ("log1p", "false_first"), ("alpha", "less"), ("subset", "text")],
    "mlp": [("feature_count", "less"), ("alpha", "less"), ("hidden_layer_sizes", "text"), ("subset", "text")],
    "xgboost": [("feature_count", "less"), ("max_depth", "less"), ("n_estimators", "less"), ("learning_rate", "less"), ("subsample", "less"), ("colsample_bytree", "less"), ("reg_lambda", "less"), ("subset", "text")],
    "extra_trees": [("feature_count", "less"), ("min_samples_leaf", "more"), ("max_depth", "bounded"), ("n_estimators", "less"), ("max_features", "order:sqrt,0.5,1.0"), ("subset", "text")],
    "rnn": [("channel_count", "less"), ("sequence_length", "less"), ("hidden_size", "less"), ("num_layers", "less"), ("cell_type", "text"), ("subset", "text")],
    "arima": [("order_complexity", "sum:p,q"), ("d", "less"), ("intercept", "false_first"), ("p", "less"), ("q", "less")],
    "arimax": [("feature_count", "less"), ("order_complexity", "sum:p,q"), ("d", "less"), ("subset", "text"), ("p", "less"), ("q", "less")],
}


class NoCandidate(ValueError):
    """Candidates that can't be ranked."""


def part(params: Column, name: str, reading: str) -> Column:
    """One step of a policy as a struct that compares as the policy says; null where the value is missing or can't be read."""
    text = params[name]
    number = text.try_cast("double")
    if reading.startswith("sum:"):
        a, b = reading[4:].split(",")
        number = params[a].try_cast("double") + params[b].try_cast("double")
    if reading.startswith("order:"):
        number = F.lit(None).cast("double")
        for place, word in enumerate(reading[6:].split(",")):
            same = (text == word) | F.coalesce(text.try_cast("double") == F.lit(word).try_cast("double"), F.lit(False))
            number = F.coalesce(number, F.when(same, float(place)))
    value = {
        "more": -number, "false_first": F.when(F.lower(text).isin("true", "false"), (F.lower(text) == "true").cast("double")),
        "bounded": F.when(text == "None", F.lit(float("inf"))).otherwise(number), "text": F.when(text.isNotNull(), F.lit(0.0)),
    }.get(reading, number)
    words = text if reading == "text" else F.lit("")
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("number"), words.alias("text")))


def policy_key(experiment: Column, params: Column, policies: dict = POLICIES) -> Column:
    """The tie-break key of a candidate: an array that compares in the order of its model's policy; null for unknown models."""
    out = F.lit(None).cast("array<struct<number:double,text:string>>")
    for name, steps in policies.items():
        out = F.when(experiment == name, F.array(*(part(params, column, reading) for column, reading in steps))).otherwise(out)
    return out


def ranked(candidates: DataFrame, metric: str = "rmse", within: tuple[str, ...] = (), policies: dict = POLICIES) -> DataFrame:
    """``candidates(experiment, params, metrics)`` with ``place``, from 1, among those of its experiment and of equal ``within`` parameters.

    One ranking serves all models: the mean of the metric first, then the policy of the model. Raises where the metric isn't mae or
    rmse, no candidate is there, a model has no policy, or a value that is ranked by is missing, unreadable or not finite.
    """
    if metric not in ("mae", "rmse"):
        raise NoCandidate(f"candidates are ranked by mae or rmse, not {metric}")
    value = F.col("metrics")[f"cv_{metric}_mean"]
    rows = candidates.withColumns({"_value": value, "_key": policy_key(F.col("experiment"), F.col("params"), policies)})
    finite = F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf"))
    n, unknown, bad = rows.agg(F.count("*"), F.collect_set(F.when(F.col("_key").isNull(), F.col("experiment"))), F.count_if(~finite | F.exists("_key", lambda x: x.isNull()))).first()
    if not n or unknown or bad:
        raise NoCandidate("there is no candidate" if not n else f"no policy for {sorted(unknown)}" if unknown else f"{bad} candidates hold values that can't be ranked")
    by = Window.partitionBy("experiment", *(F.col("params")[c] for c in within))
    return rows.withColumn("place", F.row_number().over(by.orderBy("_value", "_key"))).drop("_value", "_key")
