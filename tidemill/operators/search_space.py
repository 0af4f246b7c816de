"""Seeded draws of hyperparameters: spaces as data, draws as columns, the same on every run, task and partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS, UNIT = 12, float(1 << 48)  # hexadecimal digits of a draw's digest, and the number of their values


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def at(self, u: Column) -> Column:
        return F.round(F.lit(self.low) + u * F.lit(self.high - self.low), 6)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def at(self, u: Column) -> Column:
        return F.round(F.exp(F.lit(math.log(self.low)) + u * F.lit(math.log(self.high) - math.log(self.low))), 6)


@dataclass(frozen=True)
class Integers:
    low: int
    high: int  # exclusive

    def at(self, u: Column) -> Column:
        return (F.lit(self.low) + F.floor(u * F.lit(self.high - self.low))).cast("double")


Space = dict[str, Uniform | LogUniform | Integers | list]


def summary(space: Space) -> tuple[str, str]:
    """How the space is drawn from, and its size: a grid of lists is drawn without replacement, anything with a distribution with it."""
    if all(isinstance(v, list) for v in space.values()):
        return "random_without_replacement", str(math.prod(len(v) for v in space.values()))
    return "random_with_replacement", "distribution_defined"


def _unit(seed: int, keys: list[str], name: str) -> Column:
    """A number in [0, 1) from the digest of the seed, the row's keys and the parameter's name."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys), F.lit(name)))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / UNIT


def draws(owners: DataFrame, space: Space, n: int, seed: int) -> DataFrame:
    """``(owner columns, draw, a column for each parameter)``: ``n`` draws for each row of ``owners``, numbered from 0.

    With a distribution in the space every draw is independent and may repeat another. A space of lists alone is a grid: each
    owner gets ``n`` different points of it in a random order, or all of them. Parameters of lists are text. Rows of ``owners`` must differ;
    null keys count as empty. Names of parameters mustn't be those of the owners' columns or ``draw``.
    """
    keys = owners.columns
    clash = sorted({*keys, "draw"} & set(space))
    if clash or not space or any(isinstance(v, list) and not v for v in space.values()):
        raise ValueError(f"parameters need names of their own and values: {clash}")
    texts = {k: F.array(*(F.lit(str(x)) for x in v)) for k, v in space.items() if isinstance(v, list)}
    null_free = owners.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys))
    if len(texts) < len(space):
        rows = null_free.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else null_free.limit(0).withColumn("draw", F.lit(0).cast("long"))
        u = {k: _unit(seed, [*keys, "draw"], k) for k in space}
        return rows.withColumns({k: texts[k][F.floor(u[k] * len(v)).cast("int")] if k in texts else v.at(u[k]) for k, v in space.items()})
    size = math.prod(len(v) for v in space.values())
    points = null_free.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    order = Window.partitionBy(*keys).orderBy(_unit(seed, [*keys, "point"], "order"), "point")
    rows = points.withColumn("draw", (F.row_number().over(order) - 1).cast("long")).filter(F.col("draw") < n)
    at, below = {}, 1
    for k, v in space.items():
        at[k] = texts[k][F.pmod(F.expr(f"point div {below}"), F.lit(len(v))).cast("int")]
        below *= len(v)
    return rows.withColumns(at).drop("point")


def first_of_equal(drawn: DataFrame, owners: list[str], names: list[str]) -> DataFrame:
    """The first draw of each set of equal parameters of an owner; order and numbers stay. One aggregate, so repeats combine before they move."""
    return drawn.groupBy(*owners, *names).agg(F.min("draw").alias("draw")).select(*owners, "draw", *names)
