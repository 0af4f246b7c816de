"""Bounded samples for training on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, identity: list[str], n: int, column: str) -> list:
    """``column`` of the ``n`` rows whose identity hashes lowest, in that order, so the sample doesn't depend on row order.

    Only the keys are ranked; the values of the chosen rows are fetched afterwards, so no task sends more than ``n`` keys.
    """
    keyed = rows.select(F.xxhash64(*identity).alias("key"), column)
    keys = keyed.select("key").orderBy("key").limit(n)
    chosen = keyed.join(F.broadcast(keys.distinct()), "key").dropDuplicates(["key"])
    return [r[1] for r in sorted(chosen.collect(), key=lambda r: r[0])]
