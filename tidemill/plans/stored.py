"""Tables written between the steps of a job, so that a lost executor never restarts it from the beginning."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Sides of at most this many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a local
    session; on a cluster no machine's own folder will do, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemill.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("tidemill.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _open:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []  # the tables written within each ``temporary`` that has not ended


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``stored`` writes within, once nothing reads them any more; a result must be written outside."""
    held: list[str] = []
    _open.append(held)
    try:
        yield
    finally:
        _open.remove(held)
        for path in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows, of at most ``row_bytes``, fit the bound; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
