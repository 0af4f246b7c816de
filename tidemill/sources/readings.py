"""Readings, weather and station catalog, and how they are landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from tidemill.config import CHUNK_HOURS
from tidemill.plans.stored import small_side, stored, table

NTZ = "timestamp_ntz"
BODY_ROWS = 10_000  # rows of a landed history, about


def station_column(kind: str):
    """The station that an event belongs to: its type, its user modulo 40, or its user."""
    if kind == "dense":
        return F.col("event_type")
    user = F.col("user_id") % 40 if kind == "sparse" else F.col("user_id")
    return F.concat(F.lit("u"), user.cast("string"))


def hour(ts):
    return F.date_trunc("HOUR", ts).cast(NTZ)


def keep_last(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row for each key: the last to arrive. Runs as an aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def readings(spark: SparkSession, sf_dir: str, kind: str = "dense") -> DataFrame:
    """``(station_id, ts, value)``: the last event of each station and hour."""
    events = table(spark, sf_dir, "events").select(station_column(kind).alias("station_id"), hour(F.col("ts")).alias("ts"), "value", F.col("ts").alias("at"), "event_id")
    return keep_last(events, ["station_id", "ts"], ["at", "event_id"]).select("station_id", "ts", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station_id, ts, precipitation, temperature_2m)`` of hours that have weather."""
    events = table(spark, sf_dir, "events").filter("event_id % 3 <> 0")
    return events.groupBy(F.col("event_type").alias("station_id"), hour(F.col("ts")).alias("ts")).agg(F.avg("value").alias("precipitation"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("temperature_2m"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station_id, position_km)``."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station_id")).agg(F.avg("user_id").alias("position_km"))


def landed_bodies(events: DataFrame, most: int = BODY_ROWS) -> DataFrame:
    """``(station_id, body)``: events landed as JSON histories by station, hour and piece, of about ``most`` rows each."""
    item = F.struct(F.date_format("ts", "dd.MM.yyyy'T'HH:mm:ss'+0000'").alias("sourceDate"), F.round("value", 3).alias("value"))
    rows = events.select(F.col("event_type").alias("station_id"), F.date_trunc("HOUR", "ts").alias("hour"), item.alias("item"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = stored(rows, "landing")  # the numbers of rows are written once, so that a task that runs again deals them out alike
    # the key has no nulls; where two groups share one, they only get more pieces
    rows = rows.withColumn("key", F.xxhash64("station_id", "hour"))
    sizes = stored(rows.groupBy("key").agg(F.ceil(F.count("*") / most).alias("pieces")), "pieces")
    pieces = rows.join(small_side(sizes, 24), "key").withColumn("piece", F.pmod("salt", "pieces"))
    payload = F.struct(F.collect_list("item").alias("history")).alias("payload")
    return pieces.groupBy("station_id", "hour", "piece").agg(F.to_json(F.struct(F.struct(F.lit(200).alias("code")).alias("status"), payload)).alias("body")).select("station_id", "body")


def history_rows(payloads: DataFrame) -> DataFrame:
    """Rows of landed JSON histories ``(body)``: ``(source_ts, value)``, after the other columns; a null history has none.

    Times carry their offset (``dd.MM.yyyyTHH:mm:ss+zzzz``) and come out in UTC. A body that isn't an object, has
    another status code than 200 or a history that isn't a list raises.
    """
    body = F.from_json("body", "status struct<code:int>, payload struct<history:string>")
    rest = [c for c in payloads.columns if c != "body"]
    checked = payloads.select(*rest, body.alias("b"), "body")
    history = F.col("b.payload.history")
    bad = F.col("b").isNull() | (F.coalesce(F.col("b.status.code"), F.lit(200)) != 200) | (history.isNotNull() & ~history.startswith("["))
    checked = checked.select(*rest, F.when(bad, F.raise_error(F.concat(F.lit("unusable history: "), F.substring("body", 1, 80)))).otherwise(history).alias("h"))
    rows = checked.select(*rest, F.explode(F.from_json("h", "array<struct<sourceDate:string,value:double>>")).alias("r"))
    return rows.select(*rest, F.to_timestamp("r.sourceDate", "dd.MM.yyyy'T'HH:mm:ssxx").alias("source_ts"), F.col("r.value").alias("value"))


def flatten_catalog(stations: DataFrame) -> DataFrame:
    """Struct fields become columns joined by ``_``; columns that hold arrays or maps are dropped."""

    def walk(kind: StructType, path: tuple[str, ...]):
        for field in kind.fields:
            at = (*path, field.name)
            if isinstance(field.dataType, StructType):
                yield from walk(field.dataType, at)
            elif not isinstance(field.dataType, (ArrayType, MapType)):
                yield F.col(".".join(f"`{p}`" for p in at)).alias("_".join(at))

    return stations.select(*walk(stations.schema, ()))


def weather_from_csv(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Landed weather CSV (header; ``time, RR [kg m-2], T2M [degree_Celsius], lat, lon``) of one grid point.

    Empty cells become null; a time that can't be read, a non-empty cell that is no number, or a second grid point raises.
    Times are UTC, cut to [start, end]; of rows for one time the last in the file stays.
    """
    raw = spark.read.option("header", True).csv(path)
    names = {"time": "time", "RR [kg m-2]": "precipitation", "T2M [degree_Celsius]": "temperature_2m", "lat": "latitude", "lon": "longitude"}
    missing = [c for c in names if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    read = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).withColumn("seq", F.monotonically_increasing_id())
    number = lambda c: F.when(F.trim(F.col(c)) != "", F.when(F.col(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c))).cast("double")).otherwise(F.col(c).try_cast("double")))
    time = F.coalesce(F.try_to_timestamp("time"), F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce("time", F.lit("")))).cast("timestamp"))
    typed = read.select(time.alias("ts"), *(number(c).alias(c) for c in ("precipitation", "temperature_2m", "latitude", "longitude")), "seq")
    if typed.select("latitude", "longitude").distinct().limit(2).count() > 1:
        raise ValueError("more than one grid point")
    return keep_last(typed.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))), ["ts"], ["seq"]).drop("seq")


def chunks(ranges: DataFrame, hours: int = CHUNK_HOURS) -> DataFrame:
    """``(station_id, start, end)``: inclusive, non-overlapping pieces of at most ``hours`` hours of each ``(station_id, lo, hi)``."""
    starts = ranges.select("station_id", "hi", F.explode(F.expr(f"sequence(lo, hi, INTERVAL {hours} HOURS)")).alias("start"))
    return starts.select("station_id", "start", F.least(F.expr(f"start + INTERVAL {hours - 1} HOURS"), F.col("hi")).alias("end"))


def profile(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """One pass over a table: rows, time range, nulls of each column, and an order-free digest."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")
    return df.agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *nulls, digest)


def latest_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("n = 1").drop("n")
