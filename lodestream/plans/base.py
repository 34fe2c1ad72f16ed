"""Registration of queries, and the stand-in tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as media: micros, epoch seconds, and a place made of integer columns."""
    at = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    lat = F.lit(37.0) + (F.col("user_id") % 7) * F.lit(0.9) + (F.col("event_id") % 5) * F.lit(0.05)
    lon = F.lit(-122.0) + (F.col("user_id") % 11) * F.lit(0.7) + (F.col("event_id") % 3) * F.lit(0.03)
    return at.withColumn("lat", lat).withColumn("lon", lon)


EVENTS_SQL = """ev AS (SELECT *, epoch_us(ts) AS us,
  37.0::DOUBLE + (user_id % 7) * 0.9::DOUBLE + (event_id % 5) * 0.05::DOUBLE AS lat,
  -122.0::DOUBLE + (user_id % 11) * 0.7::DOUBLE + (event_id % 3) * 0.03::DOUBLE AS lon FROM events)"""

HAVERSINE_SQL = "(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE_SQL.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of a user's film: seconds since the first day, a length, and described fields."""
    at = events(spark, sf_dir)
    start = F.floor((F.col("us") - F.lit(1_704_067_200_000_000)) / 10_000) / 100
    length = F.lit(1.0) + (F.col("event_id") % 13)
    energy = F.element_at(F.array(*map(F.lit, ("high", "medium energy", "low", "", "very high"))), (F.col("event_id") % 5 + 1).cast("int"))
    quality = F.element_at(F.array(*map(F.lit, ("good", "shaky", "Good", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    shot = F.element_at(F.array(*map(F.lit, ("aerial shot", "wide", "close up"))), (F.col("event_id") % 3 + 1).cast("int"))
    return at.select("event_id", "user_id", "value", start.alias("start"), F.round(start + length, 2).alias("end"), energy.alias("energy"), quality.alias("quality"), shot.alias("shot"))


CHUNKS_SQL = f"""{EVENTS_SQL},
ck AS (SELECT event_id, user_id, value, ((us - 1704067200000000) // 10000) / 100.0::DOUBLE AS start, round(((us - 1704067200000000) // 10000) / 100.0::DOUBLE + 1.0 + (event_id % 13), 2) AS "end",
  ['high', 'medium energy', 'low', '', 'very high'][(event_id % 5 + 1)::INT] AS energy, ['good', 'shaky', 'Good', ''][(event_id % 4 + 1)::INT] AS quality,
  ['aerial shot', 'wide', 'close up'][(event_id % 3 + 1)::INT] AS shot FROM ev)"""
