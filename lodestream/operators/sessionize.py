"""Groups by time gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, keys: list[str], ts: Column, gap: float, tie: list[str] | None = None, name: str = "session_id") -> DataFrame:
    """Number each key's sessions from 0; a gap longer than ``gap`` (seconds; an equal one doesn't) starts a new one.

    ``ts`` is in seconds. Rows of one key are sorted in one task: choose keys
    (user, album, device) that bound a group. Null times sort first.
    """
    by = Window.partitionBy(*keys).orderBy("_ts", *(tie or []))
    at = df.withColumn("_ts", ts)
    new = F.coalesce((F.col("_ts") - F.lag("_ts").over(by) > gap).cast("int"), F.lit(0))
    return at.withColumn("_new", new).withColumn(name, F.sum("_new").over(by).cast("bigint")).drop("_ts", "_new")


def bursts(df: DataFrame, keys: list[str], ts: Column, window: float = 3, tie: list[str] | None = None) -> DataFrame:
    """Rows of chains of two or more whose neighbours are at most ``window`` seconds apart; rows without a time go."""
    chained = gap_sessions(df.where(ts.isNotNull()), keys, ts, window, tie, "burst_id")
    return chained.withColumn("burst_size", F.count("*").over(Window.partitionBy(*keys, "burst_id"))).where("burst_size >= 2")


def boundaries_to_intervals(cuts: DataFrame, keys: list[str], frame: str, last: str, fps: float = 25.0, duration: str | None = None, shortest: float = 1.0) -> DataFrame:
    """(keys, start, end) between neighbouring cuts, with 0 and the last frame added.

    Seconds have two places and end at ``duration`` if there is one; intervals
    of ``shortest`` seconds or less are dropped.
    """
    extra = [duration] if duration else []
    ends = cuts.groupBy(*keys, last, *extra).agg(F.collect_set(frame).alias("f"))
    ends = ends.withColumn("f", F.array_sort(F.array_union(F.filter("f", lambda x: x.isNotNull()), F.array(F.lit(0).cast("bigint"), F.col(last).cast("bigint")))))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("f") - 2, F.lit(0))), lambda i: F.struct(F.get("f", i).alias("a"), F.get("f", i + 1).alias("b")))
    at = ends.select(*keys, *extra, F.explode(pairs).alias("p")).where("p.b is not null")
    clamp = (lambda x: F.when(F.col(duration) > 0, F.least(x, F.col(duration))).otherwise(x)) if duration else (lambda x: x)
    at = at.select(*keys, clamp(F.round(F.col("p.a") / fps, 2)).alias("start"), clamp(F.round(F.col("p.b") / fps, 2)).alias("end"))
    return at.where(F.col("end") - F.col("start") > shortest)
