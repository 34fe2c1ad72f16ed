"""Sessions and keyed ingestion over streams of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dml import insert_or_ignore


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of parquet files with ts as a timestamp (watermarks need one with a zone).

    ``path`` may be a folder that files arrive in, or one file of it.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    import re

    if spark.read.format("binaryFile").option("pathGlobFilter", re.sub(r"([\[\]{}*?\\])", r"\\\1", name)).load(folder).limit(1).select("path").count():
        return reader.option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """(user_id, start_ts, end_ts, n_events) of sessions that the watermark has closed."""
    at = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return at.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


def run_available(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Process what is there into an in-memory table, and return it: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def closed_sessions(spark: SparkSession, path: str, gap: str, late: str) -> DataFrame:
    """Closed sessions of the files that are there now, written as parquet by the stream and read back."""
    from ..checkpoints import folder

    base = f"{folder(spark)}/stream-sessions-{uuid.uuid4().hex}"
    out = session_counts(event_stream(spark, path), gap, late)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def upsert(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str):
    """A query that adds each batch's rows whose key isn't in the table yet.

    ``read`` gives the table, ``write`` stores its new content under the
    batch's number; a repeated batch adds nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write(insert_or_ignore(read(), rows, key), number)

    return stream.writeStream.foreachBatch(batch)
