"""Summaries, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from .dml import numbered


def trip_summary(clusters: DataFrame, photos: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per trip with scenes: counts by score band (null scores are low), seconds and videos; most scenes first.

    ``photos`` has id, cluster_id, path, discarded; ``scenes`` photo_id,
    start_sec, end_sec, score.
    """
    at = scenes.join(photos.select(F.col("id").alias("photo_id"), "cluster_id"), "photo_id")
    high, mid = F.col("score") >= 2.5, (F.col("score") >= 1.5) & (F.col("score") < 2.5)
    per = at.groupBy("cluster_id").agg(F.count("*").alias("n_scenes"), F.count_if(high).alias("n_high"), F.count_if(mid).alias("n_mid"), F.coalesce(F.sum(F.col("end_sec") - F.col("start_sec")), F.lit(0.0)).alias("seconds"))
    per = per.withColumn("n_low", F.col("n_scenes") - F.col("n_high") - F.col("n_mid"))
    videos = photos.where((F.col("discarded") == 0) & text.is_video(F.col("path"))).groupBy("cluster_id").agg(F.count("*").alias("n_videos"))
    named = clusters.select(F.col("id").alias("cluster_id"), "name")
    return named.join(per, "cluster_id").join(videos, "cluster_id", "left").withColumn("n_videos", F.coalesce("n_videos", F.lit(0))).orderBy(F.col("n_scenes").desc(), "cluster_id")


def estimated_gb(files: DataFrame, keys: list[str], order: str, first: int = 15) -> DataFrame:
    """(keys, raw_gb): mean size of the first files (missing ones count as none) times the number of files, in GB."""
    by = Window.partitionBy(*keys).orderBy(order)
    at = files.withColumn("_r", F.row_number().over(by)).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_r") <= first, F.col("size"))), F.lit(0)).alias("s"))
    return at.select(*keys, F.round(F.col("s") / F.greatest(F.lit(1), F.least(F.lit(first), F.col("n"))) * F.col("n") / 1e9, 6).alias("raw_gb"))


#: Parts that the rows of a cluster are dealt to when they meet its name.
NAME_PARTS = 32


def recommendation_lines(photos: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, pos, line): Markdown table rows of described photos by cluster, by time in seconds (nulls last) and id.

    Lines are made before rows move, so that whole captions stay behind. A large
    cluster's rows are dealt to parts, and numbered from counts per minute.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("id").cast("string"), text.base_name(F.col("path")), cell("quality"), cell("scene"), cell("people"), text.shorten(F.col("caption"), 80), F.when(F.col("flagged") == 1, "yes").otherwise("")), F.lit(" |"))
    rows = photos.select("cluster_id", "taken_at", "id", line.alias("line"), F.pmod(F.xxhash64("id"), F.lit(NAME_PARTS)).alias("_part"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(NAME_PARTS - 1).cast("bigint")))
    at = rows.join(names.select(F.col("id").alias("cluster_id"), F.col("name").alias("_n"), parts.alias("_part")), ["cluster_id", "_part"], "left")
    cluster = F.when(F.coalesce("cluster_id", F.lit(0)) == 0, "unclustered").otherwise(F.coalesce("_n", F.concat(F.lit("cluster-"), F.col("cluster_id").cast("string"))))
    at = at.select(cluster.alias("cluster"), "taken_at", "id", "line")
    return numbered(at, "pos", F.floor(F.col("taken_at") / 60), "taken_at", "id", ["cluster"]).select("cluster", F.col("pos").cast("int").alias("pos"), "line")


def flag_counts(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("n_photos"), F.count_if(F.col("flagged") == 1).alias("n_flagged"))


def source_headers(rows: DataFrame, order: list[str], source: str, keys: list[str]) -> DataFrame:
    """Adds is_header: the first row of a key (one page or one film), and each whose source differs from the one before."""
    last = F.lag(F.struct(source)).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("is_header", last.isNull() | ~last[source].eqNullSafe(F.col(source)))


def discard_manifest(photos: DataFrame) -> DataFrame:
    """(filename, reason) of every discarded row."""
    return photos.where("discarded = 1").select(text.base_name(F.col("path")).alias("filename"), F.coalesce("discard_reason", F.lit("unknown")).alias("reason"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", True).csv(path)


def discard_plan(photos: DataFrame, listing: DataFrame, dest: Column) -> DataFrame:
    """(id, src, dest, missing): discarded files to copy; equal names are numbered from 1."""
    at = photos.where("discarded = 1").join(listing.select("path", F.lit(True).alias("_there")), "path", "left")
    n = F.row_number().over(Window.partitionBy(text.base_name(F.col("path"))).orderBy("id"))
    return at.select("id", F.col("path").alias("src"), F.concat_ws("/", dest, text.numbered_on_collision(text.base_name(F.col("path")), n, first=1)).alias("dest"), F.col("_there").isNull().alias("missing"))


def takeout_sidecars(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """(sidecar_path, json) of photos without a sidecar."""
    moment = lambda c: F.struct(F.coalesce(F.col(c), F.lit(0)).cast("string").alias("timestamp"), dates.takeout_time(F.col(c)).alias("formatted"))
    place = F.struct(F.coalesce("lat", F.lit(0.0)).alias("latitude"), F.coalesce("lon", F.lit(0.0)).alias("longitude"), F.lit(0.0).alias("altitude"))
    body = F.to_json(F.struct(text.base_name(F.col("path")).alias("title"), F.coalesce("caption", F.lit("")).alias("description"), moment("taken_at").alias("photoTakenTime"), place.alias("geoData")))
    at = photos.select(F.concat("path", F.lit(".json")).alias("sidecar_path"), body.alias("json"))
    return at.join(existing.select("sidecar_path"), "sidecar_path", "left_anti")


def discarded_pairs(photos: DataFrame) -> DataFrame:
    """(id, path, reason, kept_id, kept_path, auto): discards beside what was kept; of equal names the last row counts, and pairs whose kept file is gone fall out."""
    kept = photos.where("discarded = 0").groupBy(text.base_name(F.col("path")).alias("_k")).agg(F.max("id").alias("kept_id"), F.max_by("path", "id").alias("kept_path"))
    gone = photos.where("discarded = 1").select("id", "path", F.col("discard_reason").alias("reason"), text.kept_name(F.col("discard_reason")).alias("_k"))
    return gone.join(kept, "_k").select("id", "path", "reason", "kept_id", "kept_path", text.auto_confirmed(F.col("reason")).alias("auto"))


def search_report(hits: DataFrame) -> DataFrame:
    """(pos, line) of a Markdown table of hits (doc_id, path, caption, score)."""
    pos = F.row_number().over(Window.orderBy("score", "doc_id"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("doc_id").cast("string"), text.base_name(F.col("path")), text.shorten(F.col("caption"), 60), F.format_number("score", 3)), F.lit(" |"))
    return hits.select(pos.alias("pos"), line.alias("line"))
