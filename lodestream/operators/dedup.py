"""Duplicate groups with an explicit keep rule, in passes over what earlier passes left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def discard_duplicates(df: DataFrame, key: Column, reason: Column | None = None, id_col: str = "id", described: str | None = "described_at", skip: Column | None = None, kept_text: str = "path") -> DataFrame:
    """Rows of the groups of two or more with equal, not null keys: the input's columns, kept_id, is_kept and reason.

    The first described row by id is kept, else the smallest id. ``skip``, true
    in any row of a group, leaves that group alone. Groups are summed up before
    the shuffle and joined back, so a key with very many copies can be split.
    """
    shown = F.lit(False) if described is None else F.coalesce(F.col(described) != 0, F.lit(False))
    at = df.withColumn("_key", key).where("_key is not null")
    first = F.min(F.struct((~shown).alias("s"), F.col(id_col).alias("i"), F.col(kept_text).alias("t"))).alias("_f")
    bad = F.max(F.coalesce(skip, F.lit(False))) if skip is not None else F.lit(False)
    groups = at.groupBy("_key").agg(F.count("*").alias("_n"), first, bad.alias("_bad")).where("_n >= 2 and not _bad")
    at = at.join(groups, "_key").withColumn("kept_id", F.col("_f.i"))
    at = at.withColumn("is_kept", F.col(id_col) == F.col("kept_id"))
    why = F.when(~F.col("is_kept"), F.concat(reason if reason is not None else F.lit("exact duplicate of "), text.base_name(F.col("_f.t"))))
    return at.withColumn("reason", why).drop("_key", "_n", "_bad", "_f")


def duplicate_summary(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """One row per group of two or more equal keys: dup_key, kept_id, n_copies; scales with any hot key (partial aggregates)."""
    return df.where(key.isNotNull()).groupBy(key.alias("dup_key")).agg(F.min(id_col).alias("kept_id"), F.count("*").alias("n_copies")).where("n_copies >= 2")


def exact_file_key(files: DataFrame, content: str = "content", size: str = "length") -> DataFrame:
    """Adds content_md5, only for files whose size another one has: hashing is the dear part."""
    shared = files.groupBy(size).agg(F.count("*").alias("_n")).where("_n >= 2").select(F.col(size).alias("_size"), "_n")
    return files.join(shared, F.col(size) == F.col("_size"), "left").withColumn("content_md5", F.when(F.col("_n").isNotNull(), F.md5(F.col(content)))).drop("_n", "_size")


def cross_album(df: DataFrame, key: Column, catch_all: Column, id_col: str = "id") -> DataFrame:
    """(input, is_kept) of groups of equal keys: if some rows are in named albums, all catch-all rows go and named ones stay; else the smallest id stays."""
    at = df.withColumn("_key", key).withColumn("_all", catch_all).where("_key is not null")
    groups = at.groupBy("_key").agg(F.count("*").alias("_n"), (F.bool_or("_all") & ~F.bool_and("_all")).alias("_mixed"), F.min(id_col).alias("_first")).where("_n >= 2")
    kept = F.when(F.col("_mixed"), ~F.col("_all")).otherwise(F.col(id_col) == F.col("_first"))
    return at.join(groups, "_key").withColumn("is_kept", kept).drop("_key", "_all", "_n", "_mixed", "_first")


def sign_hash(vector: Column) -> Column:
    """A perceptual hash of a vector: the signs of its components as a string of 0 and 1."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def library_passes(photos: DataFrame, files: DataFrame, root_marker: str, named: Column) -> DataFrame:
    """All passes over a library: normalised path, bytes, picture hash, and videos across albums.

    ``files`` has id, length, content and phash (null where there is none).
    Returns (id, kept_id, pass, reason) of discarded rows; each pass sees the
    rows that the ones before it left.
    """
    left = photos.where("discarded = 0").join(files, "id", "left")
    out = None

    def take(found: DataFrame, n: int) -> None:
        nonlocal left, out
        gone = found.where("not is_kept").select("id", "kept_id", F.lit(n).alias("pass"), "reason")
        out = gone if out is None else out.unionByName(gone)
        left = left.join(gone.select("id"), "id", "left_anti")

    take(discard_duplicates(left, text.norm_path(F.col("path"), root_marker), F.lit(text.REASONS["prefix"])), 0)
    stills = left.where(~text.is_video(F.col("path")))
    take(discard_duplicates(exact_file_key(stills), F.col("content_md5"), F.lit(text.REASONS["exact"])), 1)
    variant = F.col("path").rlike("_enhanced|_compare")
    take(discard_duplicates(left.where(text.is_photo(F.col("path"))), F.col("phash"), F.lit(text.REASONS["visual"]), skip=variant), 2)
    videos = left.where(text.is_video(F.col("path")))
    crossed = cross_album(videos, text.base_name(F.col("path")), ~named)
    by_name = crossed.withColumn("_name", text.base_name(F.col("path")))
    kept = by_name.where("is_kept").groupBy("_name").agg(F.min("id").alias("kept_id"))
    crossed = by_name.join(kept, "_name").withColumn("reason", F.concat(F.lit(text.REASONS["video"]), F.col("_name")))
    take(crossed, 3)
    return out
