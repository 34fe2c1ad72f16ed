"""Evaluation of chunk scores against ground truth, and before/after benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from . import describe, intervals, metrics


def scored_chunks(chunks: DataFrame, profile=None) -> DataFrame:
    """Chunks with the stored score, or the computed one where none is stored."""
    own = scoring.chunk_score(F.col("energy"), F.col("quality"), F.col("loudness_db"), F.col("shot"), profile)
    return chunks.withColumn("score", scoring.stored_or_computed(F.col("score"), own))


def ranked(scored: DataFrame, score: str = "score", index: str = "index") -> DataFrame:
    """All chunks, the best first; equal scores stay in order of index."""
    return scored.orderBy(F.col(score).desc_nulls_last(), index)


def rank_agreement(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """(video, tau, rho) of chunk scores and mean frame scores; videos in both tables count.

    ``chunks`` has video, index, start, end, score, duration; ``frames`` has
    video, gt_score. Chunks past the frames' end have no mean and fall out.
    """
    at = chunks.join(frames, "video").withColumn("truth", intervals.frame_mean(F.col("gt_score"), F.col("start"), F.col("end"), F.col("duration")))
    at = at.select("video", "index", "score", "truth")
    return metrics.kendall(at, ["video"], "score", "truth").join(metrics.spearman(at, ["video"], "score", "truth"), "video", "full")


def macro_average(per_video: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means over videos; nulls don't count."""
    return per_video.agg(F.count("*").alias("n_videos"), *(F.round(F.avg(c), 6).alias(c) for c in columns))


def highlight_precision(chunks: DataFrame, labels: DataFrame, cell: float = 5.0) -> DataFrame:
    """(video, ap) of the best chunk score per cell against labels (video, seg, label); label 1 is positive."""
    grid = labels.groupBy("video").agg((F.max("seg") + 1).alias("n_segs"))
    best = intervals.grid_max(chunks, grid, ["video"], "start", "end", "score", cell)
    return metrics.average_precision(labels.join(best, ["video", "seg"]), ["video"], "score", "label", "seg")


def attach_scores(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """Judged scores with their chunk's thumb and times; a missing chunk leaves '' and 0."""
    at = scores.join(chunks.select("index", "thumb", "start", "end"), "index", "left")
    return at.withColumn("thumb", F.coalesce("thumb", F.lit(""))).withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("end", F.coalesce("end", F.lit(0.0)))


def benchmark(before: DataFrame, after: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows side by side, percent of true answers per question and run) of judged tables."""
    percents = metrics.percent_true(before, list(describe.QUESTIONS)).withColumn("run", F.lit("before"))
    if after is None:
        return before.select("index", F.col("total").alias("total_before")), percents
    more = metrics.percent_true(after, list(describe.QUESTIONS)).withColumn("run", F.lit("after"))
    return metrics.before_after(before, after), percents.unionByName(more)


def total_band(total) -> object:
    """Colour band of a total of seven: from 6 high, from 4 mid, else low."""
    return F.when(total >= 6, "high").when(total >= 4, "mid").otherwise("low")
