"""Joins of intervals and points, by cells and a residual condition.

A condition on ranges alone would compare all pairs. Where an equal key doesn't
bound the rows, each interval is put in the cells of a grid that it touches, the
join is on key and cell, and a pair is taken in one cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:  # noqa: E741
    """Pairs of equal keys whose intervals overlap strictly (touching ends don't). Column names must differ but for the keys.

    ``width`` is the cell's; about the length of a usual interval.
    """
    a = left.withColumn("_cell", _cells(F.col(l[0]), F.col(l[1]), width))
    b = right.withColumn("_cell", _cells(F.col(r[0]), F.col(r[1]), width))
    both = a.join(b, [*keys, "_cell"]).where((F.col(r[1]) > F.col(l[0])) & (F.col(r[0]) < F.col(l[1])))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)
    return both.where(F.col("_cell") == first).drop("_cell")


def overlap_texts(chunks: DataFrame, speech: DataFrame, keys: list[str], chunk_id: str, pos: str = "pos", text: str = "text", width: float = 10.0) -> DataFrame:
    """Each chunk of (keys, id, start, end) with the texts (array, in order) of the speech of (keys, pos, s_start, s_end, text) that overlaps it."""
    hits = overlap_join(chunks.select(*keys, chunk_id, "start", "end"), speech, keys, ("start", "end"), ("s_start", "s_end"), width)
    told = hits.groupBy(*keys, chunk_id).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]).alias("texts"))
    return chunks.join(told, [*keys, chunk_id], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def snap(points: DataFrame, speech: DataFrame, keys: list[str], point: str, margin: float = 0.3, duration: str | None = None, width: float = 60.0, point_id: str = "point_id") -> DataFrame:
    """Move each point out of the first segment (by pos) whose padded span holds it, to its nearer padded edge.

    ``speech`` has keys, pos, s_start, s_end. Ties go to the start; results are
    kept within 0 and ``duration`` (unbounded if null) and have two places; a
    point in no segment stays.
    """
    seg = speech.withColumn("_cell", _cells(F.col("s_start") - margin, F.col("s_end") + margin, width))
    at = points.withColumn("_cell", F.floor(F.col(point) / width))
    hit = at.join(seg, [*keys, "_cell"]).where(F.col(point).between(F.col("s_start") - margin, F.col("s_end") + margin))
    best = hit.groupBy(*keys, point_id).agg(F.min_by(F.struct("s_start", "s_end"), F.col("pos")).alias("_s"))
    low, high = F.col("_s.s_start") - margin, F.col("_s.s_end") + margin
    edge = F.when(F.col(point) - low <= high - F.col(point), low).otherwise(high)
    top = F.greatest(F.lit(0.0), F.least(edge, F.coalesce(F.col(duration), F.lit(float("inf"))) if duration else edge))
    return points.join(best, [*keys, point_id], "left").withColumn("snapped", F.when(F.col("_s").isNull(), F.col(point)).otherwise(F.round(top, 2))).drop("_s")


def split_long(df: DataFrame, start: str, end: str, longest: float) -> DataFrame:
    """Pieces of at most ``longest`` from the start on, two places; the last is shorter. Adds piece, piece_start, piece_end."""
    n = F.greatest(F.lit(1), F.ceil(F.round((F.col(end) - F.col(start)) / longest, 9)).cast("int"))
    at = df.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    a = F.round(F.col(start) + F.col("piece") * longest, 2)
    b = F.round(F.least(F.col(end), F.col(start) + (F.col("piece") + 1) * longest), 2)
    whole = F.col(end) - F.col(start) <= longest
    return at.withColumn("piece_start", F.when(whole, F.col(start)).otherwise(a)).withColumn("piece_end", F.when(whole, F.col(end)).otherwise(b))


def frame_mean(frames: Column, start: Column, end: Column, duration: Column) -> Column:
    """Mean of the frames of a chunk; frames spread evenly over the duration. Null if the chunk is past the end."""
    n = F.size(frames)
    fps = n / duration
    a = F.greatest(F.lit(0), F.floor(start * fps).cast("int"))
    b = F.greatest(a + 1, F.least(F.floor(end * fps).cast("int"), n))
    part = F.slice(frames, a + 1, b - a)
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part))


def grid_max(chunks: DataFrame, grid: DataFrame, keys: list[str], start: str, end: str, score: str, cell: float = 5.0) -> DataFrame:
    """(keys, seg, score): per cell of ``grid`` (keys, n_segs) the best score of the chunks that touch it, else 0."""
    first = F.greatest(F.lit(0), F.floor(F.col(start) / cell).cast("int"))
    last = F.ceil(F.col(end) / cell).cast("int") - 1
    hit = chunks.where(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("seg"), score).groupBy(*keys, "seg").agg(F.max(score).alias("score"))
    every = grid.where("n_segs > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_segs").cast("int") - 1)).alias("seg"))
    return every.join(hit, [*keys, "seg"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def first_matches(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, order: str) -> DataFrame:
    """The first right row by ``order`` of each left row of equal keys."""
    joined = left.join(right, keys)
    return joined.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, left_id).orderBy(order))).where("_r = 1").drop("_r")
