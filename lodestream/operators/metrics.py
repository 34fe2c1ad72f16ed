"""Rank-quality metrics and checklist statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, tie: str) -> DataFrame:
    """(keys, ap): mean over positives (label 1) of hits up to there over rank, best score first; 0 without positives."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    hit = F.coalesce((F.col(label) == 1).cast("int"), F.lit(0))
    at = df.withColumn("_hit", hit).withColumn("_rank", F.row_number().over(by)).withColumn("_hits", F.sum("_hit").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.sum(F.when(F.col("_hit") == 1, F.col("_hits") / F.col("_rank")))
    return at.groupBy(*keys).agg(F.round(F.coalesce(part / F.sum("_hit"), F.lit(0.0)), 6).alias("ap"))


def mean_average_precision(per_key: DataFrame) -> DataFrame:
    return per_key.agg(F.round(F.avg("ap"), 6).alias("map"))


def average_rank(x: Column, keys: list[str]) -> Column:
    by = Window.partitionBy(*keys).orderBy(x)
    same = F.count("*").over(Window.partitionBy(*keys, x))
    return F.rank().over(by) + (same - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho): correlation of average ranks; null for constant input."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = own.withColumn("_rx", average_rank(F.col(x), keys)).withColumn("_ry", average_rank(F.col(y), keys))
    return at.groupBy(*keys).agg(F.round(F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")), 6).alias("rho"))


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], by merging sorted runs of doubled length; n log(n)^2 work, no pair is formed."""
    rank, total, width = np.unique(y, return_inverse=True)[1].reshape(-1).astype(np.int64), 0, 1
    n, span = len(rank), len(rank) + 1
    place = np.arange(n)
    while width < n:
        block = place // (2 * width)
        key = block * span + rank  # runs of a block share its range of keys
        left = place % (2 * width) < width
        low = key[left]
        stop = np.cumsum(np.bincount(block[left], minlength=int(block[-1]) + 1))
        total += int((stop[block[~left]] - np.searchsorted(low, key[~left], side="right")).sum())
        rank = rank[np.argsort(key, kind="stable")]
        width *= 2
    return total


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b of two equally long columns; null if either is constant."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda n: int((n * (n - 1) // 2).sum())
    ties = lambda *v: np.diff(np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in v]), [True]])))
    every, tx, ty, both = pairs(np.array([len(x)])), pairs(ties(x)), pairs(ties(np.sort(y))), pairs(ties(x, y))
    if every in (tx, ty):
        return None
    return (every - tx - ty + both - 2 * inversions(y)) / math.sqrt((every - tx) * (every - ty))


def kendall(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, tau): tau-b; null for constant input. Rows with a null are left out.

    A key's two columns are sorted in one task: 16 bytes a row, n log n work.
    """
    from pyspark.sql import types as T

    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tau = tau_b(rows["_x"].to_numpy(), rows["_y"].to_numpy())
        return pd.DataFrame([[*key, None if tau is None else round(tau, 6)]], columns=[*keys, "tau"])

    return own.groupBy(*keys).applyInPandas(run, T.StructType([*(own.schema[k] for k in keys), T.StructField("tau", T.DoubleType())]))


def percent_true(df: DataFrame, questions: list[str]) -> DataFrame:
    """(question, percent): share of true answers per question, truncated; 0 without rows."""
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(q)).alias(q) for q in questions))
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("question"), F.col(q).alias("k")) for q in questions))).alias("e")
    return sums.select("n", each).select("e.question", F.when(F.col("n") > 0, F.floor(100 * F.col("e.k") / F.col("n"))).otherwise(0).cast("int").alias("percent"))


def total_true(questions: list[str]) -> Column:
    return sum((F.coalesce(F.col(q).cast("int"), F.lit(0)) for q in questions), F.lit(0))


def mean_totals(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """One row: n, mean_before, mean_after and delta of judged totals; null where there is nothing to compare."""
    one = lambda df, n: df.agg(F.count("*").alias(f"n_{n}"), F.round(F.avg("total"), 6).alias(f"mean_{n}")).withColumn("_one", F.lit(1))
    if after is None:
        return one(before, "before").select("n_before", "mean_before", F.lit(None).cast("double").alias("mean_after"), F.lit(None).cast("double").alias("delta"))
    both = one(before, "before").join(one(after, "after"), "_one")
    return both.select("n_before", "mean_before", "mean_after", F.round(F.col("mean_after") - F.col("mean_before"), 6).alias("delta"))


def before_after(before: DataFrame, after: DataFrame, index: str = "index") -> DataFrame:
    """Totals side by side by index; a missing after leaves nulls. Adds delta."""
    b = after.select(F.col(index), F.col("total").alias("total_after"))
    return before.select(index, F.col("total").alias("total_before")).join(b, index, "left").withColumn("delta", F.col("total_after") - F.col("total_before"))


def eta_seconds(done: DataFrame, todo: DataFrame, duration: str, longest: float, seconds: str, chunks: str) -> DataFrame:
    """One row: mean seconds a chunk so far times the chunks that the rest will have."""
    rate = done.agg((F.sum(seconds) / F.greatest(F.sum(chunks), F.lit(1))).alias("rate")).withColumn("_one", F.lit(1))
    rest = todo.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.rint(F.col(duration) / longest))), F.lit(0.0)).alias("rest")).withColumn("_one", F.lit(1))
    return rate.join(rest, "_one").select(F.round(F.col("rate") * F.col("rest"), 2).alias("eta"))
