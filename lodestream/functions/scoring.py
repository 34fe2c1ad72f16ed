"""Rule-based scores of described chunks, and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default profile.
ENERGY = {"high": 3.0, "medium": 2.0, "low": 1.0}
QUALITY_PENALTY, LOUDNESS_WEIGHT = -1.5, 1.0


def chunk_score(energy: Column, quality: Column, loudness_db: Column, shot: Column, profile: Column | None = None) -> Column:
    """Energy weight, plus a (negative) penalty unless the quality is good, plus loudness and the first fitting shot bonus.

    ``profile`` is a struct (energy_weights map, quality_penalty,
    loudness_weight, shot_type_bonus array of (key, bonus)); nulls in it take
    the defaults. The result is at least 0 and has two places.
    """

    def weight(level: str) -> Column:
        own = F.lit(None).cast("double") if profile is None else F.try_element_at(profile["energy_weights"], F.lit(level))
        return F.coalesce(own, F.lit(ENERGY[level]))

    def setting(name: str, default: float) -> Column:
        return F.lit(default) if profile is None else F.coalesce(profile[name], F.lit(default))

    text = F.lower(F.coalesce(energy, F.lit("")))
    base = (weight("high") + weight("low")) / 2
    for level in ("low", "medium", "high"):
        base = F.when(text.contains(level), weight(level)).otherwise(base)
    good = F.lower(F.coalesce(F.nullif(quality, F.lit("")), F.lit("good"))) == "good"
    base = base + F.when(good, F.lit(0.0)).otherwise(setting("quality_penalty", QUALITY_PENALTY))
    loud = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (loudness_db + 60) / 50)) * setting("loudness_weight", LOUDNESS_WEIGHT)
    base = base + F.coalesce(loud, F.lit(0.0))
    if profile is not None:
        fits = F.filter(profile["shot_type_bonus"], lambda b: F.instr(F.lower(F.coalesce(shot, F.lit(""))), F.lower(b["key"])) > 0)
        base = base + F.coalesce(F.get(fits, F.lit(0))["bonus"], F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), base), 2)


def stored_or_computed(score: Column, computed: Column) -> Column:
    return F.coalesce(score, computed)


def mean_volume(log: Column) -> Column:
    """The mean volume in a prober's log, in dB. The pattern is a fixed value: it has to match the log."""
    return F.nullif(F.regexp_extract(log, r"mean_volume:\s*([-\d.]+)\s*dB", 1), F.lit("")).try_cast("double")


def keyframe_interval(duration: Column, interval: float = 30.0) -> Column:
    """1 under a second; the interval if it fits; else an eighth of the duration, at least 1."""
    return F.when(duration < 1, F.lit(1.0)).when(duration >= interval, F.lit(float(interval))).otherwise(F.greatest(F.lit(1.0), F.floor(duration / 8).cast("double")))


def sheet_grid(n: Column) -> Column:
    """(cols, rows) of a contact sheet of n pictures."""
    cols = F.ceil(F.sqrt(n)).cast("int")
    return F.struct(cols.alias("cols"), F.ceil(n / F.greatest(cols, F.lit(1))).cast("int").alias("rows"))


def name_colour(name: Column) -> Column:
    """(r, g, b) from the first bytes of a name's MD5, each within 30 and 160."""
    part = lambda i: F.greatest(F.lit(30), F.least(F.lit(160), F.conv(F.substring(F.md5(name.cast("binary")), 1 + 2 * i, 2), 16, 10).cast("int")))
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def score_band(score: Column, high: float = 2.5, mid: float = 1.5) -> Column:
    return F.when(score >= high, "high").when(score >= mid, "mid").otherwise("low")
