"""Schemas (DDL) of the media library, video documents and their parts; additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PHOTOS = (
    "id BIGINT, path STRING, taken_at BIGINT, lat DOUBLE, lon DOUBLE, place STRING, cluster_id BIGINT, discarded INT, caption STRING, quality STRING, "
    "scene STRING, people STRING, described_at BIGINT, flagged INT, discard_reason STRING, organized_seq BIGINT"
)
SCENES = ("id BIGINT, photo_id BIGINT, start_sec DOUBLE, end_sec DOUBLE, caption STRING, score DOUBLE, created_at BIGINT")
CLUSTERS = ("id BIGINT, name STRING, album STRING, is_trip BOOLEAN, confirmed BOOLEAN, photo_count BIGINT, photo_ids ARRAY<BIGINT>, start STRING, end STRING, place STRING")
SPEECH = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, words: ARRAY<STRUCT<word: STRING, start: DOUBLE, end: DOUBLE>>>>"
CHUNK = (
    "STRUCT<start: DOUBLE, end: DOUBLE, thumb: STRING, action: STRING, shot: STRING, energy: STRING, setting: STRING, quality: STRING, "
    "description: STRING, source_video: STRING, index: BIGINT, loudness_db: DOUBLE, score: DOUBLE>"
)
VIDEO = (f"video STRING, shot_at STRING, duration DOUBLE, chunks ARRAY<{CHUNK}>, speech {SPEECH}")
PROFILE = ("scoring STRUCT<energy_weights: MAP<STRING, DOUBLE>, quality_penalty: DOUBLE, loudness_weight: DOUBLE, shot_type_bonus: ARRAY<STRUCT<key: STRING, bonus: DOUBLE>>>")

#: What a missing column of an older table is filled with; else null.
DEFAULTS = {"discarded": 0, "flagged": 0}


def struct(ddl: str) -> T.StructType:
    """The schema of a DDL text; needs a session."""
    return T.StructType.fromDDL(ddl)


def migrate(df: DataFrame, schema: str = PHOTOS, defaults: dict = DEFAULTS) -> DataFrame:
    """Add the schema's columns that a table lacks, with their defaults; others stay."""
    missing = [f for f in struct(schema).fields if f.name not in df.columns]
    return df.select("*", *(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in missing))
