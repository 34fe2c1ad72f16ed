"""Describers and judges: models behind an interface, run per partition.

A describer takes a list of rows (dicts) and returns a list of equal length of
raw replies (text, or None for a failure). Real models load once per Python
worker in ``load``; the stubs here are deterministic and need none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, scoring
from . import intervals

Describer = Callable[[dict], str | None]

# The seven questions of the checklist.
QUESTIONS = ("action_clear", "energy_clear", "setting_clear", "shot_clear", "quality_ok", "selection_ready", "concise")


def stub_describer(row: dict) -> str:
    """A photo's reply made of its path."""
    name = str(row.get("path") or row.get("id"))
    return json.dumps({"caption": f"picture {name.rsplit('/', 1)[-1]}", "quality": "good", "scene": "other", "people": "none"})


def stub_chunk_describer(row: dict) -> str:
    return json.dumps({"action": f"clip {row.get('index')}", "shot": "wide", "energy": ("low", "medium", "high")[int(row.get("index") or 0) % 3], "setting": "outdoors", "quality": "good"})


def stub_judge(text: str) -> dict[str, bool]:
    """Answers from a description's form alone."""
    t = text or ""
    return {"action_clear": "action:" in t, "energy_clear": "energy:" in t, "setting_clear": "setting:" in t, "shot_clear": "shot:" in t, "quality_ok": "quality: good" in t, "selection_ready": t.count("\n") >= 3, "concise": len(t) <= 200}


def ask(rows: DataFrame, describer: Describer, load: Callable[[], Describer] | None = None, workers: int = 5, attempts: int = 1, valid: Callable[[str], bool] | None = None, out: str = "raw") -> DataFrame:
    """Adds a model's raw reply to each row; calls run in ``workers`` threads per task, and the order stays.

    A call that fails, or whose reply isn't valid after ``attempts`` tries (the
    bad reply's first 300 characters go back as ``previous``), gives null.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def one(call: Describer, row: dict) -> str | None:
        for _ in range(attempts):
            try:
                reply = call(row)
            except MemoryError:
                raise
            except Exception:  # a model's failure is a null by contract
                return None
            if reply is not None and (valid is None or valid(reply)):
                return reply
            row = row | {"previous": (reply or "")[:300]}
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load() if load else describer
        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                yield f.assign(**{out: list(pool.map(lambda r: one(call, r), f.to_dict("records")))})

    return rows.mapInPandas(run, schema)


def describe_photos(photos: DataFrame, describer: Describer = stub_describer, force: bool = False, now: int = 0) -> DataFrame:
    """Photos that weren't described get caption, quality, scene, people and described_at; unreadable replies leave nulls."""
    todo = photos if force else photos.where("described_at is null")
    got = ask(todo, describer, attempts=3, valid=lambda r: jsontext.photo_fields(r)["quality"] is not None)
    got = got.withColumn("_d", jsontext.parse_photo(F.col("raw")))
    new = {k: F.col(f"_d.{k}") for k in jsontext.PHOTO_KEYS} | {"described_at": F.lit(now).cast("bigint")}
    done = got.select(*(new[c].alias(c) if c in new else F.col(c) for c in photos.columns))
    return done if force else photos.where("described_at is not null").unionByName(done)


def describe_chunks(chunks: DataFrame, describer: Describer = stub_chunk_describer) -> DataFrame:
    """Adds the five fields, and the action as description, too."""
    got = ask(chunks.drop(*jsontext.CHUNK_KEYS, "description"), describer)
    got = got.withColumn("_d", jsontext.parse_chunk(F.col("raw")))
    return got.select(*[c for c in got.columns if c not in ("raw", "_d")], *(F.col(f"_d.{k}").alias(k) for k in jsontext.CHUNK_KEYS), F.col("_d.action").alias("description"))


def describe_videos(scenes: DataFrame, describer: Describer = stub_chunk_describer, longest: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(scenes, summaries) of videos' scene intervals (photo_id, start, end): pieces are described and scored.

    Failed pieces fall out; a video's caption is its first piece's that has one,
    and "(no scenes detected)" only for videos without intervals.
    """
    pieces = intervals.split_long(scenes.where("start is not null"), "start", "end", longest)
    pieces = pieces.select("photo_id", F.col("piece_start").alias("start_sec"), F.col("piece_end").alias("end_sec"), F.floor(F.col("piece_start")).cast("bigint").alias("index"))
    got = ask(pieces, describer).where("raw is not null").withColumn("_d", jsontext.parse_chunk(F.col("raw")))
    none = F.lit(None)
    score = scoring.chunk_score(F.col("_d.energy"), F.col("_d.quality"), none.cast("double"), F.col("_d.shot"))
    rows = got.select("photo_id", "start_sec", "end_sec", F.nullif(F.col("_d.action"), F.lit("")).alias("caption"), score.alias("score"))
    first = rows.where("caption is not null").groupBy("photo_id").agg(F.min_by("caption", "start_sec").alias("caption"))
    known = scenes.groupBy("photo_id").agg(F.count("start").alias("_n"))
    summary = known.join(first, "photo_id", "left").select("photo_id", F.when(F.col("_n") == 0, "(no scenes detected)").otherwise(F.col("caption")).alias("caption"))
    return rows, summary


def junk(photos: DataFrame, classifier: Describer, pattern: str, is_still) -> DataFrame:
    """(id, discard_reason) of photos whose caption fits the pattern and that the classifier calls junk."""
    from ..functions import text

    suspects = photos.where((F.col("discarded") == 0) & F.col("caption").rlike(pattern) & is_still)
    got = ask(suspects, classifier).withColumn("_y", text.yes_no(F.col("raw")))
    return got.where("_y.yes").select("id", F.lit("auto-junk").alias("discard_reason"))


#: A batch's texts to its answers, one dictionary each.
BatchJudge = Callable[[list[str]], list[dict]]

#: Chunks of one judge's call.
BATCH = 15


def stub_batch_judge(texts: list[str]) -> list[dict]:
    return [stub_judge(t) for t in texts]


def judge_batches(chunks: DataFrame, judge_: BatchJudge = stub_batch_judge, text_col: str = "desc_formatted", size: int = BATCH, load: Callable[[], BatchJudge] | None = None) -> DataFrame:
    """Adds the seven answers and their total, asking about up to ``size`` chunks of a partition at a time.

    A batch that fails, or gives another number of answers, counts as false
    throughout; answers that aren't there are false.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, *(T.StructField(q, T.BooleanType()) for q in QUESTIONS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load() if load else judge_
        for f in frames:
            said: list[dict] = []
            for at in range(0, len(f), size):
                texts = f[text_col].iloc[at : at + size].tolist()
                try:
                    got = call(texts)
                except Exception:  # a model's failure is a missing answer by contract
                    got = []
                said += got if len(got) == len(texts) else [{}] * len(texts)
            yield f.assign(**{q: [bool(a.get(q, False)) for a in said] for q in QUESTIONS})

    at = chunks.mapInPandas(run, schema)
    return at.withColumn("total", sum((F.col(q).cast("bigint") for q in QUESTIONS), F.lit(0).cast("bigint")))


def transcribe(videos: DataFrame, transcriber: Callable[[str], list[dict]], load: Callable[[], Callable[[str], list[dict]]] | None = None) -> DataFrame:
    """(video, pos, s_start, s_end, text, words) of a speech model's segments; one that fails has none.

    The model takes a path and returns segments (start, end, text, words of
    word, start, end). Times have two places, texts are trimmed, and segments
    without text fall out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load() if load else transcriber
        for f in frames:
            rows = []
            for video in f["video"]:
                try:
                    found = call(video) or []
                except Exception:  # a model's failure is no speech by contract
                    found = []
                found = [s for s in found if str(s.get("text") or "").strip()]
                for pos, s in enumerate(found):
                    words = [{"word": str(w["word"]).strip(), "start": round(float(w["start"]), 2), "end": round(float(w["end"]), 2)} for w in s.get("words") or []]
                    rows.append((video, pos, round(float(s["start"]), 2), round(float(s["end"]), 2), str(s["text"]).strip(), words))
            yield pd.DataFrame(rows, columns=["video", "pos", "s_start", "s_end", "text", "words"])

    return videos.select("video").mapInPandas(run, "video string, pos int, s_start double, s_end double, text string, words array<struct<word: string, start: double, end: double>>")


def judge(chunks: DataFrame, judge_: Callable[[str], dict[str, bool]] = stub_judge, text_col: str = "desc_formatted") -> DataFrame:
    """Adds the seven answers and their total; missing answers are false."""

    @F.pandas_udf(", ".join(f"{q} boolean" for q in QUESTIONS))
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{q: bool(a.get(q, False)) for q in QUESTIONS} for a in map(judge_, x)], columns=list(QUESTIONS))

    at = chunks.withColumn("_j", run(F.col(text_col)))
    at = at.select(*chunks.columns, *(F.col(f"_j.{q}").alias(q) for q in QUESTIONS))
    return at.withColumn("total", sum((F.col(q).cast("bigint") for q in QUESTIONS), F.lit(0).cast("bigint")))


def compare_describers(photos: DataFrame, first: Describer, second: Describer) -> DataFrame:
    """Both describers' captions side by side; nothing is written."""
    a = ask(photos, first, out="raw_a")
    b = ask(a, second, out="raw_b")
    return b.select("id", jsontext.parse_photo(F.col("raw_a"))["caption"].alias("caption_a"), jsontext.parse_photo(F.col("raw_b"))["caption"].alias("caption_b"))
