"""Golden facts of column functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestream.functions import dates, geo, images, jsontext, scoring, text


def value(spark, column, **columns):
    at = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return at.select(column.alias("x")).first()["x"]


def test_haversine(spark):
    km = value(spark, geo.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(13.0827), F.lit(80.2707)))
    assert 285 < km < 295
    assert value(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))) is None
    assert value(spark, geo.from_dms(F.lit(51), F.lit(54), F.lit(22.32), F.lit("S"))) == pytest.approx(-51.9062)


@pytest.mark.parametrize(
    "energy, quality, loud, shot, weights, score",
    [
        ("high", "good", None, None, None, 3.0),
        ("high", "shaky", None, None, None, 1.5),
        ("medium", "good", -10.0, None, None, 3.0),
        ("high", "good", None, None, {"high": 4.0, "medium": 1.5, "low": 0.5}, 4.0),
        ("low", "good", None, None, {"high": 4.0, "medium": 1.5, "low": 0.5}, 0.5),
        ("medium", "good", None, "aerial shot", {}, 3.0),
        (None, "good", None, None, None, 2.0),
        ("low", "blurry, shaky", None, None, None, 0.0),
    ],
)
def test_chunk_score(spark, energy, quality, loud, shot, weights, score):
    profile = None
    if weights is not None:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]
        profile = F.struct(
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")).alias("energy_weights"), F.lit(None).cast("double").alias("quality_penalty"),
            F.lit(None).cast("double").alias("loudness_weight"), F.array(F.struct(F.lit("aerial").alias("key"), F.lit(1.0).alias("bonus"))).alias("shot_type_bonus"),
        )
    got = scoring.chunk_score(F.lit(energy).cast("string"), F.lit(quality), F.lit(loud).cast("double"), F.lit(shot).cast("string"), profile)
    assert value(spark, got) == score


def test_loudness_weight(spark):
    none = F.lit(None)
    profile = F.struct(none.cast("map<string,double>").alias("energy_weights"), none.cast("double").alias("quality_penalty"), F.lit(0.3).alias("loudness_weight"), none.cast("array<struct<key:string,bonus:double>>").alias("shot_type_bonus"))
    assert value(spark, scoring.chunk_score(F.lit("medium"), F.lit("good"), F.lit(-10.0), none.cast("string"), profile)) == 2.3


def test_small_rules(spark):
    assert value(spark, scoring.mean_volume(F.lit("x mean_volume: -23.5 dB"))) == -23.5
    assert value(spark, scoring.mean_volume(F.lit("nothing"))) is None
    assert [value(spark, scoring.keyframe_interval(F.lit(d))) for d in (0.5, 16.0, 40.0)] == [1.0, 2.0, 30.0]
    assert tuple(value(spark, scoring.sheet_grid(F.lit(7)))) == (3, 3)
    h = hashlib.md5(b"Harz").hexdigest()
    assert tuple(value(spark, scoring.name_colour(F.lit("Harz")))) == tuple(max(30, min(160, int(h[i : i + 2], 16))) for i in (0, 2, 4))
    assert value(spark, images.hamming(F.lit("ff00000000000000"), F.lit("fe00000000000001"))) == 2


def test_names(spark):
    assert value(spark, text.sanitize(F.lit("Harz – Hike 2031!"))) == "Harz-Hike-2031"
    assert value(spark, text.sanitize(F.lit("Überfahrt é"))) == "Überfahrt-é"
    assert value(spark, text.slug(F.lit("  Harz Hike! "))) == "harz-hike"
    assert value(spark, text.hex_sequence(F.lit(0), F.lit(10))) == "00000"
    assert value(spark, text.hex_sequence(F.lit(1), F.lit(1 << 24))) == "0000001"
    assert value(spark, text.organized_name(F.lit(1704067200), F.lit("00000"), F.lit("Harz Hike 2031"), F.lit("/a/x.JPG"))) == "20240101-00000-Harz-Hike-2031.jpg"
    assert value(spark, text.norm_path(F.lit("/a/lib/b/lib/c/d.jpg"), "lib")) == "c/d.jpg"
    for path, name in {"/t/Google Photos/Harz/a.jpg": "Harz", "/t/Google Photos/Photos from 2024/a.jpg": None, "/t/Google Photos/Trash/a.jpg": None, "/t/a.jpg": None, "/t/Google Photos/a.jpg": "a.jpg"}.items():
        assert value(spark, text.album(F.lit(path))) == name
    assert value(spark, text.suffix(F.lit("/a/b.tar.GZ"))) == ".gz"
    assert value(spark, text.stem(F.lit("/a/.hidden"))) == ".hidden"
    assert [value(spark, text.numbered_on_collision(F.lit("a.jpg"), F.lit(n))) for n in (1, 2, 3)] == ["a.jpg", "a_2.jpg", "a_3.jpg"]


def test_texts(spark):
    garbage = {"": True, "…": True, " a. ": True, "1234 5678 abc": True, "a clear sentence": False, "ʔ something": True}
    for t, want in garbage.items():
        assert value(spark, text.is_garbage(F.lit(t))) is want
    assert value(spark, text.is_garbage(F.lit(None).cast("string"))) is True
    assert tuple(value(spark, text.yes_no(F.lit("Yes - a receipt")))) == (True, "a receipt")
    assert tuple(value(spark, text.yes_no(F.lit("NO")))) == (False, "")
    assert value(spark, text.reply_text(F.lit("user\nq\nassistant\n hello "))) == "hello"
    assert value(spark, text.kept_name(F.lit("exact duplicate of /x/b.jpg"))) == "b.jpg"
    assert value(spark, text.auto_confirmed(F.lit("Burst shot of x"))) is True
    assert value(spark, F.lit("A Menu card").rlike(text.keyword_pattern())) is True
    assert value(spark, F.lit("menus").rlike(text.keyword_pattern())) is False
    chunk = F.struct(F.lit("runs").alias("action"), F.lit("").alias("shot"), F.lit("high").alias("energy"), F.lit(None).cast("string").alias("setting"), F.lit("good").alias("quality"), F.lit("d").alias("description"))
    assert value(spark, text.description(chunk)) == "action: runs\nenergy: high\nquality: good"


def test_dates(spark):
    def at(name):
        return value(spark, dates.filename_epoch(F.lit(name)))

    assert at("IMG_20240101_000000.jpg") == 1704067200
    assert at("20240101T000001.mp4") == 1704067201
    assert at("trip 2024-01-01.png") == 1704067200
    assert at("IMG_20241399_250000.jpg") is None
    assert at("IMG_20240101.jpg") is None
    assert value(spark, dates.exif_epoch(F.lit("2024:01:01 00:00:00"))) == 1704067200
    assert value(spark, dates.exif_epoch(F.lit("bad"))) is None
    assert value(spark, dates.iso_display(F.lit("2024-01-05T15:07:00Z"))) == "Jan 5, 3:07 PM"
    assert value(spark, dates.iso_display(F.lit("soon"))) == "soon"
    assert value(spark, dates.date_label(F.lit("2024-01-05T15:07:00"))) == "Jan 2024"
    assert value(spark, dates.date_label(F.lit("2024?01 x"))) == "2024?01"


def test_photo_json():
    good = json.dumps({"caption": " a ", "quality": "good", "scene": "", "people": None})
    assert jsontext.photo_fields(f"Sure:\n```json\n{good}\n```") == {"caption": "a", "quality": "good", "scene": None, "people": None}
    assert jsontext.photo_fields('{"caption": "a"}') == dict.fromkeys(jsontext.PHOTO_KEYS)
    assert jsontext.photo_fields(None) == dict.fromkeys(jsontext.PHOTO_KEYS)


def test_chunk_and_video_json(spark):
    assert jsontext.chunk_fields('x {"action": {"a": "b", "c": ["d", 1], "n": 2}, "shot": ["w", "x"]} y')["action"] == "b d 1"
    assert jsontext.chunk_fields("just text") == {"action": "just text", "shot": None, "energy": None, "setting": None, "quality": None}
    assert jsontext.video_fields("nothing") is None
    got = jsontext.video_fields('{"scenes": [{"caption": "x"}, 3, {"start_sec": "5", "score": null}]}', 30, 1)
    assert [(s["start_sec"], s["end_sec"], s["score"]) for s in got["scenes"]] == [(0.0, 30.0, 2.0), (5.0, 90.0, 2.0)]
    assert got["quality"] == "good" and got["people"] == "none"
    df = spark.createDataFrame([('{"caption": "c"}',), (None,)], "raw string")
    first, second = df.select(jsontext.parse_video(F.col("raw"), 30, 2).alias("v")).collect()
    assert len(first["v"]["scenes"]) == 2 and second["v"] is None


def test_sidecar(spark):
    raw = '{"photoTakenTime": {"timestamp": "1801234567"}, "geoData": {"latitude": 51.9062, "longitude": 10.4287}}'
    assert tuple(value(spark, jsontext.sidecar(F.lit(raw)))) == (1801234567, 51.9062, 10.4287)
    assert tuple(value(spark, jsontext.sidecar(F.lit('{"photoTakenTime": {"timestamp": "x"}, "geoData": {"latitude": 0.0, "longitude": 0.0}}')))) == (None, None, None)
