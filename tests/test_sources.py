"""Scans, documents and streams over small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lodestream.sources import documents, media
from lodestream.streaming import sessions


def jpeg_with_exif(date, lat, lon):
    """A minimal JPEG with an EXIF block: date, and degrees as rationals."""

    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    body = bytearray(b"II*\0" + struct.pack("<I", 8))
    text = date.encode() + b"\0"
    main_size, gps_size = 2 + 2 * 12 + 4, 2 + 4 * 12 + 4
    gps_at = 8 + main_size
    data_at = gps_at + gps_size
    date_at, lat_at, lon_at = data_at, data_at + 24, data_at + 48
    body += struct.pack("<H", 2) + entry(306, 2, len(text), struct.pack("<I", date_at)) + entry(34853, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    refs = (b"N" if lat >= 0 else b"S", b"E" if lon >= 0 else b"W")
    body += struct.pack("<H", 4) + entry(1, 2, 2, refs[0] + b"\0\0\0") + entry(2, 5, 3, struct.pack("<I", lat_at)) + entry(3, 2, 2, refs[1] + b"\0\0\0") + entry(4, 5, 3, struct.pack("<I", lon_at)) + b"\0" * 4
    body += text.ljust(24, b"\0")
    for x in (abs(lat), abs(lon)):
        body += struct.pack("<6I", int(x), 1, 0, 1, round((x - int(x)) * 3600 * 1000), 1000)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + bytes(body) + b"\xff\xd9"


def test_scan(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.mp4", "d.txt", "sub/e.heic"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = media.scan(spark, str(tmp_path))
    assert got.columns == ["path", "modificationTime", "length"]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.jpg", "b.JPG", "c.mp4", "e.heic"]


def test_metadata(spark, tmp_path):
    side = {"photoTakenTime": {"timestamp": "1801234567"}, "geoData": {"latitude": 51.9062, "longitude": 10.4287}}
    (tmp_path / "one.jpg").write_bytes(b"x")
    (tmp_path / "one.jpg.supplemental-metadata.json").write_text("{broken")
    (tmp_path / "one.jpg.json").write_text(json.dumps(side))
    (tmp_path / "two.jpg").write_bytes(b"x")
    (tmp_path / "two.json").write_text(json.dumps(side | {"geoData": {"latitude": 0.0, "longitude": 0.0}}))
    (tmp_path / "IMG_20240101_000000.jpg").write_bytes(b"x")
    (tmp_path / "exif.jpg").write_bytes(jpeg_with_exif("2024:01:01 00:00:01", -33.5, 151.25))
    files = media.with_sidecar(media.scan(spark, str(tmp_path), content=True), media.sidecars(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: (r["taken_at"], r["lat"], r["lon"]) for r in media.metadata(files).collect()}
    assert got["one.jpg"] == (1801234567, 51.9062, 10.4287)
    assert got["two.jpg"] == (1801234567, None, None)
    assert got["IMG_20240101_000000.jpg"][0] == 1704067200
    assert got["exif.jpg"] == (1704067201, pytest.approx(-33.5), pytest.approx(151.25))
    assert media.exif_of(b"\xff\xd8 Exif\0\0II") == (None, None, None) and media.exif_of(None) == (None, None, None)


def test_library_scan(spark, tmp_path):
    (tmp_path / "IMG_20240101_000000.jpg").write_bytes(b"x")
    (tmp_path / "IMG_20240102_000000.jpg").write_bytes(b"x")
    from lodestream import schemas

    have = spark.createDataFrame([(5, media.scan(spark, str(tmp_path)).orderBy("path").first()["path"], 1)], "id long, path string, taken_at long")
    out = media.library_scan(spark, str(tmp_path), schemas.migrate(have), with_exif=False)
    rows = out.orderBy("path").collect()
    assert [r["taken_at"] for r in rows] == [1, 1704153600] and rows[0]["id"] == 5 and rows[1]["id"] > 5 and rows[1]["discarded"] == 0


def test_probe_and_places(spark):
    raw = json.dumps({"format": {"duration": "12.5", "tags": {"creation_time": "2024-01-01", "com.apple.quicktime.creationdate": ""}}})
    df = spark.createDataFrame([(raw,)], "raw string")
    assert tuple(df.select(media.probe(F.col("raw")).alias("p")).first()["p"]) == (12.5, "2024-01-01")
    where = spark.createDataFrame([(51.91, 10.4), (1.0, 1.0)], "lat double, lon double")
    gaz = spark.createDataFrame([(519, 104, "Goslar, Germany")], "cell_lat long, cell_lon long, place string")
    assert {r["lat"]: r["place"] for r in media.with_place(where, gaz).collect()} == {51.91: "Goslar, Germany", 1.0: None}
    listed = spark.createDataFrame([("/b.MOV", None), ("/a.Mp4", None), ("/c.mp4", "2024")], "video string, shot_at string")
    named = spark.createDataFrame([("/c.mp4", "2024")], "video string, shot_at string")
    assert [r["video"] for r in media.video_listing(named, listed).collect()] == ["/c.mp4", "/b.MOV"]


def test_documents(spark, tmp_path):
    doc = {"video": "v1", "shot_at": None, "duration": 9.0, "chunks": [{"start": 0.0, "end": 4.0, "energy": "high"}, {"start": 4.0, "end": 9.0, "index": 7}], "speech": [{"start": 1.0, "end": 2.0, "text": "hi", "words": []}]}
    (tmp_path / "v1_chunks.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "all_chunks.json").write_text("{}")
    got = documents.videos(spark, str(tmp_path / "*_chunks.json"))
    assert [(r["pos"], r["index"]) for r in documents.chunk_rows(got).orderBy("pos").collect()] == [(0, 0), (1, 7)]
    assert documents.speech_rows(got).first()["text"] == "hi"
    (tmp_path / "l.txt").write_text("1\n0\n\n-1\n x \n")
    assert [r["label"] for r in documents.labels(spark, str(tmp_path / "l.txt")).orderBy("seg").collect()] == [1, 0, -1, None]


def test_stream_closes_sessions(spark):
    folder = "/root/testdata/sf0.001"
    closed = sessions.closed_sessions(spark, f"{folder}/events.parquet", "1 hour", "1 hour")
    batch = spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n_events"))
    every = batch.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")
    assert closed.exceptAll(every).count() == 0
    assert 0 < every.exceptAll(closed).count() < 20


def test_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, "old")], "id long, v string").write.parquet(str(tmp_path / "t0"))

    def write(df, number):
        df.write.parquet(str(tmp_path / f"t{number + 1}"))

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = sessions.upsert(stream, lambda: spark.read.parquet(str(tmp_path / "t0")), write, "id").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t1")).collect())) == [(1, "a"), (2, "old")]
