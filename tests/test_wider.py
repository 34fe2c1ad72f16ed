"""Searching as users meet it, numbering, pictures, writers, flags, judges and small operators."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream import schemas
from lodestream.functions import images, text
from lodestream.operators import cluster, dedup, describe, dml, evaluate, intervals, metrics, plans, report, search, select
from lodestream.sources import documents, media
from lodestream.streaming import sessions


def library(spark):
    rows = [(1, "Café in Zürich", 1, 5, None), (2, "a cafe by the sea", 0, 5, "Łódź"), (3, "CAFÉ, closed", 0, None, None), (4, "no coffee", 0, 5, "café street"), (5, "smörgås café and café", 0, 7, "")]
    return schemas.migrate(spark.createDataFrame(rows, "id long, caption string, discarded int, described_at long, place string").withColumn("path", F.concat(F.lit("/p/"), F.col("id"), F.lit(".jpg"))))


def test_search_photos(spark, tmp_path):
    """Marks of letters don't count; what is discarded or not described isn't found; a stored index gives the same."""
    photos = library(spark)
    hits = search.search_photos(photos, "cafe").collect()
    assert {r["id"] for r in hits} == {2, 4, 5} and hits[0].asDict().keys() == {"id", "path", "scene", "place", "caption", "cluster_id", "score"}
    assert {r["id"] for r in search.search_photos(photos, "smorgas OR straße").collect()} == {5}
    assert {r["id"] for r in search.search_photos(photos, "CAFÉ NOT place:cafe").collect()} == {2, 5}
    search.write_index(search.photo_index(photos), str(tmp_path / "index"))
    stored = search.search_photos(photos, '"cafe and caf"*', index=search.read_index(spark, str(tmp_path / "index")))
    assert [r["id"] for r in stored.collect()] == [5]
    assert search.search_photos(photos.limit(0), "cafe").count() == 0


def bm25(docs, words):
    counts = [[d.count(w) for w in words] for d in docs]
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for d, f in zip(docs, counts):
        idf = [max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 0) or 1e-6 for n in (sum(c[i] > 0 for c in counts) for i in range(len(words)))]
        out.append(-sum(w * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w, x in zip(idf, f)) if all(f) else None)
    return out


def test_scores(spark):
    rng = random.Random(4)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(d[: len(d) // 2]), " ".join(d[len(d) // 2 :])) for i, d in enumerate(docs)], "id long, x string, y string")
    want = {i: s for i, s in enumerate(bm25(docs, ["a", "b"])) if s is not None}
    got = {r["doc_id"]: r["score"] for r in search.search(df, "a b", "id", ["x", "y"], None).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    best = search.search(df, "a b", "id", ["x", "y"], 5).collect()
    assert [r["doc_id"] for r in best] == sorted(want, key=lambda i: (want[i], i))[:5]


def test_kendall():
    rng = np.random.default_rng(3)
    for n, values in ((2, 2), (7, 3), (50, 5), (257, 40), (300, 1000)):
        x, y = rng.integers(0, values, n), rng.integers(0, values, n)
        assert metrics.inversions(y) == sum(int((y[:i] > y[i]).sum()) for i in range(n))
        sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        norm = math.sqrt(float((sx != 0).sum()) * float((sy != 0).sum()))
        want = None if not norm else float((sx * sy).sum()) / norm
        assert metrics.tau_b(x.astype(float), y.astype(float)) == (None if want is None else pytest.approx(want))
    assert metrics.tau_b(np.array([1.0]), np.array([1.0])) is None


def test_farthest():
    rng = np.random.default_rng(5)
    for n in (2, 3, 40, 700):
        p = np.stack([rng.uniform(-85, 85, n), rng.uniform(-180, 180, n)], axis=1)
        for scale in (1.0, 0.001):
            q = p * scale
            want = cluster._km(q[:, None, :], q[None, :, :]).max()
            assert cluster.farthest_km(q, leaf=4) == pytest.approx(want, abs=1e-9)
            assert cluster.farthest_km(q, want / 2) > want / 2
    assert cluster.farthest_km(np.array([[1.0, 2.0]] * 5)) == 0.0


def test_numbering(spark, monkeypatch):
    """A day, a second and missing dates with many rows are split in ranges of ids, and the order stays."""
    monkeypatch.setattr(dml, "ID_RANGE", 7)
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 100, 100, 86_400 * 3 + 5, 86_400 * 3 + rng.randrange(50)]), 3 if i == 50 else None) for i in rng.sample(range(1000), 300)]
    rows.append((5000, 1, 3))
    df = spark.createDataFrame(rows, "id long, t long, s long").repartition(4)
    got = {r["id"]: r["s"] for r in dml.assign_sequence(df, "s", "t", "id").collect()}
    todo = sorted((r for r in rows if r[2] is None), key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {**{r[0]: 4 + k for k, r in enumerate(todo)}, **{r[0]: 3 for r in rows if r[2] is not None}}
    names = spark.createDataFrame([(n,) for n in ("b/2", "a/9", "a/10", "c")], "path string")
    assert [tuple(r) for r in dml.numbered(names, "n", F.lit(0), None, "path").orderBy("n").collect()] == [("a/10", 1), ("a/9", 2), ("b/2", 3), ("c", 4)]


def png(pixels, kind=0, level=9):
    """A PNG file of (height, width[, channels]) bytes with one filter for all lines."""
    height, width = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    x = pixels.reshape(height, -1).astype(int)
    left = np.pad(x, ((0, 0), (channels, 0)))[:, : x.shape[1]]
    up = np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    guess = left + up - corner
    near = np.where((abs(guess - left) <= abs(guess - up)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - up) <= abs(guess - corner), up, corner))
    lines = (x - [0, left, up, (left + up) // 2, near][kind]) % 256
    raw = b"".join(bytes([kind]) + bytes(line.astype(np.uint8)) for line in lines)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def picture(seed, height=60, width=80):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    waves = sum(rng.uniform(10, 40) * np.cos(rng.uniform(0, 0.3) * x + rng.uniform(0, 0.3) * y + rng.uniform(0, 6)) for _ in range(5))
    return np.clip(128 + waves, 0, 255).astype(np.uint8)


def test_picture_hash(spark):
    grey = picture(1)
    same = {images.picture_hash(png(grey, kind, level)) for kind in range(5) for level in (1, 9)} | {images.picture_hash(b"P5 80 60 255\n" + grey.tobytes())}
    assert len(same) == 1 and len(next(iter(same))) == 16
    colour = np.repeat(grey[:, :, None], 3, axis=2)
    assert images.picture_hash(png(colour, 4)) == next(iter(same)) == images.picture_hash(b"P6 80 60 255\n" + colour.tobytes())
    assert (images.grey(png(colour[..., [0, 1, 2]], 3)).round() == grey).all()
    twice = np.kron(grey, np.ones((2, 2), np.uint8))
    other = images.picture_hash(png(picture(2)))
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert bits(images.picture_hash(png(twice)), next(iter(same))) <= 2 < bits(other, next(iter(same)))
    for bad in (None, b"", b"no picture", png(grey)[:60], b"P5 80"):
        assert images.picture_hash(bad) is None
    df = spark.createDataFrame([(1, bytearray(png(grey))), (2, bytearray(png(colour, 2))), (3, None), (4, bytearray(b"x"))], "id long, content binary")
    got = {r["id"]: r["h"] for r in df.select("id", images.phash(F.col("content")).alias("h")).collect()}
    assert got[1] == got[2] == next(iter(same)) and got[3] is got[4] is None


def test_passes_from_pictures(spark):
    """The third pass end to end: pictures with other bytes and the same look are duplicates, unless one is a variant."""
    files = spark.createDataFrame([(i, len(p), bytearray(p)) for i, p in enumerate([png(picture(1)), png(picture(1), 2), png(picture(2)), png(picture(3)), png(picture(3), 1)])], "id long, length long, content binary")
    files = files.withColumn("phash", images.phash(F.col("content")))
    photos = spark.createDataFrame([(i, f"/r/lib/{n}", 0, None) for i, n in enumerate(["a.png", "b.png", "c.png", "d.png", "d_enhanced.png"])], "id long, path string, discarded int, described_at long")
    got = [tuple(r) for r in dedup.library_passes(photos, files, "lib", F.lit(False)).collect()]
    assert got == [(1, 0, 2, "visually identical to a.png")]


def test_sign_hash_groups(spark):
    """Whole vectors are compared: an equal beginning isn't enough, and a protected row leaves its group alone."""
    rows = [(1, [1.0, -1.0] * 32, 0), (2, [2.0, -3.0] * 32, 0), (3, [1.0, -1.0] * 31 + [-1.0, 1.0], 0), (4, [-1.0] * 64, 0), (5, [-2.0] * 64, 9)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label int").withColumn("h", dedup.sign_hash(F.col("v"))).withColumn("path", F.col("id").cast("string"))
    got = dedup.discard_duplicates(v, F.col("h"), described=None, skip=F.col("label") == 9)
    assert sorted((r["id"], r["kept_id"], r["is_kept"]) for r in got.collect()) == [(1, 1, True), (2, 1, False)]


def test_writers(spark, tmp_path):
    doc = spark.createDataFrame([("v1", None, 9.5, [(0.0, "é")])], "video string, shot_at string, duration double, chunks array<struct<start: double, text: string>>")
    documents.write_documents(doc, str(tmp_path / "d"), "video")
    raw = next((tmp_path / "d" / "_video=v1").glob("part-*")).read_text()
    assert json.loads(raw) == {"video": "v1", "shot_at": None, "duration": 9.5, "chunks": [{"start": 0.0, "text": "é"}]}
    assert raw.isascii() and '\n  "shot_at"' in raw
    trips = spark.createDataFrame([(2, "Zürich"), (1, None), (3, "x")], "id long, name string").repartition(3)
    documents.write_list(trips, str(tmp_path / "c"), "id")
    raw = next((tmp_path / "c").glob("part-*")).read_text()
    assert json.loads(raw) == [{"id": 1, "name": None}, {"id": 2, "name": "Zürich"}, {"id": 3, "name": "x"}] and "Zürich" in raw
    documents.write_list(trips.limit(0), str(tmp_path / "e"), "id")
    assert json.loads(next((tmp_path / "e").glob("part-*")).read_text()) == []


def test_unflag(spark):
    photos = spark.createDataFrame([(1, "/a/x.jpg", 1, 0, 1), (2, "/b/y.jpg", None, 0, 1), (3, "/c/z.jpg", 1, 1, 1)], "id long, path string, cluster_id long, discarded int, flagged int")
    names = spark.createDataFrame([(1, "Harz Hike")], "id long, name string")
    listing = spark.createDataFrame([("/f/Harz-Hike/x.jpg",), ("/f/Other/x.jpg",), ("/f/Harz-Hike/x_2.jpg",)], "path string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    plan = plans.unflag_plan(asked, photos, names, listing, F.lit("/f"))
    assert {r["id"]: (r["outcome"], r["path"]) for r in plan.collect()} == {1: ("done", "/f/Harz-Hike/x.jpg"), 2: ("done", None), 3: ("skipped", None), 9: ("not_found", None)}
    assert {r["id"]: r["flagged"] for r in plans.set_flags(photos, plan, 0).collect()} == {1: 0, 2: 0, 3: 1}


def test_clusters(spark):
    trips = spark.createDataFrame([(1, True, False, 5), (2, False, True, 7), (3, True, None, 1)], "id long, is_trip boolean, confirmed boolean, photo_count long")
    assert tuple(cluster.cluster_counts(trips).first()) == (3, 2, 1, 13)
    assert {r["confirmed"] for r in dml.confirm_all(trips).collect()} == {True}
    assert tuple(cluster.cluster_counts(trips.limit(0)).first()) == (0, 0, 0, 0)


def test_judge_in_batches(spark):
    asked = spark.createDataFrame([(i, "action: x" if i % 2 else "quality: good") for i in range(40)], "index long, desc_formatted string").coalesce(1)
    one, many = describe.judge(asked), describe.judge_batches(asked)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))

    def tired(texts):
        if len(texts) < describe.BATCH:
            raise RuntimeError("no more")
        return [{"concise": True}] * (len(texts) if "action" not in texts[0] else 1)

    assert sorted(r["total"] for r in describe.judge_batches(asked, tired).collect()) == [0] * 25 + [1] * 15


def test_transcripts(spark):
    def hear(path):
        if "broken" in path:
            raise OSError(path)
        return [{"start": 0.004, "end": 1.239, "text": " hello ", "words": [{"word": " hello", "start": 0.0, "end": 1.1111}]}, {"start": 2, "end": 3, "text": "  "}, {"start": 3, "end": 4, "text": "x"}]

    got = describe.transcribe(spark.createDataFrame([("a.mp4",), ("broken.mp4",)], "video string"), hear).orderBy("pos").collect()
    assert [(r["video"], r["pos"], r["s_start"], r["s_end"], r["text"], len(r["words"])) for r in got] == [("a.mp4", 0, 0.0, 1.24, "hello", 1), ("a.mp4", 1, 3.0, 4.0, "x", 0)]


def test_scans_leave_videos_alone(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.mp4", "d.heic"):
        (tmp_path / name).write_bytes(b"x" * 10)
    files = media.scan(spark, str(tmp_path), content=True).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["content"] is not None for r in files} == {"a.JPG": True, "b.png": True, "c.mp4": False, "d.heic": False}
    have = schemas.migrate(spark.createDataFrame([], "id long, path string"))
    once, again = ([tuple(r) for r in media.library_scan(spark, str(tmp_path), have).select("id", "path").orderBy("id").collect()] for _ in range(2))
    assert once == again and [i for i, _ in once] == [1, 2, 3, 4] and [p for _, p in once] == sorted(p for _, p in once)


def test_totals_and_rankings(spark):
    before = spark.createDataFrame([(0, 3), (1, 4)], "index long, total long")
    after = spark.createDataFrame([(0, 5)], "index long, total long")
    assert tuple(metrics.mean_totals(before, after).first()) == (2, 3.5, 5.0, 1.5)
    assert tuple(metrics.mean_totals(before).first()) == (2, 3.5, None, None)
    assert metrics.mean_totals(before.limit(0), after).first()["delta"] is None
    scored = spark.createDataFrame([(2, 1.0), (0, 1.0), (1, None), (3, 4.0)], "index long, score double")
    assert [r["index"] for r in evaluate.ranked(scored).collect()] == [3, 0, 2, 1]
    dated = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, taken_at long")
    assert [r["id"] for r in select.by_time_or_zero(dated).collect()] == [3, 2, 1]
    ap = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "k string, ap double")
    assert metrics.mean_average_precision(ap).first()["map"] == 0.75
    done, todo = spark.createDataFrame([(10.0, 4), (20.0, 6)], "s double, n long"), spark.createDataFrame([(25.0,), (3.0,)], "d double")
    assert metrics.eta_seconds(done, todo, "d", 10.0, "s", "n").first()["eta"] == 9.0


def test_small_joins(spark):
    left = spark.createDataFrame([(1, "k"), (2, "k"), (3, "z")], "id long, k string")
    right = spark.createDataFrame([("k", 5, "b"), ("k", 4, "a")], "k string, pos long, v string")
    assert sorted((r["id"], r["v"]) for r in intervals.first_matches(left, right, ["k"], "id", "pos").collect()) == [(1, "a"), (2, "a")]
    names = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "k string, name string, pos long")
    assert {r["id"]: r["name"] for r in select.with_default_name(left, names, "k", F.lit("none")).collect()} == {1: "new", 2: "new", 3: "none"}
    assert select.page_count(left, 2).first()["pages"] == 2 and select.page_count(left.limit(0), 2).first()["pages"] == 0
    assert {r["k"]: r["side"] for r in select.sides(left, spark.createDataFrame([("z",), ("y",), (None,)], "k string"), "k").collect()} == {"k": "a", "z": "both", "y": "b"}
    assert left.where(text.contains_ignoring_case(F.col("k"), "K")).count() == 2 and left.where(text.contains_ignoring_case(F.col("k"), "%")).count() == 0
    assert spark.range(1).select(text.reason("exact", F.lit("a.jpg")).alias("r")).first()["r"] == "exact duplicate of a.jpg"
    assert [r["id"] for r in dml.pending(left, right.select(F.lit(1).alias("id")), "id").orderBy("id").collect()] == [2, 3] and dml.pending(left, left, "id", force=True).count() == 3


def test_small_plans(spark):
    docs = spark.createDataFrame([("v", 1, ["a"]), ("v", 2, ["b"]), ("w", 1, [])], "video string, n long, speech array<string>")
    assert plans.speech_map(docs, "n").first()["speech"] == {"v": ["b"], "w": []}
    assert {r["video"]: r["speech"] for r in plans.speech_by_video(docs, "n").collect()} == {"v": ["b"], "w": []}
    listing = spark.createDataFrame([("/o/T/1.jpg",), ("/o/T/9.jpg",)], "path string")
    plan = spark.createDataFrame([(7, "1.jpg")], "id long, name string")
    assert [tuple(r) for r in plans.match_organized(plan, listing).collect()] == [(7, "/o/T/1.jpg")]
    moves = plans.staged_moves(listing, F.lit("Trip"), F.lit("/final")).collect()
    assert [r["dest"] for r in moves] == ["/final/Trip/1.jpg", "/final/Trip/9.jpg"]


def test_small_reports(spark):
    photos = spark.createDataFrame([(1, "/a/x.jpg", 1, "a lake", 1704067200, 1.5, None, 0.5), (2, "/a/y.jpg", 0, None, None, None, None, 0.1)], "id long, path string, flagged int, caption string, taken_at long, lat double, lon double, score double")
    assert tuple(report.flag_counts(photos).first()) == (2, 1)
    cars = {r["sidecar_path"]: json.loads(r["json"]) for r in report.takeout_sidecars(photos, spark.createDataFrame([("/a/y.jpg.json",)], "sidecar_path string")).collect()}
    assert cars.keys() == {"/a/x.jpg.json"} and cars["/a/x.jpg.json"]["title"] == "x.jpg" and cars["/a/x.jpg.json"]["photoTakenTime"]["timestamp"] == "1704067200"
    lines = report.search_report(photos.withColumnRenamed("id", "doc_id")).orderBy("pos").collect()
    assert [r["pos"] for r in lines] == [1, 2] and "y.jpg" in lines[0]["line"]
    rows = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, None), ("g", 4, "a")], "f string, i long, s string")
    assert [r["is_header"] for r in report.source_headers(rows, ["i"], "s", ["f"]).orderBy("i").collect()] == [True, False, True, True]


def test_run_available(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).where("id > 1")
    assert [r["id"] for r in sessions.run_available(stream, "some_rows", str(tmp_path / "state")).collect()] == [2]


def test_frame_scores(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    with h5py.File(tmp_path / "f.h5", "w") as f:
        f["name"], f["score"] = np.array([[118], [49]], dtype="u2"), np.array([[0.5, 1.0]])
        g = f.create_group("tvsum50")
        g["video"], g["gt_score"] = np.array([f["name"].ref], dtype=h5py.ref_dtype), np.array([f["score"].ref], dtype=h5py.ref_dtype)
    spark.dataSource.register(documents.FrameScores)
    assert tuple(spark.read.format("frame_scores").load(path=str(tmp_path / "f.h5")).first()) == ("v1", [0.5, 1.0])


def test_recommendation_lines(spark, monkeypatch):
    monkeypatch.setattr(dml, "ID_RANGE", 8)
    rows = [(i, f"/p/{i}.jpg", None if i % 7 == 0 else 30 * (i * 37 % 50), (0, 1, 1, 1, 2, None)[i % 6], "good", None, None, "long " * 40, i % 2) for i in range(120)]
    photos = spark.createDataFrame(rows, "id long, path string, taken_at long, cluster_id long, quality string, scene string, people string, caption string, flagged int")
    got = report.recommendation_lines(photos, spark.createDataFrame([(1, "Alps"), (3, "Goslar")], "id long, name string"))
    want = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2], r[0])):
        lines = want.setdefault({0: "unclustered", None: "unclustered", 1: "Alps"}.get(r[3], "cluster-2"), [])
        lines.append(f"| {r[0]} | {r[0]}.jpg | good |  |  | {r[7][:80]} | {'yes' if r[8] else ''} |")
    assert sorted(map(tuple, got.collect())) == sorted((c, i, line) for c, lines in want.items() for i, line in enumerate(lines, 1))
    assert got.schema["pos"].dataType.simpleString() == "int"


def test_recommendation_lines_leave_captions_behind(spark):
    photos = spark.range(40).selectExpr("id", "'/p/x' AS path", "id AS taken_at", "id % 2 AS cluster_id", "'' AS quality", "'' AS scene", "'' AS people", "repeat(string(id), 999) AS caption", "0 AS flagged").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = report.recommendation_lines(photos, spark.createDataFrame([(1, "Alps")], "id long, name string"))
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [b for b in plan.split("\n\n") if " Exchange" in b.split("Input")[0] and "RoundRobin" not in b]
    assert moved and not any("caption#" in b for b in moved)
