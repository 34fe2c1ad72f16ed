"""Golden facts of operators over small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream import schemas
from lodestream.functions import text
from lodestream.operators import cluster, dedup, describe, dml, intervals, metrics, plans, report, search, select, sessionize

DAY = 86_400
T0 = 1_704_067_200


def test_bursts(spark):
    for times, want in {(1000, 1002, 1003): [3], (1000, 1001, 2000, 2002): [2, 2], (1000, 1003): [2], (1000, 1004): [], (None, None): []}.items():
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "k int, id int, t long")
        got = sessionize.bursts(df, ["k"], F.col("t"), 3, ["id"]).groupBy("burst_id").count().collect()
        assert sorted(r["count"] for r in got) == want


def test_scene_boundaries(spark):
    df = spark.createDataFrame([("v", 100, 60), ("v", 100, 61), ("w", 10, None)], "video string, last long, frame long")
    got = sorted(map(tuple, sessionize.boundaries_to_intervals(df, ["video"], "frame", "last").collect()))
    assert got == [("v", 0.0, 2.4), ("v", 2.44, 4.0)]


def trip_photos(spark):
    rows = [("u", i, f"/x/{i}.jpg", T0 + i * DAY, 12.9, 77.6, "Bengaluru, India") for i in range(5)]
    rows += [("u", 10 + i, f"/x/{10 + i}.jpg", T0 + (15 + i) * DAY, 51.9, 10.4, "Goslar, Germany") for i in range(5)]
    rows += [("u", 90, "/x/n.jpg", None, None, None, None), ("u", 91, "/t/Google Photos/Alps/a.jpg", T0, 46.0, 8.0, "Alps")]
    return spark.createDataFrame(rows, "u string, id long, path string, taken_at long, lat double, lon double, place string")


def test_trip_clusters(spark):
    got = {r["name"]: r for r in cluster.trip_clusters(trip_photos(spark), ["u"]).collect()}
    trips = [r for r in got.values() if r["is_trip"] and r["album"] is None]
    assert len(trips) == 1 and "Germany" in trips[0]["name"] and not trips[0]["confirmed"]
    assert got["Alps"]["is_trip"] and got["Alps"]["album"] == "Alps"
    assert got["2024-01"]["confirmed"] and not got["2024-01"]["is_trip"]
    assert got["no-date"]["confirmed"] and got["no-date"]["photo_ids"] == [90]
    assert sorted(r["cluster_id"] for r in got.values()) == [1, 2, 3, 4]


def test_split_places():
    lat, lon = np.array([12.9, 12.9, np.nan, 51.9, 51.9]), np.array([77.6, 77.6, np.nan, 10.4, 10.4])
    assert cluster.split_places(lat, lon, 50).tolist() == [0, 0, 0, 1, 1]
    assert cluster.split_places(lat[:3], lon[:3], 50).tolist() == [0, 0, 0]


def whole_rule(lat, lon, radius_km):
    """The rule of split_places with all pairs of every segment."""
    todo, cuts, points = [(0, len(lat))], np.zeros(len(lat), dtype=int), np.stack([lat, lon], axis=1)
    while todo:
        a, b = todo.pop()
        own = a + np.flatnonzero(~np.isnan(points[a:b]).any(axis=1))
        if len(own) > 1 and cluster._km(points[own, None], points[None, own]).max() > radius_km:
            at = int(own[1:][np.argmax(np.round(cluster._km(points[own[:-1]], points[own[1:]]), 6))])
            cuts[at] = 1
            todo += [(a, at), (at, b)]
    return np.cumsum(cuts)


def test_split_places_of_groups():
    rng = np.random.default_rng(5)
    for few in (0, 30, 128):
        for points in (np.round(rng.normal(0, 0.1, (240, 2)), 2), np.cumsum(rng.normal(0, 0.02, (240, 2)), axis=0), np.stack([rng.integers(0, 5, 240) * 0.05, rng.integers(0, 3, 240) * 0.03], axis=1)):
            lat, lon, starts = points[:, 0] + 40, points[:, 1] + 10, [0, 3, 90, 91, 200]
            lat[rng.random(240) < 0.1] = np.nan
            got = cluster.split_places(lat, lon, 10.0, starts, few)
            for a, b in zip(starts, [*starts[1:], 240], strict=True):
                assert (got[a:b] - got[a] == whole_rule(lat[a:b], lon[a:b], 10.0)).all()


def test_split_places_work_grows_with_rows(monkeypatch):
    pairs, km = [], cluster._km
    monkeypatch.setattr(cluster, "_km", lambda a, b: pairs.append(km(a, b)) or pairs[-1])
    work = []
    for n in (500, 4000):
        rng, pairs[:] = np.random.default_rng(5), []
        cluster.split_places(37 + rng.integers(0, 5, n) * 0.05, -122 + rng.integers(0, 3, n) * 0.03, 10.0)
        work.append((sum(np.size(x) for x in pairs), len(pairs)))
    assert work[1][0] <= 10 * work[0][0] and work[1][1] <= 2 * work[0][1]


def test_trip_clusters_in_small_batches(spark):
    rows = [(f"u{i % 3}", i, "/x/a.jpg", T0 + i * DAY // 4 + i // 40 * 5 * DAY, 12.9 + i % 4 * 0.3, 77.6, "x") for i in range(160)]
    photos = spark.createDataFrame(rows, "u string, id long, path string, taken_at long, lat double, lon double, place string")
    want = sorted(map(str, cluster.trip_clusters(photos, ["u"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, cluster.trip_clusters(photos, ["u"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_home(spark):
    df = spark.createDataFrame([(i, T0 + i, 12.9, 77.6) for i in range(3)] + [(9, T0 + 9, 51.9, 10.4)], "id long, taken_at long, lat double, lon double")
    assert tuple(cluster.home_cell(df).first()) == (13.0, 77.5)


def test_library_passes(spark):
    photos = spark.createDataFrame(
        [(1, "/r/lib/a.jpg", 0, None), (2, "/r/old/lib/a.jpg", 0, 5), (3, "/r/lib/b.jpg", 0, None), (4, "/r/lib/c.jpg", 0, None), (5, "/r/lib/c_enhanced.jpg", 0, None), (6, "/r/lib/T/v.mp4", 0, None), (7, "/r/lib/2024/v.mp4", 0, None), (8, "/r/lib/d.jpg", 0, None)],
        "id long, path string, discarded int, described_at long",
    )
    files = spark.createDataFrame([(1, 3, b"abc", "f1"), (2, 3, b"abc", "f1"), (3, 4, b"wxyz", "f2"), (8, 4, b"wxyz", "f2"), (4, 5, b"12345", "f3"), (5, 6, b"123456", "f3"), (6, 9, b"v1", None), (7, 8, b"v2", None)], "id long, length long, content binary, phash string")
    named = F.col("path").contains("/T/")
    got = {r["id"]: tuple(r) for r in dedup.library_passes(photos, files, "lib", named).collect()}
    assert got == {1: (1, 2, 0, "path-prefix duplicate of a.jpg"), 8: (8, 3, 1, "exact duplicate of b.jpg"), 7: (7, 6, 3, "video duplicate of v.mp4")}


def test_intervals(spark):
    chunks = spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 1, 5.0, 40.0), ("v", 2, 50.0, 51.0)], "video string, id int, start double, end double")
    speech = spark.createDataFrame([("v", 0, 1.0, 5.0, "one"), ("v", 1, 4.0, 6.0, "two"), ("v", 2, 39.0, 41.0, "three")], "video string, pos int, s_start double, s_end double, text string")
    got = {r["id"]: r["texts"] for r in intervals.overlap_texts(chunks, speech, ["video"], "id", width=3.0).collect()}
    assert got == {0: ["one", "two"], 1: ["two", "three"], 2: []}
    points = spark.createDataFrame([("v", 1, 4.9, 40.5), ("v", 2, 41.2, 40.5), ("v", 3, 20.0, None)], "video string, point_id int, t double, dur double")
    moved = {r["point_id"]: r["snapped"] for r in intervals.snap(points, speech, ["video"], "t", 0.3, "dur", width=7.0).collect()}
    assert moved == {1: 5.3, 2: 40.5, 3: 20.0}
    pieces = intervals.split_long(spark.createDataFrame([(0.0, 25.0), (3.0, 13.0)], "a double, b double"), "a", "b", 10.0).orderBy("a", "piece").collect()
    assert [(r["piece_start"], r["piece_end"]) for r in pieces] == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0), (3.0, 13.0)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 2, 0.8, 0), ("a", 3, 0.7, 1), ("b", 1, 0.5, -1)], "k string, i int, s double, y int")
    ap = {r["k"]: r["ap"] for r in metrics.average_precision(df, ["k"], "s", "y", "i").collect()}
    assert ap["a"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6) and ap["b"] == 0.0
    same = spark.createDataFrame([("a", i, i, i * i) for i in range(6)] + [("c", i, 1, i) for i in range(4)], "k string, i int, x int, y int")
    assert {r["k"]: r["tau"] for r in metrics.kendall(same, ["k"], "x", "y").collect()} == {"a": 1.0, "c": None}
    assert {r["k"]: r["rho"] for r in metrics.spearman(same, ["k"], "x", "y").collect()} == {"a": 1.0, "c": None}
    empty = spark.createDataFrame([], "q boolean")
    assert metrics.percent_true(empty, ["q"]).first()["percent"] == 0


DOCS = [(1, "mountain lake at dawn", "outdoors", "Harz"), (2, "city street lights", "urban", "mountain town"), (3, "a lake and a lake", "outdoors", ""), (4, "dogs run", "beach", None)]


@pytest.mark.parametrize(
    "query, ids",
    [("lake", {1, 3}), ("lake mountain", {1}), ("lake OR dogs", {1, 3, 4}), ("lake NOT mountain", {3}), ('"mountain lake"', {1}), ('"lake mountain"', set()), ("mount*", {1, 2}), ("place:mountain", {2}), ("(dogs OR city) AND lights", {2}), ("NEAR(mountain dawn, 2)", {1}), ("NEAR(mountain dawn, 1)", set()), ("mountains", set())],
)
def test_search(spark, query, ids):
    docs = spark.createDataFrame(DOCS, "id long, caption string, scene string, place string")
    assert {r["doc_id"] for r in search.search(docs, query, "id", ["caption", "scene", "place"]).collect()} == ids


@pytest.mark.parametrize("query", ["", "AND", "(lake", '"', "lake)", "nocolumn:x", "lake AND"])
def test_bad_search(query):
    with pytest.raises(search.QueryError):
        search.parse(query, ["caption"])


def test_flagging(spark):
    rows = [(1, "blurry", 0, 0), (2, "good", 0, 0), (3, None, 0, 0), (4, "dark", 1, 0), (5, "dark", 0, 1)]
    df = spark.createDataFrame(rows, "id long, quality string, discarded int, flagged int")
    once = dml.flag_quality(df)
    assert {r["id"] for r in once.where("flagged = 1").collect()} == {1, 5}
    assert dml.flag_quality(once).exceptAll(once).count() == 0


def test_dml(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id long, v string")
    assert sorted(map(tuple, dml.insert_or_ignore(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    patch = spark.createDataFrame([(2, None)], "id long, v string")
    assert sorted(map(tuple, dml.update(old, patch, "id").collect())) == [(1, "a"), (2, None)]
    seq = spark.createDataFrame([(1, T0, 4), (2, None, None), (3, T0 - 1, None), (4, T0 + DAY, None)], "id long, t long, s long")
    assert {r["id"]: r["s"] for r in dml.assign_sequence(seq, "s", "t", "id").collect()} == {1: 4, 3: 5, 4: 6, 2: 7}
    legacy = spark.createDataFrame([(1, "p")], "id long, path string")
    assert schemas.migrate(legacy).first()["discarded"] == 0 and set(schemas.migrate(legacy).columns) == set(schemas.struct(schemas.PHOTOS).names)


def test_review_and_dates(spark):
    clusters = spark.createDataFrame([(i, f"n{i}", True, False, "2024-01-05") for i in range(4)], "id long, name string, is_trip boolean, confirmed boolean, start string")
    acts = spark.createDataFrame([(0, "confirm", None), (1, "rename", "Alps"), (2, "discard", None)], "id long, action string, name string")
    got = {r["id"]: (r["name"], r["is_trip"], r["confirmed"]) for r in dml.apply_review(clusters, acts).collect()}
    assert got == {0: ("n0", True, True), 1: ("Alps", True, True), 2: ("2024-01", False, True), 3: ("n3", True, False)}
    photos = spark.createDataFrame([(i, T0, 1.0, 2.0, 0) for i in range(4)] + [(9, T0 + 5 * DAY, None, None, 0)], "id long, taken_at long, lat double, lon double, discarded int")
    fresh = spark.createDataFrame([(0, T0 - DAY, None, None), (9, T0, 5.0, 6.0)], "id long, new_taken_at long, new_lat double, new_lon double")
    got = {r["id"]: (r["taken_at"], r["lat"]) for r in dml.fix_dates(photos, fresh, 3).collect()}
    assert got[0] == (T0 - DAY, 1.0) and got[9] == (T0 + 5 * DAY, None) and got[1] == (T0, 1.0)


def test_plans(spark):
    photos = spark.createDataFrame([(1, "/a/x.jpg", T0, 1, 0, None), (2, "/b/x.jpg", T0, 1, 0, 0), (3, "/b/y.jpg", T0, 2, 0, None), (4, "/b/z.jpg", T0, 1, 1, None)], "id long, path string, taken_at long, cluster_id long, discarded int, organized_seq long")
    clusters = spark.createDataFrame([(1, "Harz Hike 2031", True), (2, "2024-01", False)], "id long, name string, confirmed boolean")
    got = {r["id"]: (r["folder"], r["name"]) for r in plans.organize_plan(photos, clusters, F.lit("/out")).collect()}
    assert got == {2: ("/out/Harz-Hike-2031", "20240101-00000-Harz-Hike-2031.jpg"), 1: ("/out/Harz-Hike-2031", "20240101-00001-Harz-Hike-2031.jpg")}
    asked = spark.createDataFrame([(1,), (2,), (4,), (77,)], "id long")
    flagged = {r["id"]: (r["outcome"], r["dest"]) for r in plans.flag_plan(asked, photos, clusters.select("id", "name"), F.lit("/f")).collect()}
    assert flagged == {1: ("done", "/f/Harz-Hike-2031/x.jpg"), 2: ("done", "/f/Harz-Hike-2031/x_2.jpg"), 4: ("skipped", None), 77: ("not_found", None)}


def test_edit_list(spark):
    chunks = spark.createDataFrame([("a", 0, 0.0, 5.0, 60.0), ("a", 1, 10.0, 15.0, 60.0), ("b", 2, 0.0, 4.0, 60.0)], "source_video string, index long, start double, end double, duration double")
    speech = spark.createDataFrame([("a", 0, 4.0, 5.5)], "source_video string, pos int, s_start double, s_end double")
    chosen = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "pos long, index long")
    got = [tuple(r) for r in plans.edit_list(chunks, speech, chosen).orderBy("pos").collect()]
    assert got == [(0, "b", 0, 0.0, 4.0), (1, "a", 1, 0.0, 5.8), (2, "a", 1, 10.0, 15.0)]
    assert plans.filter_graph(plans.edit_list(chunks, speech, chosen)).first()["graph"].endswith("concat=n=3:v=1:a=1[v][a]")


def test_selection(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "id long, v string")
    assert [r["v"] for r in select.ordered_lookup(F.array(F.lit(3), F.lit(1)), df, "id").collect()] == ["r3", "r1"]
    with pytest.raises(Exception, match="not found"):
        select.ordered_lookup(F.array(F.lit(3), F.lit(9)), df, "id").collect()
    with pytest.raises(Exception, match="out of range"):
        select.check_bounds(df, "id", F.lit(3)).collect()
    names = spark.createDataFrame([(1, "Harz"), (2, "Harz North")], "id long, name string")
    assert select.find_cluster(names, "harz").first()["id"] == 1
    assert select.find_cluster(names, "north").first()["id"] == 2
    with pytest.raises(Exception, match="clusters match"):
        select.find_cluster(names, "har").collect()


def test_describe(spark):
    photos = schemas.migrate(spark.createDataFrame([(1, "/a/x.jpg"), (2, "/a/y.jpg")], "id long, path string")).withColumn("described_at", F.when(F.col("id") == 2, F.lit(7).cast("bigint")))
    got = {r["id"]: (r["caption"], r["described_at"]) for r in describe.describe_photos(photos, now=9).collect()}
    assert got == {1: ("picture x.jpg", 9), 2: (None, 7)}

    def broken(row):
        raise RuntimeError("no model")

    assert {r["raw"] for r in describe.ask(photos.select("id"), broken).collect()} == {None}
    scenes = spark.createDataFrame([(1, 0.0, 12.0), (2, None, None)], "photo_id long, start double, end double")
    rows, summary = describe.describe_videos(scenes)
    assert rows.count() == 2
    assert {r["photo_id"]: r["caption"] for r in summary.collect()} == {1: "clip 0", 2: "(no scenes detected)"}
    _, none = describe.describe_videos(scenes, broken)
    assert {r["photo_id"]: r["caption"] for r in none.collect()} == {1: None, 2: "(no scenes detected)"}
    suspects = spark.createDataFrame([(1, "/a.jpg", "a receipt on paper", 0), (2, "/b.jpg", "a lake", 0)], "id long, path string, caption string, discarded int")
    assert [tuple(r) for r in describe.junk(suspects, lambda r: "YES - paper", text.keyword_pattern(), text.is_photo(F.col("path"))).collect()] == [(1, "auto-junk")]
    both = describe.compare_describers(photos.select("id", "path"), describe.stub_describer, broken).orderBy("id").collect()
    assert [(r["caption_a"], r["caption_b"]) for r in both] == [("picture x.jpg", None), ("picture y.jpg", None)]


def test_reports(spark, tmp_path):
    photos = spark.createDataFrame([(1, "/a/x.jpg", 1, None), (2, "/b/x.jpg", 1, "exact duplicate of y.jpg"), (3, "/c/y.jpg", 0, None)], "id long, path string, discarded int, discard_reason string")
    report.write_manifest(report.discard_manifest(photos), str(tmp_path / "m"))
    got = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert sorted(map(tuple, got.collect())) == [("x.jpg", "exact duplicate of y.jpg"), ("x.jpg", "unknown")]
    pair = report.discarded_pairs(photos).collect()
    assert [(r["id"], r["kept_id"], r["auto"]) for r in pair] == [(2, 3, True)]
    listing = spark.createDataFrame([("/a/x.jpg",)], "path string")
    plan = {r["id"]: (r["dest"], r["missing"]) for r in report.discard_plan(photos, listing, F.lit("/d")).collect()}
    assert plan == {1: ("/d/x.jpg", False), 2: ("/d/x_1.jpg", True)}
