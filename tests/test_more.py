"""Evaluation, pages and guards."""

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import describe, evaluate, pages, plans


def chunks(spark):
    rows = [("v", i, 10.0 * i, 10.0 * i + 10, float(s), 40.0) for i, s in enumerate((1, 3, 2, 4))]
    return spark.createDataFrame(rows, "video string, index long, start double, end double, score double, duration double")


def test_evaluation(spark):
    frames = spark.createDataFrame([("v", [0.1] * 10 + [0.5] * 10 + [0.3] * 10 + [0.9] * 10), ("w", [1.0])], "video string, gt_score array<double>")
    got = evaluate.rank_agreement(chunks(spark), frames)
    assert [tuple(r) for r in got.collect()] == [("v", 1.0, 1.0)]
    assert tuple(evaluate.macro_average(got, ["tau", "rho"]).first()) == (1, 1.0, 1.0)
    labels = spark.createDataFrame([("v", i, 1 if i >= 6 else -1) for i in range(8)], "video string, seg long, label int")
    assert evaluate.highlight_precision(chunks(spark), labels).first()["ap"] == 1.0
    more = chunks(spark).select("video", "index", F.lit("high").alias("energy"), F.lit("good").alias("quality"), F.lit(None).cast("double").alias("loudness_db"), F.lit("x").alias("shot"), F.when(F.col("index") == 0, 0.5).alias("score"))
    assert [r["score"] for r in evaluate.scored_chunks(more).orderBy("index").collect()] == [0.5, 3.0, 3.0, 3.0]


def test_benchmark(spark):
    base = spark.createDataFrame([(0, "action: x\nenergy: y\nquality: good\nshot: z"), (1, "nothing")], "index long, desc_formatted string")
    judged = describe.judge(base)
    side, percents = evaluate.benchmark(judged, judged.where("index = 0"))
    assert [tuple(r) for r in side.orderBy("index").collect()] == [(0, 6, 6, 0), (1, 1, None, None)]
    assert percents.where("question = 'concise' and run = 'before'").first()["percent"] == 100
    attached = evaluate.attach_scores(judged, chunks(spark).withColumn("thumb", F.lit("t.jpg")).where("index = 0"))
    assert [(r["thumb"], r["end"]) for r in attached.orderBy("index").collect()] == [("t.jpg", 10.0), ("", 0.0)]
    assert "6 / 7" in pages.score_rows(judged).where("index = 0").first()["html"]


def test_pages(spark, tmp_path):
    rows = chunks(spark).select("index", F.when(F.col("index") < 2, "/a/one.mp4").otherwise("/a/two.mp4").alias("source_video"), F.lit("t.jpg").alias("thumb"), "start", "end", F.lit("a <b>").alias("description"), "score", F.array(F.lit("hi"), F.lit("you")).alias("texts"))
    html = [r["html"] for r in pages.thumb_rows(rows).orderBy("index").collect()]
    assert [h.startswith("<h2>") for h in html] == [True, False, True, False] and "a &lt;b&gt;" in html[0] and "hi / you" in html[0]
    pages.write_page(pages.thumb_rows(rows), str(tmp_path / "p"), "t")
    assert spark.read.text(str(tmp_path / "p")).count() == 6


def test_guards(spark):
    old = spark.createDataFrame([(1, True, True, [1, 2])], "id long, is_trip boolean, confirmed boolean, photo_ids array<long>")
    fresh = old.withColumn("confirmed", F.lit(False))
    with pytest.raises(Exception, match="confirmed trips"):
        plans.recluster(old, fresh).collect()
    assert plans.recluster(old, fresh, force=True).count() == plans.recluster(fresh, fresh).count() == 1
    photos = spark.createDataFrame([(1, 9), (3, 9)], "id long, cluster_id long")
    assert {r["id"]: r["cluster_id"] for r in plans.assign_clusters(photos, old).collect()} == {1: 1, 3: None}
    scenes = spark.createDataFrame([(1, 7, 0.0, 5.0), (2, 7, 5.0, 6.0)], "id long, photo_id long, start_sec double, end_sec double")
    cut = plans.highlight_cut(scenes, spark.createDataFrame([(7, "/v.mp4")], "id long, path string"), F.array(F.lit(2), F.lit(1)))
    assert [r["seconds"] for r in cut.collect()] == [1.0, 5.0]
    got = spark.range(1).select(text.inherited_name(F.lit("20240101-00001-unclustered.jpg"), F.lit("20240101-00000-Harz-Hike.png")).alias("x")).first()["x"]
    assert got == "20240101-00001-Harz-Hike.jpg"
