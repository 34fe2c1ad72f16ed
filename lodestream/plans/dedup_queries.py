"""Duplicates, keep rules and keyed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, dml, plans, report, select
from .base import CHUNKS_SQL, EVENTS_SQL, Registry, chunks, events, table

REG = Registry()


@REG.add("SELECT md5(text) AS dup_key, min(doc_id) AS kept_id, count(*) AS n_copies FROM documents GROUP BY ALL HAVING count(*) >= 2")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.duplicate_summary(docs, F.md5(F.col("text").cast("binary")), "doc_id")


@REG.add("""WITH k AS (SELECT doc_id, md5(text) AS h, source = 'src0' AS shown FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER (PARTITION BY h ORDER BY shown DESC, doc_id) AS kept_id FROM k)
SELECT doc_id, kept_id, doc_id = kept_id AS is_kept, CASE WHEN doc_id <> kept_id THEN 'exact duplicate of ' || kept_id END AS reason FROM r WHERE n >= 2""")
def keep_rule_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.when(F.col("source") == "src0", 1).otherwise(0).alias("shown"), F.concat(F.lit("/x/"), F.col("doc_id").cast("string")).alias("path"))
    return dedup.discard_duplicates(docs, F.col("h"), id_col="doc_id", described="shown").select("doc_id", "kept_id", "is_kept", "reason")


@REG.add("""WITH s AS (SELECT vec_id, label, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS h FROM embeddings),
g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, max((label = 9)::INT) OVER (PARTITION BY h) AS bad, min(vec_id) OVER (PARTITION BY h) AS kept_id FROM s)
SELECT vec_id, h, kept_id, vec_id = kept_id AS is_kept FROM g WHERE n >= 2 AND bad = 0""")
def perceptual_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", dedup.sign_hash(F.col("embedding")).alias("h"), F.col("vec_id").cast("string").alias("path"))
    return dedup.discard_duplicates(v, F.col("h"), id_col="vec_id", described=None, skip=F.col("label") == 9).select("vec_id", "h", "kept_id", "is_kept")


@REG.add("""WITH k AS (SELECT doc_id, md5(text) AS h, (source = 'src0')::INT AS catch_all FROM documents),
g AS (SELECT *, count(*) OVER w AS n, min(catch_all) OVER w AS lo, max(catch_all) OVER w AS hi, min(doc_id) OVER w AS first FROM k WINDOW w AS (PARTITION BY h))
SELECT doc_id, h, CASE WHEN lo = 0 AND hi = 1 THEN catch_all = 0 ELSE doc_id = first END AS is_kept FROM g WHERE n >= 2""")
def cross_source_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "source")
    return dedup.cross_album(docs, F.col("h"), F.col("source") == "src0", "doc_id").select("doc_id", "h", "is_kept")


@REG.add("""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '^/.*/en/', ''), '^/+', '') AS p FROM pages)
SELECT p AS dup_key, min(page_id) AS kept_id, count(*) AS n_copies FROM k GROUP BY ALL HAVING count(*) >= 2""")
def path_norm_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+:/", "").alias("path"))
    return dedup.duplicate_summary(p, text.norm_path(F.col("path"), "en"), "page_id")


@REG.add("""WITH l AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'blurry' END AS quality, (d.doc_id % 7 = 0)::INT AS discarded, 0 AS flagged FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, quality, discarded, CASE WHEN quality <> 'good' AND discarded = 0 AND flagged = 0 THEN 1 ELSE flagged END AS flagged FROM l""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "blurry")
    photos = d.select("doc_id", q.alias("quality"), (F.col("doc_id") % 7 == 0).cast("int").alias("discarded"), F.lit(0).alias("flagged"))
    return dml.flag_quality(photos)


@REG.add("""WITH asked AS (SELECT DISTINCT o_custkey * 2 AS c_custkey FROM orders), c AS (SELECT c_custkey, (c_nationkey % 2)::INT AS d FROM customer)
SELECT c_custkey, CASE WHEN d IS NULL THEN 'not_found' WHEN d = 1 THEN 'skipped' ELSE 'done' END AS outcome FROM asked LEFT JOIN c USING (c_custkey)""")
def flag_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 2).cast("int").alias("d"))
    return select.classify_ids(asked, c, "c_custkey", "d")


@REG.add(f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, user_id, value FROM ev WHERE event_id % 3 <> 0), b AS (SELECT event_id, user_id, value * 2 AS value FROM ev WHERE event_id % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE event_id NOT IN (SELECT event_id FROM a)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir).select("event_id", "user_id", "value")
    return dml.insert_or_ignore(at.where("event_id % 3 <> 0"), at.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), "event_id")


@REG.add("""WITH n AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 = 0)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return dml.replace_children(li, li.where("l_orderkey % 5 = 0").withColumn("l_linenumber", F.col("l_linenumber") + 100), "l_orderkey")


@REG.add("""WITH p AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 4 = 0)
SELECT c.c_custkey, c.c_name, CASE WHEN p.c_custkey IS NOT NULL THEN p.c_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN p USING (c_custkey)""")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return dml.update(c, c.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), "c_custkey")


ORGANIZE_SQL = """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS t, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey END AS seq FROM orders),
n AS (SELECT o_orderkey, t, (SELECT max(seq) FROM o) + row_number() OVER (ORDER BY t, o_orderkey) AS seq FROM o WHERE seq IS NULL UNION ALL SELECT o_orderkey, t, seq FROM o WHERE seq IS NOT NULL)"""


@REG.add(ORGANIZE_SQL + """ SELECT o_orderkey, seq::BIGINT AS seq, lpad(printf('%x', seq::BIGINT), greatest(5, length(printf('%x', (SELECT max(seq) FROM n)::BIGINT)))::INT, '0') AS hex,
strftime(make_timestamp(t * 1000000), '%Y%m%d') || '-' || lpad(printf('%x', seq::BIGINT), greatest(5, length(printf('%x', (SELECT max(seq) FROM n)::BIGINT)))::INT, '0') || '-Harz-Hike-2031.jpg' AS name FROM n""")
def organize_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).alias("t"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderkey")).alias("seq"))
    n = dml.assign_sequence(o, "seq", "t", "o_orderkey")
    top = n.agg(F.max("seq").alias("top")).withColumn("_one", F.lit(1))
    at = n.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn("hex", text.hex_sequence(F.col("seq"), F.col("top")))
    return at.select("o_orderkey", "seq", "hex", text.organized_name(F.col("t"), F.col("hex"), F.lit("Harz Hike 2031"), F.lit("a/b.JPG")).alias("name"))


@REG.add("""WITH v AS (SELECT conv_id, CASE WHEN conv_id % 5 <> 0 THEN min(left(md5(conv_id::VARCHAR), 8)) END AS shot_at, 'v' || lpad(conv_id::VARCHAR, 8, '0') AS file, count(*) AS n FROM conversations GROUP BY conv_id),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shot_at IS NULL, coalesce(shot_at, file), file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM v)
SELECT c.conv_id, c.turn, (b.base + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.text) - 1)::BIGINT AS index FROM conversations c JOIN b USING (conv_id)""")
def merge_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("chunks"))
    docs = docs.withColumn("video", F.col("conv_id").cast("string")).withColumn("shot_at", F.when(F.col("conv_id") % 5 != 0, F.left(F.md5(F.col("conv_id").cast("string").cast("binary")), F.lit(8))))
    docs = docs.withColumn("file", F.concat(F.lit("v"), F.lpad(F.col("conv_id").cast("string"), 8, "0")))
    return plans.merge_documents(docs).select(F.col("source_video").cast("bigint").alias("conv_id"), "c.turn", "index")


@REG.add("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10)
SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'a' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return select.sides(a, table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")), "k")


@REG.add("SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.union_distinct(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")), "k")


@REG.add("SELECT o_custkey, min(o_orderkey) AS first_pos FROM orders GROUP BY ALL")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_seen(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@REG.add(f"""WITH {CHUNKS_SQL}, p AS (SELECT event_id AS photo_id, user_id % 40 AS cluster_id, (event_id % 9 = 0)::INT AS discarded, CASE WHEN event_id % 4 = 0 THEN 'a.mp4' ELSE 'a.jpg' END AS path FROM ck),
s AS (SELECT event_id AS photo_id, CASE WHEN event_id % 11 <> 0 THEN round(value / 30, 2) END AS score, (1 + event_id % 13)::DOUBLE AS sec FROM ck WHERE user_id % 40 < 30),
g AS (SELECT cluster_id, count(*) AS n_scenes, count(*) FILTER (score >= 2.5) AS n_high, count(*) FILTER (score >= 1.5 AND score < 2.5) AS n_mid, sum(sec) AS seconds FROM s JOIN p USING (photo_id) GROUP BY ALL),
v AS (SELECT cluster_id, count(*) AS n_videos FROM p WHERE discarded = 0 AND path = 'a.mp4' GROUP BY ALL)
SELECT cluster_id, 'trip ' || cluster_id AS name, n_scenes, n_high, n_mid, seconds, n_scenes - n_high - n_mid AS n_low, coalesce(n_videos, 0) AS n_videos FROM g LEFT JOIN v USING (cluster_id)""")
def trip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = chunks(spark, sf_dir)
    photos = ck.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("cluster_id"), (F.col("event_id") % 9 == 0).cast("int").alias("discarded"), F.when(F.col("event_id") % 4 == 0, "a.mp4").otherwise("a.jpg").alias("path"))
    scenes = ck.where("user_id % 40 < 30").select(F.col("event_id").alias("photo_id"), F.lit(0.0).alias("start_sec"), (F.lit(1.0) + F.col("event_id") % 13).alias("end_sec"), F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") / 30, 2)).alias("score"))
    clusters = photos.select(F.col("cluster_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("trip "), F.col("id").cast("string")))
    return report.trip_summary(clusters, photos, scenes)


@REG.add("""WITH d AS (SELECT doc_id, source, lang, text, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS taken FROM documents)
SELECT CASE WHEN lang = 'es' THEN 'unclustered' ELSE lang END AS cluster, row_number() OVER (PARTITION BY CASE WHEN lang = 'es' THEN 'unclustered' ELSE lang END ORDER BY taken ASC NULLS LAST, doc_id)::INT AS pos,
'| ' || concat_ws(' | ', doc_id::VARCHAR, source, 'good', lang, '', left(text, 80), CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE '' END) || ' |' AS line FROM d""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.when(F.col("lang") == "es", F.lit(0)).otherwise(F.ascii(F.substring("lang", 1, 1)) * 256 + F.ascii(F.substring("lang", 2, 1)))
    photos = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("/p/"), "source").alias("path"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("taken_at"), number.alias("cluster_id"), F.lit("good").alias("quality"), F.col("lang").alias("scene"), F.lit(None).cast("string").alias("people"), F.col("text").alias("caption"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("flagged"))
    names = d.select(number.alias("id"), F.col("lang").alias("name")).where("id > 0").distinct()
    return report.recommendation_lines(photos, names)


@REG.add("""WITH g AS (SELECT c_nationkey, regexp_extract(c_name, '([0-9]+)$', 1) AS base, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'exact duplicate of x' END AS reason FROM customer WHERE c_custkey % 2 = 1)
SELECT base AS filename, coalesce(reason, 'unknown') AS reason FROM g""")
def discard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    photos = c.select(F.concat(F.lit("/a/"), F.regexp_extract("c_name", "([0-9]+)$", 1)).alias("path"), (F.col("c_custkey") % 2).cast("int").alias("discarded"), F.when(F.col("c_custkey") % 3 != 0, "exact duplicate of x").alias("discard_reason"))
    return report.discard_manifest(photos)
