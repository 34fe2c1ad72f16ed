"""Sessions, places and intervals over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, dml, intervals, report, sessionize
from ..streaming import sessions as streams
from .base import CHUNKS_SQL, EVENTS_SQL, Registry, chunks, events, haversine_sql, table

REG = Registry()
HOUR = 3_600_000_000


@REG.add(f"""WITH {EVENTS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM n)
SELECT user_id, session_id, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts, sum(value::DECIMAL(18, 4))::DOUBLE AS total_value FROM s GROUP BY ALL""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sessionize.gap_sessions(events(spark, sf_dir), ["user_id"], F.col("us"), 6 * HOUR, ["event_id"])
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return at.groupBy("user_id", "session_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), total.alias("total_value"))


@REG.add(f"""WITH {EVENTS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {HOUR} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst_id FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, burst_id) AS burst_size FROM s)
SELECT event_id, user_id, burst_id, burst_size FROM c WHERE burst_size >= 2""")
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.bursts(events(spark, sf_dir), ["user_id"], F.col("us"), HOUR, ["event_id"]).select("event_id", "user_id", "burst_id", "burst_size")


HOME_SQL = f"""{EVENTS_SQL}, cells AS (SELECT round_even(lat / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS home_lat, round_even(lon / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS home_lon, count(*) AS n, min((us, event_id)) AS seen FROM ev GROUP BY ALL),
home AS (SELECT home_lat, home_lon FROM cells ORDER BY n DESC, seen LIMIT 1)"""


@REG.add(f"WITH {HOME_SQL} SELECT * FROM home")
def home_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.home_cell(events(spark, sf_dir), order="us", tie="event_id")


@REG.add(f"WITH {HOME_SQL} SELECT user_id, round(avg(CASE WHEN {haversine_sql('lat', 'lon', 'home_lat', 'home_lon')} <= 50.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_home, avg(CASE WHEN {haversine_sql('lat', 'lon', 'home_lat', 'home_lon')} <= 50.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8 AS is_home FROM ev, home GROUP BY user_id")
def home_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir)
    home = cluster.home_cell(at, order="us", tie="event_id").withColumn("_one", F.lit(1))
    share = cluster.home_share(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon"))
    per = at.withColumn("_one", F.lit(1)).join(F.broadcast(home), "_one").groupBy("user_id").agg(share.alias("s"))
    return per.select("user_id", F.round("s", 6).alias("share_home"), (F.col("s") >= 0.8).alias("is_home"))


@REG.add(f"""WITH s AS (SELECT s_suppkey, s_nationkey, 40.0::DOUBLE + (s_suppkey % 17) AS lat, (s_suppkey % 23)::DOUBLE AS lon FROM supplier)
SELECT a.s_nationkey AS nation, round(max({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) AS spread_km FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY ALL""")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.lit(40.0) + F.col("s_suppkey") % 17).alias("lat"), (F.col("s_suppkey") % 23).cast("double").alias("lon"))
    return cluster.spread_km(s, ["nation"]).where("spread_km is not null")


@REG.add(f"""WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
j AS (SELECT user_id, pos, round({haversine_sql('la', 'lo', 'lat', 'lon')}, 6) AS jump_km FROM o WHERE la IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY jump_km DESC, pos) AS k FROM j)
SELECT user_id, jump_km, pos::BIGINT AS pos FROM r WHERE k = 1""")
def geo_largest_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.largest_jump(events(spark, sf_dir), ["user_id"], ["us", "event_id"])


TRIPS_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, g AS (SELECT *, us // 1000000 AS t, CASE WHEN us // 1000000 - lag(us // 1000000) OVER w > 86400 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us // 1000000, event_id)),
o AS (SELECT user_id, event_id, event_type, t, lat, lon, sum(fresh) OVER w AS gap_id, row_number() OVER w AS pos, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
j AS (SELECT *, round({haversine_sql('la', 'lo', 'lat', 'lon')}, 6) AS jump FROM o),
far AS (SELECT x.user_id, x.gap_id, x.pos AS p, y.pos AS q FROM o x JOIN o y ON x.user_id = y.user_id AND x.gap_id = y.gap_id AND x.pos < y.pos WHERE {haversine_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')} > 10.0),
seg AS (SELECT user_id, gap_id, min(pos) AS a, max(pos) + 1 AS b, 0 AS cut FROM j GROUP BY user_id, gap_id
  UNION ALL SELECT user_id, gap_id, unnest([a, k]), unnest([k, b]), k FROM (
    SELECT s.user_id, s.gap_id, s.a, s.b, arg_min(j.pos, (-j.jump, j.pos)) AS k FROM seg s JOIN j ON j.user_id = s.user_id AND j.pos > s.a AND j.pos < s.b
    WHERE EXISTS (SELECT 1 FROM far f WHERE f.user_id = s.user_id AND f.gap_id = s.gap_id AND f.p >= s.a AND f.q < s.b) GROUP BY s.user_id, s.gap_id, s.a, s.b)),
starts AS (SELECT DISTINCT user_id, a FROM seg), placed AS (SELECT j.*, (SELECT max(a) FROM starts s WHERE s.user_id = j.user_id AND s.a <= j.pos) AS part FROM j),
cells AS (SELECT user_id, round_even(lat / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS home_lat, round_even(lon / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS home_lon, count(*) AS n, min((t, event_id)) AS seen FROM o GROUP BY ALL),
home AS (SELECT user_id, home_lat, home_lon FROM cells QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1),
pl AS (SELECT user_id, part, event_type AS place, count(*) AS n, min((t, event_id)) AS seen FROM placed GROUP BY ALL),
best AS (SELECT user_id, part, place FROM pl QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY n DESC, seen) = 1),
c AS (SELECT user_id, part, count(*) AS photo_count, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS photo_ids, min(t) AS s, max(t) AS e, avg(({haversine_sql('lat', 'lon', 'home_lat', 'home_lon')} <= 20.0)::INT) >= 0.8 AS at_home FROM placed JOIN home USING (user_id) GROUP BY ALL),
d AS (SELECT *, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS start, strftime(make_timestamp(e * 1000000), '%Y-%m-%d') AS "end" FROM c)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s, part) AS cluster_id, CASE WHEN at_home THEN left(start, 7) ELSE start || '–' || "end" || ' ' || place END AS name, NOT at_home AS is_trip, at_home AS confirmed, photo_count, photo_ids, start, "end", place FROM d JOIN best USING (user_id, part)"""


@REG.add(TRIPS_SQL)
def trip_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of events, with radii small enough for the places to be split."""
    at = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.concat(F.lit("/media/"), "event_type", F.lit(".jpg")).alias("path"), F.floor(F.col("us") / 1_000_000).alias("taken_at"), "lat", "lon", F.col("event_type").alias("place"))
    found = cluster.trip_clusters(at, ["user_id"], gap_days=1.0, radius_km=10.0, home_radius_km=20.0)
    return found.drop("album").withColumn("photo_ids", F.array_join("photo_ids", ","))


@REG.add(f"""WITH {CHUNKS_SQL}, sp AS (SELECT user_id, event_id AS seg, start - 3.0 AS s_start, start + 4.0 AS s_end FROM ck WHERE event_id % 2 = 0)
SELECT c.event_id, count(s.seg) AS n_segments, coalesce(min(s.seg), -1) AS first_segment FROM ck c LEFT JOIN sp s ON c.user_id = s.user_id AND s.s_end > c.start AND s.s_start < c."end" GROUP BY ALL""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = chunks(spark, sf_dir)
    sp = ck.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("seg"), (F.col("start") - 3.0).alias("s_start"), (F.col("start") + 4.0).alias("s_end"))
    hits = intervals.overlap_join(ck.select("user_id", "event_id", "start", "end"), sp, ["user_id"], ("start", "end"), ("s_start", "s_end"), 60.0)
    per = hits.groupBy("event_id").agg(F.count("*").alias("n_segments"), F.min("seg").alias("first_segment"))
    return ck.select("event_id").join(per, "event_id", "left").select("event_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("first_segment", F.lit(-1)).alias("first_segment"))


@REG.add(f"""WITH {CHUNKS_SQL}, sp AS (SELECT user_id, event_id AS pos, start - 2.0 AS s_start, start + 900.0 AS s_end FROM ck WHERE event_id % 3 = 0),
hit AS (SELECT c.event_id, s.s_start - 0.3::DOUBLE AS lo, s.s_end + 0.3::DOUBLE AS hi, row_number() OVER (PARTITION BY c.event_id ORDER BY s.pos) AS k FROM ck c JOIN sp s ON c.user_id = s.user_id AND c."end" BETWEEN s.s_start - 0.3::DOUBLE AND s.s_end + 0.3::DOUBLE)
SELECT c.event_id, CASE WHEN lo IS NULL THEN c."end" ELSE round(greatest(0.0, CASE WHEN c."end" - lo <= hi - c."end" THEN lo ELSE hi END), 2) END AS snapped FROM ck c LEFT JOIN hit h ON c.event_id = h.event_id AND h.k = 1""")
def snap_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = chunks(spark, sf_dir)
    sp = ck.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("pos"), (F.col("start") - 2.0).alias("s_start"), (F.col("start") + 900.0).alias("s_end"))
    points = ck.select("user_id", "event_id", F.col("end").alias("t"))
    return intervals.snap(points, sp, ["user_id"], "t", point_id="event_id", width=600.0).select("event_id", "snapped")


@REG.add(f"""WITH {CHUNKS_SQL}, p AS (SELECT event_id, start, "end", unnest(range(0, greatest(1, ceil(round(("end" - start) / 5.0, 9))::INT)))::INT AS piece FROM ck)
SELECT event_id, piece, CASE WHEN "end" - start <= 5.0 THEN start ELSE round(start + piece * 5.0, 2) END AS piece_start, CASE WHEN "end" - start <= 5.0 THEN "end" ELSE round(least("end", start + (piece + 1) * 5.0), 2) END AS piece_end FROM p""")
def split_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_long(chunks(spark, sf_dir), "start", "end", 5.0).select("event_id", "piece", "piece_start", "piece_end")


@REG.add("""WITH f AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings),
c AS (SELECT vec_id, frame FROM f WHERE x > 1.5 UNION SELECT vec_id, 0 FROM embeddings UNION SELECT vec_id, 63 FROM embeddings),
l AS (SELECT vec_id, frame, lead(frame) OVER (PARTITION BY vec_id ORDER BY frame) AS nxt FROM c)
SELECT vec_id, round(frame / 2.0, 2)::DOUBLE AS start, round(nxt / 2.0, 2)::DOUBLE AS "end" FROM l WHERE nxt IS NOT NULL AND round(nxt / 2.0, 2) - round(frame / 2.0, 2) > 1.0""")
def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    frames = v.select("vec_id", F.posexplode("embedding").alias("frame", "x")).where("x > 1.5")
    cuts = v.select("vec_id", (F.size("embedding") - 1).cast("bigint").alias("last")).join(frames.select("vec_id", F.col("frame").cast("bigint").alias("frame")), "vec_id", "left")
    return sessionize.boundaries_to_intervals(cuts, ["vec_id"], "frame", "last", fps=2.0)


@REG.add(f"""WITH {CHUNKS_SQL}, m AS (SELECT event_id, user_id, start - floor(start / 600) * 600 AS a, value FROM ck), iv AS (SELECT user_id, a, a + 1.0 + (event_id % 13) AS b, value FROM m),
hit AS (SELECT user_id, unnest(range(greatest(0, floor(a / 5.0)::INT), ceil(b / 5.0)::INT)) AS seg, value FROM iv), best AS (SELECT user_id, seg, max(value) AS score FROM hit GROUP BY ALL),
grid AS (SELECT DISTINCT user_id, unnest(range(0, 120)) AS seg FROM ck)
SELECT g.user_id, g.seg::INT AS seg, coalesce(b.score, 0.0) AS score FROM grid g LEFT JOIN best b USING (user_id, seg)""")
def grid_align_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    ck = chunks(spark, sf_dir)
    a = F.col("start") - F.floor(F.col("start") / 600) * 600
    iv = ck.select("user_id", a.alias("a"), (a + 1.0 + F.col("event_id") % 13).alias("b"), "value")
    return intervals.grid_max(iv, ck.select("user_id", F.lit(120).alias("n_segs")).distinct(), ["user_id"], "a", "b", "value")


@REG.add("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS f, (vec_id % 10)::DOUBLE AS s, (vec_id % 10 + 1.5)::DOUBLE AS t FROM embeddings),
b AS (SELECT *, greatest(0, floor(s * (64 / 12.0::DOUBLE))::INT) AS lo FROM e), r AS (SELECT *, greatest(lo + 1, least(floor(t * (64 / 12.0::DOUBLE))::INT, 64)) AS hi FROM b)
SELECT vec_id, round(list_sum(f[lo + 1:hi]) / len(f[lo + 1:hi]), 6) AS score FROM r""")
def frame_mean_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"), (F.col("vec_id") % 10).cast("double").alias("s"))
    return v.select("vec_id", F.round(intervals.frame_mean(F.col("f"), F.col("s"), F.col("s") + 1.5, F.lit(12.0)), 6).alias("score"))


@REG.add(f"""WITH {EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 50""")
def bulk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.bulk_days(events(spark, sf_dir), F.col("ts"))


@REG.add(f"""WITH {EVENTS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {HOUR} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM n),
g AS (SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, k)
SELECT * FROM g WHERE end_ts <= (SELECT date_trunc('millisecond', max(ts)) FROM ev) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events as a stream that the watermark has closed; those still open at its end come when it goes on."""
    return streams.closed_sessions(spark, f"{sf_dir}/events.parquet", "1 hour", "1 hour")


@REG.add(f"""WITH {EVENTS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {HOUR} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n_events"))
    return at.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


@REG.add(f"""WITH {EVENTS_SQL}, o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM ev)
SELECT user_id, event_id, event_type, prev IS DISTINCT FROM event_type AS is_header FROM o""")
def source_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.source_headers(events(spark, sf_dir), ["us", "event_id"], "event_type", ["user_id"]).select("user_id", "event_id", "event_type", "is_header")
