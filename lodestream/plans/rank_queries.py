"""Scores, searches, metrics, texts and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, jsontext, scoring, text
from ..operators import describe, dml, metrics, plans, report, search, select
from .base import CHUNKS_SQL, EVENTS_SQL, Registry, chunks, events, table

REG = Registry()

SCORE_SQL = f"""{CHUNKS_SQL}, sc AS (SELECT *, round(greatest(0.0, CASE WHEN energy LIKE '%high%' THEN 4.0 WHEN energy LIKE '%medium%' THEN 1.5 WHEN energy LIKE '%low%' THEN 0.5 ELSE 2.25 END
 + CASE WHEN lower(coalesce(nullif(quality, ''), 'good')) = 'good' THEN 0.0 ELSE -1.5 END + coalesce(least(1.0, greatest(0.0, (loud + 60) / 50)) * 0.3, 0.0) + CASE WHEN shot LIKE '%aerial%' THEN 1.0 WHEN shot LIKE '%close%' THEN 0.25 ELSE 0.0 END)::DOUBLE, 2) AS score
 FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN -10.0::DOUBLE END AS loud FROM ck))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = F.array(F.struct(F.lit("aerial").alias("key"), F.lit(1.0).alias("bonus")), F.struct(F.lit("close").alias("key"), F.lit(0.25).alias("bonus")))
    profile = F.struct(F.create_map(F.lit("high"), F.lit(4.0), F.lit("medium"), F.lit(1.5), F.lit("low"), F.lit(0.5)).alias("energy_weights"), F.lit(None).cast("double").alias("quality_penalty"), F.lit(0.3).alias("loudness_weight"), bonus.alias("shot_type_bonus"))
    at = chunks(spark, sf_dir).withColumn("loud", F.when(F.col("event_id") % 3 == 0, F.lit(-10.0)))
    return at.withColumn("score", scoring.chunk_score(F.col("energy"), F.col("quality"), F.col("loud"), F.col("shot"), profile))


@REG.add(f"WITH {SCORE_SQL} SELECT event_id, score FROM sc")
def chunk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "score")


@REG.add(f"WITH {SCORE_SQL} SELECT event_id, score FROM sc ORDER BY score DESC, event_id LIMIT 50")
def top_n_then_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_n_then_index(_scored(spark, sf_dir).select("event_id", "score"), "score", "event_id", 50)


@REG.add(f"WITH {SCORE_SQL} SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 1.25::DOUBLE END, score) AS score, CASE WHEN score >= 2.5 THEN 'high' WHEN score >= 1.5 THEN 'mid' ELSE 'low' END AS band FROM sc")
def stored_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scored(spark, sf_dir)
    return at.select("event_id", scoring.stored_or_computed(F.when(F.col("event_id") % 2 == 0, F.lit(1.25)), F.col("score")).alias("score"), scoring.score_band(F.col("score")).alias("band"))


def match_sql(found: dict[str, str], match: str) -> str:
    """BM25 over the words w of each document's columns; ``found`` has the SQL of a list of the places of each term in w."""
    words = ", ".join(f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+') AS {c}" for c in ("text", "lang", "source"))
    count = lambda sql, c: f"len({sql.replace('$w', c)})"
    fs = ", ".join(f"({count(sql.split('@')[0], sql.split('@')[1]) if '@' in sql else ' + '.join(count(sql, c) for c in ('text', 'lang', 'source'))})::DOUBLE AS {name}" for name, sql in found.items())
    totals = ", ".join(f"count(*) FILTER ({name} > 0) AS n_{name}" for name in found)
    scores = " + ".join(f"CASE WHEN {f} > 0 THEN CASE WHEN ln((n_docs - n_{f} + 0.5) / (n_{f} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_{f} + 0.5) / (n_{f} + 0.5)) END * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * l / mean)) ELSE 0.0 END" for f in found if f != "no")
    return f"""WITH w AS (SELECT doc_id, {words} FROM documents), f AS (SELECT doc_id, len(text) + len(lang) + len(source) AS l, {fs} FROM w),
s AS (SELECT count(*) AS n_docs, avg(l) AS mean, {totals} FROM f) SELECT doc_id, round(-({scores}), 6) AS score FROM f, s WHERE {match}"""


def _searched(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    columns = ["text", "lang", "source"]
    index = search.build_index(table(spark, sf_dir, "documents"), "doc_id", columns)
    return search.search_index(index, query, columns, None).select("doc_id", F.round("score", 6).alias("score"))


def word_sql(word: str) -> str:
    return f"list_filter($w, lambda x: x = '{word}')"


@REG.add(match_sql({"a": "list_filter(range(1, len($w)), lambda i: $w[i] = 'of' AND $w[i + 1] = 'the')"}, "a > 0"))
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '"of the"')


@REG.add(match_sql({"a": "list_filter($w, lambda x: starts_with(x, 'mentr'))"}, "a > 0"))
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "mentr*")


@REG.add(match_sql({"a": "list_filter(range(1, len($w) + 1), lambda i: $w[i] = 'with' AND list_contains($w[greatest(1, i - 4):i + 4], 'from'))"}, "a > 0"))
def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "NEAR(with from, 3)")


@REG.add(match_sql({"a": word_sql("that"), "b": word_sql("der"), "no": word_sql("src1")}, "(a > 0 OR b > 0) AND NOT no > 0"))
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "(that OR der) NOT src1")


@REG.add(match_sql({"a": word_sql("src2") + "@source", "b": word_sql("es") + "@lang"}, "a > 0 AND b > 0"))
def column_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "source:src2 lang:es")


@REG.add(match_sql({"a": word_sql("ree")}, "a > 0"))
def accent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "réé")


def bm25_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') || regexp_extract_all(lower(lang), '[\\p{{L}}\\p{{N}}]+') || regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n_docs, avg(len) AS avglen FROM l),
f AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM t WHERE term IN ({listed}) GROUP BY ALL), n AS (SELECT term, count(*) AS n FROM f GROUP BY term),
q AS (SELECT f.doc_id, sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen))) AS s, count(*) AS k
 FROM f JOIN n USING (term) JOIN l USING (doc_id), s GROUP BY f.doc_id)
SELECT doc_id, round(-s, 6) AS score FROM q WHERE k = {len(terms)}"""


@REG.add(bm25_sql(["ention", "src3"]))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return search.search(docs, "ention src3", "doc_id", ["text", "lang", "source"], None).select("doc_id", F.round("score", 6).alias("score"))


@REG.add(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:^|[^\p{L}\p{N}_])(?:the|ention)(?:$|[^\p{L}\p{N}_])', 'i')")
def keyword_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.col("text").rlike(text.keyword_pattern(("the", "ention")))).select("doc_id")


@REG.add("""WITH r AS (SELECT d.lang, d.doc_id, l.quality AS y, d.n_chars % 101 AS score FROM documents d JOIN labels l USING (doc_id)),
k AS (SELECT *, row_number() OVER w AS rk, sum((y = 1)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM r WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id))
SELECT lang, round(coalesce(sum(CASE WHEN y = 1 THEN hits / rk END) / sum((y = 1)::INT), 0.0), 6) AS ap FROM k GROUP BY lang""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 101).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.average_precision(d, ["lang"], "score", "quality", "doc_id")


KENDALL_SQL = """WITH r AS (SELECT vec_id, label, (vec_id * 7919) % 23 AS x, round(embedding[1], 1)::DOUBLE AS y FROM embeddings),
p AS (SELECT a.label, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id),
t AS (SELECT label, sum(sx * sy) / sqrt(count(*) FILTER (sx <> 0)::DOUBLE * count(*) FILTER (sy <> 0)) AS tau FROM p GROUP BY label),
k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2 AS ry FROM r),
s AS (SELECT label, corr(rx, ry) AS rho FROM k GROUP BY label)
SELECT label, round(tau, 6) AS tau, round(rho, 6) AS rho FROM t JOIN s USING (label)"""


@REG.add(KENDALL_SQL)
def kendall_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", ((F.col("vec_id") * 7919) % 23).alias("x"), F.round(F.col("embedding")[0].cast("double"), 1).alias("y"))
    return metrics.kendall(v, ["label"], "x", "y").join(metrics.spearman(v, ["label"], "x", "y"), "label")


@REG.add(f"""WITH {EVENTS_SQL}, q AS (SELECT count(*) AS n, count(*) FILTER (value > 10) AS a, count(*) FILTER (event_id % 3 = 0) AS b, count(*) FILTER (user_id < 50) AS c FROM ev)
SELECT question, floor(100 * k / n)::INT AS percent FROM (SELECT 'action_clear' AS question, a AS k, n FROM q UNION ALL SELECT 'energy_clear', b, n FROM q UNION ALL SELECT 'concise', c, n FROM q)""")
def checklist_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir).select((F.col("value") > 10).alias("action_clear"), (F.col("event_id") % 3 == 0).alias("energy_clear"), (F.col("user_id") < 50).alias("concise"))
    return metrics.percent_true(at, ["action_clear", "energy_clear", "concise"])


@REG.add(f"""WITH {EVENTS_SQL}, b AS (SELECT event_id AS index, (value > 10)::INT + (user_id < 50)::INT AS total FROM ev), a AS (SELECT event_id AS index, (value > 20)::INT + (user_id < 90)::INT AS total FROM ev WHERE event_id % 4 <> 0)
SELECT b.index, b.total AS total_before, coalesce(a.total, -1) AS total_after, coalesce(a.total - b.total, 0) AS delta FROM b LEFT JOIN a USING (index)""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir)
    total = lambda v, u: ((F.col("value") > v).cast("int") + (F.col("user_id") < u).cast("int")).alias("total")
    return metrics.before_after(at.select(F.col("event_id").alias("index"), total(10, 50)), at.where("event_id % 4 <> 0").select(F.col("event_id").alias("index"), total(20, 90))).select("index", "total_before", F.coalesce("total_after", F.lit(-1)).alias("total_after"), F.coalesce("delta", F.lit(0)).alias("delta"))


@REG.add(f"""WITH {EVENTS_SQL}, b AS (SELECT avg((value > 10)::INT + (user_id < 50)::INT) AS m, count(*) AS n FROM ev), a AS (SELECT avg((value > 20)::INT + (user_id < 90)::INT) AS m FROM ev WHERE event_id % 4 <> 0)
SELECT b.n AS n_before, round(b.m, 6) AS mean_before, round(a.m, 6) AS mean_after, round(a.m - b.m, 6) AS delta FROM a, b""")
def mean_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir)
    total = lambda v, u: ((F.col("value") > v).cast("int") + (F.col("user_id") < u).cast("int")).alias("total")
    return metrics.mean_totals(at.select(total(10, 50)), at.where("event_id % 4 <> 0").select(total(20, 90)))


@REG.add(f"WITH {SCORE_SQL} SELECT event_id, score, (row_number() OVER (ORDER BY score DESC, event_id) - 1)::BIGINT AS place FROM sc")
def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's place in the ranking, by counts of scores; ``evaluate.ranked`` gives the same order as rows."""
    at = _scored(spark, sf_dir).select("event_id", "score")
    return dml.numbered(at, "place", -F.col("score"), None, "event_id").withColumn("place", F.col("place") - 1)


@REG.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 25)


@REG.add("SELECT event_id, user_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 20")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample(events(spark, sf_dir).select("event_id", "user_id"), 20, 42, "event_id")


@REG.add("SELECT conv_id, turn, role, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS batch FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def turn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.batches(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct(), "turn", 3, ["conv_id"])


LETTERS_SQL = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


@REG.add(f"SELECT doc_id, length(text) = 0 OR length(regexp_replace(text, '^[., …\\t\\n]+|[., …\\t\\n]+$', '', 'g')) <= 1 OR contains(text, 'ʔ') OR {LETTERS_SQL} / length(text) < 0.4 AS garbage FROM documents")
def garbage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_garbage(F.col("text")).alias("garbage"))


@REG.add(f"""WITH {EVENTS_SQL} SELECT event_id, (us // 1000000)::BIGINT AS taken_at FROM ev WHERE event_id % 2 = 0
UNION ALL SELECT event_id, epoch_us(date_trunc('day', ts)) // 1000000 FROM ev WHERE event_id % 2 = 1 AND event_id % 5 <> 0 UNION ALL SELECT event_id, -1 FROM ev WHERE event_id % 2 = 1 AND event_id % 5 = 0""")
def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir)
    long = F.concat(F.lit("IMG_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg"))
    short = F.concat(F.lit("trip "), F.date_format("ts", "yyyy-MM-dd"), F.lit(".png"))
    name = F.when(F.col("event_id") % 2 == 0, long).when(F.col("event_id") % 5 != 0, short).otherwise("IMG_20241399_250000.jpg")
    return at.select("event_id", F.coalesce(dates.filename_epoch(name), F.lit(-1)).alias("taken_at"))


@REG.add(f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, us, event_id % 4 AS kind, CASE WHEN event_id % 4 = 2 AND user_id % 2 = 0 THEN 0 ELSE user_id / 4 END::DOUBLE AS la, (-(user_id % 2))::DOUBLE AS lo FROM ev)
SELECT event_id, CASE WHEN kind <> 0 THEN us // 1000000 END AS taken_at, CASE WHEN kind <> 1 AND NOT (la = 0 AND lo = 0) THEN la END AS lat, CASE WHEN kind <> 1 AND NOT (la = 0 AND lo = 0) THEN lo END AS lon FROM c""")
def sidecar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars made of events: with a bad time, a bad place, and no place where both coordinates are zero."""
    at = events(spark, sf_dir).withColumn("kind", F.col("event_id") % 4)
    none = (F.col("kind") == 2) & (F.col("user_id") % 2 == 0)
    time = F.when(F.col("kind") == 0, "soon").otherwise(F.floor(F.col("us") / 1_000_000).cast("string"))
    lat = F.when(F.col("kind") == 1, "north").when(none, "0.0").otherwise((F.col("user_id") / 4).cast("string"))
    lon = F.when(F.col("kind") == 1, "west").when(none, "0.0").otherwise((-(F.col("user_id") % 2)).cast("double").cast("string"))
    raw = F.to_json(F.struct(F.col("props").alias("description"), F.struct(time.alias("timestamp")).alias("photoTakenTime"), F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("geoData")))
    return at.select("event_id", jsontext.sidecar(raw).alias("s")).select("event_id", "s.taken_at", "s.lat", "s.lon")


@REG.add(f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'reply ' || event_id ELSE event_type END AS action, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'a b' END AS shot FROM ev""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir)
    body = F.concat(F.lit('{"action": "'), "event_type", F.lit('", "shot": ["a", "b"]}'))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise(F.concat(F.lit("reply "), F.col("event_id").cast("string")))
    d = jsontext.parse_chunk(raw)
    return at.select("event_id", d["action"].alias("action"), d["shot"].alias("shot"))


@REG.add("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' – x/' || p_brand, '[–—]', '-', 'g'), '[^\\w-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS safe,
regexp_replace(regexp_replace(lower(p_name || ' – x/' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" – x/"), "p_brand")
    return p.select("p_partkey", text.sanitize(name).alias("safe"), text.slug(name).alias("slug"))


@REG.add("""WITH d AS (SELECT p_partkey, md5(p_name) AS h FROM part), c AS (SELECT p_partkey, list_transform([1, 3, 5], lambda i: greatest(30, least(160, ('0x' || h[i:i + 1])::INT))) AS c FROM d)
SELECT p_partkey, c[1] AS r, c[2] AS g, c[3] AS b FROM c""")
def name_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", scoring.name_colour(F.col("p_name")).alias("c"))
    return p.select("p_partkey", "c.r", "c.g", "c.b")


@REG.add("""WITH f AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal * 1000)::BIGINT END AS size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_nationkey, round(coalesce(sum(size) FILTER (r <= 15), 0) / greatest(1, least(15, count(*))) * count(*) / 1e9, 6) AS raw_gb FROM f GROUP BY ALL""")
def estimated_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.round(F.col("c_acctbal") * 1000).cast("bigint")).alias("size"))
    return report.estimated_gb(f, ["c_nationkey"], "c_custkey")


@REG.add(f"WITH {SCORE_SQL} SELECT event_id, round((start + \"end\") / 2, 3) AS seek FROM sc")
def thumb_seeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.thumb_seeks(_scored(spark, sf_dir)).select("event_id", F.round("seek", 3).alias("seek"))


@REG.add("SELECT event_id AS index, 'clip ' || event_id AS action, true AS action_clear, true AS energy_clear, true AS setting_clear, true AS shot_clear, true AS quality_ok, true AS selection_ready, true AS concise, 7::BIGINT AS total FROM events")
def describe_and_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stub describer, and stub judge in batches, over all chunks."""
    at = chunks(spark, sf_dir).select(F.col("event_id").alias("index"))
    said = describe.describe_chunks(at)
    form = text.description(F.struct("action", "shot", "energy", "setting", "quality", "description"))
    return describe.judge_batches(said.withColumn("desc_formatted", form)).select("index", "action", *describe.QUESTIONS, "total")
