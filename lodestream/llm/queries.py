"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, kneser_ney, mixing, simhash, suffix_dedup, telephony, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def source_domain() -> Column:
    """The domain of a source: by the number at its end."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).when(F.length(number) > 4, F.lit("forum")).when(number.cast("int") < 1, F.lit("web")).when(number.cast("int") < 10, F.lit("reference")).otherwise(F.lit("forum"))


#: Target weights; every source of a language weighs the same.
DOMAIN_WEIGHTS = {"web": 4, "reference": 4, "forum": 3}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def mix_weights() -> dict[str, Column]:
    def of(level: str, table: dict[str, int]) -> Column:
        out = F.lit(1)
        for name, w in table.items():
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out

    return {"domain": of("domain", DOMAIN_WEIGHTS), "lang": of("lang", LANG_WEIGHTS), "source": F.lit(1)}


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, source_domain(), mix_weights())
    return mixed.select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epoch")


def _capacity_sql(level: str, names: str, below: str, weight: str) -> str:
    """One level's nodes, from the level below: a node's capacity is that of its children, and none without weight."""
    return f"""
n_{level} AS (SELECT {names}, tokens, weight, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS capacity FROM (SELECT {names}, sum(tokens)::BIGINT AS tokens, sum(capacity)::BIGINT AS capacity, {weight} AS weight FROM {below} GROUP BY {names})),"""


def _level_sql(level: str, up: str, by: str) -> str:
    """Common table expressions that fill one level of the tree."""
    names = f"{up}, {level}" if up else level
    start = f"SELECT c.*, g.given FROM n_{level} c JOIN b_{by}_given g USING ({up})" if by else f"SELECT c.*, (SELECT sum(tokens) FROM leaves)::BIGINT AS given FROM n_{level} c"
    part = f"PARTITION BY {up}" if up else ""
    return f"""
s_{level} AS ({start}),
r_{level} AS (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s_{level} WINDOW w AS ({part} ORDER BY capacity / greatest(weight, 1), {level})),
f_{level} AS (SELECT *, capacity::HUGEINT * open_w <= greatest(given - taken, 0)::HUGEINT * weight AS is_full FROM r_{level}),
l_{level} AS (SELECT *, greatest(given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part}), 0)::HUGEINT AS left_over, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS rest_w FROM f_{level}),
p_{level} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE (left_over * weight) // greatest(rest_w, 1) END AS part, row_number() OVER (PARTITION BY {f"{up}, " if up else ""}is_full ORDER BY {level}) AS turn FROM l_{level}),
q_{level} AS (SELECT *, CASE WHEN rest_w > 0 THEN left_over ELSE 0 END - sum(part) OVER ({part}) AS spare FROM p_{level}),
b_{level} AS (SELECT {names}, tokens, CASE WHEN is_full THEN capacity ELSE part + (turn <= spare)::INT END::BIGINT AS budget FROM q_{level}),
b_{level}_given AS (SELECT {names}, budget AS given FROM b_{level}),"""


def _case_sql(level: str, table: dict[str, int]) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in table.items()) + " ELSE 1 END"


def mix_sql(docs: str = "documents", domain_weight: str = _case_sql("domain", DOMAIN_WEIGHTS), lang_weight: str = _case_sql("k_lang", LANG_WEIGHTS), source_weight: str = "1", epochs: int = 3, out: str = "doc_id, lang, source, domain AS mix_domain, tokens AS mix_tokens, epoch AS mix_epoch") -> str:
    words = "trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
    return f"""
WITH raw AS (SELECT *, {words} AS words, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS number FROM {docs}),
d AS (SELECT *, coalesce(lang, '') AS k_lang, coalesce(source, '') AS k_source,
  CASE WHEN number = '' THEN 'other' WHEN length(number) > 4 THEN 'forum' WHEN number::INT < 1 THEN 'web' WHEN number::INT < 10 THEN 'reference' ELSE 'forum' END AS domain,
  CASE WHEN words = '' THEN 0 ELSE length(words) - length(replace(words, ' ', '')) + 1 END::BIGINT AS n FROM raw),
leaves AS (SELECT domain, k_lang, k_source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL),
room AS (SELECT *, {epochs} * tokens AS capacity FROM leaves),
{_capacity_sql("k_source", "domain, k_lang, k_source", "room", source_weight)}
{_capacity_sql("k_lang", "domain, k_lang", "n_k_source", lang_weight)}
{_capacity_sql("domain", "domain", "n_k_lang", domain_weight)}
{_level_sql("domain", "", "")}
{_level_sql("k_lang", "domain", "domain")}
{_level_sql("k_source", "domain, k_lang", "k_lang")}
plan AS (SELECT domain, k_lang, k_source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM b_k_source),
placed AS (SELECT d.*, whole, rest, md5('7:' || (whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM d JOIN plan USING (domain, k_lang, k_source)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, k_lang, k_source ORDER BY k, text ROWS UNBOUNDED PRECEDING) AS upto FROM placed),
picked AS (SELECT *, unnest(range(1, whole + 1 + CASE WHEN rest > 0 AND 2 * upto - n <= 2 * rest THEN 1 ELSE 0 END))::INT AS epoch, n AS tokens FROM summed)
SELECT {out} FROM picked"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored forms and of the resampled PCM: mu-law under the contract's names, A-law and ADPCM beside."""
    at = telephony.media_columns(_table(spark, sf_dir, "documents"))
    main = [F.col(f"mulaw.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")]
    stored = lambda c: [F.octet_length(f"{c}.media").cast("long").alias("media_bytes"), F.sha2(F.col(f"{c}.media"), 256).alias("media_sha256"), telephony.pieces_sha256(F.col(f"{c}.pcm")).alias("pcm_sha256")]
    beside = [x for c in ("alaw", "adpcm") for x in (F.struct(F.col(f"{c}.payload_sha256"), *stored(c), F.col(f"{c}.feature")).alias(c),)]
    return at.select("doc_id", "n_bytes", *main, *stored("mulaw"), *beside)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.mark_repeats(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True, keep_ids=False)


# (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, weights)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_near_dedup, op2_source_mix, op3_toxicity, op4_media_columns, op5_simhash_near_dedup, op6_token_counts, op7_quality_classifier, op8_suffix_array_dedup, op9_byte_bpe, op10_url_filter)
}
ORACLE_SQL: dict[str, str] = {"op2_source_mix": mix_sql()}
