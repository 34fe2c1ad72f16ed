"""Top-n, paging, sampling, batches, ordered lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_then_index(df: DataFrame, score: str, index: str, n: int) -> DataFrame:
    """The n best scores (ties: the lower index), in order of index."""
    return df.orderBy(F.col(score).desc_nulls_last(), index).limit(n).orderBy(index)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / size).cast("bigint").alias("pages"))


def sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows by the MD5 of a seed and their id; a repeatable stand-in for random order, the same in every engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def batches(df: DataFrame, order: str, size: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Adds batch: consecutive rows of a key in batches of ``size``."""
    by = Window.partitionBy(*(keys or [])).orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("bigint"))


def ordered_lookup(ids: Column, df: DataFrame, id_col: str) -> DataFrame:
    """The rows of a list of ids, in its order (pos); a missing id raises an error."""
    spark = df.sparkSession
    asked = spark.range(1).select(F.posexplode(ids).alias("pos", id_col))
    at = asked.join(df.withColumn("_there", F.lit(True)), id_col, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col(id_col).cast("string")))).otherwise(F.col("pos"))
    return at.withColumn("pos", checked).drop("_there").orderBy("pos")


def classify_ids(asked: DataFrame, df: DataFrame, id_col: str, discarded: str) -> DataFrame:
    """(id, outcome): done, skipped (discarded) or not_found."""
    at = asked.select(id_col).distinct().join(df.select(id_col, F.col(discarded).alias("_d")), id_col, "left")
    outcome = F.when(F.col("_d").isNull(), "not_found").when(F.col("_d") == 1, "skipped").otherwise("done")
    return at.select(id_col, outcome.alias("outcome"))


def by_time_or_zero(df: DataFrame, taken_at: str = "taken_at", tie: str = "id") -> DataFrame:
    """Rows by time; those without one stand at zero."""
    return df.orderBy(F.coalesce(F.col(taken_at), F.lit(0)), tie)


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the distinct keys of two tables: both, a or b. Null keys are left out.

    One aggregate over what both tables have; neither is joined to the other.
    """
    at = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s"))).where(F.col(key).isNotNull())
    found = at.groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return found.select(key, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "a").otherwise("b").alias("side"))


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of either table."""
    return a.select(key).unionByName(b.select(key)).distinct()


def first_seen(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the place where each is first seen."""
    return df.groupBy(value).agg(F.min(pos).alias("first_pos"))


def with_default_name(df: DataFrame, names: DataFrame, key: str, default: Column) -> DataFrame:
    """Left join of a dimension (key, name); rows without a name get ``default``. The last name by pos wins."""
    last = names.groupBy(key).agg(F.max_by("name", "pos").alias("name"))
    return df.join(last, key, "left").withColumn("name", F.coalesce("name", default))


def check_bounds(df: DataFrame, index: str, n: Column) -> DataFrame:
    """The rows, raising an error on an index outside 0..n-1."""
    ok = (F.col(index) >= 0) & (F.col(index) < n)
    return df.withColumn(index, F.when(ok, F.col(index)).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), F.col(index).cast("string"))).cast("bigint")))


def find_cluster(clusters: DataFrame, name: str) -> DataFrame:
    """The cluster of a name: exact but for case, else the only one that holds it; none or several raise an error."""
    low = F.lower(F.col("name"))
    hits = clusters.withColumn("_e", (low == name.lower()).cast("int")).where(low.contains(name.lower()))
    hits = hits.withColumn("_m", F.max("_e").over(Window.partitionBy())).where("_e = _m")
    n = hits.agg(F.count("*").alias("_n"))
    checked = n.withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.format_string("%d clusters match", "_n")).cast("boolean")))
    return hits.withColumn("_one", F.lit(True)).join(checked.select(F.col("_ok").alias("_one")), "_one").drop("_e", "_m", "_one")
