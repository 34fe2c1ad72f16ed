"""Keyed inserts, updates and replacements of whole tables.

Plain files have no MERGE: each operator returns the table's new content, to be
written to a new place or partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Existing rows unchanged, and the new rows whose key isn't there (of several, the first by ``order``)."""
    fresh = new.join(existing.select(key), key, "left_anti")
    if order:
        fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    else:
        fresh = fresh.dropDuplicates([key])
    return existing.unionByName(fresh.select(existing.columns), allowMissingColumns=True)


def update(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's columns where it has the key (nulls there overwrite)."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    at = df.join(p, key, "left")
    return at.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def update_where(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """Set a column where a condition is true; unknown isn't true."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced by its rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def flag_quality(photos: DataFrame) -> DataFrame:
    """Flag what isn't good, discarded or flagged already; a null quality isn't flagged."""
    return update_where(photos, (F.col("quality") != "good") & (F.col("discarded") == 0) & (F.col("flagged") == 0), "flagged", F.lit(1))


#: Ids, or first characters of text ids, that share a range when rows are numbered.
ID_RANGE, TEXT_RANGE = 65_536, 64


def numbered(df: DataFrame, name: str, coarse: Column, order: str | None, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``coarse`` (nulls last), ``order`` and id, within ``keys`` if given; ``coarse`` must not fall as ``order`` rises.

    Counts of the coarse ranges, and of finer ones within each (equal ``order``
    and a range of ids), come first, so that a task sorts one fine range only:
    a day with very many rows, or rows without a date, are split.
    """
    text_id = df.schema[id_col].dataType.simpleString() == "string"
    fine = F.left(F.col(id_col), F.lit(TEXT_RANGE)) if text_id else F.floor(F.col(id_col) / ID_RANGE)
    keys = keys or []
    at = df.withColumn("_c", coarse).withColumn("_o", F.col(order) if order else F.lit(0)).withColumn("_f", fine)
    per = at.groupBy(*keys, "_c", "_o", "_f").agg(F.count("*").alias("_n"))
    inner = Window.partitionBy(*keys, "_c").orderBy(F.col("_o").asc_nulls_last(), "_f").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(F.col("_c").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = per.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_c").alias("_cc"), F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_first"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).drop("_n")
    equal = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    per = per.join(first, [*equal, F.col("_c").eqNullSafe(F.col("_cc"))]).select(*(F.col(f"_{k}") for k in keys), F.col("_c").alias("_c2"), F.col("_o").alias("_o2"), F.col("_f").alias("_f2"), (F.col("_before") + F.col("_first")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_c", "_o", "_f").orderBy(id_col))
    same = [*equal, F.col("_c").eqNullSafe(F.col("_c2")), F.col("_o").eqNullSafe(F.col("_o2")), F.col("_f").eqNullSafe(F.col("_f2"))]
    return at.withColumn("_p", place).join(per, same).withColumn(name, (F.col("_start") + F.col("_p")).cast("bigint")).select(*[c for c in df.columns if c != name], name)


def assign_sequence(df: DataFrame, sequence: str, taken_at: str | None, id_col: str) -> DataFrame:
    """Numbers for rows without one, from the largest on (the first is 0), by time (nulls last) and id."""
    day = F.floor(F.col(taken_at) / 86_400) if taken_at else F.lit(0)
    todo = numbered(df.where(F.col(sequence).isNull()).drop(sequence), sequence, day, taken_at, id_col)
    top = df.agg(F.coalesce(F.max(sequence), F.lit(-1)).alias("_top")).withColumn("_one", F.lit(1))
    todo = todo.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn(sequence, F.col(sequence) + F.col("_top"))
    return df.where(F.col(sequence).isNotNull()).unionByName(todo.select(df.columns))


def pending(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows that have no valid result yet."""
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")


def bulk_days(df: DataFrame, ts: Column, most: int = 50) -> DataFrame:
    """(day, n) of the days, as text, with more than ``most`` rows."""
    return df.where(ts.isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def fix_dates(photos: DataFrame, fresh: DataFrame, most: int = 50) -> DataFrame:
    """Re-read rows of days with more than ``most`` photos: the date changes, or a place is newly found.

    ``fresh`` has id, new_taken_at, new_lat, new_lon. A place that is there is kept.
    """
    suspect = bulk_days(photos.where("discarded = 0"), F.timestamp_seconds("taken_at"), most).select(F.to_date("day").alias("_day"))
    at = photos.withColumn("_day", F.to_date(F.timestamp_seconds("taken_at"))).join(suspect.withColumn("_s", F.lit(True)), "_day", "left").join(fresh, "id", "left")
    hit = F.col("_s") & F.col("new_taken_at").isNotNull() & ((F.col("new_taken_at") != F.col("taken_at")) | (F.col("lat").isNull() & F.col("new_lat").isNotNull()))
    changed = {"taken_at": F.col("new_taken_at"), "lat": F.coalesce("lat", "new_lat"), "lon": F.coalesce("lon", "new_lon")}
    return at.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in photos.columns))


def confirm_all(clusters: DataFrame) -> DataFrame:
    """What a review that confirms everything leaves: trips confirmed, and nothing else changed."""
    return update_where(clusters, ~F.coalesce(F.col("confirmed"), F.lit(False)), "confirmed", F.lit(True))


def apply_review(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, action: confirm, rename, discard or skip; name) on clusters: discarded ones become their month, confirmed."""
    at = clusters.join(decisions.select("id", "action", F.col("name").alias("_name")), "id", "left")
    act = F.coalesce(F.col("action"), F.lit("skip"))
    name = F.when((act == "rename") & (F.length("_name") > 0), F.col("_name")).when(act == "discard", F.left("start", F.lit(7))).otherwise(F.col("name"))
    return at.select(
        *(
            name.alias("name") if c == "name" else F.when(act == "discard", F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_trip" else F.when(act.isin("confirm", "rename", "discard"), F.lit(True)).otherwise(F.col(c)).alias(c) if c == "confirmed" else F.col(c)
            for c in clusters.columns
        )
    )
