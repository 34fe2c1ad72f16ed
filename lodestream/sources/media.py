"""Scans of media trees, sidecars and embedded metadata."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, jsontext, text
from ..operators.dml import insert_or_ignore, numbered

# EXIF tags.
TAG_DATE_ORIGINAL, TAG_DATE, TAG_EXIF_IFD, TAG_GPS_IFD = 36867, 306, 34665, 34853


#: Files whose metadata are read from their bytes, and how many bytes such a file may have.
READ_SUFFIXES, MOST_BYTES = (".jpg", ".jpeg", ".png"), 256 << 20


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = text.SCAN_SUFFIXES, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content]) of the media files below a folder.

    Contents are read only if asked for, and only of pictures of up to
    MOST_BYTES (``unread`` lists the larger ones); videos' bytes are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    every = files.load(root).where(text.suffix(F.col("path")).isin(*suffixes)).select("path", "modificationTime", "length")
    if not content:
        return every
    small = [files.option("pathGlobFilter", f"*{s}").load(root).where(F.col("length") <= MOST_BYTES) for s in _any_case(READ_SUFFIXES)]
    bytes_ = reduce(DataFrame.unionByName, small).select("path", "content")
    return every.join(bytes_, "path", "left")


def _any_case(suffixes: tuple[str, ...]) -> list[str]:
    """Glob patterns that match suffixes whatever their letters' case; no file matches two."""
    return ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]


def unread(files: DataFrame) -> DataFrame:
    """(path, length) of the pictures that are too large for their metadata to be read."""
    return files.where(text.suffix(F.col("path")).isin(*READ_SUFFIXES) & (F.col("length") > MOST_BYTES)).select("path", "length")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(sidecar_path, raw) of the JSON files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return files.select(F.col("path").alias("sidecar_path"), F.col("content").cast("string").alias("raw"))


def with_sidecar(files: DataFrame, cars: DataFrame) -> DataFrame:
    """Adds side (taken_at, lat, lon): of the three possible names, the first that exists and parses."""
    good = cars.where(F.expr("try_parse_json(raw)").isNotNull()).select(F.col("sidecar_path").alias("_side"), jsontext.sidecar(F.col("raw")).alias("_s"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    names = (F.concat("path", F.lit(".supplemental-metadata.json")), F.concat("path", F.lit(".json")), F.concat(folder, text.stem(F.col("path")), F.lit(".json")))
    tries = files.select("path", F.posexplode(F.array(*names)).alias("_i", "_side")).join(good, "_side")
    best = tries.groupBy("path").agg(F.min_by("_s", "_i").alias("side"))
    return files.join(best, "path", "left")


def _ifd(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    n = struct.unpack_from(order + "H", data, at)[0]
    found = {}
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
        size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
        where = at + 2 + 12 * i + 8
        if size > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        found[tag] = (kind, count, data[where : where + size])
    return found


def _degrees(value: tuple[int, int, bytes], ref: tuple[int, int, bytes] | None, order: str) -> float:
    nums = struct.unpack(order + "6I", value[2][:24])
    d, m, s = (a / b if b else 0.0 for a, b in zip(nums[::2], nums[1::2], strict=True))
    sign = -1 if ref and ref[2][:1] in (b"S", b"W") else 1
    return sign * (d + m / 60 + s / 3600)


def exif_of(content: bytes | None) -> tuple[str | None, float | None, float | None]:
    """(date text, latitude, longitude) in the EXIF block of a JPEG or PNG file; anything damaged gives nulls."""
    content = content or b""
    try:
        mark = b"Exif\0\0" if content[:2] == b"\xff\xd8" else b"eXIf"
        at = content.find(mark)
        if content[:8] != b"\x89PNG\r\n\x1a\n" and content[:2] != b"\xff\xd8" or at < 0:
            return None, None, None
        data = content[at + len(mark) : at + len(mark) + 65_536]
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        main = _ifd(data, struct.unpack_from(order + "I", data, 4)[0], order)
        sub = _ifd(data, struct.unpack(order + "I", main[TAG_EXIF_IFD][2])[0], order) if TAG_EXIF_IFD in main else {}
        date = sub.get(TAG_DATE_ORIGINAL) or main.get(TAG_DATE_ORIGINAL) or main.get(TAG_DATE)
        when = date[2].split(b"\0")[0].decode("ascii", "replace") if date else None
        gps = _ifd(data, struct.unpack(order + "I", main[TAG_GPS_IFD][2])[0], order) if TAG_GPS_IFD in main else {}
        if 2 in gps and 4 in gps:
            return when, _degrees(gps[2], gps.get(1), order), _degrees(gps[4], gps.get(3), order)
        return when, None, None
    except (KeyError, struct.error, IndexError):
        return None, None, None


def exif(content: Column) -> Column:
    """Struct (date, lat, lon) by a reader of EXIF blocks, in Arrow batches."""

    @F.pandas_udf("date string, lat double, lon double")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exif_of(c) for c in x], columns=["date", "lat", "lon"])

    return run(content)


def metadata(files: DataFrame, with_exif: bool = True) -> DataFrame:
    """(path, taken_at, lat, lon): dates from EXIF, sidecar, file name, file time, in this order; places from EXIF, then sidecar.

    ``files`` has path, modificationTime, side and, for EXIF, content.
    """
    if with_exif:
        files = files.withColumn("_e", F.when(text.suffix(F.col("path")) != ".heic", exif(F.col("content"))))
        own = dates.exif_epoch(F.col("_e.date"))
        lat, lon = F.col("_e.lat"), F.col("_e.lon")
    else:
        own, lat, lon = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("double")
    taken = F.coalesce(own, F.col("side.taken_at"), dates.filename_epoch(text.base_name(F.col("path"))), F.unix_seconds("modificationTime"))
    placed = lat.isNotNull() & lon.isNotNull()
    return files.select("path", taken.alias("taken_at"), F.when(placed, lat).otherwise(F.col("side.lat")).alias("lat"), F.when(placed, lon).otherwise(F.col("side.lon")).alias("lon"))


def place_name(address: Column) -> Column:
    """"City, Country" of an address struct (city, town, village, county, country); empty parts fall out."""
    town = F.coalesce(*(F.nullif(address[c], F.lit("")) for c in ("city", "town", "village", "county")))
    return F.nullif(F.concat_ws(", ", town, F.nullif(address["country"], F.lit(""))), F.lit(""))


def with_place(rows: DataFrame, gazetteer: DataFrame, cell: float = 0.1) -> DataFrame:
    """Adds place by the grid cell of a place; ``gazetteer`` has cell_lat, cell_lon (grid numbers) and place, once a cell."""
    at = rows.withColumn("cell_lat", F.rint(F.col("lat") / cell).cast("bigint")).withColumn("cell_lon", F.rint(F.col("lon") / cell).cast("bigint"))
    return at.join(gazetteer, ["cell_lat", "cell_lon"], "left").drop("cell_lat", "cell_lon")


def library_scan(spark: SparkSession, root: str, existing: DataFrame, gazetteer: DataFrame | None = None, with_exif: bool = True) -> DataFrame:
    """The library with the folder's new files; rows that are there stay as they are, and ids go on from the largest (at first 1) in order of path."""
    found = metadata(with_sidecar(scan(spark, root, content=with_exif), sidecars(spark, root)), with_exif)
    found = with_place(found, gazetteer) if gazetteer is not None else found.withColumn("place", F.lit(None).cast("string"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).withColumn("_one", F.lit(1))
    fresh = numbered(found.join(existing.select("path"), "path", "left_anti"), "id", F.lit(0), None, "path")
    fresh = fresh.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn("id", F.col("id") + F.col("_top"))
    blank = [F.lit(0).alias("discarded"), F.lit(0).alias("flagged")]
    return insert_or_ignore(existing, fresh.select("id", "path", "taken_at", "lat", "lon", "place", *blank).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in existing.schema if f.name not in ("id", "path", "taken_at", "lat", "lon", "place", "discarded", "flagged"))), "path")


def probe(raw: Column) -> Column:
    """(duration, shot_at) of a prober's JSON; the maker's creation date goes before the file's, and empty is null."""
    tag = lambda k: F.nullif(F.get_json_object(raw, f"$.format.tags['{k}']"), F.lit(""))
    shot = F.coalesce(tag("com.apple.quicktime.creationdate"), tag("creation_time"))
    return F.struct(F.get_json_object(raw, "$.format.duration").try_cast("double").alias("duration"), shot.alias("shot_at"))


def video_listing(explicit: DataFrame, listed: DataFrame) -> DataFrame:
    """(video, shot_at) of named videos and of a listing's .mov and .mp4 files, each once, by time (nulls last) and path."""
    keep = listed.where(F.col("video").rlike(r"\.(?:mov|MOV|mp4|MP4)$"))
    both = explicit.unionByName(keep).groupBy("video").agg(F.max("shot_at").alias("shot_at"))
    return both.orderBy(F.col("shot_at").isNull(), "shot_at", "video")


