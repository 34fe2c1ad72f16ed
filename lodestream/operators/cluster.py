"""Home detection, geographic splits and trips."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from .sessionize import gap_sessions


def home_cell(df: DataFrame, lat: str = "lat", lon: str = "lon", order: str = "taken_at", tie: str = "id", cell: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """(home_lat, home_lon): the commonest grid cell of dated rows with a place; ties go to the one seen first."""
    seen = df.where(F.col(order).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    cells = seen.groupBy(*(keys or []), geo.grid(F.col(lat), cell).alias("home_lat"), geo.grid(F.col(lon), cell).alias("home_lon")).agg(F.count("*").alias("n"), F.min(F.struct(order, tie)).alias("first"))
    best = F.min_by(F.struct("home_lat", "home_lon"), F.struct((-F.col("n")).alias("n"), "first")).alias("home")
    return cells.groupBy(*(keys or [])).agg(best).select(*(keys or []), "home.home_lat", "home.home_lon")


def home_share(lat: Column, lon: Column, home_lat: Column, home_lon: Column, radius_km: float = 50.0) -> Column:
    """Aggregate: the share of rows with a place that are within the radius of home."""
    near = geo.haversine_km(lat, lon, home_lat, home_lon) <= radius_km
    return F.avg(F.when(lat.isNotNull(), near.cast("double")))


def largest_jump(df: DataFrame, keys: list[str], order: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per group the first longest step between neighbouring rows with a place: (keys, jump_km, pos of the right row)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("pos", F.row_number().over(by) - 1).where(F.col(lat).isNotNull())
    at = at.withColumn("_la", F.lag(lat).over(by)).withColumn("_lo", F.lag(lon).over(by))
    at = at.withColumn("jump_km", F.round(geo.haversine_km(F.col("_la"), F.col("_lo"), F.col(lat), F.col(lon)), 6)).where("jump_km is not null")
    best = at.groupBy(*keys).agg(F.max_by(F.struct("jump_km", "pos"), F.struct("jump_km", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select(*keys, "b.jump_km", F.col("b.pos").cast("bigint").alias("pos"))


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _on_sphere(points: np.ndarray) -> np.ndarray:
    p = np.radians(points)
    return np.stack([np.cos(p[:, 0]) * np.cos(p[:, 1]), np.cos(p[:, 0]) * np.sin(p[:, 1]), np.sin(p[:, 0])], axis=1)


def farthest_km(points: np.ndarray, enough: float = math.inf, leaf: int = 32) -> float:
    """The largest distance of two of the points (rows of degrees), or one over ``enough`` as soon as it is found.

    Two boxes of points are compared at a time, the pair with the largest
    possible distance first, and split until the best distance found is at
    least what any pair left could have.
    """
    points = np.unique(points, axis=0)
    if len(points) < 2:
        return 0.0
    xyz, best, turn = _on_sphere(points), 0.0, 0

    def box(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return own, xyz[own].min(axis=0), xyz[own].max(axis=0)

    def push(a: tuple, b: tuple) -> None:
        nonlocal turn
        chord = np.sqrt((np.maximum(a[2] - b[1], b[2] - a[1]) ** 2).sum())
        most = 2 * geo.EARTH_KM * math.asin(min(1.0, chord / 2)) + 1e-6
        if most > best:
            turn += 1
            heapq.heappush(todo, (-most, turn, a, b))

    todo: list = []
    push(whole := box(np.arange(len(points))), whole)
    while todo and -todo[0][0] > best and best <= enough:
        _, _, a, b = heapq.heappop(todo)
        best = max(best, float(_km(points[a[0][0]], points[b[0][-1]])))
        if max(len(a[0]), len(b[0])) <= leaf:
            best = max(best, float(_km(points[a[0], None, :], points[None, b[0], :]).max()))
            continue
        halves = [(x,) if len(x[0]) <= leaf else tuple(map(box, np.array_split(x[0][np.argsort(xyz[x[0], int((x[2] - x[1]).argmax())], kind="stable")], 2))) for x in (a, b)]
        for i, x in enumerate(halves[0]):
            for y in halves[1][i if a is b else 0 :]:
                push(x, y)
    return best


def spread_km(df: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(keys, spread_km): the largest distance between two places of a key; null without two different rows.

    Equal places are one before they move; a key's different places are
    searched by boxes in one task, so that not all pairs are formed.
    """
    from pyspark.sql import types as T

    places = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*keys, F.col(lat).alias("_la"), F.col(lon).alias("_lo")).agg(F.count("*").alias("_n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        far = farthest_km(rows[["_la", "_lo"]].to_numpy(dtype=float)) if rows["_n"].sum() > 1 else None
        return pd.DataFrame([[*key, None if far is None else round(far, 6)]], columns=[*keys, "spread_km"])

    return places.groupBy(*keys).applyInPandas(run, T.StructType([*(places.schema[k] for k in keys), T.StructField("spread_km", T.DoubleType())]))


def last_far(points: np.ndarray, radius_km: float, leaf: int = 32, few: int = 128) -> np.ndarray:
    """For each point the position of the last one before it that is over the radius away, or -1.

    Equal points are one place. A box of places that is out of a place's reach as a
    whole counts by its last position, one in reach falls out, another is split.
    A ``few`` points are compared directly.
    """
    places, at = np.unique(points, axis=0, return_inverse=True)
    at, out = at.reshape(-1), np.full(len(points), -1, dtype=np.int64)
    if len(points) <= few:
        far = (_km(places[:, None], places[None]) > radius_km)[at[:, None], at]
        return np.where(np.tril(far, -1), np.arange(len(points)), -1).max(axis=1, initial=-1)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(places) + 1))
    xyz, chord = _on_sphere(places), 2 * math.sin(min(radius_km / geo.EARTH_KM, math.pi) / 2)

    def positions(own: np.ndarray) -> np.ndarray:
        n = first[own + 1] - first[own]
        return order[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def pass_on(asked: np.ndarray, own: np.ndarray) -> None:
        rows, seen = positions(asked), np.sort(positions(own))
        before = np.searchsorted(seen, rows)
        out[rows] = np.maximum(out[rows], np.where(before > 0, seen[before - 1], -1))

    todo = [(np.arange(len(places)), np.arange(len(places)))]
    while todo:
        own, asked = todo.pop()
        if len(own) <= leaf:
            for i in range(len(own)):
                far = asked[_km(places[own[i]], places[asked]) > radius_km]
                if len(far):
                    pass_on(far, own[i : i + 1])
            continue
        low, high, x = xyz[own].min(axis=0), xyz[own].max(axis=0), xyz[asked]
        least = np.sqrt((np.maximum(0.0, np.maximum(low - x, x - high)) ** 2).sum(axis=1))
        most = np.sqrt((np.maximum(x - low, high - x) ** 2).sum(axis=1))
        far = least > chord + 1e-9
        if far.any():
            pass_on(asked[far], own)
        asked = asked[~far & (most > chord - 1e-9)]
        if len(asked):
            todo += [(half, asked) for half in np.array_split(own[np.argsort(xyz[own, int((high - low).argmax())], kind="stable")], 2)]
    return out


def split_places(lat: np.ndarray, lon: np.ndarray, radius_km: float, starts: Sequence[int] = (0,), few: int = 128) -> np.ndarray:
    """Segment number of each row of time groups that begin at ``starts``: while a segment spreads over more than the radius, cut it before its first longest jump.

    Numbers go on from group to group, whose starts aren't counted. From where
    each row's reach ends it is known whether any segment is too wide, and the
    jumps are a tree with the first longest on top, so nothing is gone through again for each cut.
    """
    points = np.stack([lat, lon], axis=1)
    own = np.flatnonzero(~np.isnan(points).any(axis=1))
    points, edges, cuts = points[own], [*starts, len(lat)], []
    firsts = np.searchsorted(own, edges)
    jumps = np.zeros(len(own))
    jumps[1:] = np.round(_km(points[:-1], points[1:]), 6)  # millimetres, so that equal jumps are equal everywhere
    far, p = [], 0
    for q, end in zip(firsts[1:].tolist(), [*firsts[2:].tolist(), None], strict=True):
        if end is None or end - p > few:  # small neighbouring groups are looked at together
            far.append(last_far(points[p:q], radius_km, few=few))
            far[-1][far[-1] >= 0] += p
            p = q
    far = np.concatenate(far)
    inside = np.flatnonzero(far >= np.repeat(firsts[:-1], np.diff(firsts)))
    reach = np.full(len(own), len(own))  # the first row that is too far from this one or from one between them
    np.minimum.at(reach, far[inside], inside)
    reach = np.minimum.accumulate(reach[::-1])[::-1].tolist()
    own_rows, jump = own.tolist(), jumps.tolist()
    for a, b, p, q in zip(edges, edges[1:], firsts.tolist(), firsts[1:].tolist(), strict=False):
        if p == q or reach[p] >= q:
            continue
        left, right, open_ = {}, {}, []
        for k in range(p + 1, q):
            below = None
            while open_ and jump[open_[-1]] < jump[k]:
                below = open_.pop()
            left[k] = below
            if open_:
                right[open_[-1]] = k
            open_.append(k)
        todo = [(a, b, p, q, open_[0])]
        while todo:
            a, b, p, q, k = todo.pop()
            if p == q or reach[p] >= q:
                continue
            if jump[k] > 0:
                at, m, parts = own_rows[k], k, (left[k], right.get(k))
            else:  # all jumps are rounded to none: the middle row
                at, parts = a + (b - a) // 2, (k, k)
                m = int(np.searchsorted(own, at))
            cuts.append(at)
            todo += [(a, at, p, m, parts[0]), (at, b, m, q, parts[1])]
    out = np.zeros(len(lat), dtype=np.int64)
    out[np.array(cuts, dtype=np.int64)] = 1
    return np.cumsum(out)


def cluster_counts(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_clusters, n_trips, n_months, n_photos): how many clusters are trips, and what all of them hold."""
    return clusters.groupBy(*(keys or [])).agg(F.count("*").alias("n_clusters"), F.count_if(F.col("is_trip")).alias("n_trips"), F.count_if(~F.col("is_trip")).alias("n_months"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("n_photos"))


def trip_clusters(photos: DataFrame, keys: list[str], gap_days: float = 3.0, radius_km: float = 50.0, home_radius_km: float = 50.0) -> DataFrame:
    """One row per cluster of (keys, id, path, taken_at, lat, lon, place): albums, then time and place groups, then undated rows.

    Albums are trips as they are. The other dated rows are split by time gaps
    and then by place; a group with under 80 % of its places near home is a trip
    (named by its days and commonest place), another is a month and confirmed.
    Undated rows are one cluster. Clusters are numbered within ``keys``, whose
    groups are sorted and split by one task each.
    """
    at = photos.withColumn("album", text.album(F.col("path")))
    albums = at.where("album is not null").withColumn("kind", F.lit(0)).withColumn("part", F.col("album"))
    loose = at.where("album is null and taken_at is not null")
    grouped = gap_sessions(loose, keys, F.col("taken_at"), gap_days * 86_400, ["id"], "gap_id")

    by = Window.partitionBy(*keys).orderBy("taken_at", "id")
    grouped = grouped.withColumn("_row", F.row_number().over(by)).withColumn("_fresh", F.lag("gap_id").over(by).isNull() | (F.lag("gap_id").over(by) != F.col("gap_id")))

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(held)
        lat, lon = (g[c].cast(pa.float64()).to_numpy() for c in ("lat", "lon"))
        starts = np.flatnonzero(g["_fresh"].to_numpy()).tolist()
        segment = pa.array(split_places(lat, lon, radius_km, starts), pa.int64())
        return iter(g.drop_columns(["_row", "_fresh"]).append_column("segment", segment).to_batches())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # what may go on in the next batch: the last time group
        for batch in batches:
            fresh = np.flatnonzero(batch["_fresh"].to_numpy(zero_copy_only=False))
            last = int(fresh[-1]) if len(fresh) else 0
            if len(fresh) and (held or last):
                yield from cut([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from cut(held)

    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in grouped.schema.fields if f.name not in ("_row", "_fresh")), T.StructField("segment", T.LongType())])
    # Many time groups share a call, since most are small and a call for each costs more than its rows.
    timed = grouped.repartition(*keys).sortWithinPartitions(*keys, "_row").mapInArrow(split, schema)
    timed = timed.withColumn("kind", F.lit(1)).withColumn("part", F.format_string("%012d-%012d", "gap_id", "segment")).drop("gap_id", "segment")
    undated = at.where("album is null and taken_at is null").withColumn("kind", F.lit(2)).withColumn("part", F.lit(""))
    homes = home_cell(photos, keys=keys)
    rows = albums.unionByName(timed).unionByName(undated).join(homes, keys, "left")
    near = F.when(F.col("lat").isNotNull(), (geo.haversine_km(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) <= home_radius_km).cast("double"))
    rows = rows.withColumn("_near", near)
    # By place first, then by part, in one pass: two groupings of the rows would split all of them twice.
    per = rows.groupBy(*keys, "kind", "part", "place").agg(
        F.first("album").alias("album"), F.count("*").alias("n"), F.min(F.struct("taken_at", "id")).alias("first"), F.collect_list("id").alias("ids"),
        F.min("taken_at").alias("_start"), F.max("taken_at").alias("_end"), F.sum("_near").alias("_near"), F.count("_near").alias("_placed"),
    )
    named = F.when((F.col("kind") < 2) & (F.col("place") != ""), F.struct((-F.col("n")).alias("n"), "first"))
    out = per.groupBy(*keys, "kind", "part").agg(
        F.first("album").alias("album"), F.sum("n").alias("photo_count"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("photo_ids"), F.min("_start").alias("_start"), F.max("_end").alias("_end"),
        F.try_divide(F.sum("_near"), F.sum("_placed")).alias("_share"), F.min_by("place", named).alias("place"),
    )
    trip = (F.col("kind") == 0) | ((F.col("kind") == 1) & ~F.coalesce(F.col("_share") >= 0.8, F.lit(False)))
    days = F.concat(dates.day_text(F.col("_start")), F.lit("–"), dates.day_text(F.col("_end")))
    name = F.when(F.col("kind") == 0, F.col("album")).when(F.col("kind") == 2, "no-date").when(trip, F.concat_ws(" ", days, "place")).otherwise(dates.month_text(F.col("_start")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("kind", F.when(F.col("kind") == 0, F.col("album")), F.col("_start"), "part"))
    return out.select(
        *keys, number.cast("bigint").alias("cluster_id"), name.alias("name"), "album", trip.alias("is_trip"), ((F.col("kind") > 0) & ~trip).alias("confirmed"),
        "photo_count", "photo_ids", dates.day_text(F.col("_start")).alias("start"), dates.day_text(F.col("_end")).alias("end"), "place",
    )
