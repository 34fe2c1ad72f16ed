"""Plans for files and clips: what to copy, cut, merge and rename, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .dml import assign_sequence, update
from .intervals import snap
from .select import classify_ids, ordered_lookup


def merge_documents(docs: DataFrame, order: str = "shot_at", fallback: str = "file") -> DataFrame:
    """Chunks of all documents with one running index: documents with a time first (as text), then by file name.

    Positions are sums over documents, so only one row per document is sorted in one task.
    """
    per = docs.select("video", order, fallback, F.size("chunks").alias("n"))
    by = Window.orderBy(F.col(order).isNull(), F.coalesce(order, fallback), fallback)
    base = per.withColumn("_base", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("video", fallback, "_base")
    at = docs.select("video", fallback, F.posexplode("chunks").alias("pos", "c")).join(base, ["video", fallback])
    return at.select((F.col("_base") + F.col("pos")).cast("bigint").alias("index"), F.col("video").alias("source_video"), "pos", "c")


def speech_by_video(docs: DataFrame, order: str) -> DataFrame:
    """(video, speech): of documents with one video, the last by ``order`` counts."""
    return docs.groupBy("video").agg(F.max_by("speech", order).alias("speech"))


def speech_map(docs: DataFrame, order: str) -> DataFrame:
    """One row: a map of each video's speech; of documents with one video, the last by ``order`` counts.

    For a film's documents, which are few; ``speech_by_video`` is the same without the one row.
    """
    last = speech_by_video(docs, order)
    return last.agg(F.map_from_entries(F.collect_list(F.struct("video", "speech"))).alias("speech"))


def organize_plan(photos: DataFrame, clusters: DataFrame, dest: Column) -> DataFrame:
    """(id, src, folder, name): where each kept photo of a confirmed cluster goes. Equal names of a folder get _dup."""
    numbered = assign_sequence(photos, "organized_seq", "taken_at", "id")
    named = numbered.join(clusters.where("confirmed").select(F.col("id").alias("cluster_id"), F.col("name").alias("trip")), "cluster_id").where("discarded = 0")
    top = numbered.agg(F.max("organized_seq").alias("_top")).withColumn("_one", F.lit(1))
    at = named.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")
    at = at.withColumn("name", text.organized_name(F.col("taken_at"), text.hex_sequence(F.col("organized_seq"), F.col("_top")), F.col("trip"), F.col("path")))
    at = at.withColumn("folder", F.concat_ws("/", dest, text.sanitize(F.col("trip"))))
    n = F.row_number().over(Window.partitionBy("folder", "name").orderBy("id"))
    final = F.when(n == 1, F.col("name")).otherwise(F.concat(text.stem(F.col("name")), F.lit("_dup"), F.when(n > 2, (n - 1).cast("string")).otherwise(F.lit("")), text.suffix(F.col("name"))))
    return at.select("id", F.col("path").alias("src"), "folder", final.alias("name"))


def flag_plan(asked: DataFrame, photos: DataFrame, names: DataFrame, dest: Column) -> DataFrame:
    """(id, outcome, src, dest): what flagging a list of ids does; copies of equal names are numbered."""
    out = classify_ids(asked, photos, "id", "discarded")
    at = out.join(photos.select("id", "path", "cluster_id"), "id", "left").join(names.select(F.col("id").alias("cluster_id"), F.col("name").alias("_n")), "cluster_id", "left")
    folder = F.concat_ws("/", dest, text.sanitize(F.coalesce("_n", F.lit("unclustered"))))
    n = F.row_number().over(Window.partitionBy("outcome", "_f", "_b").orderBy("id"))
    at = at.withColumn("_f", folder).withColumn("_b", text.base_name(F.col("path")))
    to = F.when(F.col("outcome") == "done", F.concat_ws("/", "_f", text.numbered_on_collision(F.col("_b"), n)))
    return at.select("id", "outcome", F.when(F.col("outcome") == "done", F.col("path")).alias("src"), to.alias("dest"))


def unflag_plan(asked: DataFrame, photos: DataFrame, names: DataFrame, listing: DataFrame, dest: Column) -> DataFrame:
    """(id, outcome, path): what taking flags back does, and the copies to delete.

    These are the listed files of the photo's name in its own cluster's folder;
    files of that name elsewhere stay. A photo without such a file has one row
    with a null path.
    """
    out = classify_ids(asked, photos, "id", "discarded")
    at = out.join(photos.select("id", "path", "cluster_id"), "id", "left").join(names.select(F.col("id").alias("cluster_id"), F.col("name").alias("_n")), "cluster_id", "left")
    at = at.withColumn("_to", F.when(F.col("outcome") == "done", F.concat_ws("/", dest, text.sanitize(F.coalesce("_n", F.lit("unclustered"))), text.base_name(F.col("path")))))
    return at.drop("path").join(listing.select("path"), F.col("_to") == F.col("path"), "left").select("id", "outcome", "path")


def set_flags(photos: DataFrame, planned: DataFrame, flag: int) -> DataFrame:
    """Photos with the flag of a plan's done rows set."""
    return update(photos, planned.where("outcome = 'done'").select("id", F.lit(flag).cast("int").alias("flagged")).distinct(), "id")


def edit_list(chunks: DataFrame, speech: DataFrame, selected: DataFrame, margin: float = 0.3) -> DataFrame:
    """(pos, source_video, src_idx, s, e): selected chunks in order, with ends moved out of speech.

    ``chunks`` has source_video, index, start, end, duration; ``speech`` has
    source_video, pos, s_start, s_end; ``selected`` has pos, index. src_idx
    numbers the sources by first use.
    """
    at = selected.join(chunks, "index").withColumnRenamed("pos", "_at")
    ends = at.select("source_video", "duration", "_at", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("t")), F.struct(F.lit(1).alias("side"), F.col("end").alias("t")))).alias("x"))
    ends = ends.select("source_video", "duration", (F.col("_at") * 2 + F.col("x.side")).alias("point_id"), F.col("x.t").alias("t"))
    moved = snap(ends, speech, ["source_video"], "t", margin, "duration")
    both = moved.groupBy("source_video", F.floor(F.col("point_id") / 2).alias("pos")).agg(F.min_by("snapped", "point_id").alias("s"), F.max_by("snapped", "point_id").alias("e"))
    first = at.groupBy("source_video").agg(F.min("_at").alias("_first"))
    first = first.withColumn("src_idx", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int"))
    return both.join(first, "source_video").select("pos", "source_video", "src_idx", "s", "e")


def filter_graph(edits: DataFrame) -> DataFrame:
    """One row: the text of a filter graph that trims each edit and joins them."""
    part = F.format_string("[%d:v]trim=start=%s:end=%s,setpts=PTS-STARTPTS[v%d];[%d:a]atrim=start=%s:end=%s,asetpts=PTS-STARTPTS[a%d]", "src_idx", F.col("s").cast("string"), F.col("e").cast("string"), "pos", "src_idx", F.col("s").cast("string"), F.col("e").cast("string"), "pos")
    label = F.format_string("[v%d][a%d]", "pos", "pos")
    rows = edits.agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p"), label.alias("l")))).alias("r"))
    text_of = lambda c: F.transform("r", lambda x: x[c])
    return rows.select(F.concat(F.array_join(text_of("p"), ";"), F.lit(";"), F.array_join(text_of("l"), ""), F.format_string("concat=n=%d:v=1:a=1[v][a]", F.size("r"))).alias("graph"))


def thumb_seeks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("seek", (F.col("start") + F.col("end")) / 2)


def staged_moves(files: DataFrame, cluster: Column, final: Column) -> DataFrame:
    """(src, dest) of every staged file of a trip, in name order."""
    return files.select(F.col("path").alias("src"), F.concat_ws("/", final, cluster, text.base_name(F.col("path"))).alias("dest")).orderBy(text.base_name(F.col("src")))


def match_organized(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path): organized files of a listing, found by their planned name."""
    return plan.select("id", "name").join(listing.select("path", text.base_name(F.col("path")).alias("name")), "name").select("id", "path")


def highlight_cut(scenes: DataFrame, photos: DataFrame, ids: Column) -> DataFrame:
    """(pos, path, start_sec, end_sec, seconds) of a list of scene ids in its order; a missing one raises an error."""
    at = scenes.join(photos.select(F.col("id").alias("photo_id"), "path"), "photo_id").select("id", "path", "start_sec", "end_sec")
    return ordered_lookup(ids, at, "id").select("pos", "path", "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("seconds"))


def recluster(clusters: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """The fresh clusters, raising an error if confirmed trips would be lost, unless forced."""
    if force:
        return fresh
    lost = clusters.agg(F.count_if(F.col("confirmed") & F.col("is_trip")).alias("_n")).withColumn("_one", F.lit(1))
    checked = F.when(F.col("_n") > 0, F.raise_error(F.format_string("%d confirmed trips are there", "_n")).cast("int")).otherwise(F.lit(1))
    return fresh.withColumn("_one", F.lit(1)).join(F.broadcast(lost), "_one").where(checked == 1).drop("_n", "_one")


def assign_clusters(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """Photos with the cluster that lists them; those in none have none."""
    members = clusters.select(F.col("id").alias("cluster_id"), F.explode("photo_ids").alias("id"))
    return photos.drop("cluster_id").join(members, "id", "left")
