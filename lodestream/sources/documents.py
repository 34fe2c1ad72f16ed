"""Video documents, label files and frame arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .. import schemas


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video documents of a file, folder or glob; a document over several lines is one row. The merged file is left out."""
    at = spark.read.schema(schemas.VIDEO).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"))
    return at.where("file <> 'all_chunks.json'")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row per chunk: video, pos, and the chunk's fields; a missing index is the position."""
    at = docs.select("video", "shot_at", "duration", F.posexplode("chunks").alias("pos", "c"))
    return at.select("video", "shot_at", "duration", "pos", "c.*").withColumn("index", F.coalesce("index", F.col("pos").cast("bigint")))


def speech_rows(docs: DataFrame) -> DataFrame:
    return docs.select("video", F.posexplode("speech").alias("pos", "s")).select("video", "pos", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.text").alias("text"))


#: ASCII only, as other letters would be in the documents of videos.
ASCII_JSON = {"pretty": "true", "ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
#: Letters as they are, as in the document of clusters.
PLAIN_JSON = {"pretty": "true", "ignoreNullFields": "false"}


def document_text(row: Column, ascii_only: bool = True) -> Column:
    """A struct as an indented JSON document; nulls are written."""
    return F.to_json(row, ASCII_JSON if ascii_only else PLAIN_JSON)


def write_documents(docs: DataFrame, path: str, name: str, ascii_only: bool = True) -> None:
    """A folder ``<name>=<value>`` with one indented JSON document for each row (of all columns); names are unique."""
    at = docs.select(document_text(F.struct(*docs.columns), ascii_only).alias("value"), F.col(name).alias("_name"))
    at.withColumnRenamed("_name", f"_{name}").write.mode("overwrite").partitionBy(f"_{name}").text(path)


def write_list(rows: DataFrame, path: str, order: str, ascii_only: bool = False) -> None:
    """One JSON array of all rows by ``order`` (unique), written row by row in one task: for tables of a library's clusters."""
    first = rows.agg(F.min(order).alias("_first")).withColumn("_one", F.lit(1))
    body = document_text(F.struct(*rows.columns), ascii_only)
    at = rows.select(F.col(order).alias("_o"), body.alias("_t")).withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")
    lines = at.select(F.lit(1).alias("k"), F.col("_o").alias("o"), F.concat(F.when(F.col("_o") == F.col("_first"), "").otherwise(","), "_t").alias("value"))
    end = lambda k, mark: rows.sparkSession.range(1).select(F.lit(k).alias("k"), F.lit(None).cast(rows.schema[order].dataType).alias("o"), F.lit(mark).alias("value"))
    lines.unionByName(end(0, "[")).unionByName(end(2, "]")).coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, seg, label): the integers of a label file's lines that aren't blank, numbered in order."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    return lines.select("file", F.posexplode("l").alias("seg", "_t")).select("file", F.col("seg").cast("bigint").alias("seg"), F.trim("_t").try_cast("int").alias("label"))


class FrameScores(DataSource):
    """Python data source of HDF5 files of per-frame scores: (video, gt_score). Needs h5py."""

    @classmethod
    def name(cls) -> str:
        return "frame_scores"

    def schema(self) -> str:
        return "video string, gt_score array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options["path"])


class _FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        import h5py  # optional: only where such files are read

        with h5py.File(self.path) as f:
            group = f["tvsum50"]
            for name, scores in zip(group["video"], group["gt_score"], strict=True):
                text = "".join(chr(int(c)) for c in f[name[0]][:].reshape(-1))
                yield text, [float(x) for x in f[scores[0]][:].reshape(-1)]
