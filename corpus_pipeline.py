"""A corpus pipeline of five stages: toxicity, SimHash, suffix arrays, mixing and BPE.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows
that its predecessor kept. All but the last return the columns of documents, and
other columns of the input are left out. Ids may be null or repeat (rows are told
apart by all their columns), a null text is empty, and an empty table gives an
empty one; what that means is said at each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, mixing, near_copies, queries, suffix_dedup, toxicity
from lodestream.llm.common import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model learns from the labels of this stage's documents.

    Every row is judged by its own text. Empty texts get the score of a text
    without words, and without usable labels all rows get the toxic share,
    smoothed (a half without any): then everything stays or goes together.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs.select(COLUMNS), model, name="_toxicity").where("_toxicity < 0.5").select(COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, then the smallest checksum of the text; null ids come last.

    Texts without words are copies of one another. Of rows that are equal in
    all columns one stays; unlike texts of one id stay both.
    """
    text = F.md5(F.col("text").cast("binary"))
    whole = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", text.alias("text")), {"ignoreNullFields": "false"})
    rows = docs.select(*COLUMNS, F.md5(whole.cast("binary")).alias("_row"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text.alias("text"), "_row")
    first = near_copies.first_of_groups(rows.select(rank.alias("rank"), "text")).select("first._row")
    return rows.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; characters broken at a cut become U+FFFD.

    Every row stays, if need be with an empty text. Rows of one id don't remove
    from one another, and a null id is later than all others.
    """
    out = suffix_dedup.mark_repeats(docs, keep_text=True, carry=("lang", "source"))
    out = out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves cut or repeated to their target weights; a further epoch repeats a document's row.

    Null languages and sources are leaves of their own; texts without words
    cost nothing and come with every epoch that is begun.
    """
    return mixing.mix(docs, queries.source_domain(), queries.mix_weights()).select(COLUMNS)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row; an empty text has none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", to_ids),
]

#: SQL can't express the learnt and iterative stages; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents.

    What lies between them is written to the checkpoint folder. A stage's rows
    go once the next stage's are written, and the last ones, which the result
    still reads, when the program ends.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            files.delete(before, True)
        before = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
        files.deleteOnExit(root)
    return STAGES[-1][1](spark, docs, sf_dir)
