"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import folder as ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Later reads survive lost executors, and a non-deterministic input is fixed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver's garbage is collected, which may be
    long after the data have been written to the checkpoint folder.
    """
    for _ in range(3):  # what one round frees in Python, and then in the JVM, frees more in the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # Spark's cleaner works beside the program


def _give_back() -> None:
    """Return a Python worker's free memory to the system.

    Workers serve one task after another; what their allocators hold back adds
    up beside the next operator's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy_task(run: Callable) -> Callable:
    """A function over a task's batches that gives free memory back at its end."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """A function over the tables of a group (of megabytes) that gives free memory back after each.

    Its signature stays, since Spark goes by the number of parameters.
    """

    @functools.wraps(run)
    def tidied(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        _give_back()
        return out

    tidied.__signature__ = inspect.signature(run)
    return tidied


class Memo(dict):
    """A dictionary of short keys that is emptied before it holds more than about ``most`` bytes."""

    def __init__(self, most: int = 16 << 20, longest: int = 64):
        super().__init__()
        self.most, self.longest, self.held = most, longest, 0

    def keep(self, key, value, size: int):
        """Remember a value unless its key is long (``size`` characters); returns the value."""
        if size > self.longest:
            return value
        self.held += 200 + 2 * size
        if self.held > self.most:
            self.clear()
            self.held = 200 + 2 * size
        self[key] = value
        return value


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about ``most`` bytes of one text column."""
    from pyarrow import compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bare(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text (as string) under internal names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
