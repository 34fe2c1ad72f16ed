"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors are projected on many random lines. On each line, two vectors
collide if one lies in the window around the other; pairs with enough
collisions are verified by their cosine in double precision. Window and count
are calibrated at the threshold, where the difference of two vectors projects
to a normal with a known spread. Labels with many vectors are first split by
the signs of a few further projections, in several tables, so that the work for
a vector doesn't grow with the size of its label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ragged
from .common import cut, shuffle_width, tidy_task
from .components import components
from .pairing import Forest, split_groups

SEED, MOST_BITS = 20_240_601, 40


class Plan:
    """Window, collision count and tables for a threshold, by their recall there.

    Of the pairs at the threshold at least ``recall`` meet in a table, and as
    many of those have enough collisions; above it, more. A recall of 1 is the
    exact way: all vectors of a label meet, in blocks, and all pairs are verified.
    """

    def __init__(self, threshold: float, lines: int = 48, cell: int = 256, recall: float = 0.9999):
        self.exact = recall >= 1
        self.threshold, self.lines, self.cell = threshold, lines, cell
        gap = math.sqrt(max(2 - 2 * threshold, 1e-12))
        # Half of the pairs at the threshold collide on a line: 0.6745 is the normal's upper quartile.
        self.window = 0.6745 * gap
        miss, self.least = 0.5**lines, 0
        while miss <= 1 - recall and self.least < lines:
            self.least += 1
            miss += math.comb(lines, self.least) * 0.5**lines
        agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        self.tables = [1] + [1 if self.exact else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**b))) for b in range(1, MOST_BITS + 1)]

    @property
    def most_bits(self) -> int:
        return 0 if self.exact else MOST_BITS

    def directions(self, dim: int) -> np.ndarray:
        return np.random.default_rng([SEED, dim]).standard_normal((self.lines, dim))

    def cells(self, unit: np.ndarray, bits: int) -> np.ndarray:
        """A sign code of each vector in each table."""
        planes = np.random.default_rng([SEED, unit.shape[1], bits]).standard_normal((self.tables[bits], max(bits, 1), unit.shape[1]))
        if not bits:
            return np.zeros((len(unit), 1), dtype=np.int64)
        return np.stack([((unit @ p.T) > 0) @ (1 << np.arange(bits, dtype=np.int64)) for p in planes], axis=1)


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """Collisions of each pair: on every line (row), right is sorted and each left value queries a window around it."""
    n, m = left.shape[1], right.shape[1]
    counts, met, held = np.zeros(n * m, dtype=np.int64), [], 0
    row = np.arange(n) * m
    for x, y in zip(left, right, strict=True):
        order = np.argsort(y)
        there = y[order]
        low, hits = (at := np.searchsorted(there, x - window)), np.searchsorted(there, x + window, side="right") - at
        met.append(_ragged(order, low, hits) + np.repeat(row, hits))
        held += len(met[-1])
        if held > 4 * n * m:
            counts += np.bincount(np.concatenate(met), minlength=n * m)
            met, held = [], 0
    if met:
        counts += np.bincount(np.concatenate(met), minlength=n * m)
    return counts.reshape(n, m)


def _task(plan: Plan, x: np.ndarray, cells: np.ndarray, table: int, side: np.ndarray, p: int, q: int, mult: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of one task: copies linked to each row, and the edges of a spanning forest."""
    lines = plan.directions(x.shape[1]) @ x.T
    left = np.arange(len(x)) if p == q else np.flatnonzero(side == p)
    right = left if p == q else np.flatnonzero(side == q)
    linked, forest = np.zeros(len(x), dtype=np.int64), Forest(len(x))
    for s in range(0, len(left), 256):
        mine = left[s : s + 256]
        if plan.exact:
            a, b = np.repeat(mine, len(right)), np.tile(right, len(mine))
        else:
            a, b = np.nonzero(collisions(lines[:, mine], lines[:, right], plan.window) >= plan.least)
            a, b = mine[a], right[b]
        # A pair counts in the first table where it meets, and once in that.
        new = ~(cells[a, :table] == cells[b, :table]).any(axis=1)
        if p == q:
            new &= a < b
        a, b = a[new], b[new]
        near = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65_536]], x[b[k : k + 65_536]]) for k in range(0, len(a), 65_536)]) if len(a) else np.zeros(0)
        a, b = a[near >= plan.threshold], b[near >= plan.threshold]
        linked += np.bincount(a, weights=mult[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=mult[a], minlength=len(x)).astype(np.int64)
        forest.join(a, b)
    return linked, forest.edges


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, chunk: int = 2048, plan: Plan | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Two vectors link if their labels are equal and not null, their lengths are
    equal, and their cosine in double precision is at least ``threshold``; every
    link returned holds. At the threshold 0.9998 of the links are found, by
    calculation (more above it); with Plan(threshold, recall=1) all are. Equal vectors of a label are one node with a count,
    so copies link without being compared. A vector that is null, empty or zero
    or has a null or non-finite component, and one without a label, links with
    nothing. component_id is the smallest id that links reach, itself included
    (null ids don't name a component), and kept is vec_id = component_id. Ids
    may be null or repeat; every row gives one row.
    """
    plan = plan or Plan(threshold)
    at = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").cast("long").alias("label"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    at = at.withColumn("ok", valid).withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))

    nodes = at.where("ok").groupBy("h", "label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(plan.most_bits), F.floor(F.log2(F.col("n") / plan.cell)).cast("int")))
    routed = nodes.select("node", "label", "mult", F.col("v").cast("array<double>").alias("v")).join(sizes.select("label", bits.alias("bits")), "label")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("v")])
            bits = batch.column("bits").to_numpy()
            cells: list = [None] * batch.num_rows
            for dim, b in {*zip(dims.tolist(), bits.tolist())}:
                own = np.flatnonzero((dims == dim) & (bits == b))
                flat = batch.column("v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
                for i, c in zip(own.tolist(), plan.cells(unit_rows(flat, dim), b), strict=True):
                    cells[i] = c.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("mult"), batch.column("v"), pa.array(dims), pa.array(cells, pa.list_(pa.int64()))], names=["node", "label", "mult", "v", "dim", "cells"])

    routed = routed.mapInArrow(tidy_task(route), "node long, label long, mult long, v array<double>, dim long, cells array<long>")
    slots = routed.select("*", F.posexplode("cells").alias("tab", "cell"))
    key = ["label", "dim", "tab", "cell"]
    tasks = split_groups(slots, key, "node", chunk)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("label", "dim", "tab", "cell", "p", "q")]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and last != where[:, a].tolist():
                    yield from done(held, last)
                    held = []
                last = where[:, a].tolist() if b > a else last
                held += [batch.slice(a, b - a)] if b > a else []
        if held:
            yield from done(held, last)

    def done(held: list[pa.RecordBatch], where: list[int]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held).combine_chunks()
        node, mult, side = (group.column(c).to_numpy() for c in ("node", "mult", "side"))
        x = unit_rows(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), where[1])
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        linked, edges = _task(plan, x, cells, where[2], side, where[4], where[5], mult)
        some = np.flatnonzero(linked)
        a = np.concatenate([node[some], node[[i for i, _ in edges]]]) if len(some) or edges else np.zeros(0, np.int64)
        b = pa.array([None] * len(some) + node[[j for _, j in edges]].tolist(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), b, pa.array(linked[some].tolist() + [None] * len(edges), pa.int64())], names=["a", "b", "n"])

    order = [*key, "p", "q"]
    found = tasks.select("node", "mult", "v", "cells", "side", *order).repartition(shuffle_width(vectors.sparkSession), *order).sortWithinPartitions(*order)
    found = cut(found.mapInArrow(tidy_task(work), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("node", "h", "label", "v", "first_id", "mult").join(counts, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("component_id", "node")).drop("component_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("h", F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = at.where("ok").join(named, "h").where("label = _label and v = _v").select("vec_id", "n_links", "component_id")
    alone = at.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
