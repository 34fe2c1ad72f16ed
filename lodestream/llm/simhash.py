"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are equal in at least ``keep`` of ``blocks`` bit blocks if they
differ in at most blocks - keep bits; each choice of such blocks is a candidate
key. Inside a key's task the fingerprints stand in Gray order, neighbours share
most bits, and a tree of nodes with the bits all members share lets whole
groups be ruled out by the differences added up so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, cut, shuffle_width, texts_of, tidy_task
from .components import components
from .pairing import Forest, split_groups

BITS, LEAF, FANOUT = 64, 16, 8


def fingerprint_of(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (see ``fingerprints``)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    ones, n = np.zeros(BITS, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        h = [digest(joined[a:b], 42) for a, b in zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)]
        ones += np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every whole text.

    A-Z are lower-cased, words are runs of other than ASCII white space, and
    shingles are ``width`` words joined by a space, repeats included; with
    fewer words the whole sequence is the one shingle, and with none the
    fingerprint is zero. A bit is set if it is in over half the shingles'
    XXH64 (seed 42). A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint_of(t, width) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return bare(docs, id_col, text_col).mapInArrow(tidy_task(run), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def candidate_masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of all choices of blocks - distance of the blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - distance)]


class GrayTree:
    """Hierarchical index over fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        #: From the leaves up: pattern, mask (bits that all members share) of each node.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.arange(0, len(fps), LEAF)
        ones, both = np.bitwise_or.reduceat(self.fps, starts), np.bitwise_and.reduceat(self.fps, starts)
        self.levels.append((both, ~(ones ^ both)))
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, both = np.bitwise_or.reduceat(ones, starts), np.bitwise_and.reduceat(both, starts)
            self.levels.append((both, ~(ones ^ both)))

    def near(self, other: GrayTree, distance: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (of self, of other) whose fingerprints differ in at most ``distance`` bits.

        Goes down both trees together; a pair of nodes whose shared bits already
        differ too often is dropped with all below it. Yields bounded pieces.
        """
        depth = max(len(self.levels), len(other.levels)) - 1
        top = [min(depth, len(t.levels) - 1) for t in (self, other)]
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(self.levels[top[0]][0])), np.arange(len(other.levels[top[1]][0])), indexing="ij"))
        stack = [(depth, a, b)]
        while stack:
            level, a, b = stack.pop()
            la, lb = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
            (pa_, ma), (pb, mb) = self.levels[la], other.levels[lb]
            keep = np.bitwise_count((pa_[a] ^ pb[b]) & ma[a] & mb[b]) <= distance
            if self is other:
                keep &= a <= b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                for s in range(0, len(a), most // LEAF**2):
                    yield self._leaves(other, a[s : s + most // LEAF**2], b[s : s + most // LEAF**2], distance)
                continue
            step_a, step_b = FANOUT if la == level else 1, FANOUT if lb == level else 1
            for s in range(0, len(a), max(1, most // FANOUT**2)):
                x, y = a[s : s + most // FANOUT**2], b[s : s + most // FANOUT**2]
                x = (x[:, None, None] * step_a + np.arange(step_a)[None, :, None]) + np.zeros((1, 1, step_b), dtype=np.int64)
                y = (y[:, None, None] * step_b + np.arange(step_b)[None, None, :]) + np.zeros((1, step_a, 1), dtype=np.int64)
                ok = (x < len(self.levels[min(level - 1, len(self.levels) - 1)][0])) & (y < len(other.levels[min(level - 1, len(other.levels) - 1)][0]))
                stack.append((level - 1, x[ok], y[ok]))

    def _leaves(self, other: GrayTree, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        x = a[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros((1, 1, LEAF), dtype=np.int64)
        y = b[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((1, LEAF, 1), dtype=np.int64)
        ok = (x < len(self.fps)) & (y < len(other.fps))
        if self is other:
            ok &= x < y
        x, y = x[ok], y[ok]
        hit = np.bitwise_count(self.fps[x] ^ other.fps[y]) <= distance
        return self.order[x[hit]], other.order[y[hit]]


def _task_links(fps: np.ndarray, side: np.ndarray, p: int, q: int, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one task (links of nodes that it joins already add nothing)."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    forest = Forest(len(fps))
    if p == q:
        tree = GrayTree(fps)
        for x, y in tree.near(tree, distance):
            forest.join(x, y)
    else:
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        if len(left) and len(right):
            for x, y in GrayTree(fps[left]).near(GrayTree(fps[right]), distance):
                forest.join(left[x], right[y])
    return forest.edges


def links(fps: DataFrame, distance: int = 4, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that connect all links.

    Within a task only a spanning forest of its links is returned, so a group
    of n near copies gives n edges or so, and not n * n.
    """
    masks = candidate_masks(distance, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)))
    rows = fps.select("fp", F.explode(keys).alias("e")).select("fp", "e.m", "e.key")
    tasks = split_groups(rows, ["m", "key"], "fp", chunk)
    n = shuffle_width(fps.sparkSession)
    tasks = tasks.repartition(n, "m", "key", "p", "q").sortWithinPartitions("m", "key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy() for c in ("m", "key", "p", "q", "side", "fp")]).astype(np.int64)
            if rest is not None:
                part = np.concatenate([rest, part], axis=1)
            last = np.flatnonzero((part[:4] != part[:4, -1:]).any(axis=0))
            end = last[-1] + 1 if len(last) else 0
            rest = part[:, end:]
            yield from edges(part[:, :end])
        if rest is not None:
            yield from edges(rest)

    def edges(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not part.shape[1]:
            return
        cuts = np.flatnonzero((part[:4, 1:] != part[:4, :-1]).any(axis=0)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.shape[1]], strict=True):
            if b - a > 1:
                fp = part[5, a:b]
                out += [(int(fp[i]), int(fp[j])) for i, j in _task_links(fp.view(np.uint64), part[4, a:b], int(part[2, a]), int(part[3, a]), distance)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(tidy_task(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents link if their fingerprints differ in at most ``distance`` bits;
    component_id is the smallest doc_id that links reach, itself included.
    Equal fingerprints are one node, whatever the number of copies. Documents
    without words have the fingerprint zero and link like any others. A null
    text is empty; a document with a null id gets its component's id, too, but
    doesn't name it (null if no other id is there). Ids may repeat; every row
    gives one row. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(nodes, distance, blocks, chunk))
    # node = a fingerprint that has links; component_id = the smallest fingerprint of its component
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first_id", F.coalesce("component_id", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def hex64(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
