"""Groups of texts whose sets of five-word shingles are alike (Jaccard 0.8 or more).

Candidates share a band of min-hashes. Inside a key's task a Gray-order tree
gives the pairs within a wide SimHash distance, and what is passed on is
compared exactly, set by set. Small groups pass on all pairs. Large ones pass
on some disjoint forests, nearest pairs first, and what connects the pairs that
they leave over. Texts connected so, if they are in several groups by then, meet
with their sets in blocks, where those of different groups are compared exactly:
so every candidate pair is compared, or its texts are in one group already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ragged
from .common import cut, release, shuffle_width, slices, texts_of, tidy_group, tidy_task
from .components import components
from .pairing import Forest, split_groups
from .simhash import BITS, GrayTree

#: Words of a shingle. Two sets of a and b shingles, c of them shared, are alike if c / (a + b - c) >= 4 / 5.
WIDTH = 5
#: Bands of so many min-hashes: 1 - (1 - 0.8^6)^20 = 0.998 of the pairs at the similarity share one.
BANDS, ROWS = 20, 6
#: Bits that fingerprints of a candidate pair may differ in; 9.7 on average at the similarity, spread 2.9.
DISTANCE = 22
#: Rows of a task up to which all of its pairs go through joins, and the forests of a larger one that do. Blocks compare
#: whatever is left over, so these decide only where a pair is compared, not whether.
FEW, LAYERS = 16, 0
#: Shingles that each side of a block has at most, or so.
LOAD = 1 << 20

#: Of a candidate pair's 120 min-hashes (a byte of each) so many must be equal before its sets are fetched: 96 are on
#: average at the similarity, spread 4.4, so 2 in 10^7 such pairs have fewer.
LEAST_EQUAL = 72

_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; all words are one shingle if they are fewer than WIDTH."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64))


def _node(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def _sketch(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """SimHash of a set, its band keys, and a byte of each of its min-hashes."""
    ones, least = np.zeros(BITS, dtype=np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 512):
        part = h[at : at + 512]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[None, :] ^ _FLIP) * _ODD).min(axis=1))
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"), key, (least >> np.uint64(24)).astype(np.uint8).view(np.int8)


def sketches(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but the text, and node (hash of the set), fp, n (its size) and the band keys."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "node long", "fp long", "n int", "keys array<long>", "mins array<tinyint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                node, fp, size, keys, mins = [], [], [], [], []
                for text in texts_of(part, "text"):
                    h = shingles(text)
                    bits, key, least = _sketch(h)
                    node.append(_node(h))
                    fp.append(bits)
                    size.append(len(h))
                    mins.append(least)
                    keys.append(key.view(np.int64) if len(h) else np.zeros(0, np.int64))
                cells = [part.column(f.name) for f in kept]
                cells += [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, fp)]
                cells += [pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays(cells, names=[*(f.name for f in kept), "node", "fp", "n", "keys", "mins"])

    return rows.mapInArrow(tidy_task(run), schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node and its set of shingle hashes, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                sets = [shingles(t) for t in texts_of(part, "text")]
                node = np.array([_node(h) for h in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "set"])

    return texts.select("text").mapInArrow(tidy_task(run), "node long, set array<long>").groupBy("node").agg(F.any_value("set").alias("set"))


def _task_links(fp: np.ndarray, n: np.ndarray, side: np.ndarray, p: int, q: int, layers: int, few: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """One task's candidate pairs to compare one by one, and a spanning forest of the others.

    All pairs of a few rows are to be compared, else the edges of ``layers``
    disjoint forests, nearest fingerprints first.
    """
    found = []
    if p == q:
        left = right = np.arange(len(fp))
        trees = (tree := GrayTree(fp), tree)
    else:
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        if not (len(left) and len(right)):
            return [], []
        trees = GrayTree(fp[left]), GrayTree(fp[right])
    for x, y in trees[0].near(trees[1], DISTANCE):
        x, y = left[x], right[y]
        like = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
        found.append(np.stack([x[like], y[like]]).astype(np.int32))
    if not found:
        return [], []
    x, y = np.concatenate(found, axis=1)
    if len(fp) <= few:
        return list(zip(x.tolist(), y.tolist(), strict=True)), []
    order = np.argsort(np.bitwise_count(fp[x] ^ fp[y]), kind="stable")
    x, y, out = x[order], y[order], []
    for _ in range(layers):
        if not len(x):
            break
        forest, apart = Forest(len(fp)), np.bitwise_count(fp[x] ^ fp[y])
        for start, stop in zip(*(np.searchsorted(apart, np.unique(apart), side=s) for s in ("left", "right")), strict=True):
            forest.join(x[start:stop], y[start:stop])
        out += forest.edges
        used = np.array([i * len(fp) + j for i, j in forest.edges], dtype=np.int64)
        left_over = ~np.isin(x.astype(np.int64) * len(fp) + y, used)
        x, y = x[left_over], y[left_over]
    rest = Forest(len(fp))
    rest.join(x, y)
    return out, rest.edges


def candidates(nodes: DataFrame, chunk: int = 1024, layers: int = LAYERS, few: int = FEW) -> DataFrame:
    """Distinct (a, b, rest): pairs of nodes that are to be compared, and where ``rest`` is true edges that connect all other candidates."""
    rows = nodes.select("node", "fp", "n", F.posexplode("keys").alias("m", "key"))
    tasks = split_groups(rows, ["m", "key"], "node", chunk)
    tasks = tasks.repartition(shuffle_width(nodes.sparkSession), "m", "key", "p", "q").sortWithinPartitions("m", "key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy() for c in ("m", "key", "p", "q", "side", "fp", "n", "node")]).astype(np.int64)
            if rest is not None:
                part = np.concatenate([rest, part], axis=1)
            last = np.flatnonzero((part[:4] != part[:4, -1:]).any(axis=0))
            end = last[-1] + 1 if len(last) else 0
            rest = part[:, end:]
            yield edges(part[:, :end])
        if rest is not None:
            yield edges(rest)

    def edges(part: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((part[:4, 1:] != part[:4, :-1]).any(axis=0)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.shape[1]], strict=True):
            if b - a > 1:
                node = part[7, a:b]
                both = _task_links(part[5, a:b].view(np.uint64), part[6, a:b], part[4, a:b], int(part[2, a]), int(part[3, a]), layers, few)
                out += [(*sorted((int(node[i]), int(node[j]))), rest) for rest, found in zip((False, True), both, strict=True) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "rest"])

    return tasks.mapInArrow(tidy_task(run), "a long, b long, rest boolean").distinct()


def _block_links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, p: int, q: int, hashes: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, row) of a block that join its groups; rows of different groups are compared exactly, as far as they are still apart."""
    _, ids = np.unique(hashes, return_inverse=True)
    begin, out = np.cumsum(size) - size, []
    inside, group = np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool), group.copy()
    order = np.arange(len(fp))
    for i in order if p == q else np.flatnonzero(side == p):
        j = np.flatnonzero((order > i if p == q else side == q) & (group != group[i]))
        j = j[(np.bitwise_count(fp[j] ^ fp[i]) <= DISTANCE) & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))]
        own = ids[begin[i] : begin[i] + size[i]]
        inside[own] = True
        for at in range(0, len(j), 256):
            k = j[at : at + 256]
            shared = np.add.reduceat(inside[_ragged(ids, begin[k], size[k])], np.cumsum(size[k]) - size[k], dtype=np.int64)
            for x in k[9 * shared >= 4 * (size[k] + size[i])].tolist():
                if group[x] != group[i]:
                    out.append((int(i), x))
                    group[group == group[x]] = group[i]
        inside[own] = False
    return out


def links_in_blocks(rows: DataFrame, chunk: int, load: int = LOAD) -> DataFrame:
    """Links (a, b) that join groups within a cluster; ``rows`` has cluster, node, group, fp, n and the set of each node."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        node, group, side = (table.column(c).to_numpy() for c in ("node", "group", "side"))
        sets = table.column("set").combine_chunks()
        found = _block_links(table.column("fp").to_numpy().view(np.uint64), group, side, key[1].as_py(), key[2].as_py(), sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64))
        return pa.table([pa.array([int(node[e[k]]) for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return split_groups(rows, ["cluster"], "node", chunk, "n", load).groupBy("cluster", "p", "q").applyInArrow(tidy_group(block), "a long, b long")


def first_of_groups(rows: DataFrame, chunk: int = 1024, few: int = FEW, layers: int = LAYERS) -> DataFrame:
    """The least ``rank`` (a struct) of each group of near copies, in column ``first``.

    ``rows`` has the columns rank and text. Texts link if their sets of
    shingles have a Jaccard similarity of 0.8 or more; a group is what links
    reach. Equal sets are one node, whatever the number of copies; texts
    without words are copies of each other. A null text is empty.
    """
    spark = rows.sparkSession
    marked = rows.select("rank", F.md5(F.col("text").cast("binary")).alias("mark"), "text")
    nodes = cut(sketches(marked).groupBy("node").agg(F.min("rank").alias("rank"), F.min("mark").alias("mark"), *(F.any_value(c).alias(c) for c in ("fp", "n", "keys", "mins"))))

    found = cut(candidates(nodes, chunk, layers, few))
    release(spark)
    mins = [nodes.select(F.col("node").alias(c), F.col("mins").alias(f"mins_{c}")) for c in ("a", "b")]
    equal = F.size(F.filter(F.zip_with("mins_a", "mins_b", lambda x, y: x == y), lambda e: e))
    pairs = cut(found.where("not rest").join(mins[0], "a").join(mins[1], "b").where(equal >= LEAST_EQUAL).select("a", "b"))
    crowds = cut(components(found.where("rest").select("a", "b")).withColumnRenamed("component_id", "cluster"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node")).distinct()
    texts = marked.join(nodes.join(ends, "node", "left_semi").select("mark"), "mark", "left_semi")
    sets = cut(shingle_sets(texts))
    side = [sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b")]
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = cut(pairs.join(side[0], "a").join(side[1], "b").where(9 * shared >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b"))
    release(spark)
    joined = cut(components(links))

    # Only clusters of several groups have pairs that may still link.
    crowds = crowds.join(joined, "node", "left").withColumn("group", F.coalesce("component_id", "node")).drop("component_id")
    apart = crowds.groupBy("cluster").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi")).where("_lo < _hi").select("cluster")
    crowds = cut(crowds.join(apart, "cluster", "left_semi"))
    if not crowds.isEmpty():
        more = cut(links_in_blocks(crowds.join(nodes.select("node", "fp", "n"), "node").join(sets, "node"), chunk))
        if not more.isEmpty():
            joined = components(links.unionByName(more))
    roots = nodes.select("node", "rank").join(joined, "node", "left").groupBy(F.coalesce("component_id", "node").alias("root"))
    return roots.agg(F.min("rank").alias("first")).select("first")
