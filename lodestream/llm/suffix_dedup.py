"""Exact substring deduplication with suffix arrays.

Every window of ``length`` bytes is marked that also starts in a document with
a smaller id. Windows are routed by the least hash of the 32-byte strings in
them: equal windows have equal least hashes, so only windows whose hash occurs
in two documents can match. The stretches of such windows go to the hash's
shard, where a suffix array of the shard's distinct stretches (refined by prefix
doubling as by Larsson and Sadakane) and Kasai's common prefixes give the classes
of equal windows. A shard that is larger than one array is several arrays, merged
by binary search.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pack, _ragged, _unpack
from .common import cut, release, shuffle_width, slices, texts_of, tidy_group, tidy_task

#: A multiple of 8. The longer, the fewer hashes are shared by windows that differ, and the more stretches there are.
GRAM = 32
LATEST = (1 << 63) - 1


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)]).view(">u8").reshape(-1).astype(np.uint64)


def least_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """For each window start, the least hash (48 bits) of the GRAM-byte strings in the window."""
    with np.errstate(over="ignore"):
        w = _words8(buf) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(32)
        n = max(len(buf) - GRAM + 1, 0)
        h = w[:n]
        for at in range(8, GRAM, 8):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + w[at : at + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
        h >>= np.uint64(16)
    span, have = length - GRAM + 1, 1
    while have < span:  # minimum over 1, 2, 4, ... places
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def stretches(texts: list[bytes], length: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of window starts with one least hash: (text's index, first start, number of starts, hash).

    Works on about ``most`` bytes at a time, long texts in pieces.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), most):
            piece = t[at : at + most + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= most:
                yield _runs(held, length)
                held, size = [], 0
    if held:
        yield _runs(held, length)


def _runs(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    h = least_hashes(buf, length)
    # A run ends where the hash changes, at a piece's last window, and where the next piece begins.
    new = np.empty(len(h), dtype=bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[begin] = True
    dead = ends - length + 1
    new[dead[dead < len(h)]] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(h))
    piece = np.searchsorted(ends, start, side="right")
    live = start < dead[piece]
    start, stop, piece = start[live], stop[live], piece[live]
    index, offset = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
    return index[piece], start - begin[piece] + offset[piece], stop - start, h[start]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text``, sorted by at least ``depth`` bytes, and each suffix's rank.

    Ranks by eight bytes are refined by pairs of ranks at doubled distance; only
    suffixes whose rank is shared are sorted again (Larsson and Sadakane).
    """
    key = _words8(text)
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    rank = np.empty(len(order) + 1, dtype=np.int64)
    rank[order], rank[-1] = first, -1
    have = 8
    while have < depth:
        alone = fresh & np.append(fresh[1:], True)
        where = np.flatnonzero(~alone)
        if not len(where):
            break
        own = order[where]
        nxt = rank[np.minimum(own + have, len(order))]
        # The group (its first place) leads, so sorting keeps every group in its places.
        pair = first[where] * np.int64(len(order) + 2) + (nxt + 1)
        move = np.argsort(pair)
        own, pair = own[move], pair[move]
        order[where] = own
        split = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh[where] = split
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        rank[order] = first
        have *= 2
    return order, rank[:-1]


#: Walks through the text that go on side by side.
LANES = 65_536


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, up to ``most``.

    ``order`` is a whole suffix array, sorted by at least ``most`` bytes. By
    Kasai's walk in the text's order: a suffix shares with its predecessor at
    least what the suffix a place earlier did, less one byte (if the sorting
    went far enough to keep the two in order). The text is cut into lanes that
    are walked at the same time, eight bytes at a comparison.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    word = np.concatenate([_words8(text), np.zeros(most + 8, np.uint64)])
    before = np.full(n, n, dtype=np.int64)  # the suffix before each one in the array; n is none
    before[order[1:]] = order[:-1]
    place = np.empty(n + 1, dtype=np.int64)
    place[order], place[n] = np.arange(n), n
    steps = -(-n // LANES)
    start, shared, found = np.arange(0, n, steps), np.zeros(-(-n // steps), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for t in range(steps):
        i = start[: len(start) if start[-1] + t < n else -1] + t
        j, h = before[i], np.maximum(shared[: len(i)] - 1, 0)
        if t:
            h[place[np.minimum(before[i - 1] + 1, n)] > place[i]] = 0
        open_ = np.arange(len(i))
        while len(open_):
            diff = word[i[open_] + h[open_]] ^ word[j[open_] + h[open_]]
            same = diff == 0
            apart = open_[~same]
            h[apart] += (diff[~same].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            open_ = open_[same]
            h[open_] += 8
            open_ = open_[h[open_] < most]
        # Suffixes at the text's end share no more bytes than they have.
        shared[: len(i)] = found[i] = np.minimum(np.minimum(h, most), n - np.maximum(i, j))
    return found[order]


class Array:
    """Classes of equal windows of one suffix array, with the least document of each."""

    def __init__(self, pieces: list[bytes], least: np.ndarray, length: int):
        self.text, self.length = np.frombuffer(b"".join(pieces), dtype=np.uint8), length
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        window = np.arange(len(self.text)) + length <= np.repeat(ends, sizes)
        order, _ = suffix_order(self.text, length)
        shared = common_prefixes(self.text, order, length)
        # Suffixes that aren't windows fall out; neighbours that are left share the least of what stood between them.
        left = np.flatnonzero(window[order])
        shared = np.minimum.reduceat(shared[: left[-1] + 1], np.concatenate([[0], left[:-1] + 1]))
        order = order[left]
        group = np.cumsum(shared < length)
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.first = np.minimum.reduceat(least[owner[order]], new)
        self.head = order[new]
        self.place = np.zeros(len(self.text), dtype=np.int32)
        self.place[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(new, append=len(order)))
        self.window = window
        self.keys = np.zeros(0)

    def sort_keys(self) -> None:
        """The classes' windows as sorted fixed-width keys; a last byte of 1 keeps numpy from dropping zeros at the end."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[self.head]
        self.keys = np.concatenate([view, np.ones((len(view), 1), np.uint8)], axis=1).view(f"S{self.length + 1}").reshape(-1)

    def merge(self, other: Array) -> None:
        """Both take the lesser document of each window that both have, found by binary search."""
        at = np.minimum(np.searchsorted(self.keys, other.keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == other.keys)
        both = np.minimum(self.first[at[hit]], other.first[hit])
        self.first[at[hit]], other.first[hit] = both, both

    def windows(self) -> np.ndarray:
        """The least document of every window, piece by piece."""
        return self.first[self.place[self.window]]


def least_documents(pieces: list[bytes], group: np.ndarray, least: np.ndarray, length: int, array_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The least document of every window of the distinct stretches, and where each stretch's windows begin.

    A group (one hash) with a single stretch has no other place to match.
    """
    _, back, n = np.unique(group, return_inverse=True, return_counts=True)
    many = np.flatnonzero(n[back.reshape(-1)] > 1)
    sizes = np.fromiter((len(p) - length + 1 for p in pieces), dtype=np.int64, count=len(pieces))
    begin = np.cumsum(sizes) - sizes
    out = np.repeat(least, sizes)
    part = (np.cumsum(sizes[many] + length - 1) - 1) // array_bytes
    members = np.split(many, np.flatnonzero(np.diff(part)) + 1) if len(many) else []
    arrays = [Array([pieces[i] for i in m.tolist()], least[m], length) for m in members]
    if len(arrays) > 1:
        for array in arrays:
            array.sort_keys()
        for a in range(len(arrays)):
            for b in range(a + 1, len(arrays)):
                arrays[a].merge(arrays[b])
    for m, array in zip(members, arrays, strict=True):
        out[_ragged(np.arange(len(out)), begin[m], sizes[m])] = array.windows()
    return out, begin


def removed(first: np.ndarray, begin: np.ndarray, sizes: np.ndarray, which: np.ndarray, own: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that go: (occurrence, first window, last window) for occurrences of stretches ``which`` in documents ``own``."""
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    low, high = np.minimum.reduceat(first, begin)[which], np.maximum.reduceat(first, begin)[which]
    whole = np.flatnonzero(high < own)
    out = [(whole, np.zeros(len(whole), np.int64), sizes[which[whole]] - 1)]
    some = np.flatnonzero((low < own) & (high >= own))
    at = np.cumsum(sizes[which[some]]) // most
    for occ in np.split(some, np.flatnonzero(np.diff(at)) + 1) if len(some) else ():
        n = sizes[which[occ]]
        hit = _ragged(first, begin[which[occ]], n) < np.repeat(own[occ], n)
        row = np.repeat(np.arange(len(occ)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (row[1:] != row[:-1])]))
        stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (row[1:] != row[:-1]), [True]]))
        out.append((occ[row[start]], offset[start], offset[stop]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def verdicts_by_part(rows: list[dict], first: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> list[tuple]:
    """(part, documents, first windows, further windows) that go, of a shard's rows; ``first`` is gone through once for all parts."""
    ends = np.cumsum([len(r["at"]) for r in rows])
    occ, a, b = removed(first, begin, windows, *(np.concatenate([r[c] for r in rows]) for c in ("at", "of")))
    # What a part gets stays together.
    move = np.argsort(occ, kind="stable")
    occ, a, b = occ[move], a[move], b[move]
    cuts = np.searchsorted(occ, ends)
    out = []
    for r, end, i, j in zip(rows, ends.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        if i < j:
            own = occ[i:j] - (end - len(r["at"]))
            doc, start = _unpack(r["docs"])[_unpack(r["doc"])].astype(np.int64)[own], _unpack(r["start"]).astype(np.int64)[own] + a[i:j]
            order = np.lexsort((start, doc))
            out.append((r["part"], _pack(np.diff(doc[order], prepend=0)), _pack(start[order]), _pack((b - a)[i:j][order])))
    return out


class _Part:
    """The texts of one part, and their stretches."""

    def __init__(self, table: pa.Table, length: int):
        rows = table.sort_by([("first_id", "ascending"), ("h", "ascending")])
        self.ids = rows.column("first_id").to_numpy().astype(np.int64)
        self.texts = [_unzip(z) for z in rows.column("z").to_pylist()]
        got = list(stretches(self.texts, length))
        self.doc, self.start, self.count, self.hash = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(4))
        self.hash = self.hash.astype(np.uint64)

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        if not len(self.hash):
            return
        where = (self.hash % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order], prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            yield int(where[order[a]]), order[a:b]


TEXTS = "part long, first_id long, h binary, z binary"
#: Digests of texts that a task has sent already, as far as it remembers them.
SEEN = 200_000


def _distinct_texts(rows: DataFrame, sums: DataFrame, parts: int, docs: DataFrame) -> DataFrame:
    """The distinct texts, each once, compressed, with its least document, dealt to parts."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # a task sends equal rows once, so that very many of them don't go to one task
        for batch in batches:
            for s in slices(batch, "text", 8 << 20):
                fresh = []
                for i, x in enumerate(zip(s.column("h").to_pylist(), s.column("k").to_pylist(), strict=True)):
                    if x not in seen:
                        fresh.append(i)
                        seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                s = s.take(pa.array(fresh, pa.int64()))
                z = [_zip(t) for t in texts_of(s, "text")]
                yield pa.RecordBatch.from_arrays([s.column("part"), s.column("k"), s.column("h"), pa.array(z, pa.binary())], names=["part", "first_id", "h", "z"])

    def first_only(key: tuple, have: pa.Table, want: pa.Table) -> pa.Table:
        wanted = {*zip(want.column("h").to_pylist(), want.column("first_id").to_pylist())}
        pick = []
        for i, x in enumerate(zip(have.column("h").to_pylist(), have.column("first_id").to_pylist())):
            if x in wanted:
                wanted.discard(x)
                pick.append(i)
        return have.take(pa.array(pick, pa.int64()))

    part = F.pmod(F.xxhash64("h", "k"), F.lit(parts))
    texts = docs.withColumn("part", part).mapInArrow(tidy_task(squeeze), TEXTS)
    want = sums.select(F.pmod(F.xxhash64("h", "first_id"), F.lit(parts)).alias("part"), "h", "first_id")
    kept = texts.groupBy("part").cogroup(want.groupBy("part")).applyInArrow(tidy_group(first_only), TEXTS)
    return cut(kept)


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, part_bytes: int = 8 << 20, hot: int = 4096, array_bytes: int = 2 << 20, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes (null: empty); matches don't cross documents, may
    overlap, and are judged on the input. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256; with ``keep_text`` also
    kept (the remaining bytes), and the input's columns named in ``carry``. A null id is later than all others; rows with
    equal ids aren't smaller than one another, so they don't remove from each
    other. Every row gives one row; other columns are ignored.

    Equal texts (by SHA-256) are one text with its least id; a later copy of ``length``
    bytes or more goes as a whole. A hash with more than ``hot`` stretches (a
    line in many documents, say) doesn't go to one shard: its windows go one by
    one, each to the shard of its own hash.
    """
    spark = docs.sparkSession
    extra = [F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)]
    at = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *extra)
    at = at.withColumn("k", F.coalesce("doc_id", F.lit(LATEST)))
    carried = [f"_carry{i}" for i in range(len(carry))]
    at = at.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = cut(at.select("doc_id", "k", "h", F.octet_length("text").cast("long").alias("n_bytes"), *carried))
    sums = cut(rows.where(F.col("n_bytes") >= length).groupBy("h").agg(F.min("k").alias("first_id")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    shards = max(parts, shuffle_width(spark))
    # What parts offer is smaller than their texts, so there are fewer buckets, and fewer rows between them.
    buckets = max(-(-total // (4 * part_bytes)), shuffle_width(spark))
    texts = _distinct_texts(rows, sums, parts, at.where(F.octet_length("text") >= length).select("text", "k", "h"))

    release(spark)

    def offer(key: tuple, table: pa.Table) -> pa.Table:
        part, out = _Part(table, length), []
        for b, own in part.by_bucket(buckets):
            six = np.ascontiguousarray(part.hash[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            out.append((b, key[0].as_py(), six.tobytes(), _pack(np.diff(part.doc[own], prepend=0))))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "part", "hashes", "docs"])

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        each, parts_ = [], table.column("part").to_pylist()
        for k, (six, deltas) in enumerate(zip(table.column("hashes").to_pylist(), table.column("docs").to_pylist(), strict=True)):
            h = np.zeros((len(six) // 6, 8), np.uint8)
            h[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            each.append((h.view("<u8").reshape(-1), np.cumsum(_unpack(deltas).astype(np.int64)) + (k << 32)))
        h, doc = np.concatenate([x for x, _ in each]), np.concatenate([x for _, x in each])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        docs_of = np.bincount(group, weights=np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        size = np.bincount(group)
        state = np.zeros(len(h), np.uint8)
        state[order] = np.where(docs_of > 1, np.where(size > hot, 2, 1), 0)[group]
        ends = np.cumsum([len(x) for x, _ in each])
        cells = np.split(state, ends[:-1])
        some = [k for k, c in enumerate(cells) if c.any()]
        return pa.table({"part": pa.array([parts_[k] for k in some], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(some), pa.int64()), "state": pa.array([_zip(cells[k].tobytes()) for k in some], pa.binary())})

    offers = texts.groupBy("part").applyInArrow(tidy_group(offer), "bucket long, part long, hashes binary, docs binary")
    states = cut(offers.groupBy("bucket").applyInArrow(tidy_group(shared), "part long, bucket long, state binary"))
    del offers
    release(spark)

    def send(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return pa.table([pa.array([], t) for _, t in SEGMENTS], names=[n for n, _ in SEGMENTS])
        part = _Part(table, length)
        state = np.zeros(len(part.doc), np.uint8)
        known = dict(zip(replies.column("bucket").to_pylist(), replies.column("state").to_pylist(), strict=True))
        for b, own in part.by_bucket(buckets):
            if b in known:
                state[own] = np.frombuffer(_unzip(known[b]), np.uint8)
        by_shard: defaultdict[int, list] = defaultdict(list)
        flagged = np.flatnonzero(state)
        flagged = flagged[np.argsort(part.hash[flagged], kind="stable")]
        for doc, start, n, h, kind in zip(*(x[flagged].tolist() for x in (part.doc, part.start, part.count, part.hash, state)), strict=True):
            text = part.texts[doc]
            if kind == 1:
                by_shard[h % shards].append((h, text[start : start + n + length - 1], doc, start))
            else:
                for a in range(start, start + n):
                    window = text[a : a + length]
                    g = int.from_bytes(hashlib.blake2b(window, digest_size=6).digest(), "little")
                    by_shard[g % shards].append((g, window, doc, a))
        out = []
        for shard, found in by_shard.items():
            number: dict[tuple, int] = {}
            which = [number.setdefault((h, p), len(number)) for h, p, _, _ in found]
            docs_, local = np.unique([d for _, _, d, _ in found], return_inverse=True)
            out.append({
                "shard": shard, "part": key[0].as_py(), "bytes": _zip(b"".join(p for _, p in number)), "sizes": _pack(np.array([len(p) for _, p in number])),
                "hashes": _zip(np.array([h for h, _ in number], dtype="<u8").tobytes()), "which": _pack(np.array(which)),
                "ids": _zip(part.ids[docs_].astype("<i8").tobytes()), "docs": _pack(docs_), "doc": _pack(local.reshape(-1)), "start": _pack(np.array([s for _, _, _, s in found])),
            })
        return pa.table([pa.array([r[n] for r in out], t) for n, t in SEGMENTS], names=[n for n, _ in SEGMENTS])

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        number: dict[tuple, int] = {}
        least: list[int] = []
        rows_ = table.to_pylist()
        for r in rows_:
            raw, sizes = _unzip(r["bytes"]), _unpack(r["sizes"]).tolist()
            hashes = np.frombuffer(_unzip(r["hashes"]), "<u8").tolist()
            ids = np.frombuffer(_unzip(r["ids"]), "<i8")[_unpack(r["doc"])]
            which = _unpack(r["which"]).astype(np.int64)
            mine = np.full(len(sizes), LATEST, np.int64)
            np.minimum.at(mine, which, ids)
            at, own = 0, []
            for h, n, low in zip(hashes, sizes, mine.tolist(), strict=True):
                k = number.setdefault((h, raw[at : at + n]), len(number))
                at += n
                if k == len(least):
                    least.append(low)
                elif low < least[k]:
                    least[k] = low
                own.append(k)
            r["at"], r["of"] = np.array(own, dtype=np.int64)[which], ids
        pieces = [p for _, p in number]
        first, begin = least_documents(pieces, np.array([h for h, _ in number], dtype=np.uint64), np.array(least, dtype=np.int64), length, array_bytes)
        windows = np.fromiter((len(p) - length + 1 for p in pieces), dtype=np.int64, count=len(pieces))
        out = verdicts_by_part(rows_, first, begin, windows)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "doc", "start", "more"])

    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary'}" for n, t in SEGMENTS)
    segments = texts.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(tidy_group(send), ddl)
    verdicts = cut(segments.groupBy("shard").applyInArrow(tidy_group(judge), "part long, doc binary, start binary, more binary"))
    del segments
    release(spark)

    names = [("h", pa.binary(), "binary"), ("k", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    names += [("kept", pa.binary(), "binary")] if keep_text else []

    def finish(key: tuple, table: pa.Table, verdict: pa.Table) -> pa.Table:
        rows_ = table.sort_by([("first_id", "ascending"), ("h", "ascending")])
        spans: defaultdict[int, list] = defaultdict(list)
        for doc, start, more in zip(*(verdict.column(c).to_pylist() for c in ("doc", "start", "more")), strict=True):
            for d, a, m in zip(np.cumsum(_unpack(doc).astype(np.int64)).tolist(), _unpack(start).tolist(), _unpack(more).tolist(), strict=True):
                spans[d].append((a, a + m + length))
        out: dict[str, list] = {n: [] for n, _, _ in names}
        for i, z in enumerate(rows_.column("z").to_pylist()):
            text, kept, removed, runs, upto, last = _unzip(z), [], 0, 0, 0, -1
            for a, b in sorted(spans.get(i, ())):
                if a > last:
                    kept.append(text[max(upto, 0) : a])
                    runs += 1
                    removed += b - a
                elif b > last:
                    removed += b - last
                last = max(last, b)
                upto = last
            kept.append(text[upto:])
            rest = b"".join(kept)
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                out["kept"].append(rest)
        out["h"], out["k"] = (rows_.column(c).to_pylist() for c in ("h", "first_id"))
        return pa.table({n: pa.array(out[n], t) for n, t, _ in names})

    done = texts.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(tidy_group(finish), ", ".join(f"{n} {s}" for n, _, s in names))
    nothing = hashlib.sha256(b"").hexdigest()
    # One join each, so that the join of a text with very many copies can be split.
    long = rows.where(F.col("n_bytes") >= length)
    copies = long.join(sums, ["h"]).where("k > first_id").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if keep_text else []), *carried)
    lead = long.join(done, ["h", "k"]).select("doc_id", "n_bytes", *[n for n, _, _ in names[2:]], *carried)
    short = at.where(F.octet_length("text") < length).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []), *carried)
    return lead.unionByName(copies).unionByName(short).withColumnsRenamed(dict(zip(carried, carry, strict=True)))


SEGMENTS = [("shard", pa.int64()), ("part", pa.int64()), *((n, pa.binary()) for n in ("bytes", "sizes", "hashes", "which", "ids", "docs", "doc", "start"))]
