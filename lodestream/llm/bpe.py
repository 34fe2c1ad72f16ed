"""Byte-level BPE: encode each distinct word once, decode by the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, cut, shuffle_width, slices, tidy_group, tidy_task

@lru_cache(1)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file; read once in a Python worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class TokenBytes:
    """The token-byte table, sorted by id; ids are joined to it many at a time."""

    def __init__(self, path: str):
        words = sorted(ranks(path).items(), key=lambda w: w[1])
        self.flat = np.frombuffer(b"".join(w for w, _ in words), dtype=np.uint8)
        self.ids = np.fromiter((k for _, k in words), dtype=np.int64, count=len(words))
        self.sizes = np.fromiter((len(w) for w, _ in words), dtype=np.int64, count=len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one after the other; an id that the table lacks raises an error."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        if len(ids) and (self.ids[at] != ids).any():
            raise ValueError("an id is not in the vocabulary")
        return _ragged(self.flat, self.starts[at], self.sizes[at]).tobytes()


@lru_cache(1)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def word_encoder(path: str):
    """A function from a word's bytes to its ids, without splitting it again."""
    import tiktoken

    # A pattern that takes a word as a whole, line ends included.
    encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
    return lambda word: encode(word.decode())


@lru_cache(1)
def _newer_letters() -> str:
    """Letters and numbers of the regex module's Unicode version that tiktoken's older version doesn't have."""
    import regex
    import tiktoken

    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    kind = r"[\p{L}\p{N}]"
    matched = tiktoken.Encoding("kinds", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return "".join(sorted(set(regex.findall(kind, unknown)) - set(matched.decode(matched.encode_ordinary(unknown)))))


@lru_cache(4)
def splitter(pattern: str):
    """findall of the pre-token pattern, with white space, letters and numbers as tiktoken's engine has them."""
    import regex

    newer = _newer_letters()
    own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    plain = regex.compile(own)
    late = regex.compile(own.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{newer}])").replace(r"?\p{L}+", rf"?(?:(?![{newer}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{newer}])\p{{N}})+")) if newer else None
    rare = re.compile("[^\x00-\u02ff\u2000-\u206f]").search  # all the newer ones are rare
    return lambda text: late.findall(text) if newer and rare(text) else plain.findall(text)


def _pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers as zstd over their four byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of all i, one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[shift + np.arange(ends[-1] if len(ends) else 0)]


#: Ranks below FEW are a byte of their own; the others are a byte for their class and 14 bits.
FEW, LOW_BITS = 192, 14


def _pack_ranks(ranks_: np.ndarray) -> bytes:
    """Frequency ranks, as a skewed byte stream and the low bits of the rare ones."""
    rest = ranks_.astype(np.int64) - FEW
    rare = rest >= 0
    if len(rest) and (rest.max() >> LOW_BITS) >= 256 - FEW:
        return b"\0" + _pack(ranks_)
    lead = np.where(rare, FEW + (rest >> LOW_BITS), ranks_).astype(np.uint8)
    low = (rest[rare] & ((1 << LOW_BITS) - 1)).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return b"\1" + zstandard.ZstdCompressor(level=3).compress(len(lead).to_bytes(8, "little") + lead.tobytes() + np.ascontiguousarray(low).tobytes())


def _unpack_ranks(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return _unpack(blob[1:])
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    n = int.from_bytes(raw[:8], "little")
    lead = np.frombuffer(raw, dtype=np.uint8, offset=8, count=n)
    low = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, offset=8 + n).reshape(2, -1).T).view("<u2").reshape(-1)
    out = lead.astype(np.uint32)
    rare = lead >= FEW
    out[rare] = FEW + ((lead[rare].astype(np.uint32) - FEW) << LOW_BITS) + low
    return out


def _bucket(words: list[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), dtype=np.int64, count=len(words)) % n


BLOCKS = "block long, part int, bucket int, payload binary, lengths binary, doc_ids array<long>, sizes array<int>"


def _blocks(docs: DataFrame, pattern: str, buckets: int, block_bytes: int) -> DataFrame:
    """Distinct words of blocks of documents by bucket, and the documents as word positions.

    A block's words are numbered by how often it has them. part 0: a bucket's
    words of the block, in order; part 1: documents of the block as numbers in
    text order; part 2: the numbers of the words, bucket by bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, task, k, held = splitter(pattern), TaskContext.get().partitionId(), 0, 0
        number: defaultdict[str, int] = defaultdict(count().__next__)
        seqs: list[tuple[np.ndarray, list, list[int]]] = []
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                own = [np.fromiter(map(number.__getitem__, find(t)), dtype=np.uint32) for t in texts]
                seqs.append((np.concatenate(own), part.column("doc_id").to_pylist(), [len(x) for x in own]))
                held += sum(map(len, texts))
                if held >= block_bytes:
                    yield from block(task << 24 | k, number, seqs)
                    number, seqs, held, k = defaultdict(count().__next__), [], 0, k + 1
        if seqs:
            yield from block(task << 24 | k, number, seqs)

    def block(name: int, number: dict[str, int], seqs: list) -> Iterator[pa.RecordBatch]:
        often = sum((np.bincount(s, minlength=len(number)) for s, _, _ in seqs), np.zeros(len(number), np.int64))
        rank = np.empty(len(number), dtype=np.uint32)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(number))
        for a in range(0, len(seqs), 4):
            some = seqs[a : a + 4]
            flat = rank[np.concatenate([s for s, _, _ in some])] if len(rank) else np.zeros(0, np.uint32)
            yield _row(name, 1, 0, _pack_ranks(flat), None, [i for _, ids, _ in some for i in ids], [n for _, _, sizes in some for n in sizes])
        every = [w.encode() for w in number]
        where = _bucket(every, buckets)
        order = np.array(sorted(range(len(every)), key=every.__getitem__), dtype=np.int64)
        order = order[np.argsort(where[order], kind="stable")]
        edges = np.searchsorted(where[order], np.arange(buckets + 1))
        yield _row(name, 2, 0, _pack(rank[order]), None, None, np.diff(edges).tolist())
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = [every[i] for i in order[edges[b] : edges[b + 1]].tolist()]
            yield _row(name, 0, b, zstandard.ZstdCompressor(level=6).compress(b"".join(own)), _pack(np.fromiter(map(len, own), dtype=np.int64)), None, None)

    return docs.mapInArrow(tidy_task(run), BLOCKS)


def _row(*cells) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _encoded(blocks: DataFrame, path: str) -> DataFrame:
    """Each bucket's distinct words encoded once; ids go back to every block that has the word."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        encode = word_encoder(path)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        mine = []
        for payload, lengths in zip(group.column("payload").to_pylist(), group.column("lengths").to_pylist(), strict=True):
            raw, ends = zstandard.ZstdDecompressor().decompress(payload), np.cumsum(_unpack(lengths)).tolist()
            mine.append(np.fromiter((number[raw[a:b]] for a, b in zip([0, *ends], ends)), dtype=np.int64))
        ids = [encode(w) for w in number]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for y in ids for x in y), dtype=np.uint32, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        out = [(_pack(_ragged(flat, starts[m], sizes[m])), _pack(sizes[m])) for m in mine]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "ids": pa.array([x for x, _ in out], pa.binary()), "lengths": pa.array([x for _, x in out], pa.binary())})

    return blocks.where("part = 0").select("bucket", "block", "payload", "lengths").groupBy("bucket").applyInArrow(tidy_group(run), "block long, bucket int, ids binary, lengths binary")


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20, bucket_bytes: int = 256 << 20, digests: bool = False, keep_ids: bool = True) -> DataFrame:
    """BPE ids of every whole text, by a global shuffle of distinct words.

    Texts are split by ``pattern``; every block of documents keeps its words'
    positions as numbers and sends each distinct word once to the word's
    bucket (one for each ``bucket_bytes`` of texts at least), where it is encoded
    once; the ids come back to the block and are put together by position.
    ``vocabulary`` is the path of a rank file on every machine. Returns doc_id and n_tokens; with ``keep_ids`` ids
    (array<int>); with ``digests`` also ids_sha256 (little-endian unsigned
    32-bit) and decoded_sha256, of the ids joined with the token-byte table.

    A null text is empty: 0 tokens, digests of no bytes. Ids may be null or
    repeat; every input row gives one row. Other columns are ignored.
    """
    slim = bare(docs, id_col, text_col)
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_width(docs.sparkSession), -(-total // bucket_bytes))
    blocks = cut(_blocks(slim, pattern, buckets, block_bytes))
    table = _encoded(blocks, vocabulary)
    columns = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long")]
    columns += [("ids", pa.list_(pa.int32()), "array<int>")] if keep_ids else []
    columns += [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] if digests else []

    def put_together(key: tuple, seqs: pa.Table, words: pa.Table) -> pa.Table:
        ids_of = dict(zip(words.column("bucket").to_pylist(), zip(words.column("ids").to_pylist(), words.column("lengths").to_pylist(), strict=True), strict=True))
        part, payloads, lengths = (seqs.column(c).to_pylist() for c in ("part", "payload", "sizes"))
        numbers = _unpack(payloads[part.index(2)])
        ends = np.cumsum(lengths[part.index(2)])
        sizes, starts, at, pieces = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64), 0, []
        for b in sorted(ids_of):
            ids, n = _unpack(ids_of[b][0]), _unpack(ids_of[b][1]).astype(np.int64)
            own = numbers[ends[b] - len(n) : ends[b]]
            sizes[own], starts[own] = n, at + np.cumsum(n) - n
            at += len(ids)
            pieces.append(ids)
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        decoded = token_bytes(vocabulary).join if digests else None
        out: dict[str, list] = {name: [] for name, _, _ in columns}
        for kind, payload, doc_ids, counts in zip(part, payloads, seqs.column("doc_ids").to_pylist(), lengths, strict=True):
            if kind == 2:
                continue
            seq, start = _unpack_ranks(payload), 0
            for doc_id, n in zip(doc_ids, counts, strict=True):
                mine = seq[start : start + n]
                start += n
                ids = _ragged(flat, starts[mine], sizes[mine]).astype("<u4")
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                if keep_ids:
                    out["ids"].append(ids.astype(np.int32))
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded(ids.astype(np.int64))).hexdigest())
        return pa.table({name: pa.array(out[name], kind) for name, kind, _ in columns})

    seqs = blocks.where("part > 0").select("block", "part", "payload", "doc_ids", "sizes")
    return seqs.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(tidy_group(put_together), ", ".join(f"{n} {s}" for n, _, s in columns))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text bytes of BPE ids, by a join with the token-byte table inside each batch.

    The table is bounded by the vocabulary. Null ids give null bytes; an id
    outside the table raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = token_bytes(vocabulary).join
        for batch in batches:
            texts = [None if x is None else decoded(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy_task(run), "doc_id long, bytes binary")
