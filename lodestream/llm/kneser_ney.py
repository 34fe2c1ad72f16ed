"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

The model is trained on the trusted texts. Counts, continuation counts and
backed-off probabilities are tables sharded by n-gram or context; what the
documents need is looked up by joins: every block of documents sends its
distinct n-grams to their shards and gets their probabilities back.

An n-gram is five 12-bit symbols in one long, so a context is a shift and a
shorter n-gram a mask. Most characters are one symbol; those of other scripts
are two, a lead and a trail, so that every character has symbols of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, shuffle_width, slices, tidy_group, tidy_task

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
#: Characters from here on are a lead (their code without its lowest 12 bits) and a trail; there are 272 leads.
PLAIN = CLASSES - (0x110000 >> BITS)
#: Languages whose thresholds may be broadcast.
MOST_BROADCAST = 10_000


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end at each symbol of the texts, one after the other, and the texts' numbers of symbols.

    Symbol 0 stands before a text.
    """
    pad = "\0" * (ORDER - 1)
    x = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    wide = x >= PLAIN
    chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.arange(1, len(texts) + 1) * (ORDER - 1) + np.cumsum(chars) - chars
    upto = np.concatenate([[0], np.cumsum(wide)])
    sizes = chars + upto[begin + chars] - upto[begin]
    last = np.arange(len(x)) + upto[1:]  # of each character's symbols
    x, chars_ = np.repeat(x, 1 + wide), x
    x[last[wide]] &= CLASSES - 1
    x[last[wide] - 1] = PLAIN + (chars_[wide] >> BITS)
    code = np.zeros(max(len(x) - ORDER + 1, 0), dtype=np.int64)
    for k in range(ORDER):
        code = code << BITS | x[k : k + len(code)]
    start = np.arange(len(texts)) * (ORDER - 1) + np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes)
    return code[np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _shard(code: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _batches(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and their counts."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some in _batches(texts):
        c, k = np.unique(grams_of(some)[0], return_counts=True)
        code, back = np.unique(np.concatenate([code, c]), return_inverse=True)
        n = np.bincount(back.reshape(-1), weights=np.concatenate([n, k]), minlength=len(code)).astype(np.int64)
    return code, n


def _split(code: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has some of the n-grams, and their places."""
    if not len(code):
        return
    where = _shard(code, shards)
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.diff(where[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        yield int(where[order[a]]), order[a:b]


def _prefix(gram: str) -> Column:
    return F.shiftright(gram, BITS)


def _tables(top: DataFrame) -> list[tuple[DataFrame, list[float]]]:
    """Counts (gram, c) of orders 5 to 1, continuation counts below the top, each with its discounts D1, D2, D3+."""
    out, at = [], top
    for order in range(ORDER, 0, -1):
        row = at.agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (max(row[f"n{k}"], 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        out.append((at, [min(max(d, 0.1), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]))
        if order > 1:
            at = cut(at.groupBy(F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("gram")).agg(F.count("*").alias("c")))
    return out


def _probabilities(wanted: DataFrame, tables: list[tuple[DataFrame, list[float]]]) -> DataFrame:
    """(gram, p) of all wanted n-grams of the top order, from the lowest order up."""
    known = None
    for order in range(1, ORDER + 1):
        counts, d = tables[ORDER - order]
        asked = wanted.select(F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")).distinct() if order < ORDER else wanted
        cost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = counts.groupBy(_prefix("gram").alias("context")).agg(F.sum("c").alias("total"), F.sum(cost).alias("freed"))
        rows = asked.join(counts, "gram", "left").withColumn("context", _prefix("gram")).join(contexts, "context", "left")
        if known is None:
            lower = F.lit(1.0 / CLASSES)
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(known.select(F.col("gram").alias("short"), F.col("p").alias("q")), "short")
            lower = F.col("q")
        own = F.when(F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("c") - cost)
        known = cut(rows.select("gram", F.when(F.col("total").isNull(), lower).otherwise((own + F.col("freed") * lower) / F.col("total")).alias("p")))
    return known


PACKED = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
PACKED_NAMES = ["block", "doc_id", "lang", "out", "size", "z"]


def _unpacked(table: pa.Table) -> tuple[list, list, list, list[str]]:
    """Ids, languages, held-out marks and texts of a block's rows."""
    ids, langs, outs = (table.column(c).combine_chunks().flatten().to_pylist() for c in ("doc_id", "lang", "out"))
    texts = []
    for z, sizes in zip(table.column("z").to_pylist(), table.column("size").to_pylist(), strict=True):
        raw, at = _unzip(z), 0
        for n in sizes:
            texts.append(raw[at : at + n].decode("utf-8", "surrogatepass"))
            at += n
    return ids, langs, outs, texts


class Lookup:
    """Places of n-grams in a sorted array, mostly by a direct table."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, max(10, int(len(codes)).bit_length() + 3)
        self.table = np.zeros(1 << self.bits, dtype=np.int32)
        self.table[self._slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(c)]
        miss = np.flatnonzero(self.codes[at] != c)
        at[miss] = np.searchsorted(self.codes, c[miss])
        return at


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, lang, n_chars, perplexity and role of every whole text.

    role is 2 for a trusted text (label 1) that the model was trained on, 1 for
    a trusted one that was held out (crc32 of the id divisible by 5), else 0.
    The model counts all trusted texts that aren't held out; without any, all
    symbols are equally likely. The perplexity is per character, also of those
    that are two symbols. An empty or null text has perplexity 1. Rows of one
    id, or of one text without an id, are rated by one task.
    """
    spark = docs.sparkSession
    at = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    total = at.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    shards = max(shuffle_width(spark), blocks)
    # Null ids are dealt by their texts, others by themselves.
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", block.alias("block"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", 24 << 20):
                where, ids, langs, outs, every = (s.column(c).to_pylist() for c in ("block", "doc_id", "lang", "out", "text"))
                rows = defaultdict(list)
                for i, b in enumerate(where):
                    rows[b].append(i)
                for b, own in rows.items():
                    data = [(every[i] or "").encode("utf-8", "surrogatepass") for i in own]
                    cells = ([b], [[ids[i] for i in own]], [[langs[i] for i in own]], [[outs[i] for i in own]], [[len(d) for d in data]], [_zip(b"".join(data))])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, PACKED, strict=True)], names=PACKED_NAMES)

    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks))).otherwise(block)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    texts = at.select(spread.alias("block"), "doc_id", "lang", out.alias("out"), "text").mapInArrow(tidy_task(squeeze), "block long, doc_id array<long>, lang array<string>, out array<boolean>, size array<int>, z binary")

    def count(key: tuple, table: pa.Table, trust: pa.Table) -> pa.Table:
        ids = {*trust.column("doc_id").to_pylist()}
        own_ids, _, outs, every = _unpacked(table)
        own = [t for t, i, o in zip(every, own_ids, outs, strict=True) if i in ids and not o]
        rows = []
        code, n = _distinct(own)
        for s, pick in _split(code, shards):
            rows.append((s, key[0].as_py(), 1, _zip(code[pick].tobytes()), _zip(n[pick].astype("<i8").tobytes())))
        code, _ = _distinct(every)
        for s, pick in _split(code, shards):
            rows.append((s, key[0].as_py(), 0, _zip(np.diff(code[pick], prepend=0).tobytes()), None))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "block", "train", "codes", "counts"])

    offers = cut(texts.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(tidy_group(count), "shard long, block long, train int, codes binary, counts binary"))
    release(spark)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        codes = np.concatenate([np.frombuffer(_unzip(z), "<i8") for z in table.column("codes").to_pylist()])
        n = np.concatenate([np.frombuffer(_unzip(z), "<i8") for z in table.column("counts").to_pylist()])
        gram, back = np.unique(codes, return_inverse=True)
        return pa.table({"gram": gram, "c": np.bincount(back.reshape(-1), weights=n, minlength=len(gram)).astype(np.int64)})

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"gram": np.unique(np.concatenate([np.cumsum(np.frombuffer(_unzip(z), "<i8")) for z in table.column("codes").to_pylist()]))})

    top = cut(offers.where("train = 1").groupBy("shard").applyInArrow(tidy_group(add_up), "gram long, c long"))
    wanted = cut(offers.where("train = 0").select("shard", "codes").groupBy("shard").applyInArrow(tidy_group(asked), "gram long"))
    known = _probabilities(wanted, _tables(top))

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shard(batch.column("gram").to_numpy(), shards)), batch.column("gram"), batch.column("p")], names=["shard", "gram", "p"])

    def answer(key: tuple, ask: pa.Table, have: pa.Table) -> pa.Table:
        have = have.sort_by("gram")
        gram, logp = have.column("gram").to_numpy(), np.log(have.column("p").to_numpy()).astype("<f4")
        replies = [_zip(logp[np.searchsorted(gram, np.cumsum(np.frombuffer(_unzip(z), "<i8")))].tobytes()) for z in ask.column("codes").to_pylist()]
        return pa.table({"block": ask.column("block"), "shard": ask.column("shard"), "logp": pa.array(replies, pa.binary())})

    asks = offers.where("train = 0").select("shard", "block", "codes")
    prices = known.mapInArrow(shard_of, "shard long, gram long, p double")
    replies = cut(asks.groupBy("shard").cogroup(prices.groupBy("shard")).applyInArrow(tidy_group(answer), "block long, shard long, logp binary"))
    del offers, top, wanted, known, asks, prices  # their checkpoints can go before texts are shuffled again
    release(spark)

    def rate(key: tuple, table: pa.Table, reply: pa.Table, trust: pa.Table) -> pa.Table:
        own_ids, langs, outs, texts_ = _unpacked(table)
        code, _ = _distinct(texts_)
        price = np.zeros(max(len(code), 1))
        known_ = dict(zip(reply.column("shard").to_pylist(), reply.column("logp").to_pylist(), strict=True))
        for s, pick in _split(code, shards):
            price[pick] = np.frombuffer(_unzip(known_[s]), "<f4")
        find, sums = Lookup(code) if len(code) else None, []
        for some in _batches(texts_):
            grams, sizes = grams_of(some)
            running = np.concatenate([[0.0], np.cumsum(price[find(grams)])]) if len(grams) else np.zeros(1)
            ends = np.cumsum(sizes)
            sums.append(running[ends] - running[ends - sizes])
        sums = np.concatenate(sums) if sums else np.zeros(0)
        n = np.fromiter(map(len, texts_), dtype=np.int64, count=len(texts_))
        ids = {*trust.column("doc_id").to_pylist()}
        role = [(1 if o else 2) if i in ids else 0 for i, o in zip(own_ids, outs, strict=True)]
        return pa.table({"doc_id": pa.array(own_ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_chars": n, "perplexity": np.exp(-sums / np.maximum(n, 1)), "role": pa.array(role, pa.int32())})

    def rate_pair(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        return rate(key, table, side.filter(pa.compute.is_valid(side.column("shard"))), side.filter(pa.compute.is_null(side.column("shard"))))

    side = replies.select("block", "shard", "logp", F.lit(None).cast("long").alias("doc_id")).unionByName(trusted.select("block", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("logp"), "doc_id"))
    return texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(tidy_group(rate_pair), "doc_id long, lang string, n_chars long, perplexity double, role int")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, prior_chars: float = 100.0, **names: str) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, adjusted, threshold and keep of every whole text.

    A short text's perplexity says little, so ``adjusted`` adds ``prior_chars``
    characters at the median of its language's trusted texts. A language's
    threshold is ``slack`` times the ``quantile`` of the adjusted perplexities
    of its trusted held-out texts (of all its trusted texts, if none is held
    out; of all languages' ones, if it has no trusted text; without any trusted
    text all are kept). A text up to the threshold is kept. A null language is
    a language of its own; ids may be null or repeat; every row gives one row.
    Other columns are ignored.
    """
    rated = cut(perplexities(docs, labels, **names))
    rated = _by_language(rated, F.when(F.col("role") > 0, F.col("perplexity")), F.lit(None).cast("double"), 0.5, "_median")
    n = F.col("n_chars") + prior_chars
    rated = rated.withColumn("adjusted", F.exp((F.ln("perplexity") * F.col("n_chars") + F.ln(F.coalesce("_median", F.lit(1.0))) * prior_chars) / n))
    held, trusted = F.when(F.col("role") == 1, F.col("adjusted")), F.when(F.col("role") > 0, F.col("adjusted"))
    rated = _by_language(rated, held, trusted, quantile, "_limit")
    limit = F.coalesce("_limit", F.lit(float("inf"))) * slack
    return rated.select("doc_id", "lang", "n_chars", "perplexity", "adjusted", limit.alias("threshold"), (F.col("adjusted") <= limit).alias("keep"))


def _by_language(rated: DataFrame, first: Column, second: Column, quantile: float, name: str) -> DataFrame:
    """Adds a quantile of the row's language: of ``first``, else of ``second``, else that of all rows (null without any)."""
    at = lambda x: F.percentile_approx(x, quantile, 10_000)
    every = rated.agg(F.coalesce(at(first), at(second))).first()[0]
    per = rated.groupBy(F.col("lang").alias("_lang")).agg(F.coalesce(at(first), at(second), F.lit(every).cast("double")).alias(name))
    per = cut(per)
    near = F.broadcast(per) if per.count() <= MOST_BROADCAST else per
    return rated.join(near, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
