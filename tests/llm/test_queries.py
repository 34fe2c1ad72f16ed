"""Each operator against brute force, and on null, empty, long, repeated and clashing input."""

import base64
import hashlib
import math
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from helpers import check

from lodestream.llm import bpe, embedding_dedup, kneser_ney, mixing, queries, simhash, suffix_dedup, telephony, token_counts, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOC)


ODD = [
    (1, None, "en", "src1"), (2, "", None, None), (3, "   \n ", "en", "src2"), (4, "same text, twice over", "en", "src0"), (5, "same text, twice over", "de", "src0"), (4, "same text, twice over", "en", "src0"),
    (None, "no id here \U0001f600 é\u0301", "fr", "src3"), (7, "word " * 30_000, "en", "src0"), (8, "x" * 200_000, "en", "src0"), (9, "\u2028\u00a0 mixed\tspace\r\n", "xx", "odd"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts, and extra columns with names that operators use inside."""
    extra = {n: F.lit(1) for n in ("fp", "h1", "z", "score", "node", "part", "bucket", "_tokens", "label")}
    return docs(spark, ODD).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_sql(spark):
    for name, sql in queries.ORACLE_SQL.items():
        check(spark, queries.QUERIES[name], sql, "/root/testdata/sf0.01")


# 1: embeddings


def links_by_force(rows, threshold=0.93):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            _, w, b = rows[j]
            if ok(v, a) and ok(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    out = []
    for i, (k, _, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        least = min(ids) if ids else None
        out.append((k, n[i], least, k is not None and k == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("plan, chunk", [(None, 2048), (embedding_dedup.Plan(0.93, cell=8), 5), (embedding_dedup.Plan(0.93, recall=1), 7)])
def test_embeddings(spark, plan, chunk):
    rng, rows = np.random.default_rng(3), []
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.12).tolist(), int(g % 3)))
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [None] + [1.0] * 15, 1), (803, [float("nan")] + [1.0] * 15, 1), (804, [float("inf")] + [1.0] * 15, 1), (805, [1.0] * 16, None), (806, [], 1), (None, rows[3][1], rows[3][2]), (0, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("h", F.lit("x"))
    got = embedding_dedup.embedding_links(df, chunk=chunk, plan=plan)
    got = sorted(((None if pd.isna(r.vec_id) else int(r.vec_id), r.n_links, None if pd.isna(r.component_id) else int(r.component_id), bool(r.kept)) for r in got.toPandas().itertuples()), key=str)
    want = links_by_force([(k, v, a) for k, v, a in rows])
    assert got == want


def test_large_label(spark):
    """One label of 6,000 vectors in 64 dimensions at the registered plan, with pairs just over and under the threshold."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.where(np.arange(3000) % 6, 0.9301, 0.9299)[:, None]
    v = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])
    df = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.embedding_links(df).toPandas().set_index("vec_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = ((unit @ unit.T) >= 0.93).sum(axis=1) - 1
    assert links.sum() == 5000 and (got.n_links[np.arange(6000)].to_numpy() <= links).all()
    assert got.n_links.sum() >= 0.999 * links.sum()
    whole = embedding_dedup.embedding_links(df, plan=embedding_dedup.Plan(0.93, recall=1)).toPandas().set_index("vec_id")
    assert (whole.n_links[np.arange(6000)].to_numpy() == links).all()


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(df).count() == 0


# 2: mixing


def mixed_rows(df):
    return sorted(map(str, df.select("doc_id", "source", "mix_domain", "mix_tokens", "mix_epoch").collect()))


def sql_mix(rows, **weights):
    import duckdb
    from pyspark.sql import Row

    made = pd.DataFrame([(i, t, l, s) for i, t, l, s in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    found = duckdb.connect()
    found.register("made", made)
    out = found.execute(queries.mix_sql("made", out="doc_id, source, domain, tokens, epoch", **weights)).fetchall()
    return sorted(str(Row(doc_id=a, source=b, mix_domain=c, mix_tokens=int(d), mix_epoch=e)) for a, b, c, d, e in out)


def test_mix_equals_sql(spark):
    """Leaves of very different sizes, weights of zero on every level, one id on a third of the rows, and equal rows."""
    rng = random.Random(9)
    rows = [(rng.choice([i, i, 7]), "w " * rng.randrange(0, 30) + str(rng.randrange(4)), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", "src12", "src12345", None])) for i in range(900)]
    rows += [(3, "the same row", "en", "src0")] * 300
    df = docs(spark, rows).repartition(5)
    assert mixed_rows(mixing.mix(df, queries.source_domain(), queries.mix_weights())) == sql_mix(rows)
    zero = {"domain": F.when(F.col("domain") == "forum", 0).otherwise(2), "lang": F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 5).otherwise(1), "source": F.when(F.col("source") == "src12", 0).otherwise(1)}
    want = sql_mix(rows, domain_weight="CASE WHEN domain = 'forum' THEN 0 ELSE 2 END", lang_weight="CASE k_lang WHEN 'de' THEN 0 WHEN 'fr' THEN 5 ELSE 1 END", source_weight="CASE WHEN k_source = 'src12' THEN 0 ELSE 1 END")
    got = mixed_rows(mixing.mix(df, queries.source_domain(), zero))
    assert got == want and len(got) > 500


def test_shortage_under_zero_weight(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 1000), ("web", "de", "b", 1000), ("forum", "en", "c", 5000)], "domain string, lang string, source string, tokens long")
    weights = {"domain": F.lit(1), "lang": F.when(F.col("lang") == "de", 0).otherwise(1), "source": F.lit(1)}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(5000), weights, 1).collect()}
    assert got == {"a": 1000, "b": 0, "c": 4000}
    # What rounding down leaves is handed out.
    three = spark.createDataFrame([("d", "en", s, 100) for s in "abc"], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(three, F.lit(100), {k: F.lit(1) for k in mixing.LEVELS}, 1).collect()}
    assert got == {"a": 34, "b": 33, "c": 33}


def test_mix(spark, odd, empty):
    weights = queries.mix_weights()
    assert mixing.mix(empty, queries.source_domain(), weights).count() == 0
    # Clashing names, nulls, blank and repeated rows: the same rows as the SQL gives.
    clash = odd.withColumns({n: F.lit(-5) for n in ("_rest", "_lang", "_domain", "_source", "_id", "_bucket", "_key", "_end", "_mix_key", "tokens", "budget", "MIX_EPOCH")})
    got = mixing.mix(clash, queries.source_domain(), weights)
    assert got.columns == [*(c for c in clash.columns if c != "MIX_EPOCH"), *mixing.ADDED]
    assert got.where("_tokens <> 1 or _rest <> -5 or _lang <> -5 or _mix_key <> -5").count() == 0
    assert mixed_rows(got) == sql_mix(ODD)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src1", "src12"])) for i in range(600)]
    mixed = mixing.mix(docs(spark, rows), queries.source_domain(), weights, total=F.lit(6000)).toPandas()
    assert 5900 <= mixed.mix_tokens.sum() <= 6100
    by = mixed.groupby("mix_domain").mix_tokens.sum()
    assert by["web"] == pytest.approx(6000 * 4 / 11, rel=0.03) and by["forum"] == pytest.approx(6000 * 3 / 11, rel=0.03)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "de", "b", 1000), ("forum", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    one = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(600), one, 1).collect()}
    assert got == {"a": 10, "b": 290, "c": 300}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(5000), one, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 1000}


# 3: toxicity


def test_toxicity(spark, odd, empty):
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "garden", "letter", "window", "summer", "paper"]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(30)) + (" " + " ".join(rng.choice(["idiot", "moron", "scum"]) for _ in range(3)) if bad else "")
        rows.append((i, text, "en", "s"))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None)]
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model).toPandas().set_index("doc_id")
    want = pd.Series({k: v for k, v in labels if k is not None and v is not None})
    held = pd.Series({i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index})
    assert (got.held_out == held[got.index]).all()
    assert (got.predicted[held[held].index] == want[held[held].index]).mean() > 0.99
    hidden = docs(spark, [(1, "river stone 1d1ot m0r0n $cum", "en", "s"), (2, "river i d i o t stone", "en", "s"), (3, "mooorrrooon scuuum", "en", "s"), (4, "river stone 12 cloud a b c", "en", "s")])
    out = toxicity.score(hidden, model, keep_restored=True).toPandas().set_index("doc_id")
    assert out.predicted.to_dict() == {1: 1, 2: 1, 3: 1, 4: 0}
    assert out.restored[1] == "river stone idiot moron scum"
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.with_score(odd, model).columns == [*odd.columns, "toxicity"]
    none = toxicity.train(df, lab.where("toxic = 0"))
    assert toxicity.score(df, none).agg(F.max("predicted")).first()[0] == 0
    nothing = toxicity.train(empty, lab)
    assert 0 < toxicity.score(odd, nothing).first()["score"] < 1


def gram_task(monkeypatch):
    """What a task of count_grams does with its batches."""

    class Caught(Exception):
        pass

    class Rows:
        def mapInArrow(self, run, ddl):
            raise Caught(run)

    monkeypatch.setattr(toxicity, "bare", lambda *a: Rows())
    with pytest.raises(Caught) as caught:
        toxicity.count_grams(None)
    return caught.value.args[0]


def test_grams_in_little_memory(monkeypatch):
    """A task that counts grams takes a few times the size of the text that it works on, beside its counts of 10 MB."""
    import tracemalloc

    import pyarrow as pa

    run, rng = gram_task(monkeypatch), random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(150_000))
    batch = pa.RecordBatch.from_pydict({"text": [text[at : at + 5_000] for at in range(0, len(text), 5_000)]})
    toxicity._letters()
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) > 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6


@pytest.mark.parametrize("places", [1, 2, 3, 7, 1 << 16])
def test_grams_by_force(monkeypatch, places):
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "PLACES", places)
    texts = ["Abba, 12 b--c", None, "", "  ", "x", "\U0001f600 \u00c9t\u00e9 a\n"]
    got = {}
    for b in gram_task(monkeypatch)(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])):
        got |= {(k, cell): n for k, cell, n in zip(*(b.column(c).to_pylist() for c in ("k", "cell", "n")), strict=True)}
    joined = "\n\n".join(["", *(t.lower() for t in texts if t), "x"])
    letters = [ord(c) if c.isalpha() else 0 for c in joined]
    letters = [0, 0, *(c for i, c in enumerate(letters) if c or (i and letters[i - 1]))]
    want = defaultdict(int)
    for i in range(2, len(letters)):
        for k, cells in enumerate(toxicity._gram_cells(np.array(letters[i - 2 : i + 1], dtype=np.uint64))):
            want[k, int(cells[0])] += 1
    assert got == dict(want)


def test_decoder_against_all_readings():
    """The cost of the decoded text is the least of all ways through the lattice, found by trying every one."""
    rng = np.random.default_rng(5)
    counts = [np.floor(rng.random(1 << b) ** 6 * 50).astype(np.float32) for b in toxicity.GRAM_BITS]
    it = toxicity.Decoder(counts)

    def readings(token, i, a, b, cost, said):
        if i == len(token):
            yield cost + it.cost(a, b, ""), said
            return
        o = token[i]
        if o in toxicity.GAPS:
            yield from readings(token, i + 1, a, b, cost + toxicity.GAPS[o], said)
            if b:
                yield from readings(token, i + 1, "", "", cost + it.cost(a, b, ""), said + " ")
            return
        extra = toxicity.REPEAT if token[max(0, i - 2) : i + 3].count(o) > 2 else toxicity.DOUBLE
        for c, price in [(c, toxicity.SWAP) for c in toxicity.LEET.get(o, "")] + ([(o, 0.0)] if o.isalpha() else []):
            yield from readings(token, i + 1, b, c, cost + price + it.cost(a, b, c), said + c)
            if c == b:
                yield from readings(token, i + 1, a, b, cost + price + extra, said)
        if not o.isalpha():
            yield from readings(token, i + 1, a, b, cost + (toxicity.DIGIT if o.isdigit() else toxicity.INSERT), said)

    letters = random.Random(3)
    for _ in range(150):
        token = "".join(letters.choice("ab10$@!es" + toxicity.SPELT) for _ in range(letters.randrange(1, 8)))
        every = list(readings(token, 0, "", "", 0.0, ""))
        least = min(c for c, _ in every)
        assert it.decode(token) in {s for c, s in every if c <= least + 1e-9}


# 4: telephony


def test_media(spark, odd, empty):
    got = telephony.media_columns(odd).select("doc_id", "n_bytes", "mulaw.*").toPandas()
    want = sorted((str(i), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)) for i, t, _, _ in ODD for p in [(t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 if t else 64)])
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in got.itertuples()) == want
    assert telephony.media_columns(empty).count() == 0 and telephony.decode_media(empty.select("doc_id", F.lit(b"").alias("media"))).count() == 0


def straight_lines(pcm):
    """The signal at twice the rate and its features, sample by sample."""
    wide = [w for i, v in enumerate(pcm) for w in (v, (v + (pcm[i + 1] if i + 1 < len(pcm) else v)) // 2)]
    n = max(len(wide), 1)
    turns = sum((a >= 0) != (b >= 0) for a, b in zip(wide, wide[1:]))
    return wide, f"samples={len(wide)},peak={max(map(abs, wide), default=0)},mean={sum(wide) // n},energy={sum(w * w for w in wide) // n},crossings={turns}"


@pytest.mark.parametrize("piece", [telephony.PIECE, 256])
def test_decoded_media(spark, monkeypatch, piece):
    """Every format of every row against a decoder that goes sample by sample; pieces and rows share calls."""
    monkeypatch.setattr(telephony, "PIECE", piece)
    rng = random.Random(2)
    texts = ["", "short", "x" * 64, "é" * 700, *("".join(rng.choice("ab \n\u20ac~") for _ in range(rng.randrange(1, 900))) for _ in range(12))]
    for codec in telephony.CODECS:
        data = [t.encode() + b"\0" * (-len(t.encode()) % 64 if t else 64) for t in texts]
        media = [telephony.pack_wav(d, codec) for d in data]
        for d, m, row in zip(data, media, telephony.decode_rows([*media, None, b"RIFF"], 2), strict=False):
            pcm = telephony.decode(m)[1].tolist() if codec != "adpcm" else [v for a in range(0, len(d), 64) for v in adpcm_by_force(d[a : a + 64])]
            wide, marks = straight_lines(pcm)
            assert row["data"] == d and row["rate"] == 16_000 and row["feature"] == marks
            assert np.frombuffer(b"".join(row["pcm"]), "<i2").tolist() == wide
    df = spark.createDataFrame([(i, bytearray(telephony.pack_wav(b"\x10" * 64 * i, c))) for i, c in enumerate(telephony.CODECS, 1)] + [(9, None), (None, bytearray(b"noise"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in telephony.decode_media(df).collect()}
    assert got[9]["pcm"] is None and got[None]["error"] == "not a WAV file"
    assert len(b"".join(map(bytes, got[1]["pcm"]))) == 64 * 4 and len(b"".join(map(bytes, got[3]["pcm"]))) == 3 * 121 * 4


def adpcm_by_force(data):
    value, index, out = int.from_bytes(data[:2], "little", signed=True), min(data[2], 88), []
    out.append(value)
    for byte in data[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.IMA_STEP[index])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(telephony.IMA_INDEX[code])))
            out.append(value)
    return out


def test_codecs():
    # Values of the standards: silence, the extremes and a step in between.
    assert telephony.MULAW[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    every = bytes(range(256))
    for law in telephony.LAWS:
        pcm = telephony.expand(every, law)
        assert (telephony.expand(telephony.compress(pcm, law), law) == pcm).all()
        assert telephony.unpack_wav(telephony.pack_wav(every + b"\1", law))[3] == every + b"\1"
    wave = (np.sin(np.arange(5000) / 15) * 9000).astype(np.int16)
    back = telephony.adpcm_decode(telephony.adpcm_encode(wave), 256)[: len(wave)]
    assert np.abs(back.astype(int) - wave).mean() < 200

    data = telephony.adpcm_encode(wave, 64)
    want = [v for a in range(0, len(data), 64) for v in adpcm_by_force(data[a : a + 64])]
    assert telephony.adpcm_decode(data, 64).tolist() == want
    assert telephony.upsample(np.array([0, 10, 4], np.int16), np.array([2, 1]), np.array([10, 5]), 2).tolist() == [0, 5, 10, 10, 4, 4]
    with pytest.raises(ValueError):
        telephony.unpack_wav(b"RIFFxxxx")


# 5: SimHash


def simhash_by_force(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [2048, 3])
def test_simhash(spark, odd, empty, chunk):
    assert simhash.near_duplicates(empty).count() == 0
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(8):
            copy = list(base)
            copy[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows) + 100, " ".join(copy), "en", "s"))
    df = docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("m", F.lit(2))
    got = sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.fingerprint, str(None if pd.isna(r.component_id) else int(r.component_id))) for r in simhash.near_duplicates(df, chunk=chunk).toPandas().itertuples())
    fps = [simhash_by_force(t) for _, t, _, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None and (least[root(i)] is None or r[0] < least[root(i)]):
            least[root(i)] = r[0]
    assert got == sorted((str(r[0]), f"{fps[i]:016x}", str(least[root(i)])) for i, r in enumerate(rows))


def test_gray_tree():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    tree = simhash.GrayTree(fps)
    got = {(min(x, y), max(x, y)) for a, b in tree.near(tree, 4) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    rank = simhash.gray_rank(np.array([0, 1, 3, 2, 6], dtype=np.uint64))
    assert rank.tolist() == [0, 1, 2, 3, 4]


# 6: token counts


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = docs(spark, [(50, "end <|endoftext|> here", "en", "s"), (53, "<|endoftext|>" + "far too long for a chunk, " * 400 + " <|endoftext|><|endoftext|> x", "en", "s"), (51, "naïve café 123 ... don't", "en", "s"), (52, "日本語 text", "ja", "s")])
    df = odd.select(extra.columns).unionByName(extra)
    got = token_counts.token_counts(df, path, chunk=1500, overlap=40).collect()
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False))) for r in df.collect()}
    assert len(got) == len(ODD) + 4
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.token_counts(empty, path).count() == 0
    c = token_counts.counter(path)
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "x'll", "12", "é", "!?"]) for _ in range(400))
        want = len(t.encode(text, add_special_tokens=False))
        assert c.plain(text) == c.spliced(text, 60, 8) == want
        marked = text[:200] + "<|endoftext|>" + text[200:]
        assert c.count(marked, 60, 8) == len(t.encode(marked, add_special_tokens=False))


# 7: Kneser-Ney


def test_kneser_ney_sums_to_one(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(["abracadabra", "abra cadabra", "cab a bra"] * 3)]
    top = defaultdict(int)
    for _, t, _, _ in rows:
        for g in kneser_ney.grams_of([t])[0].tolist():
            top[g] += 1
    counts = spark.createDataFrame(list(top.items()), "gram long, c long")
    tables = kneser_ney._tables(counts)
    context = (ord("a") << 36) | (ord("b") << 24) | (ord("r") << 12) | ord("a")
    for ctx in (context, ord("z") << 36 | context & ((1 << 36) - 1), 0):
        wanted = spark.range(kneser_ney.CLASSES).select((F.lit(ctx << 12) + F.col("id")).alias("gram"))
        total = kneser_ney._probabilities(wanted, tables).agg(F.sum("p"), F.min("p")).first()
        assert total[0] == pytest.approx(1, abs=1e-9) and total[1] > 0


def test_every_character_is_itself(spark):
    """Symbols can be read back, so no two characters are the same to the model."""
    rng = random.Random(7)
    texts = ["", "a漢b", "\U0010ffff\u0000\u3000", *("".join(chr(rng.choice([97, 0xEEF, 0xEF0, 0xFA0, 0x6F22, 0x6F82, 0x1F600])) for _ in range(rng.randrange(20))) for _ in range(30))]
    codes, sizes = kneser_ney.grams_of(texts)
    symbols = (codes & (kneser_ney.CLASSES - 1)).tolist()
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        own, said = iter(symbols[at : at + n]), []
        for s in own:
            said.append(chr(s) if s < kneser_ney.PLAIN else chr((s - kneser_ney.PLAIN) << 12 | next(own)))
        assert "".join(said) == t
        at += n
    good, bad = "漢字仮名交文章読書" * 30, "".join(chr(ord(c) + 96 * (1 + i % 5)) for i, c in enumerate("漢字仮名交文章読書" * 30))
    rows = [(i, good[i:] + good[:i], "ja", "s") for i in range(40)] + [(99, bad, "ja", "s")]
    out = kneser_ney.quality(docs(spark, rows), spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).toPandas().set_index("doc_id")
    assert out.keep[list(range(40))].all() and not out.keep[99]


def kneser_ney_by_force(train, text):
    counts = [defaultdict(int) for _ in range(6)]
    for t in train:
        for g in kneser_ney.grams_of([t])[0].tolist():
            counts[5][g] += 1
    for k in (4, 3, 2, 1):
        for g in counts[k + 1]:
            counts[k][g & ((1 << 12 * k) - 1)] += 1
    d = [None]
    for k in range(1, 6):
        n = [max(sum(c == x for c in counts[k].values()), 1) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d.append([min(max(v, 0.1), i - 0.05) for i, v in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))])

    def p(g, k):
        if k == 0:
            return 1 / kneser_ney.CLASSES
        g &= (1 << 12 * k) - 1
        own = {x: c for x, c in counts[k].items() if x >> 12 == g >> 12}
        low = p(g, k - 1)
        if not own:
            return low
        cost = lambda c: d[k][min(c, 3) - 1]
        return ((own[g] - cost(own[g]) if g in own else 0) + sum(map(cost, own.values())) * low) / sum(own.values())

    logs = [math.log(p(g, 5)) for g in kneser_ney.grams_of([text])[0].tolist()]
    return math.exp(-sum(logs) / max(len(logs), 1))


def test_quality(spark, odd, empty):
    rng = random.Random(8)
    words = ["river", "stone", "cloud", "garden", "letter"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)), "en", "s") for i in range(60)]
    rows += [(100 + i, "".join(rng.choice("#$%&*+/<>") for _ in range(60)), "en", "s") for i in range(5)]
    lab = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    out = kneser_ney.quality(docs(spark, rows), lab, block_bytes=900).toPandas().set_index("doc_id")
    assert not out.keep[[100 + i for i in range(5)]].any() and out.keep[list(range(60))].all()
    train = [t for i, t, _, _ in rows if i < 50 and zlib.crc32(str(i).encode()) % 5]
    for i in (3, 55, 101):
        assert out.perplexity[i] == pytest.approx(kneser_ney_by_force(train, dict((r[0], r[1]) for r in rows)[i]), rel=1e-4)
    assert kneser_ney.quality(odd, lab).count() == len(ODD)
    assert kneser_ney.quality(empty, lab).count() == 0
    assert kneser_ney.quality(odd, lab.limit(0)).where("keep").count() == len(ODD)


# 8: suffix arrays


def repeats_by_force(rows, length=50):
    first, data = {}, [(suffix_dedup.LATEST if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for (k, _), (o, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < o:
                gone[i : i + length] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((str(k), len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"part_bytes": 3000, "hot": 3, "array_bytes": 500}])
def test_repeats(spark, options):
    rng = random.Random(1)
    base = ["abcab" * 40, "x" * 300, "\0" * 120, "hello world " * 10, "q" * 49, "q" * 50, "", None, "é" * 60] + ["".join(rng.choice("abc") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(120):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((rng.choice([i, i, i, None, 3]), None if a is None else a[rng.randrange(len(a) + 1) :] + (b or "")[: rng.randrange(200)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("n_bytes", F.lit(2))
    out = suffix_dedup.mark_repeats(df, keep_text=True, carry=("k",), **options).toPandas()
    assert (out.k == 1).all() and all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out.itertuples())
    got = sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.itertuples())
    assert got == repeats_by_force(rows)


def test_repeats_in_tables(spark, empty):
    df = table(spark, "documents")
    got = suffix_dedup.mark_repeats(df, part_bytes=50_000, hot=20, array_bytes=20_000).toPandas()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == repeats_by_force(rows)
    assert suffix_dedup.mark_repeats(empty).count() == 0


def test_last_window_of_an_array():
    """What stands after the last window in the array isn't compared with it."""
    line = b"y" * 50 + b"~"
    for text in ([line, b"b" + line], [b"c" * 60, b"m" * 49 + b"z", b"a" * 4 + b"m" * 49 + b"z"]):
        least = np.arange(1, len(text) + 1, dtype=np.int64)
        array = suffix_dedup.Array(text, least, 50)
        seen = {}
        for k, t in enumerate(text):
            for i in range(len(t) - 49):
                seen.setdefault(t[i : i + 50], k + 1)
        assert array.windows().tolist() == [seen[t[i : i + 50]] for t in text for i in range(len(t) - 49)]


def test_shard_is_gone_through_once(monkeypatch):
    """The work of a shard doesn't grow with its parts times its windows, nor by a long stretch among many short ones."""
    rng = np.random.default_rng(5)
    windows = np.concatenate([[1 << 20], rng.integers(1, 30, 3000)])
    begin = np.cumsum(windows) - windows
    first = rng.integers(0, 60, windows.sum())
    rows = []
    for k in range(40):
        at = rng.integers(1, 3001, 100)
        docs = np.unique(rng.integers(0, 50, 100))
        rows.append({"part": k, "at": at, "of": np.full(100, 30 + k % 3), "docs": suffix_dedup._pack(docs), "doc": suffix_dedup._pack(rng.integers(0, len(docs), 100)), "start": suffix_dedup._pack(np.arange(100) * 1000)})
    calls, whole = [], suffix_dedup._ragged
    monkeypatch.setattr(suffix_dedup, "_ragged", lambda *a: calls.append(1) or whole(*a))
    got = {part: sorted(zip(np.cumsum(suffix_dedup._unpack(d).astype(int)).tolist(), suffix_dedup._unpack(s).tolist(), suffix_dedup._unpack(m).tolist())) for part, d, s, m in suffix_dedup.verdicts_by_part(rows, first, begin, windows)}
    assert len(calls) == 1
    for r in rows:
        want = []
        docs = suffix_dedup._unpack(r["docs"])[suffix_dedup._unpack(r["doc"])]
        for doc, at, own, start in zip(docs.tolist(), r["at"].tolist(), r["of"].tolist(), suffix_dedup._unpack(r["start"]).tolist()):
            gone = [*(first[begin[at] : begin[at] + windows[at]] < own), False]
            since = None
            for i, g in enumerate(gone):
                if g and since is None:
                    since = i
                elif not g and since is not None:
                    want.append((doc, start + since, i - 1 - since))
                    since = None
        assert got.get(r["part"], []) == sorted(want)


def test_suffix_order():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    order, _ = suffix_dedup.suffix_order(text, 700)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(700), key=lambda i: raw[i:])
    shared = suffix_dedup.common_prefixes(text, order, 50)
    for k in range(1, 700):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(n, 50)


# 9: BPE


def test_bpe(spark, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    short = [*ODD, (77, "".join(random.Random(1).choice("abcdefgh") for _ in range(150_000)), "en", "s")]
    df = docs(spark, short).withColumn("block", F.lit(1)).repartition(2)
    got = bpe.encode(df, path, P.PATTERN, digests=True, block_bytes=1000)
    want = sorted((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in short for ids in [enc.encode_ordinary(t or "")])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    back = bpe.decode(got, path).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t, _, _ in short)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.token_bytes(path).join(np.array([1 << 30]))
    # Many small buckets give the same.
    many = bpe.encode(df, path, P.PATTERN, digests=True, block_bytes=1000, bucket_bytes=2000)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in many.collect()) == want


def test_rank_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint32), rng.integers(0, 1 << 19, 5000).astype(np.uint32), rng.integers(0, 1 << 31, 100).astype(np.uint32)):
        assert (bpe._unpack_ranks(bpe._pack_ranks(x)) == x).all()


# 10: URLs


def urls_by_force(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[1] if best else None, best[2] if best else None


def url_shares(host, path):
    """Shares of hashed n-grams, by the definition of the hash: each character goes on from the hash so far."""
    import xxhash

    found = []
    for part, text in (("h", host), ("p", path)):
        chars = "\x02" + text + "\x03"
        for n in url_filter.SIZES:
            for i in range(len(chars) - n + 1):
                h = 42
                for s in (part, *chars[i : i + n]):
                    h = xxhash.xxh64_intdigest(s.encode(), h)
                found.append((h - (1 << 64) if h >> 63 else h) % url_filter.WIDTH)
    return {k: found.count(k) / max(len(found), 1) for k in set(found)}


def weights_by_hand(rounds=400, rate=300.0, bias=0.1):
    """Gradient descent on the weights themselves."""
    rows = [(line[2:], float(line[0])) for line in url_filter.LABELLED_URLS.strip().splitlines()]
    x, y = np.zeros((len(rows), url_filter.WIDTH + 1)), np.array([r[1] for r in rows])
    for i, (url, _) in enumerate(rows):
        for k, share in url_shares(*urls_by_force(url)[:2]).items():
            x[i, k] = share
        x[i, -1] = bias
    w = np.zeros(url_filter.WIDTH + 1)
    for _ in range(rounds):
        w += rate / len(rows) * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    w[-1] *= bias
    return w.tolist()


def test_urls(spark):
    odd_urls = [None, "", "no scheme", "http://A.Example.ORG/en/1x?q#f", "http://example.org", "x://y.org/a://b", "http://q.com/fr/", "http://xcom/de/", "HTTP://Ä.com/de/1", "http://h.com/" + "p" * 50_000]
    urls = odd_urls + [r["url"] for r in table(spark, "pages").collect()]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit("x"))
    weights = url_filter.train(url_filter.labelled_urls(spark))
    by_hand = weights_by_hand()
    assert weights == pytest.approx(by_hand, abs=1e-6)
    for r in url_filter.judge(df, queries.URL_RULES, weights).collect():
        host, path, rule, verdict = urls_by_force(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        score = 1 / (1 + math.exp(-sum(by_hand[k] * x for k, x in url_shares(host, path).items()) - by_hand[-1]))
        assert r["p_allow"] == pytest.approx(score, abs=1e-6)
        assert r["verdict"] == (verdict or ("allow" if score >= 0.5 else "block"))
    # A list of any length is joined, with the same result.
    many = [(f"{v}", h, p) for v, h, p in queries.URL_RULES] + [("block", f"h{i}.net", "/") for i in range(url_filter.MOST_INLINE)]
    pick = ["page_id", "host", "path", "rule", "verdict"]
    few = url_filter.judge(df, queries.URL_RULES, weights).select(pick)
    assert sorted(map(str, url_filter.judge(df, many, weights).select(pick).collect())) == sorted(map(str, few.collect()))
    assert url_filter.judge(df.limit(0), queries.URL_RULES, weights).count() == 0
    lab = url_filter.labelled_urls(spark)
    fit = url_filter.judge(lab.withColumn("page_id", F.col("label")), [], weights).where("page_id = 1 and verdict = 'allow' or page_id = 0 and verdict = 'block'").count()
    assert fit == lab.count()
    assert url_filter.train(lab.limit(0)) == [0.0] * (url_filter.WIDTH + 1)
