"""Near copies by five-word shingles against brute force, and the pipeline's stage that keeps one of each group."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import common, near_copies, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOC).repartition(3)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def copies():
    """Texts with edited copies, on both sides of the similarity."""
    rng, rows = random.Random(3), []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150 + 20 * g)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            at = words[:]
            for i in rng.sample(range(len(at)), edits):
                at[i] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(at)))
    return rows


def chain():
    """Large groups of which only some pairs are alike: each text differs from the one before it in a few words."""
    rng, rows = random.Random(8), []
    for _ in range(2):
        words = [f"w{rng.randrange(5000)}" for _ in range(220)]
        for _ in range(90):
            for i in rng.sample(range(len(words)), rng.choice([1, 1, 2, 5])):
                words[i] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"few": 2, "layers": 1}])
def test_chains(spark, options):
    rows = chain()
    got = near_copies.first_of_groups(docs(spark, rows).select(F.struct("doc_id").alias("rank"), "text"), **options)
    found, want = {r["first"]["doc_id"] for r in got.collect()}, first_by_force(sorted(rows))
    assert found >= want and len(found) <= len(want) + 1  # a link may be missed by all bands


def crowd():
    """A large group in which most pairs share bands and one in eleven is alike."""
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(60)]
    for g in range(260):
        words = base[:]
        words[5 * rng.randrange(1, 12)] = f"new{g}"  # alike if it is the same word
        rows.append((g + 1, " ".join(words)))
    return rows


def test_crowd_without_tables_of_all_pairs(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(near_copies, "cut", lambda df: sizes.append((out := common.cut(df)).count()) or out)
    rows = crowd()
    for options in ({"layers": 1}, {"layers": 1, "chunk": 60}):
        sizes.clear()
        got = near_copies.first_of_groups(docs(spark, rows).select(F.struct("doc_id").alias("rank"), "text"), **options)
        assert {r["first"]["doc_id"] for r in got.collect()} == first_by_force(rows)
        if "chunk" not in options:
            assert max(sizes) < 50 * len(rows)  # of 33,670 pairs


def test_blocks(spark):
    texts = [" ".join(w) for w in ([f"w{i}" for i in range(200)], [f"w{i}" for i in range(199)], [f"v{i}" for i in range(200)], [f"w{i}" for i in range(198)])]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    rows = [(1, k, g, near_copies._sketch(h)[0], len(h), h.view("int64").tolist()) for k, (h, g) in enumerate(zip(sets, (0, 1, 2, 0)))]
    rows = [(*r[:3], r[3] - (1 << 64) if r[3] >> 63 else r[3], *r[4:]) for r in rows]
    rows = spark.createDataFrame(rows, "cluster long, node long, group long, fp long, n int, set array<long>")
    for options in ({"chunk": 100}, {"chunk": 1}, {"chunk": 100, "load": 150}):
        found = [sorted(r) for r in near_copies.links_in_blocks(rows, **options).collect()]
        # Only what joins groups: the unlike text stays alone, and so do pairs of one group.
        assert found and all(e in ([0, 1], [1, 3]) for e in found)


def first_by_force(rows):
    up = {i: i for i, _ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if alike(a, b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i in up}


@pytest.mark.parametrize("options", [{}, {"chunk": 3}, {"few": 2, "layers": 1}])
def test_groups(spark, options):
    rows = copies()
    got = near_copies.first_of_groups(docs(spark, rows).select(F.struct("doc_id").alias("rank"), "text"), **options)
    assert {r["first"]["doc_id"] for r in got.collect()} == first_by_force(rows)


def test_stage_finds_pairs_that_four_bits_miss(spark):
    rows = copies()
    missed = [(a, b) for k, a in enumerate(rows) for b in rows[:k] if alike(a[1], b[1]) and (simhash.fingerprint_of(a[1].encode()) ^ simhash.fingerprint_of(b[1].encode())).bit_count() > 4]
    assert len(missed) > 20
    got = corpus_pipeline.one_of_near_copies(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in got.collect()} == first_by_force(rows)


def test_short_and_empty(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a c"), (4, ""), (5, None), (6, " \n")]
    got = corpus_pipeline.one_of_near_copies(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in got.collect()} == {1, 3, 4}
    assert corpus_pipeline.one_of_near_copies(spark, docs(spark, []), "").count() == 0


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "one text"), (1, "another text"), (2, long), (2, "a text of its own"), (3, long + " more"), (None, "no id"), (None, "no id"), (None, "one text"), (None, long)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_near_copies(spark, docs(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, "one text"), (1, "another text"), (2, long), (2, "a text of its own"), (None, "no id")], key=str)
