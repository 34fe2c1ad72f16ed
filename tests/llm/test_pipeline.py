"""The pipeline on a small table against its stages' brute force, and each stage on odd rows."""

from pathlib import Path

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import bpe, queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from test_near_copies import first_by_force
    from test_queries import repeats_by_force

    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    at, outs = start, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SMALL).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        outs[name] = at
        if name != "byte_bpe":
            assert at.columns == start.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outs["toxicity"].collect()}
    assert sum(labels.get(i) == 0 for i in kept) >= 0.98 * sum(v == 0 for v in labels.values())
    # One document of each group of near copies: five-word shingles, similarity 0.8 or more.
    rows = sorted((r["doc_id"], r["text"]) for r in outs["toxicity"].collect())
    assert sorted(r["doc_id"] for r in outs["simhash"].collect()) == sorted(first_by_force(rows))
    # Repeats: what is left of each text.
    before = [(r["doc_id"], r["text"]) for r in outs["simhash"].collect()]
    want = {int(k): n - gone for k, n, gone, _, _ in repeats_by_force(before)}
    for r in outs["suffix_array"].collect():
        assert len(r["text"].encode()) == want[r["doc_id"]] or "\ufffd" in r["text"]
        assert r["n_chars"] == len(r["text"])
    # Mixing: the same rows and epochs as the SQL gives.
    import duckdb

    made = outs["suffix_array"].toPandas()
    con = duckdb.connect()
    con.register("made", made)
    want = con.execute(queries.mix_sql("made", out="doc_id, text, source")).fetchall()
    assert sorted(map(tuple, outs["mixing"].select("doc_id", "text", "source").collect())) == sorted(want)
    # BPE: ids decode to the texts.
    back = bpe.decode(outs["byte_bpe"], P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted(r["text"].encode() for r in outs["mixing"].collect())


def test_run(spark):
    from lodestream.checkpoints import folder

    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 100
    left = [p.name for d in Path(folder(spark).removeprefix("file:")).glob("corpus-pipeline-*") for p in d.iterdir()]
    assert set(left) <= {"mixing"}


ODD = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ODD_ROWS = [
    (1, None, "en", "src1"), (2, "", None, None), (3, "  \n", "en", "src2"), (4, "one two three four five six seven", "en", "src0"), (4, "quite another text under the same id", "de", "src0"),
    (5, "ONE two three four five six seven", "en", "src0"), (None, "no id and its own words here", "fr", "src3"), (None, "no id and its own words here", "fr", "src3"), (None, "no id but other words than those", "fr", "src3"),
    (7, LONG, "en", "src0"), (8, "é" * 150_000, "xx", "odd"), (8, "é" * 150_000, "xx", "odd"), (9, "a passage that stands in two documents and is long enough to go. First end", "en", "src1"), (10, "Begin: a passage that stands in two documents and is long enough to go.", "en", "src1"),
]


def odd_rows(spark):
    """Nulls, blanks, long and repeated rows, ties, and extra columns with names that stages use inside."""
    rows = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in ODD_ROWS], ODD)
    return rows.withColumns({n: F.lit(1) for n in ("_row", "_toxicity", "rank", "first", "kept", "h", "k", "mix_epoch", "_mix_key", "ids", "block")}).repartition(3)


def seen(df):
    return sorted((str(r["doc_id"]), r["text"] or "", r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_toxicity_on_odd_rows(spark):
    out = corpus_pipeline.reject_toxic(spark, odd_rows(spark), SMALL)
    assert out.columns == corpus_pipeline.COLUMNS
    assert seen(out) in (seen(odd_rows(spark)), [])  # no usable labels: all rows share one score


def test_near_copies_on_odd_rows(spark):
    out = corpus_pipeline.one_of_near_copies(spark, odd_rows(spark), SMALL)
    assert out.columns == corpus_pipeline.COLUMNS
    assert [(i, t[:9]) for i, t, _, _ in seen(out)] == sorted((str(i), (t or "")[:9]) for i, t in [(1, None), (4, "one two three"), (4, "quite another"), (None, "no id and"), (None, "no id but"), (7, LONG), (8, "é" * 9), (9, "a passage that"), (10, "Begin: a passage")])


def test_repeats_on_odd_rows(spark):
    out = corpus_pipeline.cut_repeats(spark, odd_rows(spark), SMALL)
    assert out.columns == corpus_pipeline.COLUMNS and out.count() == len(ODD_ROWS)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[9].startswith("a passage") and got[10] == "Begin: " and got[1] == "" and len(got[8]) == 150_000


def test_mixing_on_odd_rows(spark):
    out = corpus_pipeline.mix_sources(spark, odd_rows(spark), SMALL)
    assert out.columns == corpus_pipeline.COLUMNS
    assert {x for x in seen(out)} <= {x for x in seen(odd_rows(spark))} and out.count() > 0


def test_encoding_of_odd_rows(spark):
    out = corpus_pipeline.to_ids(spark, odd_rows(spark), SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == len(ODD_ROWS)
    back = bpe.decode(out, P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t, _, _ in ODD_ROWS)


def test_stages_on_an_empty_table(spark):
    none = odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0
