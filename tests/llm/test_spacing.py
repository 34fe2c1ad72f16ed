"""Toxic texts that spell out several words, split a word, or double its letters."""

import random

from lodestream.llm import toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_spacing(spark):
    rng = random.Random(1)
    words = ["river", "stone", "cloud", "garden", "letter", "window", "summer", "paper", "you", "are", "so", "to", "do", "the"]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(30)) + (" " + " ".join(rng.choice(["idiot", "moron", "scum"]) for _ in range(3)) if bad else "")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scorer = model.scorer()
    for said, want in {
        "y o u i d i o t": "you idiot",
        "y o u  i d i o t": "you idiot",
        "i d i o t m o r o n": "idiot moron",
        "river i.d.i.o.t m-o-r-o-n stone": "river idiot moron stone",
        "y 0 u 1 d 1 0 t": "you idiot",
        "i d i o t.": "idiot",
        "you idi ot": "you idiot",
        "mo ron, so": "moron so",
        "iidiioot": "idiot",
        "ssccuumm": "scum",
    }.items():
        assert scorer.restorer.text(said).rstrip(".") == want
        assert scorer.score(f"river {said} stone") >= 0.5
    for clean in ("letter to do the summer so", "r i v e r s t o n e", "you are so 12 a b c"):
        assert scorer.score(clean) < 0.5
    assert scorer.restorer.text("letter to do the summer so") == "letter to do the summer so"
    # Clean stretches are cut by the character model alone.
    assert scorer.restorer.text("r i v e r s t o n e") == "river stone"
