"""Toxicity of texts behind a noisy channel.

Leetspeak, spacing and repetition are undone by Viterbi decoding of character
lattices under a character language model of the whole corpus; the restored
text is then scored by a model learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bare, slices, tidy_task

# Signs and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c"}
#: Costs (natural logarithms) of the channel: a letter written as a sign, an inserted sign, an inserted digit,
#: a letter too many in a run of three or more, and in a run of two.
SWAP, INSERT, DIGIT, REPEAT, DOUBLE = 0.7, 1.5, 12.0, 0.7, 6.0
#: Separators in a token: between spelt-out characters (deleted or a word's boundary, both free), and between short
#: words, where deleting it costs.
SPELT, APART = "\x1f", " "
GAPS = {SPELT: 0.0, APART: 6.0}
#: Cost a character from which a word is unlikely, and the longest word that may be a piece of one.
UNLIKELY, PIECE = 3.5, 4
#: Letters of a word that is looked for inside stretches.
LEAST_KNOWN = 4
#: Hash bits of the counts of one, two and three characters.
GRAM_BITS = (14, 17, 20)
#: Characters of which grams are counted at a time.
PLACES = 1 << 16
#: Letters of a word's beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Tokens without evidence that are remembered.
MOST_NOTHING = 150_000
#: Feature counts that a task holds before it passes them on.
FLUSH = 100_000

SPACED = re.compile(r"(?<!\S)\S(?:[ ._*\-]{1,2}\S){2,}(?![^\s.,;:!?])")
SPACE = re.compile(r"(?<=\S)[ ._*\-]{1,2}(?=\S)")
PUNCT = ".,;:!?\"'`()[]{}<>|#%&*$-_/\\~^=+…«»“”‘’¡¿"
TRIPLE = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
RUN = re.compile(r"(.)\1+")


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint64, count=0x110000)


def _gram_cells(x: np.ndarray) -> list[np.ndarray]:
    """Cells of the characters, pairs and triples that end at each place of x (from the third on)."""
    mix = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    with np.errstate(over="ignore"):
        one = (x[2:] + np.uint64(1)) * mix[0]
        two = (one ^ (one >> np.uint64(29))) + (x[1:-1] + np.uint64(1)) * mix[1]
        three = (two ^ (two >> np.uint64(31))) + (x[:-2] + np.uint64(1)) * mix[2]
        return [((h ^ (h >> np.uint64(32))) * mix[0] >> np.uint64(64 - b)).astype(np.int64) for h, b in zip((one, two, three), GRAM_BITS, strict=True)]


def _add_grams(total: list[np.ndarray], codes: np.ndarray) -> None:
    """Add the counts of a text's code points; PLACES at a time, since the arrays of a step are many times as large as its text."""
    table, last, before = _letters(), np.uint64(0), np.zeros(2, np.uint64)
    for at in range(0, len(codes), PLACES):
        x = table[codes[at : at + PLACES]]
        x, last = x[(x != 0) | (np.concatenate([[last], x[:-1]]) != 0)], x[-1]  # one boundary between words
        x = np.concatenate([before, x])
        for counts, cells in zip(total, _gram_cells(x), strict=True):
            np.add.at(counts, cells, 1)
        before = x[-2:]


def count_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray]:
    """Counts of characters, pairs and triples of all texts, hashed to fixed sizes.

    Characters are lower-cased and what isn't a letter is a boundary. Each task
    adds up its own counts; what reaches the driver is bounded by GRAM_BITS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << b, dtype=np.int64) for b in GRAM_BITS]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text = "\n\n".join(["", *(t.lower() for t in part.column("text").to_pylist() if t), "x"])
                _add_grams(total, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        for k, counts in enumerate(total):
            some = np.flatnonzero(counts)
            for a in range(0, len(some), 50_000):
                cell = some[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(counts[cell])], names=["k", "cell", "n"])

    sums = bare(docs, id_col, text_col).mapInArrow(tidy_task(run), "k int, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(1 << b, dtype=np.float32) for b in GRAM_BITS]
    k, cell, n = (sums.column(c).to_numpy() for c in ("k", "cell", "n"))
    for i in range(3):
        out[i][cell[k == i]] = n[k == i]
    return out


class Decoder:
    """Viterbi decoding of a token's character lattice under an interpolated trigram model."""

    def __init__(self, counts: list[np.ndarray], smooth: float = 5.0):
        self.one, self.two, self.three = (np.asarray(c, dtype=np.float32) for c in counts)
        self.total, self.smooth = max(float(self.one.sum(dtype=np.float64)), 1.0), smooth
        self.memo = Memo()

    def cost(self, a: str, b: str, c: str) -> float:
        """-ln P(c | a b); "" is a word's boundary."""
        key = (a, b, c)
        if (known := self.memo.get(key)) is not None:
            return known
        x = np.array([ord(s) if s else 0 for s in key], dtype=np.uint64)
        one, two, three = (int(g[0]) for g in _gram_cells(x))
        pre = np.array([0, x[0], x[1]], dtype=np.uint64)
        mid, pair, _ = (int(g[0]) for g in _gram_cells(pre))
        k = self.smooth
        p1 = (self.one[one] + 0.1) / (self.total + 100)
        p2 = (self.two[two] + k * p1) / (self.one[mid] + k)
        p3 = (self.three[three] + k * p2) / (self.two[pair] + k)
        return self.memo.keep(key, -math.log(max(min(p3, 1.0), 1e-12)), 3)

    def price(self, word: str) -> float:
        a, b, total = "", "", 0.0
        for c in (*word, ""):
            total += self.cost(a, b, c)
            a, b = b, c
        return total

    def unlikely(self, word: str) -> bool:
        """Whether the model gives a word's letters and end a high cost on average."""
        return self.price(word) > UNLIKELY * (len(word) + 1)

    def doubled(self, word: str) -> bool:
        """Whether an unlikely word costs less without one, or all, of its doubled letters."""
        total = self.price(word)
        if total <= UNLIKELY * (len(word) + 1):
            return False
        at = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
        return total > self.price(RUN.sub(r"\1", word)) + DOUBLE * len(at) or any(total > self.price(word[:i] + word[i + 1 :]) + DOUBLE for i in at)

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token; time is linear in its length.

        Separators (GAPS) are deleted or end a word, which gives a space. All
        states are kept: a state is the last two letters, and after a letter of
        the token that letter is the last one, so there are never more than the
        square of the letters that signs stand for. Of equal costs the first
        found stays.
        """
        # state (last two letters) -> (cost, letters as a linked list)
        states: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
        for i, o in enumerate(token):
            extra = REPEAT if token[max(0, i - 2) : i + 3].count(o) > 2 else DOUBLE
            nxt: dict[tuple[str, str], tuple[float, tuple]] = {}
            if (gap := GAPS.get(o)) is not None:
                for (a, b), (cost, path) in states.items():
                    self._keep(nxt, (a, b), cost + gap, path)
                    if b:
                        self._keep(nxt, ("", ""), cost + self.cost(a, b, ""), (path, " "))
                states = nxt
                continue
            options = [(c, SWAP) for c in LEET.get(o, "")]
            if o.isalpha():
                options.append((o, 0.0))
            for (a, b), (cost, path) in states.items():
                for c, price in options:
                    self._keep(nxt, (b, c), cost + price + self.cost(a, b, c), (path, c))
                    if c == b:
                        self._keep(nxt, (a, b), cost + price + extra, path)
                if not o.isalpha():
                    self._keep(nxt, (a, b), cost + (DIGIT if o.isdigit() else INSERT), path)
            states = nxt or states
        (_, _), (_, path) = min(states.items(), key=lambda s: (s[1][0] + self.cost(*s[0], ""), s[0]))
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _keep(states: dict, at: tuple[str, str], cost: float, path: tuple) -> None:
        if at not in states or cost < states[at][0]:
            states[at] = (cost, path)


def core_of(token: str) -> str:
    """A token without punctuation around it; a single sign at the front may be a letter, runs of signs are decoration."""
    if token.isalpha():
        return token
    core = token.strip(PUNCT)
    lead = token[: len(token) - len(token.lstrip(PUNCT))]
    return lead + core if core and lead in LEET else core


class Restorer:
    """Restores lower-cased tokens; remembers some of them, in bounded memory.

    Where a stretch can be cut in several ways, ``known`` words (those with
    evidence) go before what the character model prefers.
    """

    def __init__(self, counts: list[np.ndarray], known: Iterable[str] = ()):
        self.decoder, self.memo = Decoder(counts), Memo()
        self.known = {w for w in known if len(w) >= LEAST_KNOWN and w.isalpha()}
        self.begin = {w[:n] for w in self.known for n in range(1, len(w))}
        self.single = {RUN.sub(r"\1", w): w for w in sorted(self.known)}

    def suspicious(self, core: str) -> bool:
        if core.isalpha():
            return TRIPLE.search(core) is not None or (DOUBLED.search(core) is not None and self.decoder.doubled(core))
        return any(c.isalpha() or c in LEET for c in core) or TRIPLE.search(core) is not None

    def token(self, token: str) -> str:
        """The token without punctuation around it, decoded if it has signs, tripled letters, or doubled ones that are unlikely."""
        if token.isalpha() and not DOUBLED.search(token):
            return token
        if (known := self.memo.get(token)) is not None:
            return known
        core = core_of(token)
        if core not in self.known and len(DOUBLED.findall(core)) > 1 and (word := self.single.get(RUN.sub(r"\1", core))):
            return self._remember(token, word)
        return self._remember(token, self.decoder.decode(core) if self.suspicious(core) else core)

    def _remember(self, key: str, out: str | bool) -> str | bool:
        return self.memo.keep(key, out, len(key))

    def _stretch(self, token: str) -> str:
        if (known := self.memo.get(token)) is not None:
            return known
        return self._remember(token, self.decoder.decode(token))

    def _spelt(self, run: str) -> str:
        """Single characters with separators between them, as words; a wider separator than the others is a boundary, most likely."""
        if not any(c.isalpha() for c in run):
            return SPACE.sub("", run)
        if (known := self.memo.get(key := SPELT + run)) is not None:
            return known
        least = min(len(m[0]) for m in SPACE.finditer(run))
        out = []
        for part in self._around(SPACE.sub(lambda m: "" if len(m[0]) == least else APART, run)):
            marked = APART.join(SPELT.join(w) for w in part.split(APART))
            out.append(part if part in self.known else self.decoder.decode(marked))
        return self._remember(key, " ".join(w for w in out if w))

    def _around(self, joined: str) -> list[str]:
        """Known words in a joined stretch, also where signs stand for letters, and what is between them."""
        out, at = [], 0
        for start, stop in self._inside(plain := "".join(LEET.get(c, c)[0] for c in joined)):
            out += [joined[at:start].strip(APART), plain[start:stop]]
            at = stop
        return [w for w in (*out, joined[at:].strip(APART)) if w]

    def _inside(self, plain: str) -> list[tuple[int, int]]:
        """Places of known words from the left, the longest at each."""
        out, at = [], 0
        while self.known and at < len(plain):
            stop, n = 0, 1
            while plain[at : at + n] in self.begin and at + n < len(plain):
                n += 1
                stop = at + n if plain[at : at + n] in self.known else stop
            if stop:
                out.append((at, stop))
            at = stop or at + 1
        return out

    def _odd(self, word: str) -> bool:
        """Whether a short word is an unlikely one."""
        key = f"{APART}{word}"
        return known if (known := self.memo.get(key)) is not None else self._remember(key, word.isalpha() and self.decoder.unlikely(word))

    def split(self, text: str, whole: list[str] | None = None) -> list[str]:
        """The words of a lower-cased text: spelt-out ones, and neighbouring short ones of which one is unlikely, put together.

        Each spelt-out stretch as one word is added to ``whole``.
        """

        def spelt(m: re.Match) -> str:
            if whole is not None:
                whole.append(SPACE.sub("", m[0]))
            return self._spelt(m[0])

        words = SPACED.sub(spelt, text).split()
        seen = set(words)
        if starts := self.begin & seen:
            words = self._whole(words, starts)
        if odd := {w for w in seen if len(w) <= PIECE and self._odd(w)}:
            words = self._pieces(words, odd)
        return words

    def _whole(self, words: list[str], starts: set[str]) -> list[str]:
        """Neighbours that are a known word together, put together."""
        out, done = [], 0
        for at in [i for i, w in enumerate(words) if w in starts]:
            end, whole = at + 1, words[at]
            while whole in self.begin and whole not in self.known and end < len(words):
                whole, end = whole + words[end].strip(PUNCT), end + 1
            if at >= done and whole in self.known and end > at + 1:
                out += [*words[done:at], whole]
                done = end
        return out + words[done:] if done else words

    def _pieces(self, words: list[str], odd: set[str]) -> list[str]:
        """Runs of unlikely short words and their short neighbours, decoded."""
        out, done = [], 0
        short = lambda i: 0 <= i < len(words) and len(words[i]) <= PIECE and words[i].isalpha()
        for at in [i for i, w in enumerate(words) if w in odd]:
            if at < done:
                continue
            start, end = at - (at > done and short(at - 1)), at + 1
            while short(end) and (words[end - 1] in odd or words[end] in odd):
                end += 1
            if end - start > 1:
                out += words[done:start] + self._stretch(APART.join(words[start:end])).split()
                done = end
        return out + words[done:] if done else words

    def text(self, text: str) -> str:
        return " ".join(self.token(w) for w in self.split(text.lower()))

    def tokens(self, text: str) -> set[str]:
        """The distinct words of ``split``, and each spelt-out stretch without a known word as one word."""
        whole: list[str] = []
        out = set(self.split(text.lower(), whole))
        return out.union(w for w in whole if not self._inside(w))

    def words(self, text: str) -> set[str]:
        return {self.token(w) for w in self.tokens(text)}


def features_of(word: str) -> list[str]:
    """A word, and its beginnings (marked)."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def known_words(*tables: dict[str, float]) -> set[str]:
    """Whole words that speak for toxicity more than against it."""
    return {w for t in tables for w, v in t.items() if v > 0}


class Model:
    """Evidence of features, and a logistic regression over a text's strongest words."""

    def __init__(self, counts: list[np.ndarray] | None, evidence: dict[str, float], floor: float, weights: np.ndarray):
        self.counts, self.evidence, self.floor, self.weights = counts, evidence, floor, weights

    def scorer(self, restorer: Restorer | None = None) -> Scorer:
        return Scorer(self, restorer or Restorer(self.counts, known_words(self.evidence)))


def single_letters(word: str) -> str:
    """A word with each run of a letter as one."""
    return RUN.sub(r"\1", word)


class Scorer:
    def __init__(self, model: Model, restorer: Restorer):
        self.model, self.memo, self.restorer = model, Memo(), restorer
        #: Tokens that are known to have no evidence.
        self.nothing: set[str] = set()
        #: Words and beginnings with evidence, and the same with runs of a letter as one.
        self.heads = {f.removesuffix("-") for f, v in model.evidence.items() if v > model.floor}
        self.single = {single_letters(h) for h in self.heads}
        self.first = {h[:3] for h in self.heads}

    def possible(self, token: str) -> bool:
        """Whether a token may be a word with evidence.

        Decoding letters only takes repeated ones away, so a word of letters
        begins, or is, as its single letters do.
        """
        if not token.isalpha():
            return True
        if not DOUBLED.search(token):
            return token[:3] in self.first and (token in self.heads or any(token[:n] in self.heads for n in BEGINNINGS))
        token = single_letters(token)
        return token in self.single or any(token[:n] in self.single for n in range(1, 1 + max(BEGINNINGS)))

    def strength(self, token: str) -> tuple[str, float] | None:
        word = self.restorer.token(token)
        best = max((self.model.evidence.get(f, self.model.floor) for f in features_of(word)), default=self.model.floor)
        return (word, best) if best > self.model.floor else None

    def inputs(self, text: str) -> np.ndarray:
        """The strongest three words' evidence and the number of words with any."""
        found, memo, new = {}, self.memo, []
        for t in self.restorer.tokens(text).difference(self.nothing):
            if (hit := memo.get(t)) is None:
                core = core_of(t)
                if not self.possible(core) or (hit := self.strength(core)) is None:
                    new.append(t)
                    continue
                memo.keep(t, hit, len(t))
            found[hit[0]] = hit[1]
        if len(self.nothing) + len(new) > MOST_NOTHING:
            self.nothing.clear()
        self.nothing.update(t for t in new if len(t) <= memo.longest)
        top = sorted(found.values(), reverse=True)[:3]
        top += [self.model.floor] * (3 - len(top))
        return np.array([*top, math.log1p(len(found)), 1.0])

    def score(self, text: str) -> float:
        z = float(self.inputs(text) @ self.model.weights)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def held_out(id_column: str) -> object:
    """Rows that are never learnt from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labels: int = 20_000, most_features: int = 65_536, prior: float = 8.0) -> Model:
    """Learn from labelled documents that aren't held out.

    The language model counts all documents. Labels: at most ``most_labels``
    rows, those with the smallest hash of their id, so that the list may be
    broadcast; of a labelled id's rows the one whose text has the smallest MD5
    is learnt from, so no more rows than labels reach the driver. A feature's evidence is the smoothed log odds of toxic texts
    among those that have it, for at most ``most_features`` features. The
    regression is fitted on evidence from the other half of the texts (halves
    by the texts' checksums, so that copies stay together). Rows with a null
    id, text or label are left out; labels of one class only, or none, give a
    model that scores their (smoothed) share.
    """
    spark = docs.sparkSession
    counts = count_grams(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(counts)
    own = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    known = bare(docs, id_col, text_col).where("text is not null").join(F.broadcast(own), "doc_id")
    one = known.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("m"), "text", "y")).alias("r"))
    rows = one.select("r.text", "r.y").persist()

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total = Restorer(shared.value), {}

        def flush() -> Iterator[pa.RecordBatch]:
            keys, cells = list(total), list(total.values())
            total.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64())], names=["half", "f", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                half = zlib.crc32(text.encode()) & 1
                for f in {f for w in restorer.words(text) for f in features_of(w)}:
                    total.setdefault((half, f), [0, 0])[y] += 1
                if len(total) >= FLUSH:
                    yield from flush()
        yield from flush()

    table = rows.mapInArrow(tidy_task(stats), "half int, f string, clean long, toxic long").groupBy("f").agg(*(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("clean", "toxic")))
    shares = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    base = (shares["toxic"] + 1) / (shares["n"] + 2)
    share = F.expr("(toxic0 + toxic1) / (toxic0 + toxic1 + clean0 + clean1 + 8D)")
    kept = table.where("toxic0 + toxic1 >= 3").where(share > 1.5 * base).orderBy(share.desc(), "f").limit(most_features).toArrow()
    cells = {c: kept.column(c).to_numpy() for c in ("clean0", "toxic0", "clean1", "toxic1")}
    names = kept.column("f").to_pylist()

    def evidence(halves: tuple[int, ...]) -> dict[str, float]:
        t, c = sum(cells[f"toxic{h}"] for h in halves), sum(cells[f"clean{h}"] for h in halves)
        p = (t + prior * base) / (t + c + prior)
        return dict(zip(names, np.log(p / (1 - p)).tolist(), strict=True))

    floor = math.log(base / (1 - base))
    if not 0 < shares["toxic"] < shares["n"]:
        rows.unpersist()
        return Model(counts, {}, floor, np.array([0.0, 0.0, 0.0, 0.0, floor]))
    cross = spark.sparkContext.broadcast([Model(None, {k: max(v, floor) for k, v in evidence((1 - h,)).items()}, floor, np.zeros(5)) for h in (0, 1)])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value, known_words(*(m.evidence for m in cross.value)))
        scorers = [m.scorer(restorer) for m in cross.value]
        for batch in batches:
            x = [scorers[zlib.crc32(t.encode()) & 1].inputs(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    fitted = rows.mapInArrow(tidy_task(inputs), "x array<double>, y int").toArrow()
    x = np.array(fitted.column("x").to_pylist(), dtype=np.float64).reshape(-1, 5)
    weights = _fit(x, fitted.column("y").to_numpy().astype(np.float64))
    rows.unpersist()
    return Model(counts, {k: max(v, floor) for k, v in evidence((0, 1)).items()}, floor, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_restored: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every whole text.

    With ``keep_restored`` also the restored, lower-cased text. Only the text
    is an input of the score. A null text is empty and gets the score of a text
    without words; ids may be null (then held_out is false) or repeat; other
    columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ", restored string" if keep_restored else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                cells = [part.column("doc_id"), part.column("held_out"), pa.array([scorer.score(t) for t in texts], pa.float64())]
                cells += [pa.array([scorer.restorer.text(t) for t in texts], pa.string())] if keep_restored else []
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "held_out", "score", *(["restored"] if keep_restored else [])])

    at = bare(docs, id_col, text_col).withColumn("held_out", held_out("doc_id"))
    return at.mapInArrow(tidy_task(run), f"doc_id long, held_out boolean, score double{extra}").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The input's rows and columns, and each whole text's score as a further column ``name``."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for part in slices(batch, text_col, 8 << 20):
                scores = [scorer.score(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy_task(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
