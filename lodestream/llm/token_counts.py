"""Exact token counts of whole texts, huge documents included."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, bare, slices, tidy_task

#: Characters for which this module's splitter and the library's agree by definition: ASCII and Latin letters and signs.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‘-‟]")
#: A boundary that no context can move: white space right after something else.
EDGE = re.compile(r"(?<=\S)\s")


class Counter:
    """Counts tokens with one tokenizers file; one instance serves a Python worker."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # Counting word by word is exact only for this splitter, and only without a normaliser.
        self.by_words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not (spec["model"].get("dropout") or spec["model"].get("ignore_merges"))
        added = spec.get("added_tokens", [])
        #: Special strings are found first, the longest of those that begin at a place, and what is between them is encoded by itself.
        self.special = re.compile("|".join(re.escape(t) for t in sorted((t["content"] for t in added), key=len, reverse=True))) if added else None
        self.cuts_cleanly = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.memo = Memo(32 << 20)

    def _words(self, text: str) -> int:
        words, memo = self.split(text), self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            pass
        new = list({w for w in words if w not in memo})
        fresh = dict(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        total = sum(fresh[w] if w in fresh else memo[w] for w in words)
        for w, n in fresh.items():
            memo.keep(w, n, len(w))
        return total

    def count(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a whole text: of the special strings in it, and of what stands between them."""
        if self.special is None or not self.special.search(text):
            return self.spliced(text, chunk, overlap)
        if not self.cuts_cleanly:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        return len(self.special.findall(text)) + sum(self.spliced(t, chunk, overlap) for t in self.special.split(text) if t)

    def plain(self, text: str) -> int:
        """Tokens of a chunk that is encoded in one piece."""
        if self.by_words and not PLAIN.search(text):
            return self._words(text)
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text without special strings from overlapping chunks; a text of one chunk needs no splice.

        Neighbouring encodings are spliced at a place in their overlap where
        white space follows something else and both have a token boundary: no
        match of the splitter reaches across it, and what follows depends on
        nothing before it. If the overlap has no such place, it is widened.
        """
        if len(text) <= chunk or not self.by_words:
            return self.plain(text)
        total, start, cut = 0, 0, 0
        while True:
            end = min(len(text), start + chunk)
            spans = self._spans(text, start, end)
            if end == len(text):
                return total + sum(a >= cut for a, _ in spans)
            wide = overlap
            while True:
                begin = max(end - wide, cut)
                right = {a for a, _ in self._spans(text, begin, end)}
                left = {a for a, _ in spans}
                # The last character of the chunk may lack its look-ahead.
                found = [m.start() for m in EDGE.finditer(text, begin, end - 1) if m.start() > begin]
                found = [p for p in found if p in left and p in right and p > cut]
                if found or begin == cut:
                    break
                wide *= 2
            if not found:
                chunk *= 2
                continue
            total += sum(cut <= a < found[-1] for a, _ in spans)
            start = cut = found[-1]

    def _spans(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        got = self.tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        return [(a + start, b + start) for a, b in got]


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``vocabulary`` is the path of a ``tokenizers`` file, present on every
    machine. Texts over ``chunk`` characters are encoded in overlapping chunks
    and spliced, between the special strings that they hold. No begin, end or other added tokens; special strings inside a
    text count as the library's default has it. A null text is empty and has 0
    tokens; ids may be null or repeat; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [it.count(t, chunk, overlap) for t in texts]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return bare(docs, id_col, text_col).mapInArrow(tidy_task(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
