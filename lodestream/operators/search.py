"""Full-text search: an index of word arrays, a query language, BM25.

Queries: words (all must be there), AND, OR, NOT, "a phrase", prefix*,
column:word, NEAR(a b, n), and parentheses.

The index has one row a document with the words of each column in order. A
query is then one pass over it: what each term finds is counted inside the row
by array functions, and only counts of matching documents are summed up, so
nothing is exploded, shuffled by word or gathered by document.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WORD = r"[\p{L}\p{N}]+"
#: Marks that stand behind a letter as characters of their own.
MARKS = r"[\u0300-\u036f]"


@cache
def _plain_letters() -> tuple[str, str]:
    """Letters with exactly one mark, and the letters without it."""
    pairs = []
    for c in map(chr, range(0xC0, min(0x2000, sys.maxunicode))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isalpha() and unicodedata.combining(parts[1]):
            pairs.append((c, parts[0]))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def folded(text: Column) -> Column:
    """Lower case, and without the marks of letters."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, ""), *_plain_letters())


def folded_word(word: str) -> str:
    return re.sub("[\u0300-\u036f]", "", word.lower()).translate(str.maketrans(*_plain_letters()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, id_col: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """(doc_id, words, len): the words of each column in order, and their number.

    ``words`` is a struct with one array for each column. ``where`` keeps the
    rows that may be found, and unknown isn't true. Null texts have no words.
    """
    rows = docs if where is None else docs.where(where)
    at = rows.select(F.col(id_col).alias("doc_id"), F.struct(*(tokens(F.col(c)).alias(c) for c in columns)).alias("words"))
    return at.withColumn("len", reduce(lambda x, y: x + y, (F.size(F.col("words")[c]) for c in columns), F.lit(0)).cast("bigint"))


def described(photos: DataFrame) -> Column:
    """What a library's search finds: rows that are described and not discarded."""
    return photos["described_at"].isNotNull() & (photos["discarded"] == 0)


def write_index(index: DataFrame, path: str) -> None:
    """Store an index, replacing what is there."""
    index.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class QueryError(ValueError):
    """A query that doesn't parse."""


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    near: int | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


TOKEN = re.compile(r'\s*(?:(NEAR)\s*\(|(\()|(\))|(AND|OR|NOT)\b|(?:(\w+)\s*:\s*)?"([^"]*)"(\*)?|(?:(\w+)\s*:\s*)?([^\s()":*,]+)(\*)?|(,))', re.UNICODE)


def parse(query: str, columns: list[str]) -> Term | Op:
    """The tree of a query; raises QueryError."""
    items, at = [], 0
    while at < len(query.rstrip()):
        m = TOKEN.match(query, at)
        if not m:
            raise QueryError(f"syntax error near {query[at:at + 10]!r}")
        items.append(m)
        at = m.end()
    at = 0

    def peek() -> re.Match | None:
        return items[at] if at < len(items) else None

    def take() -> re.Match:
        nonlocal at
        if at >= len(items):
            raise QueryError("the query ends early")
        at += 1
        return items[at - 1]

    def words(text: str) -> tuple[str, ...]:
        found = tuple(re.findall(r"[^\W_]+", folded_word(text)))
        if not found:
            raise QueryError(f"no word in {text!r}")
        return found

    def leaf() -> Term | Op:
        m = take()
        if m[1]:
            got: list[str] = []
            distance = 10
            while not (m := take())[3]:
                if m[11]:
                    number = take()
                    if not (number[9] or "").isdigit():
                        raise QueryError("NEAR needs a number")
                    distance = int(number[9])
                elif m[6] or m[9]:
                    got += words(m[6] or m[9])
                else:
                    raise QueryError("NEAR holds words only")
            return Term(tuple(got), near=distance)
        if m[2]:
            inner = either()
            if not (peek() and take()[3]):
                raise QueryError("a parenthesis is open")
            return inner
        if m[6] is not None or m[9]:
            column = m[5] if m[6] is not None else m[8]
            if column is not None and column not in columns:
                raise QueryError(f"no such column: {column}")
            return Term(words(m[6] if m[6] is not None else m[9]), bool(m[7] or m[10]), column)
        raise QueryError(f"syntax error near {m[0]!r}")

    def without() -> Term | Op:
        left = leaf()
        while peek() is not None and peek()[4] == "NOT":
            take()
            left = Op("NOT", (left, leaf()))
        return left

    def every() -> Term | Op:
        parts = [without()]
        while (m := peek()) is not None and not m[3] and m[4] != "OR":
            if m[4] == "AND":
                take()
            elif m[4] or m[11]:
                raise QueryError(f"syntax error near {m[0]!r}")
            parts.append(without())
        return parts[0] if len(parts) == 1 else Op("AND", tuple(parts))

    def either() -> Term | Op:
        parts = [every()]
        while (m := peek()) is not None and m[4] == "OR":
            take()
            parts.append(every())
        return parts[0] if len(parts) == 1 else Op("OR", tuple(parts))

    if not items:
        raise QueryError("an empty query")
    tree = either()
    if peek() is not None:
        raise QueryError(f"syntax error near {peek()[0]!r}")
    return tree


def _leaves(node: Term | Op) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    return [t for i, p in enumerate(node.parts) if not (node.kind == "NOT" and i) for t in _leaves(p)]


def _fits(term: Term, i: int) -> Callable[[Column], Column]:
    """Whether a word is the term's i-th one, or begins with it if that is its last and a prefix."""
    word = term.words[i]
    return lambda x: x.startswith(word) if term.prefix and i == len(term.words) - 1 else x == word


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def _count_places(words: Column, term: Term) -> Column:
    """How many places in an array of words a term of several words begins at, by the places of each of its words."""
    n = len(term.words)
    of = lambda i: F.filter(F.transform(words, lambda x, k: F.when(_fits(term, i)(x), k)), lambda k: k.isNotNull())

    def begins(places: Column) -> Column:
        if term.near is None:
            return F.filter(places[0], lambda p: _all(F.array_contains(places[i], p + i) for i in range(1, n)))
        span = term.near + n
        whole = lambda start: _all(F.exists(places[i], lambda q: (q >= start) & (q < start + span)) for i in range(n))
        return F.filter(places[0], lambda p: F.exists(F.flatten(places), lambda start: (start <= p) & (p < start + span) & whole(start)))

    # Bound as a lambda's variable, so that the places are found once.
    found = F.transform(F.array(F.array(*(of(i) for i in range(n)))), lambda places: F.size(begins(places)))
    return F.get(found, F.lit(0))


def occurrences(words: Column, term: Term, columns: list[str]) -> Column:
    """How often a term is found in the columns of a document."""

    def count(own: Column) -> Column:
        if len(term.words) > 1:
            # Bound, too: a text is split once and not for each word.
            return F.get(F.transform(F.array(own), lambda words_: _count_places(words_, term)), F.lit(0))
        return F.size(F.filter(own, _fits(term, 0)))

    return reduce(lambda x, y: x + y, (count(words[c]) for c in columns if term.column in (None, c)), F.lit(0)).cast("double")


def _true(node: Term | Op, number: dict[Term, int]) -> Column:
    """Whether a document fits a tree, by its counts f."""
    if isinstance(node, Term):
        return F.get("f", F.lit(number[node])) > 0
    first, *rest = (_true(p, number) for p in node.parts)
    for other in rest:
        first = first | other if node.kind == "OR" else first & (~other if node.kind == "NOT" else other)
    return first


def _terms(node: Term | Op) -> list[Term]:
    return [node] if isinstance(node, Term) else [t for p in node.parts for t in _terms(p)]


def search_index(index: DataFrame, query: str, columns: list[str], limit: int | None = 20) -> DataFrame:
    """(doc_id, score), the best first: lower (more negative) BM25 scores are better; ties by id.

    k1 is 1.2 and b is 0.75; an idf that isn't positive becomes 1e-6; occurrences
    and lengths are over all columns. ``limit`` None returns all matches, in no
    order.
    """
    tree = parse(query, columns)
    number = {t: i for i, t in enumerate(dict.fromkeys(_terms(tree)))}
    scored = [number[t] for t in dict.fromkeys(_leaves(tree))]
    at = index.select("doc_id", "len", F.array(*(occurrences(F.col("words"), t, columns) for t in number)).alias("f"))
    total = at.agg(F.count("*").alias("_docs"), F.avg("len").alias("_mean"), F.array(*(F.count_if(F.get("f", F.lit(i)) > 0) for i in range(len(number)))).alias("_n"))
    at = at.where(_true(tree, number)).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    score = F.lit(0.0)
    for i in scored:
        f, n = F.get("f", F.lit(i)), F.get("_n", F.lit(i))
        idf = F.ln((F.col("_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("_mean")))
        score = score + F.when(f > 0, part).otherwise(0.0)
    out = at.select("doc_id", (-score).alias("score"))
    return out if limit is None else out.orderBy("score", "doc_id").limit(limit)


def search(docs: DataFrame, query: str, id_col: str, columns: list[str], limit: int | None = 20, where: Column | None = None) -> DataFrame:
    """``search_index`` over the index of these rows; see there."""
    return search_index(build_index(docs, id_col, columns, where), query, columns, limit)


#: Columns of a library's index.
PHOTO_COLUMNS = ["caption", "scene", "people", "place"]


def photo_index(photos: DataFrame) -> DataFrame:
    return build_index(photos, "id", PHOTO_COLUMNS, described(photos))


def search_photos(photos: DataFrame, query: str, limit: int | None = 20, index: DataFrame | None = None) -> DataFrame:
    """(id, path, scene, place, caption, cluster_id, score) of a library's matches, by a stored index if there is one."""
    hits = search_index(photo_index(photos) if index is None else index, query, PHOTO_COLUMNS, limit)
    found = photos.select("id", "path", "scene", "place", "caption", "cluster_id").join(hits.withColumnRenamed("doc_id", "id"), "id")
    return found if limit is None else found.orderBy("score", "id")
