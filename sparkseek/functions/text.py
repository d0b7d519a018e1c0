"""Text to terms, and the BM25 parts that are columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemmer import stem

MAX_TOKEN_BYTES = 40
STOP_WORDS = tuple("s t a as at be by if in is it no of on or to and are but for not the was www into such that then they this will with their there these".split())
#: Letters and what counts as one (the Alphabetic property), numbers of all kinds, and underscores.
WORD = r"[\p{Alphabetic}\p{N}_]+"
_WORD = regex.compile(WORD)
#: The same in ASCII, where both agree and this is faster.
_ASCII_WORD = re.compile(r"\w+", re.ASCII)
#: Distinct tokens whose terms a worker remembers.
REMEMBERED = 1 << 19


def tokens(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


class Terms:
    """The term of each token: lower case, and its stem if wanted; none for a token that is too long or a stop-word."""

    def __init__(self, stemming: bool = True, max_bytes: int = MAX_TOKEN_BYTES):
        self.stemming, self.max_bytes, self.known = stemming, max_bytes, {}

    def of(self, token: str) -> str | None:
        if token in self.known:
            return self.known[token]
        term = None
        if len(token) <= self.max_bytes and len(token.encode()) <= self.max_bytes:
            term = token.lower()
            term = None if term in STOP_WORDS else stem(term) if self.stemming else term
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = term
        return term

    def listed(self, text: str) -> list[str]:
        """In the order of the text, duplicates too."""
        return [t for t in map(self.of, tokens(text)) if t is not None]

    def counted(self, text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        known = self.known
        for token, n in Counter(tokens(text)).items():
            if (term := known[token] if token in known else self.of(token)) is not None:
                out[term] = out.get(term, 0) + n
        return out


def terms(text: Column, stemming: bool = True, max_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """Tokens of at most max_bytes bytes in lower case, without stop-words, stemmed; duplicates stay. Null gives null."""
    known = Terms(stemming, max_bytes)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else known.listed(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def term_counts(docs: DataFrame, id_col: str, text_col: str, stemming: bool = True, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """(id, term, count, length): a row for each distinct term of each row of docs with a text; length counts all terms.

    One pass over the texts, in Arrow batches, and nothing is shuffled. A token is looked up once a document.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(stemming, max_bytes)
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, batch.num_rows, 1000):
                counts = [known.counted(x) for x in texts.slice(at, 1000).to_pylist()]
                n = np.array([len(c) for c in counts])
                total = np.array([sum(c.values()) for c in counts], np.int64)
                rows = pa.array(np.repeat(np.arange(len(counts)), n))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 1000).take(rows), pa.array([t for c in counts for t in c], pa.string()), pa.array([x for c in counts for x in c.values()], pa.int64()), pa.array(np.repeat(total, n))],
                    names=["id", "term", "count", "length"],
                )

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return some.mapInArrow(run, f"id {kind}, term string, count bigint, length bigint")


def term_lists(docs: DataFrame, id_col: str, text_col: str, stemming: bool = True, wanted: list[str] | None = None, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """(id, length, terms, counts): a row for each row of docs with a text; length counts all terms, wanted or not."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(None if wanted is None else frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some = Terms(stemming, max_bytes), shared.value
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, batch.num_rows, 1000):
                counts = [known.counted(x) for x in texts.slice(at, 1000).to_pylist()]
                total = [sum(c.values()) for c in counts]
                if some is not None:
                    counts = [{x: n for x, n in c.items() if x in some} for c in counts]
                ends = pa.array(np.cumsum([0, *map(len, counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array([x for c in counts for x in own(c)], of)) for own, of in ((dict.keys, pa.string()), (dict.values, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), pa.array(total, pa.int64()), *lists], names=["id", "length", "terms", "counts"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return some.mapInArrow(run, f"id {kind}, length bigint, terms array<string>, counts array<bigint>")


def lengths(docs: DataFrame, text_col: str, stemming: bool = False, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """(n_docs, total): rows with a text and their terms, by tasks; neither terms nor texts leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = Terms(stemming, max_bytes), 0, 0
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, 1000):
                total += sum(sum(known.counted(x).values()) for x in batch.column(0).slice(at, 1000).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n_docs", "total"])

    return docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, "n_docs bigint, total bigint")


def tf(count: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """BM25's saturated term frequency."""
    return count * F.lit(k1 + 1.0) / (count + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * (length / average)))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
