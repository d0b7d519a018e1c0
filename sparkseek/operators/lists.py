"""Search a document at a time: each document's terms are one row, and all queries are scored against batches of these rows.

A document's score needs nothing of other tasks, so only the best of each query leave one: what is shuffled grows with the
tasks and not with documents times queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as t
from . import sparse
from .sparse import DIGITS, OVERSAMPLE, top_per_query

#: Rows of queries' terms that are sent to every task; more are joined.
ASKED = 1 << 20
#: Cells of a matrix of terms by queries or by documents, scores that are held at once, and postings of a slice.
CELLS = 1 << 21
POSTINGS = 1 << 21
QUERIES = 256
#: Residues of document numbers that the bucketed variant keeps one document each of.
BUCKETS = 512


@dataclass
class Lists:
    """Where the lists (id, length, terms, counts) are, and how many documents and terms they have in all."""

    path: str
    n_docs: int
    total: int
    stemming: bool

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def postings(self, spark: SparkSession) -> DataFrame:
        """(term, id, count, length), a row for each term of each document."""
        each = self.table(spark).select("id", "length", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        return each.select(F.col("e.terms").alias("term"), "id", F.col("e.counts").alias("count"), "length")


def build(docs: DataFrame, root: str, id_col: str = "id", text_col: str = "text", stemming: bool = True, wanted: list[str] | None = None) -> Lists:
    """The lists of all documents with a text, of all terms or those wanted; the texts are read once and nothing is shuffled.

    Rows with one id are one document, as they are in a group by id, but for n_docs, which counts rows.
    """
    spark, path = docs.sparkSession, f"{root}/lists-{uuid.uuid4().hex}"
    t.term_lists(docs, id_col, text_col, stemming, wanted).write.parquet(f"{path}/each")
    each = spark.read.parquet(f"{path}/each")
    n, total = each.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    again = each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice"))
    if again.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("twice"))
        of = each.join(again, same, "left_semi")
        long = of.groupBy("id").agg(F.sum("length").alias("length"))
        sums = of.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("id", "e.terms").agg(F.sum("e.counts").alias("n"))
        one = sums.groupBy("id").agg(F.collect_list(F.struct("terms", "n")).alias("e")).select(F.col("id").alias("twice"), F.col("e.terms").alias("terms"), F.col("e.n").alias("counts"))
        none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("terms", "array<string>"), ("counts", "array<bigint>"))]
        merged = long.join(one, same, "left").select("id", "length", *none)
        each.join(again, same, "left_anti").unionByName(merged).write.parquet(f"{path}/merged")
        return Lists(f"{path}/merged", n, total, stemming)
    return Lists(f"{path}/each", n, total, stemming)


def asked_rows(queries: DataFrame, term: str, weight: str | None = None) -> list | None:
    """(query_id, term, weight) of all queries; None if they are more than are sent to every task."""
    rows = queries.select("query_id", F.col(term).alias("term"), F.col(weight).cast("double") if weight else F.lit(1.0), *[c for c in ("threshold",) if c in queries.columns])
    rows = [tuple(r) for r in rows.where("term IS NOT NULL").limit(ASKED + 1).collect()]
    return rows if len(rows) <= ASKED else None


@dataclass
class _Block:
    """Some queries: their ids, the numbers of their terms, and of each term of a query the places in both."""

    names: list
    terms: np.ndarray
    row: np.ndarray
    col: np.ndarray
    entry: np.ndarray

    def matrix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.names)))
        np.add.at(out, (self.row, self.col), values[self.entry])
        return out


def _blocks(rows: list[tuple]) -> tuple[list[str], list[_Block]]:
    """The distinct terms, and the queries in blocks of bounded size."""
    number: dict[str, int] = {}
    of: dict = {}
    for at, (name, term, *_) in enumerate(rows):
        of.setdefault(name, []).append((number.setdefault(term, len(number)), at))
    blocks: list[_Block] = []
    names: list = []
    own: dict[int, int] = {}
    places: list[tuple[int, int, int]] = []

    def close() -> None:
        if names:
            blocks.append(_Block(list(names), np.array(list(own)), *(np.array(v) for v in zip(*places))))
        names.clear(), own.clear(), places.clear()

    for name, entries in of.items():
        if names and (len(names) == QUERIES or (len(own) + len(entries)) * (len(names) + 1) > CELLS):
            close()
        places.extend((own.setdefault(term, len(own)), len(names), at) for term, at in entries)
        names.append(name)
    close()
    return list(number), blocks


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, so that a slice has at most so many rows, and POSTINGS unless it is one row."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, side="right"))
        yield lo, (lo := max(lo + 1, min(hi, lo + most)))


def _found(batch: pa.RecordBatch, vocabulary: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term's number, count) of the terms asked for in some rows of a batch."""
    terms, counts = (batch.column(c).slice(lo, hi - lo) for c in ("terms", "counts"))
    number = pc.index_in(terms.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(hi - lo), np.asarray(pc.list_value_length(terms)))
    has = number >= 0
    return row[has], number[has], counts.flatten().to_numpy(zero_copy_only=False)[has].astype(np.float64)


def _products(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, wide: int, right: np.ndarray) -> np.ndarray:
    """A sparse matrix times a dense one, some rows of it at a time. row doesn't fall."""
    out, step = np.empty((n, right.shape[1])), max(1, CELLS // max(1, wide))
    for lo in range(0, n, step):
        a, b = np.searchsorted(row, (lo, lo + step))
        left = np.zeros((min(step, n - lo), wide))
        left[row[a:b] - lo, col[a:b]] = value[a:b]
        out[lo : lo + step] = left @ right
    return out


def _best(s: np.ndarray, least: np.ndarray, k: int, bucket: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) of the k best of each row of s, ties to the first, of a bucket one; nothing below least, which rises."""
    if bucket is None:
        tops = s
    else:
        order = np.argsort(bucket, kind="stable")
        tops = np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(bucket[order], prepend=-1)), axis=1)
    if tops.shape[1] >= k:
        np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k], out=least)
    row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    score = s[row, col]
    if bucket is not None:
        order = np.lexsort((col, -score, bucket[col], row))
        key = row[order] * BUCKETS + bucket[col[order]]
        order = order[np.diff(key, prepend=-1) != 0]
        row, col, score = row[order], col[order], score[order]
    order = np.lexsort((col, -score, row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept]


#: What a weight is computed from: the numbers of terms, their counts, and the lengths of their documents.
Weights = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _search(table: DataFrame, query_type, rows: list[tuple], k: int, passes: list[tuple[Weights, np.ndarray, np.ndarray | None]], digits: int | None, bucketed: bool = False, exact: tuple[Weights, np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score, exact): of each task's documents the k best of each query, at least.

    A score sums over passes the products of documents' weights and queries' values, of which a pass has its own terms of
    queries; a weight that isn't a number is of no term. A document without a term of a query has no score. exact is of
    the documents that are given.
    """
    terms, blocks = _blocks(rows)
    queries = sum(len(b.names) for b in blocks)
    shared = table.sparkSession.sparkContext.broadcast((terms, blocks))
    kind, arrow = query_type.simpleString(), to_arrow_type(query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, blocks = shared.value
        vocabulary = pa.array(terms, pa.string())
        least = [np.full(len(b.names), -np.inf) for b in blocks]
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("terms")))
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            for lo, hi in _slices(size, max(1, CELLS // max(1, queries))) if blocks else ():
                order = np.asarray(pc.sort_indices(batch.column("id").slice(lo, hi - lo), null_placement="at_start"))
                ids = batch.column("id").slice(lo, hi - lo).take(pa.array(order))
                rank = np.empty(hi - lo, np.int64)
                rank[order] = np.arange(hi - lo)
                row, term, count = _found(batch, vocabulary, lo, hi)
                long = lengths[lo:hi][row].astype(np.float64)
                row = rank[row]
                by = np.argsort(row, kind="stable")
                row, term, count, long = row[by], term[by], count[by], long[by]
                bucket = np.mod(ids.to_numpy(zero_copy_only=False), BUCKETS) if bucketed else None
                for block, floor in zip(blocks, least):
                    place = np.full(len(terms), -1)
                    place[block.terms] = np.arange(len(block.terms))
                    own = np.flatnonzero(place[term] >= 0)
                    r, n, c, w = row[own], term[own], count[own], long[own]
                    col, wide = place[n], len(block.terms)
                    s, there = np.zeros((hi - lo, len(block.names))), np.zeros((hi - lo, len(block.names)))
                    for weights, values, chosen in passes:
                        value = weights(n, c, w)
                        has = ~np.isnan(value)
                        part = r[has], col[has]
                        held = np.ones(len(values)) if chosen is None else chosen.astype(float)
                        product = _products(*part, value[has], hi - lo, wide, block.matrix(values * held))
                        s += product
                        positive = (value[has] > 0).all() and (values > 0).all()
                        there += product if positive else _products(*part, np.ones(len(part[0])), hi - lo, wide, block.matrix(held))
                    s = np.where(there > 0, s if digits is None else np.round(s, digits) + 0.0, -np.inf).T
                    asked, found = _best(np.ascontiguousarray(s), floor, k, bucket)
                    columns = [pa.array(block.names, arrow).take(pa.array(asked)), ids.take(pa.array(found)), pa.array(s[asked, found])]
                    if exact is not None:
                        x = _products(r, col, exact[0](n, c, w), hi - lo, wide, block.matrix(exact[1]))
                        columns.append(pa.array(np.round(x[found, asked], DIGITS) + 0.0))
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", "exact"][: len(columns)])

    return table.select("id", "length", "terms", "counts").mapInArrow(run, f"query_id {kind}, id {table.schema['id'].dataType.simpleString()}, score double" + ", exact double" * (exact is not None))


def _frequencies(table: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of these terms is."""
    shared = table.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pa.array(shared.value, pa.string()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            number = pc.index_in(batch.column("terms").flatten(), value_set=vocabulary).drop_null().to_numpy(zero_copy_only=False)
            total += np.bincount(number, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(at)), pa.array(total[at])], names=["term", "df"])

    return {r["term"]: r["df"] for r in table.select("terms").mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def text_best(built: Lists, queries: DataFrame, rows: list[tuple], k: int, k1: float, b: float, avgdl: float | None = None, bucketed: bool = False) -> DataFrame:
    """(query_id, id, score) by BM25 of terms asked, rows of asked_rows(queries): the k best of each query and task at least.

    With bucketed the best of each residue of the id alone is in question.
    """
    rows = list(dict.fromkeys(rows))
    table = built.table(queries.sparkSession)
    terms, _ = _blocks(rows)
    found = _frequencies(table, terms) if terms else {}
    df = np.array([found.get(term, 0) for term in terms], np.float64)
    idf = np.log1p((built.n_docs - df + 0.5) / (df + 0.5))
    mean = avgdl if avgdl is not None else built.total / built.n_docs if built.n_docs else None

    def weights(term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return count * (k1 + 1.0) / (count + k1 * ((1.0 - b) + b * (length / mean))) * idf[term]

    return _search(table, queries.schema["query_id"].dataType, rows, k, [(weights, np.ones(len(rows)), None)], DIGITS, bucketed)


def sparse_best(built: Lists, queries: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    """(query_id, id, score) by products of counts and the queries' values: the k best of each query and task at least."""
    weights = lambda term, count, length: count
    return _search(built.table(queries.sparkSession), queries.schema["query_id"].dataType, rows, k, [(weights, np.array([r[2] for r in rows], float), None)], DIGITS)


def quantized_best(built: Lists, queries: DataFrame, rows: list[tuple], k: int, upper: float, bits: int, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, exact): by products of codes, of which a query's small ones read large codes alone; and the exact products."""
    top = float((1 << bits) - 1)
    code = lambda value: np.floor(np.maximum(0.0, np.minimum(top, value / upper * top)))
    value = np.array([r[2] for r in rows], float)
    own = code(value)
    limit = np.array([np.nan if (x := r[3] if len(r) > 3 and r[3] is not None else threshold) is None else x for r in rows], float) * float(1 << bits)
    cut = np.where(np.isnan(limit) | (own > np.floor(limit)), 0, np.floor(np.minimum(limit, 255.0)))

    def least(at: float) -> Weights:
        return lambda term, count, length: np.where((c := code(count)) >= at, c, np.nan)

    passes = [(least(at), own, cut == at) for at in np.unique(cut).tolist()]
    exact = (lambda term, count, length: count), value
    found = _search(built.table(queries.sparkSession), queries.schema["query_id"].dataType, rows, k, passes, None, exact=exact)
    return found.withColumn("score", F.col("score").cast("bigint"))


def search(built: Lists, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k largest products of counts and the values of queries (query_id, dim, q)."""
    rows = asked_rows(queries, "dim", "q")
    if rows is None:
        return sparse.search(_values(built, queries), queries, k)
    return top_per_query(sparse_best(built, queries, rows, k), k)


def quantized_search(built: Lists, queries: DataFrame, k: int = 10, upper: float = 1.0, bits: int = 6, threshold: float | None = None, rerank: bool = False, oversample: int | None = OVERSAMPLE) -> DataFrame:
    """As sparse.quantized_search, of counts. A document's counts are there with their codes, so with oversample=None all are ranked by them."""
    rows = asked_rows(queries, "dim", "q")
    if rows is None:
        return sparse.quantized_search(sparse.with_codes(_values(built, queries), upper, bits), queries, k, upper, bits, threshold, rerank, oversample)
    if rerank and oversample is None:
        return top_per_query(sparse_best(built, queries, rows, k), k)
    if not rerank:
        return top_per_query(quantized_best(built, queries, rows, k, upper, bits, threshold), k)
    found = quantized_best(built, queries, rows, k * oversample, upper, bits, threshold)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    some = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k * oversample)
    return top_per_query(some.select("query_id", "id", F.col("exact").alias("score")), k)


def _values(built: Lists, queries: DataFrame) -> DataFrame:
    each = built.postings(queries.sparkSession)
    return each.select(F.col("term").alias("dim"), "id", F.col("count").cast("double").alias("val"))
