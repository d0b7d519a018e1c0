"""Exact top-k search by three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_groups, arrow_map, mapped, materialise, pruned

K = 10
#: Score lists of a query: one for each of so many ranges of the vectors' dimensions.
LISTS = 2
#: Vectors in a tile, at most.
TILE = 2048
#: Ranges of tiles of either side at most; a task takes one of each, and sends one list of the best for each query.
MOST_PARTS = 128
DIGITS = 6
#: Cutoffs are lowered by this, so that neither rounding of scores nor the order of sums can drop an entry.
MARGIN = 2 * 10.0**-DIGITS


def _tiles(vectors: DataFrame, dim: int) -> DataFrame:
    """(tile, ids, data): up to TILE vectors of dim finite numbers each, packed, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            right = np.flatnonzero(size == dim)
            flat = lists.take(pa.array(right)).flatten()
            data = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            fine = np.isfinite(data).all(1)
            ids, data = batch.column("id").to_numpy()[right[fine]], data[fine]
            for i in range(0, len(ids), TILE):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + TILE].tobytes()], pa.binary()), pa.array([data[i : i + TILE].tobytes()], pa.binary())], names=["ids", "data"])

    packed = arrow_map(vectors, run, "ids binary, data binary")
    return materialise(packed.select(F.monotonically_increasing_id().alias("tile"), "ids", "data"), "tiles")


def _pairs(queries: DataFrame, n_queries: int, tiles: DataFrame, n: int, cutoffs: DataFrame | None = None) -> DataFrame:
    """Each tile of queries, with its cutoffs if there are any, and each tile of items; neither side is broadcast.

    A task has a range of tiles of either side, and all items of a tile of queries on end.
    """
    left = queries.select(F.col("tile").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    if cutoffs is not None:
        left = left.join(cutoffs, "q")
    right = tiles.select(F.col("tile").alias("x"), F.col("ids").alias("x_ids"), F.col("data").alias("x_data"))
    parts = lambda m: max(1, min(m, MOST_PARTS))
    return left.repartition(parts(n_queries), "q").hint("shuffle_replicate_nl").crossJoin(right.repartition(parts(n), "x"))


def _lists(dim: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def _best(k: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Positions of the k best entries of each row, by score, then smallest id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    begin = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _entries(names: list[str], q: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), blob(rows, np.int32), blob(ids, np.int64), blob(scores, np.float64)], names=names)


def top_k(vectors: DataFrame, k: int = K, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score): for every query the k other vectors with the largest inner product, exactly.

    queries has the same columns as vectors; without it, every row is a query. A query's score of a vector is a sum of
    local scores, one of each range of dimensions, so it has a local score list for each range and each tile of vectors.
    First, the k best entries of each list are gathered and their sums give a cutoff: the k-th best sum so far can only
    be beaten, so an entry whose local scores are all below cutoff / lists can't be among the k best. Second, the cutoff
    of each query goes to all its lists, which return every entry that reaches it. Third, the sums of those entries are
    resolved exactly and the k best stay. A task merges what its tiles give for a query before it sends it on, so what
    meets in one place is k entries a query from each of MOST_PARTS ranges at most, whatever the number of vectors.

    Scores are rounded to 6 places; ties go to the smallest id, and rank counts from 1. Ids are whole numbers, of any
    width; others are refused. Rows of the query's own id aren't its neighbours. Rows with a null id, and vectors that
    are null, hold a null, NaN or infinite number or haven't the vectors' most common length (the larger one at a tie)
    take no part. Rows that repeat an id are queries and neighbours each. Fewer than k others give fewer rows. Other
    columns don't matter. An empty table gives an empty result.
    """
    for df in (vectors, queries):
        if df is not None and not isinstance(df.schema[id_col].dataType, T.IntegralType):
            raise TypeError(f"{id_col} has ids of type {df.schema[id_col].dataType.simpleString()}: whole numbers are needed")
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    fit = lambda df: pruned(df, id=id_col, vector=vector_col).where("id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    some = fit(vectors)
    lengths = some.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if lengths is None or not lengths["n"]:
        return empty
    dim = lengths["n"]
    tiles = _tiles(some, dim)
    n = tiles.count()
    asked, n_asked = (tiles, n) if queries is None else ((t := _tiles(fit(queries), dim)), t.count())
    ranges = _lists(dim, lists)
    names = ["q", "rows", "ids", "scores"]
    kind = "q bigint, rows binary, ids binary, scores binary"

    def best_of(batches: Iterator[pa.RecordBatch], entries_of) -> Iterator[pa.RecordBatch]:
        """The k best entries of each query over successive tiles of items, one row for a tile of queries."""
        at, held = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != at:
                    if held is not None:
                        yield _entries(names, at, *held)
                    at, held = row[0], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                both = [np.concatenate(x) for x in zip(held, entries_of(*row))]
                best = _best(k, *both)
                held = tuple(x[best] for x in both)
        if held is not None:
            yield _entries(names, at, *held)

    def first_lists(q, q_ids, q_data, _, x_ids, x_data):
        (qi, qv), (xi, xv) = _unpack(q_ids, q_data, dim), _unpack(x_ids, x_data, dim)
        same = np.isin(qi, xi)
        first = min(k + int(same.any()) * int(np.unique(xi, return_counts=True)[1].max()), len(xi))
        row, col = [], []
        for r in ranges:
            local = qv[:, r] @ xv[:, r].T
            best = np.argpartition(local, len(xi) - first, axis=1)[:, len(xi) - first :]
            row.append(np.repeat(np.arange(len(qi)), first))
            col.append(best.ravel())
        both = np.unique(np.concatenate(row) * len(xi) + np.concatenate(col))
        rows, cols = both // len(xi), both % len(xi)
        other = qi[rows] != xi[cols]
        rows, cols = rows[other], cols[other]
        return rows, xi[cols], np.einsum("ij,ij->i", qv[rows], xv[cols])

    def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        return table.column("q")[0].as_py(), join("rows", np.int32).astype(np.int64), join("ids", np.int64), join("scores", np.float64)

    def cutoff(table: pa.Table) -> pa.Table:
        q, rows, ids, scores = merged(table)
        best = _best(k, rows, ids, scores)
        count = np.bincount(rows[best], minlength=int(rows.max(initial=-1)) + 1)
        low = np.full(len(count), math.inf)
        np.minimum.at(low, rows[best], scores[best])
        low[count < k] = -math.inf
        return pa.table({"q": pa.array([q], pa.int64()), "low": pa.array([low.tobytes()], pa.binary())})

    def reaching(q, q_ids, q_data, low, _, x_ids, x_data):
        (qi, qv), (xi, xv) = _unpack(q_ids, q_data, dim), _unpack(x_ids, x_data, dim)
        total = np.full(len(qi), -math.inf)
        known = np.frombuffer(low, np.float64)
        total[: len(known)] = known - MARGIN
        share = (total / len(ranges))[:, None]
        reached = np.zeros((len(qi), len(xi)), bool)
        for r in ranges:
            reached |= qv[:, r] @ xv[:, r].T >= share
        rows, cols = np.nonzero(reached)
        other = qi[rows] != xi[cols]
        rows, cols = rows[other], cols[other]
        scores = np.concatenate([np.einsum("ij,ij->i", qv[rows[i : i + 65536]], xv[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        near = scores >= total[rows]
        return rows[near], xi[cols[near]], np.round(scores[near], DIGITS)

    def resolve(table: pa.Table) -> pa.Table:
        qi = np.frombuffer(table.column("q_ids")[0].as_py(), np.int64)
        _, rows, ids, scores = merged(table)
        best = _best(k, rows, ids, scores)
        begin = np.flatnonzero(np.append(True, rows[best][1:] != rows[best][:-1])) if len(best) else np.zeros(0, np.int64)
        rank = np.arange(len(best)) - np.repeat(begin, np.diff(np.append(begin, len(best)))) + 1
        return pa.table({"query_id": qi[rows[best]], "rank": rank.astype(np.int32), "id": ids[best], "score": scores[best] + 0.0})

    local = mapped(_pairs(asked, n_asked, tiles, n), lambda b: best_of(b, first_lists), _schema(spark, kind))
    low = materialise(arrow_groups(local.groupBy("q"), cutoff, "q bigint, low binary"), "cutoffs")
    reached = mapped(_pairs(asked, n_asked, tiles, n, low), lambda b: best_of(b, reaching), _schema(spark, kind))
    entries = reached.join(asked.select(F.col("tile").alias("q"), F.col("ids").alias("q_ids")), "q")
    return arrow_groups(entries.groupBy("q"), resolve, "query_id bigint, rank int, id bigint, score double")


def _schema(spark, ddl: str):
    return spark.createDataFrame([], ddl).schema


#: Of the registered query, every row whose id is divisible by this is a query, against all rows.
QUERY_EVERY = 50

SQL = f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id,
           round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {DIGITS}) + 0.0 AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % {QUERY_EVERY} = 0
  )
) WHERE rank <= {K}
"""
