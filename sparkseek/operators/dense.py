"""Dense top-k search: exact, filtered, quantised with exact re-ranking, one query or a table of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import DimensionMismatch, SearchError
from ..functions import quantize
from ..functions.filters import Filter
from ..functions.vectors import METRICS, cosine, dot_codes, literal_vector

#: Candidates kept for each result wanted, before exact re-ranking.
OVERSAMPLE = 5
DIGITS = 6
#: Queries that are sent to every task, in bytes at most; those of a larger table meet the records in blocks.
QUERY_BYTES = 4 << 20
#: Scores that a task holds at once, and bytes of a block's vectors as doubles.
SCORES = 1 << 21
BLOCK_BYTES = 16 << 20
#: Scores of which only the largest is compared when a query's bound is looked for, and candidates scored exactly at once.
GROUP = 64
CANDIDATES = 1 << 16


def check_dimension(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """df, with a row that fails the job if its vector has another length."""
    n = F.size(vector_col)
    return df.withColumn(vector_col, F.when(F.col(vector_col).isNull() | (n == dim), F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit(f"vector of other than {dim} dimensions: "), n.cast("string"))).cast("array<float>")))


def _filtered(records: DataFrame, where: Filter | Column | None) -> DataFrame:
    if where is None:
        return records
    return records.where(where.column() if isinstance(where, Filter) else where)


def search(
    records: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Filter | Column | None = None,
    id_col: str = "id", vector_col: str = "dense", return_cols: tuple[str, ...] = (), final_score: str | None = None,
) -> DataFrame:
    """(id, score, *return_cols): the k best records, after the filter, by the metric; ties go to the smallest id.

    Scores are rounded to 6 places before they are ordered. Records without a score (null vector, other length, zero
    norm) aren't results. final_score="cosine" reports the cosine for what another metric ranks.
    """
    m = METRICS.get(metric)
    if m is None:
        raise SearchError(f"no metric {metric}")
    if not query:
        raise DimensionMismatch("the query is empty")
    q = literal_vector(query)
    score = F.round(m.score(F.col(vector_col), q), DIGITS) + F.lit(0.0)
    ranked = _filtered(records, where).select(F.col(id_col).alias("id"), score.alias("score"), vector_col, *return_cols).where("score IS NOT NULL")
    best = ranked.orderBy(m.order(F.col("score")), "id").limit(k)
    if final_score == "cosine":
        best = best.withColumn("score", F.round(cosine(F.col(vector_col), q), DIGITS))
    return best.select("id", "score", *return_cols)


def quantized_search(
    records: DataFrame, query: list[float], k: int = 10, low: float = -1.0, high: float = 1.0, oversample: int = OVERSAMPLE,
    where: Filter | Column | None = None, id_col: str = "id", vector_col: str = "dense", codes_col: str | None = None,
) -> DataFrame:
    """(id, score): ranks by the cosine of 8-bit codes, keeps oversample * k, and ranks those by the exact cosine.

    codes_col names codes stored with the records, so that the scan reads these alone until the second step.
    """
    codes = F.col(codes_col) if codes_col else quantize.u8_codes(F.col(vector_col), low, high)
    q = np.floor((np.clip(np.asarray(query, np.float64), low, high) - low) / (high - low) * 255.0).astype(int)
    qc = F.array(*[F.lit(int(x)).cast("smallint") for x in q])
    q_norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    rough = F.round(dot_codes(codes, qc) / (quantize.code_norm(codes) * F.lit(q_norm)), DIGITS)
    some = _filtered(records, where).select(F.col(id_col).alias("id"), rough.alias("rough"), vector_col).where("rough IS NOT NULL")
    candidates = some.orderBy(F.desc("rough"), "id").limit(k * oversample)
    return candidates.select("id", F.round(cosine(F.col(vector_col), literal_vector(query)), DIGITS).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def batch_search(
    records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "dense",
    query_id_col: str = "query_id", query_col: str = "query", where: Column | None = None, exclude_self: bool = False,
    match: tuple[str, str] | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the k best records for each row of queries; rank counts from 1.

    where may use columns of both sides, so each query can have its own filter; the sides are then joined, and Catalyst
    picks how. match names a column of the records and one of the queries that have to be equal; null equals nothing.
    Without where, a metric that is a product is computed by matrix products of bounded size, of which only k results a
    query and batch of records leave the task: queries go to every task once where they are few, by a count of their
    bytes, and meet the records of their match block by block otherwise.
    """
    m = METRICS.get(metric)
    if m is None:
        raise SearchError(f"no metric {metric}")
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_col).alias("query"), *[c for c in queries.columns if c not in (query_id_col, query_col)])
    if metric in ("cosine", "dotproduct") and where is None:
        few = match is None and (q.agg(F.sum(F.size("query") * 8)).first()[0] or 0) <= QUERY_BYTES
        hits = _scored_by_batches(records, q, k, metric, id_col, vector_col, exclude_self) if few else _scored_by_blocks(records, q, k, metric, id_col, vector_col, exclude_self, match)
        return _ranked(hits, m, k)
    if match is not None:
        equal = records[match[0]] == q[match[1]]
        where = equal if where is None else equal & where
    pairs = records.crossJoin(q) if where is None else records.join(q, where)
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col(id_col))
    score = F.round(m.score(F.col(vector_col), F.col("query")), DIGITS) + F.lit(0.0)
    return _ranked(pairs.select("query_id", F.col(id_col).alias("id"), score.alias("score")).where("score IS NOT NULL"), m, k)


def _ranked(hits: DataFrame, m, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(m.order(F.col("score")), "id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _matrix(lists: pa.ListArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors) of those that are whole and of this length, of the first one's if none is given."""
    size = np.diff(lists.offsets.to_numpy())
    has = ~np.asarray(lists.is_null())
    dim = dim if dim is not None else int(size[has][0]) if has.any() else 0
    right = np.flatnonzero((size == dim) & has)
    return right, lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), dim)


def _best(names: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, metric: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best records of each query, ties to the smallest id, some queries at a time.

    Products in single precision leave out what can't be among the k best, by a bound on their error and what rounding
    can move; the others are scored in double.
    """
    wide, long = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    least = np.nextafter(0, 1) if metric == "cosine" else 0
    asked, has = np.flatnonzero((wide >= least) & np.isfinite(wide)), np.flatnonzero((long >= least) & np.isfinite(long))
    if not len(asked) or not len(has):
        return
    has = has[np.asarray(pc.sort_indices(ids.take(pa.array(has)), null_placement="at_start"))]
    ids, x, long, q, wide = ids.take(pa.array(has)), x[has], long[has], q[asked], wide[asked]
    # lengths of at most 1, in which errors are those of single precision
    scale = long if metric == "cosine" else np.full(len(x), long.max() or 1.0)
    unit = np.where(wide > 0, wide, 1.0)
    xs = np.ascontiguousarray((x / scale[:, None]).astype(np.float32).T)
    qs = (q / unit[:, None]).astype(np.float32)
    moved = 10.0**-DIGITS if metric == "cosine" else 10.0**-DIGITS / (unit * scale[0])
    slack = np.broadcast_to(2 * (x.shape[1] + 8) * 2.0**-24 + 1.1 * moved, len(q))
    step, n = max(1, SCORES // len(x)), len(x) // GROUP * GROUP
    room = np.empty((min(step, len(q)), len(x)), np.float32)
    for lo in range(0, len(q), step):
        s = np.matmul(qs[lo : lo + step], xs, out=room[: len(qs) - lo])
        if len(x) > k:
            of = s[:, :n].reshape(len(s), GROUP, -1).max(1) if n >= 2 * k * GROUP else s
            bound = np.partition(of, of.shape[1] - k, axis=1)[:, of.shape[1] - k] - slack[lo : lo + step]
            row, col = np.divmod(np.flatnonzero(s >= bound.astype(np.float32)[:, None] - np.float32(1e-7)), len(x))
        else:
            row, col = np.divmod(np.arange(s.size), len(x))
        parts = [np.einsum("ij,ij->i", q[row[at : at + CANDIDATES] + lo], x[col[at : at + CANDIDATES]]) for at in range(0, len(row), CANDIDATES)]
        score = np.concatenate(parts)
        if metric == "cosine":
            score = score / (wide[row + lo] * long[col])
        score = np.round(score, DIGITS) + 0.0
        row, col, score = (v[np.isfinite(score)] for v in (row, col, score))
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([names.take(pa.array(asked[row[kept] + lo])), ids.take(pa.array(col[kept])), pa.array(score[kept])], names=["query_id", "id", "score"])


def _scored_by_batches(records: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str, exclude_self: bool) -> DataFrame:
    rows = queries.where("query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("query")).collect()
    dims = {len(r["query"]) for r in rows}
    if len(dims) > 1:
        raise DimensionMismatch(f"queries have {sorted(dims)} dimensions")
    dim = dims.pop() if dims else 0
    shared = records.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["query"] for r in rows], np.float64).reshape(len(rows), dim)))
    kind, arrow = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    id_kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        names = pa.array(names, arrow)
        for batch in batches:
            if len(names):
                right, x = _matrix(batch.column("vector"), dim)
                yield from _best(names, q, batch.column("id").take(pa.array(right)), x, metric, k + int(exclude_self))

    hits = records.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")
    return hits.where("query_id <> id") if exclude_self else hits


def _scored_by_blocks(records: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str, exclude_self: bool, match: tuple[str, str] | None) -> DataFrame:
    """Queries and records of one length and match are dealt to blocks of bounded size, and each two blocks meet in a task.

    Each side is sent as often as the other has blocks, and a query has k results a block of records: both grow as the
    pairs do, but divided by the rows of a block.
    """
    kind, id_kind = queries.schema["query_id"].dataType.simpleString(), records.schema[id_col].dataType.simpleString()
    both = (F.lit(0), F.lit(0)) if match is None else (F.col(match[1]), F.col(match[0]))
    left = queries.select("query_id", F.col("query").alias("vector"), F.size("query").alias("dim"), both[0].alias("part")).where("vector IS NOT NULL AND dim > 0")
    right = records.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim"), both[1].alias("part")).where("vector IS NOT NULL AND dim > 0")
    blocks = F.ceil(F.count("*") * F.col("dim") * 8 / F.lit(BLOCK_BYTES)).cast("int")
    sizes = left.groupBy("dim", "part").agg(blocks.alias("lefts")).join(right.groupBy("dim", "part").agg(blocks.alias("rights")), ["dim", "part"])
    own = lambda key, n: F.pmod(F.xxhash64(key, "vector"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, ["dim", "part"]).select("query_id", "vector", "dim", "part", own("query_id", "lefts").alias("i"), every("rights").alias("j"))
    right = right.join(sizes, ["dim", "part"]).select("id", "vector", "dim", "part", own("id", "rights").alias("j"), every("lefts").alias("i"))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        names, ids, (own_q, q), (own_x, x) = asked["query_id"].combine_chunks(), there["id"].combine_chunks(), *(_matrix(t["vector"].combine_chunks(), None) for t in (asked, there))
        found = list(_best(names.take(pa.array(own_q)), q, ids.take(pa.array(own_x)), x, metric, k + int(exclude_self))) if len(q) and len(x) else []
        schema = pa.schema([("query_id", names.type), ("id", ids.type), ("score", pa.float64())])
        return pa.Table.from_batches(found, schema)

    keys = ["dim", "part", "i", "j"]
    hits = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, f"query_id {kind}, id {id_kind}, score double")
    return hits.where("query_id <> id") if exclude_self else hits


def neighbours(records: DataFrame, record_id, k: int = 10, id_col: str = "id", vector_col: str = "dense", metric: str = "cosine") -> DataFrame:
    """(query_id, rank, id, score) of the records nearest to a record, itself left out."""
    own = records.where(F.col(id_col) == F.lit(record_id)).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query"))
    return batch_search(records, own, k, metric, id_col, vector_col, exclude_self=True)
