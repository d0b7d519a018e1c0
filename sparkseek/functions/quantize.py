"""Quantisation of dense and sparse values, and the parameters sampled for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError

#: Levels of a sparse quantisation and the bits they take.
LEVEL_BITS = {16: 4, 32: 5, 64: 6, 128: 7, 256: 8}
#: Wire names of storage types, and the bits of a code where it is less than a byte.
STORAGE_TYPES = {"binary": "subbyte1", "quaternay": "subbyte2", "quaternary": "subbyte2", "octal": "subbyte3", "u8": "u8", "f16": "f16", "f32": "f32"}
DENSE_BOUNDS = (0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
SPARSE_BOUNDS = tuple(float(i) for i in range(1, 10))


def level_bits(levels: int) -> int:
    try:
        return LEVEL_BITS[levels]
    except KeyError:
        raise SearchError(f"{levels} levels: one of {sorted(LEVEL_BITS)} is possible") from None


def u8_codes(vector: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Codes 0 to 255 of values clamped to [low, high], cut to whole numbers."""

    def code(x: Column) -> Column:
        x = F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double")))
        return F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(255.0)).cast("smallint")

    return F.transform(vector, code)


def code_norm(codes: Column) -> Column:
    """Length of the vector of codes."""
    return F.sqrt(F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def subbyte_codes(vector: Column, bits: int, clamp_top: bool = True) -> Column:
    """Codes of `bits` bits over [-1, 1] in equal steps. Without clamp_top, 1.0 overflows to 0 as in plain bit masks."""
    top = (1 << bits) - 1

    def code(x: Column) -> Column:
        c = F.floor((x.cast("double") + 1.0) / F.lit(2.0 / (1 << bits))).cast("int")
        return F.least(F.greatest(c, F.lit(0)), F.lit(top)) if clamp_top else c.bitwiseAND(F.lit(top))

    return F.transform(vector, code)


def bit_planes(codes: Column, bits: int) -> Column:
    """Codes as `bits` arrays of bytes, the highest bit first; the first code is the highest bit of its byte.

    A null code counts as 0, null codes have null planes. A whole Arrow batch is packed at once.
    """

    def run(v: pa.Array) -> pa.Array:
        size = np.asarray(pc.list_value_length(v).fill_null(0)).astype(np.int64)
        flat = v.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        wide = -(-size // 8)  # bytes of a plane
        ends, begins = np.cumsum(wide), np.cumsum(size) - size
        room = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, flat.dtype)
        room[np.arange(len(flat)) + np.repeat((ends - wide) * 8 - begins, size)] = flat
        planes = [np.packbits((room >> (bits - 1 - i) & 1).astype(np.uint8)) for i in range(bits)]
        # of each row one plane after the other
        at = np.repeat(np.cumsum(bits * wide) - bits * wide, wide) + np.arange(len(room) // 8) - np.repeat(ends - wide, wide)
        out = np.zeros(bits * len(room) // 8, np.int32)
        for i, plane in enumerate(planes):
            out[at + i * np.repeat(wide, wide)] = plane
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.repeat(wide, bits))).astype(np.int32)), pa.array(out))
        outer = pa.array((np.arange(len(v) + 1) * bits).astype(np.int32))
        return pa.ListArray.from_arrays(outer, inner, mask=v.is_null() if v.null_count else None)

    return F.arrow_udf(run, "array<array<int>>")(codes.cast("array<int>"))


def half_values(vector: Column) -> Column:
    """The values rounded to half precision, as floats."""

    def run(v: pa.Array) -> pa.Array:
        flat = v.flatten()
        values = pa.array(flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32), mask=np.asarray(flat.is_null()))
        ends = np.cumsum(np.asarray(pc.list_value_length(v).fill_null(0)), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), values, mask=v.is_null() if v.null_count else None)

    return F.arrow_udf(run, "array<float>")(vector.cast("array<float>"))


def sparse_code(value: Column, upper: Column | float, bits: int) -> Column:
    """Codes 0 to 2^bits - 1 of values as shares of the upper bound, cut to whole numbers."""
    top = float((1 << bits) - 1)
    upper = F.lit(upper) if not isinstance(upper, Column) else upper
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top), value.cast("double") / upper * F.lit(top)))).cast("int")


# == sampled parameters


def dense_range(df: DataFrame, vector_col: str, clamp_percent: float = 1.0) -> DataFrame:
    """(low, high): the smallest bounds beyond which at most clamp_percent of all values lie, else -1 and 1.

    Each row counts its own values, so nothing is exploded or shuffled but fifteen numbers a partition.
    """
    v = F.col(vector_col)

    def beyond(bound: float) -> Column:
        outside = F.filter(v, (lambda x: x > bound) if bound > 0 else (lambda x: x < bound))
        return F.coalesce(F.sum(F.size(outside)), F.lit(0))

    counts = [beyond(b).alias(f"above{i}") for i, b in enumerate(DENSE_BOUNDS)] + [beyond(-b).alias(f"below{i}") for i, b in enumerate(DENSE_BOUNDS)]
    totals = df.where(v.isNotNull()).agg(F.coalesce(F.sum(F.size(v)), F.lit(0)).alias("n"), *counts)

    def bound(side: str, sign: float) -> Column:
        out = F.lit(sign)
        for i in range(len(DENSE_BOUNDS) - 1, -1, -1):
            out = F.when(F.col(f"{side}{i}") * 100.0 <= F.col("n") * F.lit(clamp_percent), F.lit(sign * DENSE_BOUNDS[i])).otherwise(out)
        return out

    return totals.select(bound("below", -1.0).alias("low"), bound("above", 1.0).alias("high"))


def sparse_upper_bound(postings: DataFrame, value_col: str = "val", clamp_percent: float = 1.0) -> DataFrame:
    """(upper): the smallest of 1, 2, ..., 9 that at most clamp_percent of the values exceed, else 10."""
    value = F.col(value_col)
    totals = postings.agg(F.count(value).alias("n"), *[F.count(F.when(value > b, 1)).alias(f"above{i}") for i, b in enumerate(SPARSE_BOUNDS)])
    out = F.lit(10.0)
    for i in range(len(SPARSE_BOUNDS) - 1, -1, -1):
        out = F.when(F.col(f"above{i}") * 100.0 <= F.col("n") * F.lit(clamp_percent), F.lit(SPARSE_BOUNDS[i])).otherwise(out)
    return totals.select(out.alias("upper"))


def first_rows(df: DataFrame, n: int, seq_col: str) -> DataFrame:
    """The first n rows by arrival, from which parameters are sampled; all if there are fewer."""
    return df.orderBy(seq_col).limit(n)


# == clustering


def kmeans_1d(df: DataFrame, value_col: str, start: list[float], iterations: int = 10) -> list[tuple[float, int]]:
    """(centroid, values) after some Lloyd steps over one-dimensional values; a centroid without values stays.

    Each step is one aggregation, which returns a row a centroid.
    """
    centroids = [float(c) for c in start]
    counts = [0] * len(centroids)
    value = F.col(value_col).cast("double")
    for _ in range(iterations):
        distances = F.array(*[F.abs(value - F.lit(c)) for c in centroids])
        nearest = F.array_position(distances, F.array_min(distances)) - 1
        got = {r["c"]: r for r in df.where(value.isNotNull()).groupBy(nearest.alias("c")).agg(F.avg(value).alias("m"), F.count("*").alias("n")).collect()}
        before = list(centroids)
        centroids = [got[i]["m"] if i in got else c for i, c in enumerate(centroids)]
        counts = [got[i]["n"] if i in got else 0 for i in range(len(centroids))]
        if before == centroids:
            break
    return list(zip(centroids, counts))


def is_imbalanced(counts: list[int], ratio: float = 2.0) -> bool:
    """Whether the largest cluster has more than ratio times the rows of the smallest."""
    return bool(counts) and max(counts) > ratio * max(1, min(counts))


class ProductQuantizer:
    """Codes of sub-vectors by k-means codebooks, one for each range of dimensions."""

    def __init__(self, codebooks: list[np.ndarray]):
        self.codebooks = codebooks

    @classmethod
    def fit(cls, df: DataFrame, vector_col: str, dim: int, parts: int = 8, centroids: int = 16, seed: int = 7, iterations: int = 10) -> ProductQuantizer:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if dim % parts:
            raise SearchError(f"{parts} parts don't divide {dim} dimensions")
        width, books = dim // parts, []
        for p in range(parts):
            sub = df.where(F.size(vector_col) == dim).select(array_to_vector(F.slice(F.col(vector_col).cast("array<double>"), p * width + 1, width)).alias("features"))
            books.append(np.array(KMeans(k=centroids, seed=seed, maxIter=iterations).fit(sub).clusterCenters()))
        return cls(books)

    def encode(self, df: DataFrame, vector_col: str, out_col: str = "codes") -> DataFrame:
        books, width = self.codebooks, self.codebooks[0].shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(batch.schema.names.index(vector_col)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                codes = np.stack([((x[:, None, i * width : (i + 1) * width] - b[None]) ** 2).sum(2).argmin(1) for i, b in enumerate(books)], 1) if batch.num_rows else np.zeros((0, len(books)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(books)), pa.array(codes.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out_col])

        return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<int>").alias(out_col)).schema)

    def scores(self, codes: Column, query: list[float]) -> Column:
        """Approximate inner product with the query, by a table lookup for each part."""
        width = self.codebooks[0].shape[1]
        total = F.lit(0.0)
        for i, book in enumerate(self.codebooks):
            table = F.array(*[F.lit(float(x)) for x in book @ np.asarray(query[i * width : (i + 1) * width])])
            total = total + F.get(table, F.get(codes, F.lit(i)))
        return total

    def candidates_for(self, encoded: DataFrame, k: int = 10, recall: float = 0.95, queries: int = 200, id_col: str = "id", vector_col: str = "dense", codes_col: str = "codes") -> int:
        """The least number of candidates by codes that holds this share of the exact k best by inner product.

        It is measured on records as queries, the first by a hash of their id, each of which is compared with all
        records: of its k best ones the places by codes are counted, those that tie with them included.
        """
        books, dim = self.codebooks, sum(b.shape[1] for b in self.codebooks)
        right = encoded.where(F.size(vector_col) == dim).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(codes_col).alias("codes"))
        rows = right.orderBy(F.xxhash64("id"), "id").limit(queries).select("vector").collect()
        if not rows:
            return k
        q = np.array([r["vector"] for r in rows])
        width = books[0].shape[1]
        tables = [q[:, i * width : (i + 1) * width] @ b.T for i, b in enumerate(books)]

        def rough(codes: np.ndarray) -> np.ndarray:
            return np.round(sum(t[:, codes[:, i]] for i, t in enumerate(tables)), 6)

        def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return batch.column("vector").flatten().to_numpy().reshape(-1, dim), batch.column("codes").flatten().to_numpy().reshape(-1, len(books))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, codes = columns(batch)
                exact, near = q @ x.T, rough(codes)
                top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(exact[at, top.ravel()]), pa.array(near[at, top.ravel()])], names=["query", "exact", "near"])

        hits: list[list] = [[] for _ in q]
        for r in right.mapInArrow(best, "query bigint, exact double, near double").groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("exact", "near")), asc=False), 1, k).alias("hits")).collect():
            hits[r["query"]] = [h["near"] for h in r["hits"]]
        wanted = [np.sort(h) for h in hits]

        def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(len(w), np.int64) for w in wanted]
            for batch in batches:
                near = np.sort(rough(columns(batch)[1]), axis=1)
                for i, w in enumerate(wanted):
                    total[i] += near.shape[1] - np.searchsorted(near[i], w, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sum(map(len, total)))), pa.array(np.concatenate(total))], names=["hit", "place"])

        places = sorted(r["place"] for r in right.mapInArrow(beyond, "hit bigint, place bigint").groupBy("hit").agg(F.sum("place").alias("place")).collect())
        return max(k, places[int(np.ceil(recall * len(places) - 1e-9)) - 1])

    def search(self, encoded: DataFrame, query: list[float], k: int = 10, candidates: int = 10, id_col: str = "id", vector_col: str = "dense", codes_col: str = "codes") -> DataFrame:
        """(id, score): the best candidates by codes, ranked by the exact inner product; ties go to the smallest id."""
        rough = F.round(self.scores(F.col(codes_col), query), 6)
        exact = F.aggregate(F.zip_with(F.col(vector_col).cast("array<double>"), F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        some = encoded.select(F.col(id_col).alias("id"), rough.alias("rough"), vector_col).orderBy(F.desc("rough"), "id").limit(candidates)
        return some.select("id", F.round(exact, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
