"""Vector kernels as native expressions over arrays, and Arrow kernels where Spark has no type for it.

Sums are in double, whatever the element type. A null vector or vectors of different lengths give null, except for
Hamming distance, which is infinite there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _summed(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def dot(a: Column, b: Column) -> Column:
    """Inner product, of floats, codes or bit planes' codes alike."""
    return _same_length(a, b, _summed(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def dot_codes(a: Column, b: Column) -> Column:
    """Inner product of integer codes, as a bigint."""
    product = F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint"))
    return _same_length(a, b, F.aggregate(product, F.lit(0).cast("bigint"), lambda acc, x: acc + x))


def norm(a: Column) -> Column:
    return F.sqrt(_summed(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null if either norm is 0. Norms that are known can be given."""
    both = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when(both != 0, dot(a, b) / both)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return _same_length(a, b, F.sqrt(_summed(square)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between codes of at most 8 bits, as a double; infinite if the lengths differ."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int"))).cast("double"))
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), _summed(bits)).otherwise(F.lit(float("inf")))


def binary_dot(a: Column, b: Column) -> Column:
    """Ones in common of packed one-bit codes, eight to an element."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseAND(y.cast("int"))).cast("double"))
    return _same_length(a, b, _summed(bits))


def plane_dot(a: Column, b: Column, bits: int, plane_order: str = "most_first") -> Column:
    """Inner product of codes stored as bit planes: arrays of `bits` arrays of packed bytes.

    plane_order tells what plane 0 is worth: "most_first" takes it for the highest bit, as the packer writes it;
    "least_first" for the lowest. Pairs of planes are counted for a whole Arrow batch at once.
    """
    worth = [1 << (bits - 1 - i if plane_order == "most_first" else i) for i in range(bits)]

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = (v.astype(np.uint8).reshape(len(v), bits, -1) for v in (x, y))
        return sum(float(worth[i] * worth[j]) * np.bitwise_count(x[:, i] & y[:, j]).sum(1, dtype=np.int64) for i in range(bits) for j in range(bits))

    flat = lambda planes: F.when(F.size(planes) == bits, F.flatten(planes))
    return _pairwise(product)(flat(a), flat(b))


def plane_hamming(a: Column, b: Column, bits: int) -> Column:
    """Bits that differ between codes stored as bit planes; infinite if the lengths differ."""
    return sum((hamming(F.element_at(a, i + 1), F.element_at(b, i + 1)) for i in range(bits)), F.lit(0.0))


# == half precision and batches, through Arrow


def _rows(a: pa.ListArray, at: np.ndarray, width: int) -> np.ndarray:
    return a.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pairwise(kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """A kernel over matrices as a column of two arrays: rows of one length go to it together, from Arrow's buffers.

    A null, also within a vector, and vectors of different lengths give null.
    """

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        size = [np.where(np.asarray(x.is_null()), -1, np.asarray(pc.list_value_length(x).fill_null(-1))) for x in (a, b)]
        out, known = np.zeros(len(a)), np.zeros(len(a), bool)
        same = (size[0] == size[1]) & (size[0] >= 0)
        for n in np.unique(size[0][same]):
            at = np.flatnonzero(same & (size[0] == n))
            if n:
                x, y = (_rows(v, at, n).astype(np.float64) for v in (a, b))
                if a.values.null_count or b.values.null_count:  # nulls within are NaN by now
                    whole = ~(np.isnan(x) | np.isnan(y)).any(1)
                    at, x, y = at[whole], x[whole], y[whole]
                out[at] = kernel(x, y)
            known[at] = True
        return pa.array(out, pa.float64(), mask=~known)

    return F.arrow_udf(run, "double")


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float16)


def half_dot(a: Column, b: Column) -> Column:
    """Inner product of the vectors' half-precision roundings, summed in double."""
    return _pairwise(lambda x, y: (_half(x).astype(np.float64) * _half(y).astype(np.float64)).sum(1))(a, b)


def half_euclidean(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: np.sqrt(((_half(x).astype(np.float64) - _half(y).astype(np.float64)) ** 2).sum(1)))(a, b)


def half_hamming(a: Column, b: Column) -> Column:
    """Bits that differ between the half-precision representations."""
    return _pairwise(lambda x, y: np.bitwise_count(_half(x).view(np.uint16) ^ _half(y).view(np.uint16)).sum(1, dtype=np.int64))(a, b)


def vector_sha256(a: Column) -> Column:
    """SHA-256, in hexadecimal, of the vector's elements as little-endian 32-bit floats; the bytes are Arrow's buffer."""

    def packed(v: pa.Array) -> pa.Array:
        n = np.asarray(pc.list_value_length(v).fill_null(0)).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
        data = v.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        valid = pa.array(np.asarray(v.is_valid())) if v.null_count else None
        bits = valid.buffers()[1] if valid is not None else None
        return pa.Array.from_buffers(pa.binary(), len(v), [bits, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])

    return F.sha2(F.arrow_udf(packed, "binary")(a.cast("array<float>")), 256)


# == metrics


@dataclass(frozen=True)
class Metric:
    """A score and which way is better."""

    name: str
    score: Callable[[Column, Column], Column]
    larger_is_better: bool

    def order(self, score: Column) -> Column:
        return score.desc_nulls_last() if self.larger_is_better else score.asc_nulls_last()


METRICS = {
    m.name: m
    for m in (
        Metric("cosine", cosine, True),
        Metric("dotproduct", dot, True),
        Metric("euclidean", euclidean, False),
        Metric("hamming", hamming, False),
        Metric("cosine_distance", cosine_distance, False),
    )
}


def literal_vector(values: list[float]) -> Column:
    """A query vector as a constant, which Catalyst folds."""
    return F.array(*[F.lit(float(x)) for x in values])
