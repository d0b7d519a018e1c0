"""Language-model scores from n-gram counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_groups, arrow_map, column, mapped, materialise, mix, private, pruned, release, settle, slices, text_buffer, words

ORDER = 3
#: Counts are held as powers of this base.
BASE = 1.5
BITS_PER_EVENT = 12
PROBES = 5
#: Words whose n-grams a task counts before it sends them on.
COUNT_WORDS = 1 << 21
#: The filter is broadcast if it can't be larger than this, whatever the texts are; else it stays in parts, and the
#: n-grams that texts ask for go to the parts.
BROADCAST_BYTES = 64 << 20
#: A filter takes so many bytes for a byte of text at most: a word and what divides it from the next are two bytes, and
#: each of a word's n-grams is an event at most, as a count is never below its level.
FILTER_BYTES_OF_TEXT = ORDER * BITS_PER_EVENT / 8 / 2
#: Bytes of text whose n-grams are asked for at once, and packed bytes of n-grams that a part of the filter gets, about.
CHUNK = 8 << 20
PART = 8 << 20
#: Weights of the orders in the mixture, from one word to ORDER words, and what is taken off a count of several words,
#: so that a run of words that has been seen once says less than one that has been seen twice.
WEIGHTS = (0.1, 0.3, 0.6)
DISCOUNT = 0.75
_TAG = np.uint64(3)
#: A key has so many bits more than it takes to number the n-grams, so that one in 2^SPARE_BITS has another's key.
SPARE_BITS = 14


def key_bits(size: int) -> int:
    """Bits of a key for texts of so many bytes: a word and what divides it from the next are two bytes at least."""
    return min(64, max(40, (ORDER * size // 2).bit_length() + SPARE_BITS))


def ngrams(h: np.ndarray, first: np.ndarray, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, key) of each run of n words within a text. The lowest two bits of a key tell n."""
    begin = np.repeat(first[:-1], np.diff(first))
    last = np.flatnonzero(np.arange(len(h)) - begin >= n - 1)
    with np.errstate(over="ignore"):
        key = np.full(len(last), np.uint64(n), np.uint64)
        for i in range(n - 1, -1, -1):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[last - i])
    return last, (key >> np.uint64(64 - bits) & ~_TAG) | np.uint64(n - 1)


def bucket_of(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count), at most 255."""
    return np.minimum(1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9), 255).astype(np.int64)


def count_at(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the mean of what it holds; 0 for level 0."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, BASE ** (levels - 1.0) * (1 + BASE) / 2))


def _probe(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, bits to look at in it) of the event that a key has at least this level."""
    with np.errstate(over="ignore"):
        e = mix(keys + np.asarray(level).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        at = (e >> np.uint64(32)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)
        f, mask = mix(e), np.zeros(len(e), np.uint64)
        for i in range(PROBES):
            mask |= np.uint64(1) << (f >> np.uint64(6 * i) & np.uint64(63))
    return at.astype(np.int64), mask


def build_filter(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """64-bit words with the events (key, 1) to (key, level) of every key."""
    events = np.repeat(keys, levels)
    level = np.arange(len(events)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    size = max(1, -(-len(events) * BITS_PER_EVENT // 64))
    out = np.zeros(size, np.uint64)
    at, mask = _probe(events, level, size)
    np.bitwise_or.at(out, at, mask)
    return out


class Filter:
    """The parts of the filter on end; a key's part is that of its bucket."""

    def __init__(self, parts: list[np.ndarray], bits: int = 64):
        self.bits = bits
        sizes = np.array([len(p) for p in parts], np.int64)
        self.buckets, self.sizes, self.begin = len(parts), np.maximum(sizes, 1), np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
        self.data = np.concatenate([p if len(p) else np.zeros(1, np.uint64) for p in parts])

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probes level by level until one is missing; a key's level is the last that wasn't."""
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.buckets, self.bits)
        size, begin, todo = self.sizes[bucket], self.begin[bucket], np.arange(len(keys))
        for level in range(1, 256):
            if not len(todo):
                break
            at, mask = _probe(keys[todo], level, size[todo])
            todo = todo[self.data[begin[todo] + at] & mask == mask]
            out[todo] = level
        return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, the bytes of like weight together, and counts, compressed.

    A count is a byte, and 255 says that the count is with the others of its kind at the end.
    """
    gaps = np.diff(keys, prepend=np.uint64(0))
    large = np.flatnonzero(counts >= 255)
    parts = [np.array([len(keys)], np.int64), np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T), np.minimum(counts, 255).astype(np.uint8), counts[large].astype(np.int64)]
    return zstandard.compress(b"".join(x.tobytes() for x in parts), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    out = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=8 + 9 * n)
    with np.errstate(over="ignore"):
        return np.cumsum(gaps, dtype=np.uint64), out


def _found(texts: pa.Array, order: int, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(index of each text's first word, (places, keys) of the n-grams of each order)."""
    h, _, _, first = words(*text_buffer(texts))
    return first, [ngrams(h, first, n, bits) for n in range(1, order + 1)]


def _sent(keys: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """(buckets, packed distinct keys and counts of each); the keys go up from bucket to bucket."""
    distinct, counts = np.unique(keys, return_counts=True)
    cuts = np.searchsorted(bucket_of(distinct, buckets, bits), np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    return some, [pack(distinct[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]) for b in some]


def _counts(docs: DataFrame, buckets: int, order: int, bits: int) -> DataFrame:
    """(bucket, counts): the distinct n-grams of each few megabytes, by bucket, with how often they stand there."""

    def sent(keys: list[np.ndarray]) -> pa.RecordBatch:
        some, packed = _sent(np.concatenate(keys), buckets, bits)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                first, found = _found(batch.column("text").slice(lo, hi - lo), order, bits)
                for n in range(order):
                    held[n].append(found[n][1])
                size += int(first[-1])
                if size >= COUNT_WORDS:
                    yield from map(sent, held)
                    held, size = [[] for _ in range(order)], 0
        if size:
            yield from map(sent, held)

    return arrow_map(docs, run, "bucket int, counts binary")


def _summed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    k, c = k[order], c[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[begin], np.add.reduceat(c, begin) if len(k) else c


def _joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts) of all on end, and where each begins (one more entry)."""
    parts = [unpack(p) for p in packed]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.cumsum([0, *[len(p[0]) for p in parts]])


def build(docs: DataFrame, order: int = ORDER, text_col: str = "text", buckets: int = 1, bits: int = 64) -> DataFrame:
    """(bucket, words, tokens, types), written to the shared folder: a part of the filter for each bucket of n-grams.

    All n-grams of all texts are counted and held; tokens and types are the words of the bucket, with and without
    repetition.
    """

    def part(table: pa.Table) -> pa.Table:
        keys, counts = _summed(*_joined(table.column("counts").to_pylist())[:2])
        single = keys & _TAG == 0
        data = build_filter(keys, level_of(counts))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "words": pa.array([data.tobytes()], pa.binary()), "tokens": pa.array([int(counts[single].sum())]), "types": pa.array([int(single.sum())])})

    some = pruned(docs, text=text_col).where("text IS NOT NULL")
    return materialise(arrow_groups(_counts(some, buckets, order, bits).repartitionById(buckets, "bucket").groupBy("bucket"), part, "bucket int, words binary, tokens bigint, types bigint"), "ngrams")


def _log_probabilities(levels: list[np.ndarray], last: list[np.ndarray], n: int, tokens: int, types: int) -> np.ndarray:
    """Of each of n words: a mixture of its relative frequencies after 0, 1, ... words of context.

    The counts of several words are discounted. Both (n-1)-grams of an n-gram are held, at least as often; a level that
    contradicts this is a false hit of the filter, and is cut to what is possible.
    """
    weights = np.array(WEIGHTS[: len(levels)]) / sum(WEIGHTS[: len(levels)])
    single = count_at(levels[0])
    p = weights[0] * (single + 1) / (tokens + types + 1)
    shorter = single
    for k in range(1, len(levels)):
        by_place = np.zeros(n)
        by_place[last[k - 1]] = shorter
        context = by_place[last[k] - 1]
        shorter = np.minimum(count_at(levels[k]), np.minimum(context, by_place[last[k]]))
        p[last[k]] += weights[k] * np.maximum(shorter - DISCOUNT, 0) / np.maximum(context, 1)
    return np.log(p)


def _summary(first: np.ndarray, logs: np.ndarray) -> list[pa.Array]:
    total = np.concatenate([[0.0], np.cumsum(logs)])
    count = np.diff(first)
    score = total[first[1:]] - total[first[:-1]]
    none = count == 0
    mean = score / np.maximum(count, 1)
    return [pa.array(count, pa.int64()), pa.array(mean, mask=none), pa.array(score, mask=none), pa.array(np.exp(np.minimum(-mean, 700)), mask=none)]


NEW = ["n_words", "log_prob", "total_log_prob", "perplexity"]


def score(docs: DataFrame, order: int = ORDER, text_col: str = "text", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART) -> DataFrame:
    """The columns `keep` of docs (all by default), with n_words, log_prob, total_log_prob and perplexity under docs' n-grams.

    log_prob is the natural logarithm of a word's probability on average, total_log_prob that of the whole text, and
    perplexity exp(-log_prob). The model is counted over all texts of docs, and holds all their n-grams. The filter is
    broadcast if by the bytes of the texts it can't be larger than broadcast_bytes. Otherwise it stays in parts that
    grow in number with the texts: the distinct n-grams of each few megabytes of text go to their parts with their
    counts, which there make the filter and are then probed in it, and the levels go back. Either way gives the same
    model; where the bits of the parts fall differs, and so which words a filter takes for a level higher (one in about
    fifty; it never misses what it holds).

    order is 1 to ORDER. Null and empty texts and texts without words have 0 words and null scores. Repeated rows and
    null ids are scored like any other, and counted. Columns of docs by the new names are replaced. An empty table
    gives an empty result.
    """
    if not 1 <= order <= ORDER:
        raise ValueError(f"order is 1 to {ORDER}, not {order}")
    spark = docs.sparkSession
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in NEW]
    (source,) = private(docs, "source")
    chosen = docs.select(*[column(c) for c in kept], column(text_col).alias(source))
    schema = docs.select(*[column(c) for c in kept], *[F.lit(None).cast(k).alias(c) for c, k in zip(NEW, ("bigint", "double", "double", "double"))]).schema
    size = docs.agg(F.sum(F.octet_length(column(text_col)).cast("bigint"))).first()[0] or 0
    if size * FILTER_BYTES_OF_TEXT > broadcast_bytes:
        return _scored_by_exchange(chosen, size, order, schema, part_bytes)
    buckets = max(1, math.ceil(size / PART))
    bits = key_bits(size)
    parts = build(docs, order, text_col, buckets, bits)
    got = {r["bucket"]: r for r in parts.toLocalIterator()}
    release(parts)
    tokens, types = (sum(r[c] for r in got.values()) for c in ("tokens", "types"))
    shared = spark.sparkContext.broadcast(Filter([np.frombuffer(got[b]["words"] if b in got else b"", np.uint64) for b in range(buckets)], bits))
    del got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in slices(texts):
                first, found = _found(texts.slice(lo, hi - lo), order, bits)
                levels = []
                for _, keys in found:
                    distinct, inverse = np.unique(keys, return_inverse=True)
                    levels.append(held.levels(distinct)[inverse])
                logs = _log_probabilities(levels, [last for last, _ in found], int(first[-1]), tokens, types)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], *_summary(first, logs)], names=[*kept, *NEW])

    return mapped(chosen, run, schema)


def _ipc(columns: list[pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(blob: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().columns


def _scored_by_exchange(chosen: DataFrame, size: int, order: int, schema: T.StructType, part_bytes: int) -> DataFrame:
    """Scores without a broadcast; the last column of chosen is the text.

    Texts are written in chunks first. A chunk sends its distinct keys, with counts, to their buckets: that is the
    corpus count and the probes in one. A bucket sums the counts, makes its part of the filter, and answers each
    chunk's keys with their levels. Buckets and chunks are of bounded size, and their numbers grow with the texts.
    """
    bits = key_bits(size)
    buckets = max(1, math.ceil(size * 1.2 / part_bytes))  # a byte of text makes about that many of packed keys
    names = [f"c{i}" for i in range(len(chosen.columns))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | at], pa.int64()), pa.array([_ipc([c.slice(lo, hi - lo) for c in batch.columns])], pa.binary())], names=["chunk", "rows"])
                at += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
                _, found = _found(_rows(blob)[-1], order, bits)
                keys = np.concatenate([k for _, k in found])
                del found
                some, packed = _sent(keys, buckets, bits)
                del keys
                for i in range(0, len(some), 64):
                    part = packed[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(some[i : i + 64].astype(np.int32)), pa.array(part, pa.binary())], names=["chunk", "bucket", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        """The levels of each chunk's keys; for the bucket itself (chunk null), how many words it has, and distinct ones."""
        keys, counts, cuts = _joined(table.column("counts").to_pylist())
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        del table
        distinct, total = _summed(keys, counts)
        single = distinct & _TAG == 0
        tokens, types = int(total[single].sum()), int(single.sum())
        part = Filter([build_filter(distinct, level_of(total))])  # a filter of one part, whose bucket every key is in
        levels = part.levels(distinct).astype(np.uint8)
        del total, single, part
        out = [zstandard.compress(levels[np.searchsorted(distinct, keys[lo:hi])].tobytes(), 1) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table(
            {
                "chunk": pa.array([*chunks, None], pa.int64()),
                "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int32()),
                "data": pa.array([*out, None], pa.binary()),
                "tokens": pa.array([None] * len(chunks) + [tokens], pa.int64()),
                "types": pa.array([None] * len(chunks) + [types], pa.int64()),
            }
        )

    own = materialise(arrow_map(chosen.toDF(*names), cut, "chunk bigint, rows binary"), "chunks", "none")
    asked = arrow_map(own, ask, "chunk bigint, bucket int, counts binary").repartitionById(buckets, "bucket").groupBy("bucket")
    levels = materialise(arrow_groups(asked, answer, "chunk bigint, bucket int, data binary, tokens bigint, types bigint"), "levels", "none")
    del asked
    settle(own.sparkSession)  # the n-grams that were exchanged aren't needed any more
    tokens, types = (x or 0 for x in levels.agg(F.sum("tokens"), F.sum("types")).first())

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist()))
        del table
        columns = _rows(rows[0][1])
        first, found = _found(columns[-1], order, bits)
        _, inverse = np.unique(np.concatenate([k for _, k in found]), return_inverse=True)
        flat = np.frombuffer(b"".join(zstandard.decompress(r[1]) for r in rows[1:]), np.uint8)[inverse]
        del inverse
        each = np.split(flat.astype(np.int64), np.cumsum([len(k) for _, k in found])[:-1])
        logs = _log_probabilities(each, [last for last, _ in found], int(first[-1]), tokens, types)
        return pa.table([*columns[:-1], *_summary(first, logs)], names=[f"c{i}" for i in range(len(schema))])

    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    both = own.select("chunk", F.lit(-1).alias("bucket"), F.col("rows").alias("data")).union(levels.where("chunk IS NOT NULL").select("chunk", "bucket", "data"))
    return arrow_groups(both.repartition(max(1, math.ceil(size / CHUNK)), "chunk").groupBy("chunk"), join, out).toDF(*schema.names)
