"""Near-duplicate search by SimHash, with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, column, components, materialise, mix, private, shingles, slices, text_buffer, words

BITS = 256
#: Fingerprints that differ in at most this many bits belong to near copies.
RADIUS = 50
#: Documents are compared if one of this many least hashes of their shingles is the same, for shingles of so many words.
KEYS = 10
SHINGLE = 4
#: Bit planes between two looks at which blocks can be abandoned.
STRIDE = 16
#: A set of more documents that share a key is cut into tiles of about so many, and every two tiles are a task's work.
TILE = 1024
#: Rows of sets that a task compares, about.
TASK_ROWS = 20_000
_ODD = (mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


# == fingerprints


def halves(planes: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Adds the bit-sliced numbers of each document in pairs, all of a document's on end. planes[i] has the i-th bits."""
    half = (count + 1) // 2
    begin, to = np.cumsum(count) - count, np.cumsum(half) - half
    within = np.arange(half.sum()) - np.repeat(to, half)
    first = np.repeat(begin, half) + 2 * within
    alone = 2 * within + 1 >= np.repeat(count, half)
    second = np.where(alone, first, first + 1)
    carry, out = None, []
    for p in planes:
        a, b = p[first], p[second]
        b[alone] = 0
        x = a ^ b
        if carry is None:
            out.append(x)
            carry = a & b
        else:
            out.append(x ^ carry)
            carry = (a & b) | (x & carry)
    return [*out, carry], half


def majority(features: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each document, the bits that more than half of its features have. features: 64-bit words, (n, BITS / 64)."""
    planes, n = [features], count
    while len(n) and n.max() > 1:
        planes, n = halves(planes, n)
    out = np.zeros((len(count), features.shape[1]), np.uint64)
    has = count > 0
    if not has.any():
        return out
    total = np.zeros((has.sum(), features.shape[1] * 64), np.int64)
    for i, p in enumerate(planes):
        total += np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1), axis=1, bitorder="little").astype(np.int64) << i
    bits = total * 2 > count[has][:, None]
    out[has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash of the distinct words, least shingle hashes, number of distinct words) of each text."""
    data, off = text_buffer(texts)
    h, _, _, first = words(data, off)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(first))
    distinct = np.unique((h >> np.uint64(24)) | (doc << np.uint64(40)))
    count = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(off) - 1)
    seed = distinct & np.uint64((1 << 40) - 1)
    with np.errstate(over="ignore"):
        features = np.stack([mix(seed + np.uint64((i + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) for i in range(BITS // 64)], 1)
        prints = majority(features, count)
        s, begin = shingles(h, first, SHINGLE)
        has = np.flatnonzero(np.diff(begin))
        keys = np.zeros((len(off) - 1, KEYS), np.uint64)
        for i in range(KEYS if len(s) else 0):
            keys[has, i] = mix(np.minimum.reduceat(s * _ODD[i], begin[has]) + np.uint64(i))
    return prints, keys, count


# == comparison


def slice_planes(prints: np.ndarray) -> np.ndarray:
    """planes[b, w]: bit b of the fingerprints 64 w to 64 w + 63."""
    n = len(prints)
    wide = np.zeros((-(-n // 64) * 64, BITS), np.uint8)
    wide[:n] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little")).view(np.uint64)


def within_radius(planes: np.ndarray, prints: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each pair of a query and a word of 64 documents, those of its lanes that differ in at most radius bits.

    Distances of 64 documents grow at once, as bit-sliced counters: three planes go through a carry-save adder into
    ones and twos, and the carries ripple on. The counters begin at 2^m - 1 - radius, so that the m-th bit shows that
    the radius is exceeded. A pair is abandoned as soon as it shows for all lanes.
    """
    m = max(1, int(radius).bit_length())
    start = (1 << m) - 1 - radius
    out = np.zeros(len(query), np.uint64)
    at, ones_all = np.arange(len(query)), np.uint64(0xFFFFFFFFFFFFFFFF)
    q, w, alive = query, word, lanes.copy()
    counters = [np.full(len(q), ones_all if start >> i & 1 else 0, np.uint64) for i in range(m)]
    over = np.zeros(len(q), np.uint64)

    def add(carry: np.ndarray, level: int) -> None:
        for i in range(level, m):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over[:] |= carry

    def difference(b: int) -> np.ndarray:
        mask = (prints[q, b // 64] >> np.uint64(b % 64) & np.uint64(1)) * ones_all
        return planes[b, w] ^ mask

    b = 0
    while b < BITS and len(at):
        for _ in range(STRIDE // 2):
            if b + 1 < BITS:
                x, y = difference(b), difference(b + 1)
                z = counters[0]
                u = x ^ y
                counters[0] = u ^ z
                add((x & y) | (u & z), 1)
                b += 2
            elif b < BITS:
                add(difference(b), 0)
                b += 1
        alive &= ~over
        stay = alive != 0
        if not stay.all():
            at, q, w, alive, over = at[stay], q[stay], w[stay], alive[stay], over[stay]
            counters = [c[stay] for c in counters]
    out[at] = alive
    return out


def lanes_of(begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The lanes of each word that hold positions from begin to end - 1."""
    lo, hi = np.clip(begin - 64 * word, 0, 64), np.clip(end - 64 * word, 0, 64)
    ones_all = np.uint64(0xFFFFFFFFFFFFFFFF)
    up = np.where(lo < 64, ones_all << np.minimum(lo, 63).astype(np.uint64), np.uint64(0))
    down = np.where(hi > 0, ones_all >> np.minimum(64 - hi, 63).astype(np.uint64), np.uint64(0))
    return up & down


def pairs_of_sets(prints: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all fingerprints within the radius in the same set; sets lie on end."""
    planes = slice_planes(prints)
    ends = np.repeat(np.cumsum(sizes), sizes)
    position = np.arange(len(prints))
    n_words = np.where(position + 1 < ends, (ends - 1) // 64 - (position + 1) // 64 + 1, 0)
    left, right = [], []
    cuts = np.searchsorted(np.cumsum(n_words), np.arange(0, n_words.sum() + most, most))
    for lo, hi in zip(cuts[:-1], np.append(cuts[1:-1], len(position))):
        own = position[lo:hi]
        q = np.repeat(own, n_words[lo:hi])
        if not len(q):
            continue
        begin = np.cumsum(n_words[lo:hi]) - n_words[lo:hi]
        w = np.repeat((own + 1) // 64 - begin, n_words[lo:hi]) + np.arange(len(q))
        hit = within_radius(planes, prints, q, w, lanes_of(q + 1, ends[q], w), radius)
        some = np.flatnonzero(hit)
        i, lane = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left.append(q[some[i]])
        right.append(w[some[i]] * 64 + lane)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the least of those that the pairs join it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for each position but the least of each group that the pairs join, however many pairs there are."""
    label = labels(left, right, n)
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, keys) of each document that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for lo, hi in slices(texts):
                prints, keys, count = fingerprints(texts.slice(lo, hi - lo))
                has = np.flatnonzero(count)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(has), [None, pa.py_buffer(prints[has].tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * KEYS), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(has)), raw, lists], names=["id", "print", "keys"])

    some = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return arrow_map(some, run, f"id {some.schema['id'].dataType.simpleString()}, print binary, keys array<bigint>")


def links_of_sets(prints: np.ndarray, sizes: np.ndarray, tile: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same documents as all near pairs of each set would; tile tells which of two tiles a row is of.

    Within a set of one tile these are a spanning forest. Of a set of two tiles it is what joins the trees of one tile
    with those of the other, as either tile has a task that sends its own forest.
    """
    ends = np.cumsum(sizes)
    left, right = [], []
    cuts = np.unique(np.searchsorted(np.cumsum(sizes**2), np.arange(0, int((sizes**2).sum()) + 1, 1 << 22), side="left"))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(sizes))):
        if lo == hi:
            continue
        at = ends[lo] - sizes[lo]
        own = slice(at, ends[hi - 1])
        i, j = pairs_of_sets(prints[own], sizes[lo:hi], radius)
        if not len(i):
            continue
        side = tile[own]
        within = side[i] == side[j]
        label = labels(i[within], j[within], ends[hi - 1] - at)
        crossing = np.unique(label[i[~within]] << np.int64(32) | label[j[~within]])
        a, b = forest(crossing >> np.int64(32), crossing & np.int64(0xFFFFFFFF), len(label))
        two = np.repeat(np.maximum.reduceat(side, ends[lo:hi] - sizes[lo:hi] - at) != np.minimum.reduceat(side, ends[lo:hi] - sizes[lo:hi] - at), sizes[lo:hi])
        moved = np.flatnonzero((label != np.arange(len(label))) & ~two)
        left += [a + at, label[moved] + at]
        right += [b + at, moved + at]
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return whole(left), whole(right)


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by set (key, a, b) in, links out. The rows of the last set of a batch wait for the next one; a set is
    of two tiles at most, and so of bounded size."""
    rest = None

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        of = [batch.column(c).to_numpy() for c in ("key", "a", "b")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in of])
        return np.flatnonzero(new)

    def links(batch: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(begin, batch.num_rows))
        prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        some = np.repeat(sizes > 1, sizes)
        rows = np.flatnonzero(some)
        a, b = links_of_sets(prints[some], sizes[sizes > 1], batch.column("tile").to_numpy()[some], radius)
        ids = batch.column("id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows[a])), ids.take(pa.array(rows[b]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        begin = begins(batch)
        rest = batch.slice(begin[-1])
        if len(begin) > 1:
            yield links(batch.slice(0, begin[-1]), begin[:-1])
    if rest is not None:
        yield links(rest, np.zeros(1, np.int64))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(a, b): links between near copies, which join just the documents that all near pairs found would join.

    Documents of the same fingerprint are linked with the smallest of them, which alone is compared with others. A set
    of documents that share a key isn't one task's work if it is large: its rows fall into tiles by a hash of the
    fingerprint, and each pair of tiles goes to a task of its own.
    """
    sketch = materialise(_sketch(docs, id_col, text_col), "simhash")
    kind = sketch.schema["id"].dataType.simpleString()
    least = sketch.groupBy("print").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("print", "a")
    same = sketch.select("print", F.col("id").alias("b")).join(least, "print").where("a <> b").select("a", "b")
    distinct = sketch.groupBy("print", "keys").agg(F.min("id").alias("id"))
    keyed = materialise(distinct.select("print", "id", F.explode("keys").alias("key")).groupBy("key", "print").agg(F.min("id").alias("id")), "keys")
    sets = keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    several = keyed.join(sets, "key").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    other = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = other.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "print")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // TASK_ROWS))
    near = arrow_map(paired.repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b"), lambda b: _compare(b, radius), f"a {kind}, b {kind}")
    return same.union(near)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(node, component) for every id that has a near copy; the component is the smallest id of its group."""
    return components(near_links(docs, id_col, text_col, radius), "a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of near copies: the one with the smallest id.

    The fingerprint is the SimHash of a text's distinct words, in lower case; pairs that share one of KEYS least hashes
    of shingles are compared, all of them, and those at most radius bits apart are near copies. Groups are what such
    pairs join, directly or over others. Texts with one and the same fingerprint are near copies too.

    Null and empty texts and texts without a word are copies of nothing and stay. So do rows with a null id. Rows that
    repeat an id are one document: they all stay or all go. Extra columns are kept as they are. An empty table gives
    an empty result.
    """
    (lost,) = private(docs, "lost")
    gone = near_groups(docs, id_col, text_col, radius).where("node <> component").select(F.col("node").alias(lost))
    return docs.join(gone, column(id_col) == F.col(lost), "left_anti")
