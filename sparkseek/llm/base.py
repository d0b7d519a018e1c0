"""What the operators share: the cluster's folder, private column names, word hashing and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch, and the setting that bounds them.
BATCH_BYTES = "8m"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all is one process, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not regex.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: the executors need a folder that they all share")
        set_to = "file://" + tempfile.mkdtemp(prefix="sparkseek-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


#: What materialise() wrote and nobody has deleted yet.
_written: list[str] = []


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing that is still to run reads it."""
    delete(df.sparkSession, df._shared_path)
    if df._shared_path in _written:
        _written.remove(df._shared_path)


def settle(spark: SparkSession) -> None:
    """Let go of what ended jobs left in the driver, so that Spark deletes their shuffle files before the next job needs the disk."""
    for _ in range(2):  # the first lets go of what Python held, the second finds it gone
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def written() -> set[str]:
    """The tables that operators have written in this process and that aren't deleted."""
    return set(_written)


def clear(spark: SparkSession, *keep: DataFrame, before: set[str] = frozenset()) -> None:
    """Delete every table that the operators have written in this process, but those of `keep` and those written before.

    A result is computed when it is read, so this is for when all results since are stored elsewhere.
    """
    kept = {df._shared_path for df in keep} | before
    for path in [p for p in _written if p not in kept]:
        delete(spark, path)
        _written.remove(path)


def cut_rows(df: DataFrame, size: str, order: list[str], most: int) -> DataFrame:
    """The first rows by `order` whose `size` adds up to at most `most`; for a bounded table only. Rows are whole, or not there."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    (total,) = private(df, "total")
    return df.where(F.col(size) <= most).withColumn(total, F.sum(size).over(so_far)).where(F.col(total) <= most).drop(total)


def labelled_sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, most_rows: int, most_bytes: int) -> tuple[dict, DataFrame]:
    """How many labelled ids of each kind have a text, and (kind, place, text) of a sample of them: whole texts.

    known has a kind for each id. Of each kind the sample has the first rows in the order of place, a hash of the id, at
    most most_rows and as far as they are most_bytes together; a text that is longer alone isn't taken. Of an id with
    several texts one counts.
    """
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text").cast("bigint").alias("size")
    one = known.join(texts.select("id", "h", size), "id").groupBy("id", "kind").agg(F.min(F.struct("h", "size")).alias("pick"))
    there = materialise(one.select("id", "kind", "pick.h", "pick.size", F.xxhash64("id").alias("place")), "labelled")
    count = {r["kind"]: r["n"] for r in there.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    sample = None
    for kind in sorted(count):
        some = cut_rows(there.where(F.col("kind") == kind).where(F.col("size") <= most_bytes).orderBy("place", "id").limit(most_rows), "size", ["place", "id"], most_bytes)
        sample = some if sample is None else sample.union(some)
    if sample is None:
        sample = there
    return count, texts.join(F.broadcast(sample.drop("size")), ["id", "h"]).groupBy("id", "h", "kind", "place").agg(F.first("text").alias("text")).select("kind", "place", "text")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str):
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pruned(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the names given."""
    return df.select(*[column(c).alias(name) for name, c in wanted.items()])


def give_back() -> None:
    """Memory that a task is done with, back to the system: an idle Python worker counts against its executor too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of bounded size, whatever the length of texts; a limit that the session sets stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def arrow_groups(grouped: GroupedData, run: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """applyInArrow that gives memory back after each group."""

    def tidy(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return grouped.applyInArrow(tidy, schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """arrow_map by position: neither the names of df nor those of schema need be plain or distinct."""
    plain = [f"c{i}" for i in range(len(schema))]
    kinds = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=plain)

    return arrow_map(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), renamed, kinds).toDF(*schema.names)


# == words of a batch of texts, without a Python object per word

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Bytes whose words are hashed at once.
BLOCK = 1 << 18
_powers = {"n": 0, "up": None, "down": None}

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    _WORD[_lo : _hi + 1] = True
_WORD[95] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Characters of words; and those of scripts that put no space between words, each of which is a word.
LETTERS = r"\p{Alphabetic}\p{M}\p{N}_\u200c\u200d"
ALONE = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}"


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 for none of a word, 1 for a letter, 2 for one that is a word alone; and the lower case of it.

    A character whose lower case takes more or fewer bytes is its own.
    """
    every = "".join(map(chr, range(0x110000)))
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for m in regex.finditer(f"[{LETTERS}]+", every):
        kinds[m.start() : m.end()] = 1
    for m in regex.finditer(f"[{ALONE}]+", every):
        kinds[m.start() : m.end()] *= 2
    for m in regex.finditer(r"[\p{Lu}\p{Lt}]", every):
        low = m[0].lower()
        if len(low) == 1 and len(low.encode()) == len(m[0].encode()):
            lower[m.start()] = ord(low)
    return kinds, lower


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _powers["n"]:
        n = max(n, 1 << 19)
        up, down = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit hashes (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text is a range of its own."""
    _, off = text_buffer(texts)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _beyond(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of bytes, code point) of each character beyond ASCII; data is UTF-8."""
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    code = (data[lead] & (0xFF >> (size + 1)).astype(np.uint8)).astype(np.uint32)
    for i in range(1, 4):
        more = size > i
        code[more] = code[more] << np.uint32(6) | (data[lead[more] + i] & 0x3F)
    return lead, size, code


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, and for each text the index of its first word (one more entry).

    A word is a run of letters, marks, digits and underscores, in lower case; a character of a script without spaces
    between words (Chinese, Japanese, Thai and the like) is a word of its own.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    is_word = _WORD[data]
    low = _LOWER[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    lead, size, code = _beyond(data)
    if len(lead):
        kinds, lower = _unicode()
        kind = kinds[code]
        for i in range(4):
            is_word[lead[(kind > 0) & (size > i)] + i] = True
        edge[lead[kind == 2]] = True
        edge[(lead + size)[kind == 2]] = True
        small = lower[code]
        changed = np.flatnonzero(small != code)
        at, left, bytes_of = lead[changed], small[changed], size[changed]
        for i in range(3, 0, -1):
            more = bytes_of > i
            low[at[more] + i] = 0x80 | left[more] & 0x3F
            left[more] >>= np.uint32(6)
        low[at] = (0xF00 >> bytes_of & 0xFF).astype(np.uint8) | left.astype(np.uint8)
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # in blocks that fit a cache; a hash doesn't depend on where its block begins
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = low[base : ends[stop - 1]]
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            begin = starts[at:stop] - base
            h[at:stop] = mix((total[ends[at:stop] - base] - total[begin]) * down[begin])
        at = stop
    return h, starts, ends, np.searchsorted(starts, off)


def of_all(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each begin to end - 1."""
    up, down = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[: len(h)], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B1))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words, never across texts, and the index of the first one of each text.

    A text of fewer than k words, but one at least, gets one shingle of all its words.
    """
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    where = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    last = np.repeat(first[1:], n)
    out = np.zeros(begin[-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            at = where + i
            out = mix(out * np.uint64(0x100000001B3) + np.where(at < last, h[np.minimum(at, len(h) - 1)], np.uint64(7)))
    return out, begin


# == filters of bounded size

#: Bytes of a filter at most, whatever it holds: what doesn't fit makes it pass more, never less. And bits for a digest.
FILTER_BYTES = 32 << 20
FILTER_BITS = 12
FILTER_PROBES = 5
#: 64-bit words of a filter that are put together at once.
FILTER_BLOCK = 1 << 13


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    e = mix(keys.astype(np.int64).view(np.uint64))
    at = ((e >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    f, mask = mix(e), np.zeros(len(e), np.uint64)
    for i in range(FILTER_PROBES):
        mask |= np.uint64(1) << (f >> np.uint64(6 * i) & np.uint64(63))
    return at, mask


def build_filter(keys: DataFrame) -> np.ndarray:
    """64-bit words of a Bloom filter of the column key, a bigint: FILTER_BITS for each row, FILTER_BYTES at most.

    Blocks of it are put together in tasks, so that the driver gets each of its words once.
    """
    size = max(1, min(FILTER_BYTES // 8, -(-keys.count() * FILTER_BITS // 64)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = _bits(batch.column("key").to_numpy(), size)
            order = np.argsort(at, kind="stable")
            at, mask = at[order], mask[order]
            cuts = np.flatnonzero(np.append(True, at[1:] // FILTER_BLOCK != at[:-1] // FILTER_BLOCK)) if len(at) else np.zeros(0, np.int64)
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]))
            pack = lambda a: pa.array([a[i:j].tobytes() for i, j in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts] // FILTER_BLOCK), pack((at % FILTER_BLOCK).astype(np.int32)), pack(mask)], names=["block", "at", "mask"])

    def block(table: pa.Table) -> pa.Table:
        out = np.zeros(FILTER_BLOCK, np.uint64)
        for at, mask in zip(table.column("at").to_pylist(), table.column("mask").to_pylist()):
            np.bitwise_or.at(out, np.frombuffer(at, np.int32), np.frombuffer(mask, np.uint64))
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    packed = arrow_map(keys.select("key"), parts, "block bigint, at binary, mask binary")
    whole = np.zeros(-(-size // FILTER_BLOCK) * FILTER_BLOCK, np.uint64)
    for row in arrow_groups(packed.groupBy("block"), block, "block bigint, bits binary").toLocalIterator():
        whole[row["block"] * FILTER_BLOCK :][:FILTER_BLOCK] = np.frombuffer(row["bits"], np.uint64)
    return whole[:size]


def held_by(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, mask = _bits(keys, len(words))
    return words[at] & mask == mask


def may_hold(spark: SparkSession, words: np.ndarray):
    """A column function of the keys: whether the filter may hold them. Its size is bounded, so it is broadcast."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        return pd.Series(held_by(shared.value, keys.fillna(0).to_numpy()))

    return probe


# == connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node is joined with. Nodes without an edge don't appear.

    Large-star and small-star steps in turn, until no edge changes; each round is written to the shared folder.
    A star has one row an edge, so a hub of any degree is never gathered into one row.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    seen = fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        before, now = now, materialise(small.where("u <> v").distinct(), "edges")
        release(before)
        was, seen = seen, fingerprint(now)
        if was == seen:
            break
    if not seen[0]:
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
