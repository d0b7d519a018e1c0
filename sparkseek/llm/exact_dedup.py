"""Exact de-duplication by a log-structured merge index of digests."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_map, build_filter, column, delete, materialise, may_hold, private, shared_dir

#: Rows that a memtable takes before it is flushed.
MEMTABLE = 1 << 19
#: Runs that lie about before they are merged into one.
FAN_IN = 4


def digest(text):
    """128 bits of a text; a hit is verified by its bytes later."""
    return F.unhex(F.md5(text))


def sorted_run(held: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A memtable's entries: the smallest id and the rows of each digest, in the order of digests."""
    table = pa.Table.from_batches(held).group_by("digest").aggregate([("id", "min"), ("digest", "count")])
    out = table.select(["digest", "id_min", "digest_count"]).rename_columns(["digest", "id", "n"]).sort_by("digest")
    yield from out.cast(schema).to_batches()


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of digest and id in; one of each digest out, with its smallest id and all its rows."""
    rest = None

    def one_each(batch: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        n = np.add.reduceat(batch.column("n").to_numpy(), begin)
        at = pa.array(begin)
        return pa.RecordBatch.from_arrays([batch.column("digest").take(at), batch.column("id").take(at), pa.array(n)], names=["digest", "id", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        same = pc.equal(batch.column("digest")[1:], batch.column("digest")[:-1]).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.append(True, ~same))
        if len(begin) > 1:
            yield one_each(batch.slice(0, begin[-1]), begin[:-1])
        rest = one_each(batch.slice(begin[-1]), np.zeros(1, np.int64))
    if rest is not None:
        yield rest


def key_of(digests):
    """What a filter holds of a digest."""
    return F.xxhash64(digests)


# == the index

#: First and last flush that a run is of, and how often it was merged.
Run = tuple[int, int, int]


class LsmIndex:
    """Digest -> smallest id and number of rows, as sorted runs in a folder that all executors share.

    flush() fills memtables, one after another in each task: a memtable takes up to MEMTABLE rows, keeps the smallest
    id of each digest, and is flushed in a sorted file of a new run; nothing is shuffled. compact() merges sorted runs
    into one whose files divide the range of digests, in which each digest stands once; the runs merged are deleted
    after that. Every run is Parquet with a Bloom filter on the digest and min/max statistics for each page, so that
    find() skips what can't hold a digest; `holds` has the run's filter as a whole, for lookups of many at once.

    A run is seen only with its _SUCCESS marker, and is named after the flushes it comes from, so an index that is
    opened again after a crash sees each flush once: a run within another's range is left over from a merge.
    texts keeps the bytes of what is in the index, if later batches are to be verified against it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "bigint"):
        self.spark, self.id_type = spark, id_type
        self.path = path or f"{shared_dir(spark)}/lsm-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        self.holds: dict[Run, np.ndarray] = {}
        if path:
            self._open()

    @property
    def schema(self) -> str:
        return f"digest binary, id {self.id_type}, n bigint"

    def _open(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return
        found = [f.getPath() for f in files.listStatus(at)]
        named = [(m, p) for p in found if (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", p.getName())) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        spans = [(int(m[1]), int(m[2]), int(m[3])) for m, _ in named]
        self.runs = sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] and s[2] < o[2] for o in spans))
        if self.runs:
            self.id_type = self.spark.read.parquet(self._at(self.runs[0])).schema["id"].dataType.simpleString()

    def _at(self, run: Run) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}-{run[2]}"

    def _texts(self, number: int) -> str:
        return f"{self.path}/texts-{number}"

    def _write(self, entries: DataFrame, run: Run) -> None:
        (
            entries.write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled#digest", "true")
            .option("parquet.bloom.filter.max.bytes", str(1 << 20))
            .mode("overwrite")  # what a flush that failed has left there
            .parquet(self._at(run))
        )

    def flush(self, keyed: DataFrame) -> Run:
        """Add rows with the columns digest and id, as a new run."""
        number = 1 + max((run[1] for run in self.runs), default=0)
        kinds = keyed.select("digest", F.col("id").cast(self.id_type).alias("id"))

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, schema = [], 0, None
            for batch in batches:
                schema = pa.schema([("digest", pa.binary()), ("id", batch.schema.field("id").type), ("n", pa.int64())])
                held.append(batch)
                rows += batch.num_rows
                if rows >= MEMTABLE:
                    yield from sorted_run(held, schema)
                    held, rows = [], 0
            if rows:
                yield from sorted_run(held, schema)

        self._write(arrow_map(kinds, memtables, self.schema), (number, number, 0))
        self.runs.append((number, number, 0))
        return number, number, 0

    def read(self, *runs: Run) -> DataFrame:
        """The entries of the runs, of all by default. An empty index has none."""
        frames = [self.spark.read.schema(self.schema).parquet(self._at(run)) for run in runs or self.runs]
        return reduce(DataFrame.union, frames) if frames else self.spark.createDataFrame([], self.schema)

    def merge(self, entries: DataFrame) -> DataFrame:
        """Sorted entries with each digest once: its smallest id (a null counts as none) and all its rows."""
        in_order = entries.repartitionByRange("digest").sortWithinPartitions("digest", F.col("id").asc_nulls_last())
        return arrow_map(in_order, merged, self.schema)

    def compact(self, *runs: Run) -> Run:
        """One run of these (of all by default), with the smallest id of each digest; they must follow each other."""
        old = sorted(runs or self.runs)
        new = old[0][0], old[-1][1], 1 + max(run[2] for run in old)
        self._write(self.merge(self.read(*old)), new)
        self.runs = sorted([*(run for run in self.runs if run not in old), new])
        for run in old:
            self.holds.pop(run, None)
            delete(self.spark, self._at(run))
        return new

    def filter_of(self, run: Run) -> np.ndarray:
        if run not in self.holds:
            self.holds[run] = build_filter(self.read(run).select(key_of("digest").alias("key")))
        return self.holds[run]

    def find(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests: the list goes to Parquet's filters and statistics, which skip what can't hold one."""
        return self.read().where(F.col("digest").isin([*map(bytearray, digests)])).groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))

    def known(self, digests: DataFrame, *runs: Run) -> DataFrame:
        """Those of many digests that a run has; a run is read for those that its filter may hold."""
        found = [digests.where(may_hold(self.spark, self.filter_of(run))(key_of("digest"))).join(self.read(run).select("digest"), "digest", "left_semi") for run in runs]
        return reduce(DataFrame.union, found).distinct() if found else digests.limit(0)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LsmIndex | None = None) -> DataFrame:
    """The rows of docs, all columns, without exact copies: of equal texts the row with the smallest id stays.

    Texts are equal if their bytes are. Null texts aren't copies of anything and stay; empty texts are copies of each
    other. A null id counts as the largest. Ids may be of any type that has an order. Rows of equal text and id
    (repeated rows) are copies too: one stays, the first by the hash of its other columns. An empty table gives an empty
    result. Extra columns are kept as they are.

    Digests alone go into the index (24 bytes a row), whose merged run tells which digests repeat. A filter of these, of
    bounded size, goes to all tasks: a row that it can't hold passes without being moved. The others meet by digest and
    bytes, so that false hits of the filter pass, and so do two texts of one digest; copies are combined before they are
    moved.

    With an index, texts in it from earlier calls count too: their copies go, whatever their ids, as the earlier rows
    have been given out; this call's rows are added, with their bytes, once the result is computed here and written.
    """
    d, row, t = private(docs, "digest", "row", "text")
    text, ident = column(text_col), column(id_col)
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    own = index if index is not None else LsmIndex(spark, id_type=id_type)
    if own.id_type != id_type:
        if own.runs:
            raise ValueError(f"the index has ids of type {own.id_type}, not {id_type}")
        own.id_type = id_type
    earlier = [*own.runs]
    run = own.flush(docs.where(text.isNotNull()).select(digest(text).alias("digest"), ident.alias("id")))
    run = own.compact(run)
    hits = own.read(run).where("n > 1").select("digest")
    if earlier:
        known = materialise(own.known(own.read(run).select("digest"), *earlier), "known")
        hits = hits.union(known).distinct()
    probe = may_hold(spark, build_filter(hits.select(key_of("digest").alias("key"))))
    # what is moved is never a null text
    keyed = docs.withColumn(d, digest(text))
    gate = F.coalesce(probe(key_of(F.col(d))), F.lit(False)) & text.isNotNull()
    passed = keyed.where(~gate).drop(d)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    order = F.struct(ident.isNull(), ident, F.xxhash64(*[column(c) for c in plain]))
    first = keyed.where(gate).groupBy(d, text.alias(t)).agg(F.min_by(F.struct(*[column(c) for c in docs.columns]), order).alias(row))
    if earlier:
        there = reduce(DataFrame.union, [spark.read.schema("digest binary, text string").parquet(own._texts(n)) for n in range(1, earlier[-1][1] + 1)])
        again = there.join(known, "digest", "left_semi").select(F.col("digest").alias(d), F.col("text").alias(t))
        first = first.join(again, [d, t], "left_anti")
    out = passed.unionByName(first.select(f"{row}.*"))
    if index is None:
        return out
    done = materialise(out, "kept")
    done.where(text.isNotNull()).select(digest(text).alias("digest"), text.alias("text")).write.mode("overwrite").parquet(own._texts(run[1]))
    if len(own.runs) >= FAN_IN:  # a merge of all now and then, so that lookups meet few runs
        own.compact()
    return done


SQL = """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1 OR text IS NULL
"""
