"""Indexes in a folder: postings clustered by term or dimension, and dense codes; built once, read in part."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize
from ..functions.vectors import cosine, literal_vector
from . import bm25, dense, sparse

#: Terms or dimensions that are looked up by a list, which Parquet's filters and statistics see; more are joined.
LISTED = 2000


def _write(table: DataFrame, path: str, *order: str) -> None:
    """Sorted over all files, so that a term's rows are in few row groups; a term of many rows may take several files."""
    (
        table.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.option(f"parquet.bloom.filter.enabled#{order[0]}", "true")
        .option("parquet.bloom.filter.max.bytes", str(1 << 20))
        .parquet(path)
    )


def _asked_for(table: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows of the keys asked for: few keys as a list that reaches the scan, many by a join."""
    keys = [r[0] for r in asked.select(key).distinct().limit(LISTED + 1).collect()]
    return table.where(F.col(key).isin(keys)) if len(keys) <= LISTED else table.join(asked.select(key).distinct(), key, "left_semi")


@dataclass
class Built:
    """Where an index is, the version of the collection that it has, and what was counted or sampled for it."""

    kind: str
    path: str
    version: int
    numbers: dict

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def as_json(self) -> dict:
        return asdict(self)


def build_text(docs: DataFrame, root: str, version: int = 0, id_col: str = "id", text_col: str = "text", stemming: bool = True) -> Built:
    """Postings (term, id, count, length) in the order of terms, and (id, length) of each document with a text."""
    path = f"{root}/text-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    raw = f"{path}/raw"
    bm25.term_table(docs, id_col, text_col, stemming).write.parquet(raw)  # the texts are read once
    counted = spark.read.parquet(raw)
    _write(counted.select("term", "id", "count", "length"), f"{path}/postings", "term", "id")
    some = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"))
    lengths = counted.groupBy("id").agg(F.first("length").alias("length"))
    some.join(lengths, "id", "left").select("id", F.coalesce("length", F.lit(0)).cast("bigint").alias("length")).write.parquet(f"{path}/lengths")
    n = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    at = spark._jvm.org.apache.hadoop.fs.Path(raw)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return Built("tf_idf", path, version, {"n_docs": n[0], "total": n[1], "stemming": stemming})


def text_scores(built: Built, queries: DataFrame, k1: float = bm25.K1, b: float = bm25.B, changed: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) over the index, of which only postings of the terms asked are read.

    changed are ids whose postings don't count any more, fresh the records (id, text) of those that are there in another
    state: what has come after the index was built.
    """
    spark = queries.sparkSession
    stemming = built.numbers["stemming"]
    asked = bm25.query_terms(queries, stemming=stemming)
    postings = _asked_for(built.table(spark, "postings"), "term", asked)
    n, total = built.numbers["n_docs"], built.numbers["total"]
    if changed is not None:
        gone = built.table(spark, "lengths").join(changed, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        come = fresh.where("text IS NOT NULL")
        own = bm25.term_table(come, stemming=stemming)
        n, total = n - gone[0] + come.count(), total - gone[1] + (own.agg(F.sum("count")).first()[0] or 0)
        postings = postings.join(changed, "id", "left_anti").select("term", "id", "count", "length").union(own.join(asked.select("term").distinct(), "term", "left_semi").select("term", "id", "count", "length"))
    return bm25.scored(postings, asked, F.lit(n), F.lit(total / n if n else None).cast("double"), k1, b)


def build_sparse(postings: DataFrame, root: str, version: int = 0, bits: int = 6, upper: float | None = None) -> Built:
    """Postings (dim, id, val, code) in the order of dimensions; the codes' upper bound is sampled where none is given."""
    path = f"{root}/sparse-{uuid.uuid4().hex}"
    upper = upper if upper is not None else float(quantize.sparse_upper_bound(postings).first()["upper"])
    _write(sparse.with_codes(postings.select("dim", "id", "val"), upper, bits), f"{path}/postings", "dim", "id")
    return Built("sparse", path, version, {"upper": upper, "bits": bits})


def sparse_postings(built: Built, queries: DataFrame, changed: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """The postings, with codes, of the dimensions asked for; fresh are postings (dim, id, val)."""
    found = _asked_for(built.table(queries.sparkSession, "postings"), "dim", queries)
    if changed is not None:
        own = sparse.with_codes(fresh.join(queries.select("dim").distinct(), "dim", "left_semi").select("dim", "id", "val"), built.numbers["upper"], built.numbers["bits"])
        found = found.join(changed, "id", "left_anti").select("dim", "id", "val", "code").union(own)
    return found


def build_dense(records: DataFrame, root: str, version: int = 0, storage: str = "u8", bounds: tuple[float, float] | None = None, id_col: str = "id", vector_col: str = "dense") -> Built:
    """(id, codes, norm) of each vector: bytes over a range, which is sampled where none is given, or codes of a few bits."""
    path = f"{root}/dense-{uuid.uuid4().hex}"
    some = records.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = quantize.STORAGE_TYPES[storage]
    if kind == "u8" and bounds is None:
        r = quantize.dense_range(some, "v").first()
        bounds = (float(r["low"]), float(r["high"]))
    if kind == "u8":
        codes = quantize.u8_codes(F.col("v"), *bounds)
    elif kind.startswith("subbyte"):
        codes = quantize.subbyte_codes(F.col("v"), int(kind[-1])).cast("array<smallint>")
    else:
        codes = (quantize.half_values(F.col("v")) if kind == "f16" else F.col("v")).cast("array<float>")
    _write(some.select("id", codes.alias("codes")).withColumn("norm", quantize.code_norm(F.col("codes"))), f"{path}/codes", "id")
    return Built("dense", path, version, {"storage": kind, "bounds": list(bounds) if bounds else None})


def dense_candidates(built: Built, codes: DataFrame, query: list[float], n: int) -> list:
    """The ids of the n best by the cosine of their codes, ties to the smallest id; of codes, a table of the index or a part."""
    kind, q = built.numbers["storage"], [float(x) for x in query]
    if kind == "u8":
        low, high = built.numbers["bounds"]
        q = [float(int((min(max(x, low), high) - low) / (high - low) * 255.0)) for x in q]
    elif kind.startswith("subbyte"):
        bits = int(kind[-1])
        q = [float(min(max(int((x + 1.0) // (2.0 / (1 << bits))), 0), (1 << bits) - 1)) for x in q]
    own = sum(x * x for x in q) ** 0.5
    rough = F.round(cosine(F.col("codes"), literal_vector(q), F.col("norm"), F.lit(own)), dense.DIGITS)
    return [r["id"] for r in codes.select("id", rough.alias("rough")).where("rough IS NOT NULL").orderBy(F.desc("rough"), "id").limit(n).collect()]


def load(text: str) -> Built:
    return Built(**json.loads(text))
