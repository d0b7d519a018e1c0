"""Collections in a folder of tables: catalogue, change log, transactions, versions and index definitions."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, DimensionMismatch, DuplicateId, InvalidFieldValue, NotFound, SearchError, TransactionError
from ..functions.filters import Field, Filter, MetadataSchema
from ..functions.quantize import STORAGE_TYPES, level_bits
from ..operators import bm25, dense, fusion, index, sparse
from . import changes as log
from .records import CHANGE, metadata_struct

INDEX_KINDS = ("dense", "sparse", "tf_idf")
EPOCH_SECONDS = 3600
VERSIONS = "version bigint, source string, source_id string, created_at timestamp, records_upserted bigint, records_deleted bigint, total_operations bigint"
TRANSACTIONS = "transaction_id string, status string, at timestamp, version bigint, records bigint, seconds double"


@dataclass
class Collection:
    """What a collection is declared to hold."""

    name: str
    description: str = ""
    dense: bool = True
    sparse: bool = False
    text: bool = False
    dimension: int | None = None
    store_raw_text: bool = False
    metadata_schema: dict | None = None
    indexes: dict = field(default_factory=dict)

    def schema(self) -> MetadataSchema | None:
        if self.metadata_schema is None:
            return None
        fields = tuple(Field(f["name"], tuple(f["values"])) for f in self.metadata_schema["fields"])
        return MetadataSchema(fields, tuple((c["op"], tuple(c["fields"])) for c in self.metadata_schema.get("conditions", ())))


class _Files:
    """Small files next to the tables, through the file system that Spark reads them by."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def _put(self, path, text: str, overwrite: bool) -> None:
        out = self.fs.create(path, overwrite)
        out.write(text.encode())
        out.close()

    def write(self, name: str, text: str) -> None:
        """A whole file or the one before: it is written aside, and takes the name in one step."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        self._put(aside, text, True)
        how = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(how.OVERWRITE.getClass(), 1)
        options[0] = how.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf).rename(aside, self.path(name), options)

    def claim(self, name: str, text: str = "") -> bool:
        """Makes a file that isn't there; False if somebody else has made it."""
        try:
            self._put(self.path(name), text, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(b & 0xFF for b in self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def folders(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path("")) if s.isDirectory()) if self.exists("") else []

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


class Store:
    """All collections under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)
        self._loaded: dict[str, DataFrame] = {}

    def create(self, collection: Collection) -> CollectionStore:
        if self.files.exists(f"{collection.name}/collection.json"):
            raise AlreadyExists(f"collection {collection.name}")
        if collection.dense and not collection.dimension:
            raise SearchError("a collection with dense vectors has a dimension")
        collection.schema()
        self.files.write(f"{collection.name}/collection.json", json.dumps(asdict(collection)))
        return CollectionStore(self, collection)

    def get(self, name: str) -> CollectionStore:
        if not self.files.exists(f"{name}/collection.json"):
            raise NotFound(f"collection {name}")
        return CollectionStore(self, Collection(**json.loads(self.files.read(f"{name}/collection.json"))))

    def names(self) -> list[str]:
        return [n for n in self.files.folders() if self.files.exists(f"{n}/collection.json")]

    def delete(self, name: str) -> Collection:
        found = self.get(name).collection
        self.unload(name)
        self.files.delete(name)
        return found

    def load(self, name: str) -> DataFrame:
        """Keeps the latest view in memory and on disk of the executors until unload."""
        if name not in self._loaded:
            self._loaded[name] = self.get(name).latest().persist()
        return self._loaded[name]

    def unload(self, name: str) -> None:
        if name in self._loaded:
            self._loaded.pop(name).unpersist()

    def loaded(self) -> list[str]:
        return sorted(self._loaded)


class CollectionStore:
    """One collection. Changes are Parquet folders, one a version; a version exists once its row is written."""

    def __init__(self, store: Store, collection: Collection):
        self.store, self.spark, self.collection = store, store.spark, collection
        self.root = f"{store.root}/{collection.name}"
        self._open: Transaction | None = None

    # reading

    def _table(self, name: str, ddl: str) -> DataFrame:
        if not self.store.files.exists(f"{self.collection.name}/{name}"):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")

    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    def changes(self) -> DataFrame:
        """All changes of versions that were committed; folders of others aren't read."""
        everything = self._table("changes", f"{CHANGE}, version bigint")
        return everything.join(self.versions().select("version").distinct(), "version", "left_semi").select(*everything.columns)

    def latest(self) -> DataFrame:
        return log.latest(self.changes())

    def as_of(self, version: int) -> DataFrame:
        return log.as_of(self.changes(), version)

    def current_version(self) -> int:
        return self.versions().agg(F.max("version")).first()[0] or 0

    def list_versions(self) -> DataFrame:
        """Versions with cumulative_upserts, the running sum that ignores deletions, and live_count as of each."""
        from pyspark.sql import Window

        v = self.versions()
        running = F.sum("records_upserted").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0))
        live = self.changes().select("id", "version", "seq", "op")
        first = Window.partitionBy("id").orderBy("version")
        last_in = live.groupBy("id", "version").agg((F.max_by("op", "seq") != log.DELETE).cast("int").alias("live"))
        step = last_in.withColumn("step", F.col("live") - F.coalesce(F.lag("live").over(first), F.lit(0))).groupBy("version").agg(F.sum("step").alias("step"))
        total = F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0))
        return v.join(step, "version", "left").select(*v.columns, running.alias("cumulative_upserts"), total.alias("live_count"))

    def details(self) -> dict:
        return asdict(self.collection) | {"vectors_count": self.latest().count(), "current_version": self.current_version()}

    # writing

    def checked(self, records: DataFrame) -> DataFrame:
        """Records as upserts, if their vectors have the declared dimension and their metadata the declared values.

        Text is kept only where declared. Both checks are one job, which stops at the first rows that break them.
        """
        c = self.collection
        wrong = F.lit(None).cast("string")
        if c.dense and c.dimension:
            wrong = F.when(F.col("dense").isNotNull() & (F.size("dense") != c.dimension), F.lit("dense"))
        if (schema := c.schema()) is not None:
            meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
            declared = F.array(*[F.lit(f.name) for f in schema.fields])
            wrong = F.coalesce(wrong, F.when(F.size(F.array_except(F.map_keys(meta), declared)) > 0, F.lit("a field that isn't declared")))
            for f in schema.fields:
                value = F.try_element_at(meta, F.lit(f.name))
                wrong = F.coalesce(wrong, F.when(value.isNotNull() & ~value.isin([str(v) for v in f.values]), F.concat(F.lit(f"{f.name}: "), value)))
        bad = records.select(wrong.alias("wrong")).where("wrong IS NOT NULL").first()
        if bad is not None:
            if bad["wrong"] == "dense":
                raise DimensionMismatch(f"{c.name} has {c.dimension} dimensions")
            raise InvalidFieldValue(bad["wrong"])
        if not c.store_raw_text and not c.text:
            records = records.withColumn("text", F.lit(None).cast("string"))
        if "seq" not in records.columns:
            records = records.withColumn("seq", F.monotonically_increasing_id())
        return records.withColumn("op", F.lit("upsert"))

    def _next_version(self) -> int:
        """A version that nobody else has or gets: the file with its number is made by one writer alone."""
        version = self.current_version() + 1
        while not self.store.files.claim(f"{self.collection.name}/claims/{version}"):
            version += 1
        return version

    def append(self, changes: DataFrame, source: str, source_id: str = "", version: int | None = None) -> int:
        """Writes a version: its changes first, its row last, so that a failure between leaves nothing that is read.

        Writers at the same time get versions of their own. A version that is given is the caller's to keep apart, as
        that of a micro-batch that is written again after a failure.
        """
        if version is None:
            version = self._next_version()
        path = f"{self.root}/changes/version={version}"
        plain = changes.select(*[f.split()[0] for f in ("id", "document_id", "dense", "sparse", "text", "metadata", "op", "seq")])
        plain.write.mode("overwrite").parquet(path)
        n = self.spark.read.parquet(path).agg(F.count(F.when(F.col("op") != log.DELETE, 1)).alias("up"), F.count(F.when(F.col("op") == log.DELETE, 1)).alias("down")).first()
        row = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(source).alias("source"), F.lit(source_id).alias("source_id"), F.current_timestamp().alias("created_at"),
            F.lit(n["up"]).cast("bigint").alias("records_upserted"), F.lit(n["down"]).cast("bigint").alias("records_deleted"), F.lit(n["up"] + n["down"]).cast("bigint").alias("total_operations"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return version

    def transaction(self) -> Transaction:
        """Opens the one transaction that a collection can have, whoever asks: it is noted with the tables."""
        t = Transaction(self)
        if not self.store.files.claim(f"{self.collection.name}/transaction.json", json.dumps({"id": t.id, "opened": time.time()})):
            raise TransactionError(f"transaction {self.open_transaction()} is open")
        self._note(t.id, "not_started")
        self._open = t
        return t

    def open_transaction(self) -> str | None:
        name = f"{self.collection.name}/transaction.json"
        return json.loads(self.store.files.read(name))["id"] if self.store.files.exists(name) else None

    def commit(self, transaction_id: str) -> int:
        return self._current(transaction_id)._commit()

    def abort(self, transaction_id: str) -> None:
        """Also one that another process has left open: what it had staged is gone with it."""
        if self._open is None and transaction_id == self.open_transaction():
            self._close(transaction_id)
            self._note(transaction_id, "aborted")
            return
        self._current(transaction_id)._abort()

    def _close(self, transaction_id: str) -> None:
        self._open = None
        if self.open_transaction() == transaction_id:
            self.store.files.delete(f"{self.collection.name}/transaction.json")

    def _current(self, transaction_id: str) -> Transaction:
        """The open transaction, if it has this id and was opened here; another id leaves it open."""
        if self._open is None or self._open.id != transaction_id or self.open_transaction() != transaction_id:
            raise TransactionError(f"transaction {transaction_id} isn't the open one")
        return self._open

    def upsert(self, records: DataFrame) -> int:
        """Streaming upsert: a version of its own, searchable on return; the last of equal ids wins."""
        version = self.append(self.checked(records), "implicit")
        self._sample()
        return version

    def delete(self, ids: DataFrame) -> int:
        return self.append(deletions(ids), "implicit")

    def roll_back(self, version: int) -> int:
        """A new version in which everything is as it was in an earlier one."""
        if not 0 <= version <= self.current_version():
            raise NotFound(f"version {version}")
        back = log.inverse(self.changes(), version).withColumn("seq", F.lit(0).cast("bigint"))
        return self.append(back, "rollback", str(version))

    def compact(self) -> None:
        """The latest view as one version in place of all changes; earlier versions can't be read any more."""
        version = self.append(self.latest().drop("version"), "compaction")
        for r in self.versions().where(F.col("version") < version).select("version").collect():
            self.store.files.delete(f"{self.collection.name}/changes/version={r[0]}")

    # status of transactions

    def _note(self, transaction_id: str, status: str, version: int | None = None, records: int = 0, seconds: float | None = None) -> None:
        row = self.spark.createDataFrame([(transaction_id, status, version, records, seconds)], "transaction_id string, status string, version bigint, records bigint, seconds double")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/transactions")

    def transactions(self) -> DataFrame:
        """The last status of each transaction; records_per_second is null where no time passed."""
        rows = self._table("transactions", TRANSACTIONS)
        order = F.when(F.col("status").isin("complete", "aborted"), 2).when(F.col("status") == "in_progress", 1).otherwise(0)
        last = rows.groupBy("transaction_id").agg(F.max_by(F.struct("status", "version", "records", "seconds", "at"), F.struct(order, "at")).alias("x")).select("transaction_id", "x.*")
        return last.withColumn("records_per_second", F.when(F.col("seconds") > 0, F.col("records") / F.col("seconds")))

    def transaction_status(self, transaction_id: str) -> str:
        row = self.transactions().where(F.col("transaction_id") == transaction_id).first()
        if row is None:
            raise NotFound(f"transaction {transaction_id}")
        return row["status"]

    def indexing_status(self) -> DataFrame:
        return status_summary(self.transactions())

    # indexes

    def create_index(self, kind: str, **options) -> dict:
        """Declares an index, and builds it over what is there, if that is sample_threshold records or more.

        Until it is built searches read the records themselves; it is then built when an upsert reaches the threshold, or
        on the commit of a transaction, however few records there are.
        """
        if kind not in INDEX_KINDS:
            raise SearchError(f"no index {kind}")
        if kind in self.collection.indexes:
            raise AlreadyExists(f"{kind} index of {self.collection.name}")
        self.collection.indexes[kind] = index_options(kind, options)
        self._save()
        self._sample(kind)
        return self.collection.indexes[kind]

    def _records_of(self, kind: str, records: DataFrame) -> DataFrame:
        return records.where(F.col({"dense": "dense", "sparse": "sparse", "tf_idf": "text"}[kind]).isNotNull())

    def _sample(self, *kinds: str) -> None:
        """Builds declared indexes that aren't built and have enough records by now."""
        for kind in kinds or INDEX_KINDS:
            options = self.collection.indexes.get(kind)
            if options is not None and self.built(kind) is None and self._records_of(kind, self.latest()).limit(options["sample_threshold"]).count() >= options["sample_threshold"]:
                self.build_index(kind)

    def build_index(self, kind: str) -> index.Built:
        """Builds the index over the current version; the one before is deleted once this one is in its place."""
        options, before = self.index(kind), self.built(kind)
        root, version, latest = f"{self.root}/indexes", self.current_version(), self.latest()
        if kind == "tf_idf":
            now = index.build_text(latest, root, version)
        elif kind == "sparse":
            now = index.build_sparse(sparse.postings(self._records_of(kind, latest)), root, version, options["bits"], options["upper_bound"])
        else:
            now = index.build_dense(latest, root, version, options["storage"], tuple(options["range"]) if options["range"] else None)
        self.store.files.write(f"{self.collection.name}/{kind}.index.json", json.dumps(now.as_json()))
        if before is not None:
            self.store.files.delete(before.path.removeprefix(f"{self.store.root}/"))
        return now

    def build_indexes(self) -> None:
        for kind in self.collection.indexes:
            self.build_index(kind)

    def built(self, kind: str) -> index.Built | None:
        """The index as it was built last, by whomever."""
        name = f"{self.collection.name}/{kind}.index.json"
        return index.load(self.store.files.read(name)) if self.store.files.exists(name) else None

    def indexing(self) -> str | None:
        """A warning while some index hasn't all of the current version; searches are right meanwhile, and slower."""
        current = self.current_version()
        late = [kind for kind in self.collection.indexes if (b := self.built(kind)) is None or b.version < current]
        return f"indexing in progress: {', '.join(late)}" if late else None

    def index(self, kind: str) -> dict:
        if kind not in self.collection.indexes:
            raise NotFound(f"{kind} index of {self.collection.name}")
        return self.collection.indexes[kind]

    def indexes(self) -> dict:
        """All of them, the text index too."""
        return dict(self.collection.indexes)

    def delete_index(self, kind: str) -> None:
        self.index(kind)
        del self.collection.indexes[kind]
        self._save()
        if (built := self.built(kind)) is not None:
            self.store.files.delete(f"{self.collection.name}/{kind}.index.json")
            self.store.files.delete(built.path.removeprefix(f"{self.store.root}/"))

    def _save(self) -> None:
        self.store.files.write(f"{self.collection.name}/collection.json", json.dumps(asdict(self.collection)))

    # searching

    def _since(self, built: index.Built) -> tuple[DataFrame | None, DataFrame | None]:
        """(ids changed since the index was built, the live records among them); nothing if it is up to date."""
        if built.version >= self.current_version():
            return None, None
        changed = self.changes().where(F.col("version") > built.version).select("id").distinct()
        return changed, self.latest().where(F.col("version") > built.version)

    def records(self, where: Filter | Column | None = None) -> DataFrame:
        """The live records, with a typed column for each declared metadata field, that a filter lets through.

        A filter may name declared fields alone, with declared values.
        """
        schema = self.collection.schema()
        out = self.latest() if schema is None else metadata_struct(self.latest(), schema.struct_type())
        if where is None:
            return out
        if isinstance(where, Filter):
            if schema is None:
                raise SearchError(f"{self.collection.name} declares no metadata")
            where = schema.check(where).column()
        return out.where(where)

    def _kept(self, scores: DataFrame, where: Filter | Column | None) -> DataFrame:
        return scores if where is None else scores.join(self.records(where).select("id"), "id", "left_semi")

    def search_dense(self, query: list[float], k: int = 10, where: Filter | Column | None = None, exact: bool = False) -> DataFrame:
        """(id, score): the k best by the index's metric. With an index, its codes are ranked first, ef_search of them or
        more are ranked again by the vectors; exact=True, or no index, ranks all vectors."""
        options = self.collection.indexes.get("dense", {})
        metric, built = options.get("metric", "cosine"), self.built("dense")
        records = self.records(where)
        if exact or built is None or metric != "cosine":
            return dense.search(records, query, k, metric)
        if self.collection.dimension and len(query) != self.collection.dimension:
            raise DimensionMismatch(f"{self.collection.name} has {self.collection.dimension} dimensions")
        changed, fresh = self._since(built)
        codes = built.table(self.spark, "codes")
        if changed is not None:
            codes = codes.join(changed, "id", "left_anti")
        if where is not None:
            codes = codes.join(records.select("id"), "id", "left_semi")
        near = F.col("id").isin(index.dense_candidates(built, codes, query, max(k, options["ef_search"])))
        if changed is not None:  # what has come since is ranked by its vectors at once
            near = near | (F.col("version") > built.version)
        return dense.search(records.where(near), query, k, metric)

    def batch_dense(self, queries: DataFrame, k: int = 10, where: Filter | Column | None = None) -> DataFrame:
        """(query_id, rank, id, score) for queries (query_id, query): all vectors, by matrix products."""
        return dense.batch_search(self.records(where), queries, k, self.collection.indexes.get("dense", {}).get("metric", "cosine"))

    def batch_sparse(self, queries: DataFrame, k: int = 10, where: Filter | Column | None = None, threshold: float | None = None, rerank: bool = True) -> DataFrame:
        """(query_id, rank, id, score) for queries (query_id, dim, q); of an index only the postings asked for are read.

        A threshold, the index's own if there is one, leaves out small codes of small query terms. rerank ranks again by
        the exact products: all that can be among the best, or with a threshold some more than k.
        """
        built = self.built("sparse")
        if built is None:
            return sparse.search(self._kept(sparse.postings(self._records_of("sparse", self.latest())), where), queries, k)
        changed, fresh = self._since(built)
        found = index.sparse_postings(built, queries, changed, None if fresh is None else sparse.postings(self._records_of("sparse", fresh)))
        threshold = threshold if threshold is not None else self.index("sparse")["early_terminate_threshold"] or None
        more = sparse.OVERSAMPLE if threshold is not None else None
        return sparse.quantized_search(self._kept(found, where), queries, k, built.numbers["upper"], built.numbers["bits"], threshold, rerank, more)

    def search_sparse(self, terms: list[tuple[int, float]], k: int = 10, **options) -> DataFrame:
        return self.batch_sparse(sparse.query_table(self.spark, terms), k, **options)

    def batch_text(self, queries: DataFrame, k: int = 10, where: Filter | Column | None = None) -> DataFrame:
        """(query_id, rank, id, score) by BM25 for queries (query_id, text); of an index only the terms asked are read."""
        options = self.collection.indexes.get("tf_idf", {"k1": bm25.K1, "b": bm25.B})
        built = self.built("tf_idf")
        if built is None:
            scores = bm25.scores(self.latest(), queries, options["k1"], options["b"])
        else:
            scores = index.text_scores(built, queries, options["k1"], options["b"], *self._since(built))
        return bm25.best(self._kept(scores, where), k)

    def search_text(self, text: str, k: int = 10, **options) -> DataFrame:
        return self.batch_text(self.spark.createDataFrame([(0, text)], "query_id bigint, text string"), k, **options)

    def batch_hybrid(self, k: int = 10, where: Filter | Column | None = None, rrf_k: float = fusion.RRF_K, **queries: DataFrame) -> DataFrame:
        """(query_id, rank, id, score): two or more of dense=, sparse= and text= queries, fused by reciprocal rank.

        Queries of one query_id belong together; each is in the searches whose table has it, so a batch may mix kinds.
        """
        ways = {"dense": self.batch_dense, "sparse": self.batch_sparse, "text": self.batch_text}
        if unknown := set(queries) - set(ways):
            raise SearchError(f"no searches {sorted(unknown)}")
        return fusion.fuse([ways[name](asked, k * fusion.FETCH, where) for name, asked in queries.items()], k, rrf_k)


def index_options(kind: str, options: dict) -> dict:
    """Options of an index with their defaults, checked."""
    defaults = {
        "dense": {"quantization": "auto", "storage": "u8", "range": None, "metric": "cosine", "sample_threshold": 100, "ef_construction": 128, "ef_search": 256, "num_layers": 7, "neighbors_count": 32, "level_0_neighbors_count": 64},
        "sparse": {"quantization": 64, "upper_bound": None, "early_terminate_threshold": 0.0, "sample_threshold": 100},
        "tf_idf": {"k1": 1.2, "b": 0.75, "sample_threshold": 100},
    }[kind]
    if unknown := set(options) - set(defaults):
        raise SearchError(f"{kind} index: no options {sorted(unknown)}")
    out = defaults | options
    if kind == "dense" and out["storage"] not in STORAGE_TYPES:
        raise SearchError(f"no storage type {out['storage']}")
    if kind == "sparse":
        out["bits"] = level_bits(out["quantization"])
    return out


def deletions(ids: DataFrame) -> DataFrame:
    """Changes that delete ids."""
    none = {"document_id": "string", "dense": "array<float>", "sparse": "array<struct<dim:bigint,val:float>>", "text": "string", "metadata": "map<string,string>"}
    return ids.select("id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(log.DELETE).alias("op"), F.lit((1 << 63) - 1).alias("seq"))


def status_summary(transactions: DataFrame) -> DataFrame:
    """(status, transactions, records, avg_records_per_second): one aggregation, null averages where there are none."""
    return transactions.groupBy("status").agg(F.count("*").alias("transactions"), F.sum("records").alias("records"), F.avg("records_per_second").alias("avg_records_per_second"))


class Transaction:
    """Changes staged for one explicit version, with which the indexes are built anew. Deletions count after all upserts."""

    def __init__(self, owner: CollectionStore):
        self.owner, self.id = owner, uuid.uuid4().hex
        self._staged: list[DataFrame] = []
        self._gone: list[DataFrame] = []

    def insert(self, records: DataFrame, mode: str = "insert") -> None:
        """mode="insert" refuses ids that exist, staged or committed; mode="upsert" replaces them."""
        self._alive()
        records = self.owner.checked(records)
        if mode == "insert":
            known = self.owner.latest().select("id")
            for earlier in self._staged:
                known = known.union(earlier.select("id"))
            if records.join(known, "id", "left_semi").limit(1).count() or records.groupBy("id").count().where("count > 1").limit(1).count():
                raise DuplicateId("an id exists already")
        elif mode != "upsert":
            raise SearchError(f"no mode {mode}")
        self._staged.append(records.withColumn("seq", F.lit(len(self._staged)).cast("bigint") * (1 << 40) + F.col("seq").bitwiseAND(F.lit((1 << 40) - 1))))

    def delete(self, ids: DataFrame) -> None:
        self._alive()
        self._gone.append(deletions(ids))

    def commit(self) -> int:
        return self.owner.commit(self.id)

    def abort(self) -> None:
        self.owner.abort(self.id)

    def _alive(self) -> None:
        if self.owner._open is not self:
            raise TransactionError(f"transaction {self.id} is closed")

    def _commit(self) -> int:
        columns = ["id", "document_id", "dense", "sparse", "text", "metadata", "op", "seq"]
        parts = [p.select(*columns) for p in (*self._staged, *self._gone)]
        every = parts[0] if parts else self.owner.spark.createDataFrame([], CHANGE).select(*columns)
        for p in parts[1:]:
            every = every.union(p)
        began = time.time()
        self.owner._note(self.id, "in_progress")
        version = self.owner.append(every, "explicit", self.id)
        self.owner.build_indexes()
        self.owner._close(self.id)
        n = self.owner.versions().where(F.col("version") == version).first()["total_operations"]
        self.owner._note(self.id, "complete", version, n, time.time() - began)
        return version

    def _abort(self) -> None:
        self._staged, self._gone = [], []
        self.owner._close(self.id)
        self.owner._note(self.id, "aborted")

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *error) -> None:
        if self.owner._open is self:
            self.abort() if kind else self.commit()
