import json
import time

import pytest
from pyspark.sql import functions as F

from sparkseek.errors import AlreadyExists, DimensionMismatch, DuplicateId, InvalidFieldValue, NotFound, SearchError, TransactionError
from sparkseek.functions.filters import and_, is_
from sparkseek.operators import bm25, dense, fusion, sparse
from sparkseek.sources import changes, records
from sparkseek.sources.store import Collection, Store, status_summary
from sparkseek.streaming import ingest


def batch(spark, *rows):
    return spark.createDataFrame([(i, None, [float(x) for x in v], None, t, None) for i, v, t in rows], records.RECORD)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture()
def coll(store):
    return store.create(Collection("things", dimension=2, store_raw_text=True))


def state(df):
    return {r["id"]: tuple(r["dense"]) for r in df.collect()}


def test_catalogue(store, coll):
    assert store.names() == ["things"] and store.get("things").collection.dimension == 2
    with pytest.raises(AlreadyExists):
        store.create(Collection("things", dimension=2))
    with pytest.raises(SearchError):
        store.create(Collection("other"))
    store.load("things")
    assert store.loaded() == ["things"]
    store.unload("things")
    assert store.loaded() == []
    store.delete("things")
    assert store.names() == []
    with pytest.raises(NotFound):
        store.get("things")


def test_transactions_and_versions(spark, coll):
    with coll.transaction() as t:
        t.insert(batch(spark, ("a", [1, 0], "A"), ("b", [2, 0], "B")))
        t.delete(spark.createDataFrame([("b",)], "id string"))
        t.insert(batch(spark, ("c", [3, 0], "C")))
    assert state(coll.latest()) == {"a": (1, 0), "c": (3, 0)}, "deletions count after upserts"
    assert coll.transaction_status(t.id) == "complete"
    assert coll.upsert(batch(spark, ("a", [9, 9], None))) == 2
    assert coll.delete(spark.createDataFrame([("c",)], "id string")) == 3
    assert state(coll.latest()) == {"a": (9, 9)} and state(coll.as_of(1)) == {"a": (1, 0), "c": (3, 0)} and state(coll.as_of(2)) == {"a": (9, 9), "c": (3, 0)}
    rows = coll.list_versions().orderBy("version").collect()
    assert [(r["records_upserted"], r["records_deleted"], r["cumulative_upserts"], r["live_count"]) for r in rows] == [(3, 1, 3, 2), (1, 0, 4, 2), (0, 1, 4, 1)]
    assert [r["source"] for r in rows] == ["explicit", "implicit", "implicit"] and coll.current_version() == 3
    assert changes.versions_after(coll.versions(), 1).count() == 2
    assert coll.roll_back(1) == 4 and state(coll.latest()) == {"a": (1, 0), "c": (3, 0)}
    assert coll.details()["vectors_count"] == 2
    coll.compact()
    assert state(coll.latest()) == {"a": (1, 0), "c": (3, 0)} and coll.changes().count() == 2


def test_inserts_and_upserts(spark, coll):
    coll.upsert(batch(spark, ("a", [1, 0], None)))
    t = coll.transaction()
    with pytest.raises(DuplicateId):
        t.insert(batch(spark, ("a", [2, 0], None)))
    t.insert(batch(spark, ("a", [2, 0], None)), mode="upsert")
    with pytest.raises(DuplicateId):
        t.insert(batch(spark, ("x", [2, 0], None), ("x", [2, 1], None)))
    with pytest.raises(DimensionMismatch):
        t.insert(batch(spark, ("y", [1, 2, 3], None)))
    with pytest.raises(TransactionError):
        coll.transaction()
    with pytest.raises(TransactionError):
        coll.commit("another")
    assert coll.commit(t.id) == 2 and state(coll.latest()) == {"a": (2, 0)}, "a wrong number left it open"
    with pytest.raises(TransactionError):
        t.commit()
    u = coll.transaction()
    u.insert(batch(spark, ("z", [1, 1], None)))
    u.abort()
    assert state(coll.latest()) == {"a": (2, 0)} and coll.current_version() == 2
    with pytest.raises(ZeroDivisionError):
        with coll.transaction() as v:
            v.insert(batch(spark, ("z", [1, 1], None)))
            raise ZeroDivisionError
    assert state(coll.latest()) == {"a": (2, 0)}


def test_changes_without_their_version_row_are_not_read(spark, coll):
    coll.upsert(batch(spark, ("a", [1, 0], None)))
    lost = coll.checked(batch(spark, ("b", [1, 0], None)))
    lost.write.parquet(f"{coll.root}/changes/version=2")
    assert state(coll.latest()) == {"a": (1, 0)}
    assert coll.upsert(batch(spark, ("c", [1, 0], None))) == 2 and set(state(coll.latest())) == {"a", "c"}


def test_text_is_kept_only_where_declared(spark, store):
    coll = store.create(Collection("plain", dimension=2))
    coll.upsert(batch(spark, ("a", [1, 0], "secret")))
    assert coll.latest().first()["text"] is None


def test_indexes(coll):
    assert coll.create_index("sparse", quantization=128)["bits"] == 7
    coll.create_index("tf_idf")
    coll.create_index("dense", storage="octal")
    assert set(coll.store.get("things").indexes()) == {"dense", "sparse", "tf_idf"}
    with pytest.raises(AlreadyExists):
        coll.create_index("dense")
    for kind, options in (("none", {}), ("dense", {"storage": "u9"}), ("sparse", {"quantization": 7}), ("tf_idf", {"k9": 1})):
        with pytest.raises(SearchError):
            coll.collection.indexes.pop(kind, None)
            coll.create_index(kind, **options)
    coll.create_index("dense")
    coll.delete_index("dense")
    with pytest.raises(NotFound):
        coll.index("dense")


def test_schema_of_metadata(spark, store):
    declared = {"fields": [{"values": ["pink", "teal"], "name": "hue"}, {"values": [1, 2], "name": "age"}], "conditions": [{"fields": ["hue", "age"], "op": "And"}]}
    coll = store.create(Collection("m", dimension=2, metadata_schema=declared))
    schema = store.get("m").collection.schema()
    assert schema.max_replicas() == 4
    rows = spark.createDataFrame([("a", {"hue": "pink", "age": "2"})], "id string, metadata map<string,string>")
    assert records.metadata_struct(rows, schema.struct_type()).first()["age"] == 2
    with pytest.raises(SearchError):
        records.metadata_struct(rows.withColumn("age", F.lit(1)), coll.collection.schema().struct_type())


def test_status_summary(spark):
    rows = [("complete", 10, 5.0), ("complete", 10, None), ("in_progress", 0, None)]
    df = spark.createDataFrame(rows, "status string, records bigint, records_per_second double")
    assert {tuple(r) for r in status_summary(df).collect()} == {("complete", 2, 20, 5.0), ("in_progress", 1, 0, None)}


def test_json_records(spark, tmp_path):
    lines = [
        {"id": "a", "dense_values": [1, 2], "sparse_indices": [3, 5], "sparse_values": [0.5, 1], "metadata": {"n": 1}},
        {"id": "b", "sparse_indices": [1, 2], "sparse_values": [1]}, {"id": "c", "colour": 1}, {"document_id": "d"}, {"id": "e", "text": "t"}, {"id": "f", "sparse_values": [1]},
    ]
    (tmp_path / "r.json").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    rows = records.read_json(spark, f"file://{tmp_path}/r.json").collect()
    problems = {r["id"]: r["problem"] for r in rows if r["id"]}
    assert problems["a"] is None and problems["e"] is None and "differ" in problems["b"] and "colour" in problems["c"] and "differ" in problems["f"]
    assert sorted(r["problem"] for r in rows if r["id"] is None) == ["no id", "not a JSON object of these types"]
    a = next(r for r in rows if r["id"] == "a")
    assert [tuple(e) for e in a["sparse"]] == [(3, 0.5), (5, 1.0)] and a["metadata"] == {"n": "1"}
    assert records.read_json(spark, f"file://{tmp_path}/r.json", strict=False).where("id = 'c' AND problem IS NULL").count() == 1
    with pytest.raises(Exception, match="no id"):
        records.checked(records.read_json(spark, f"file://{tmp_path}/r.json").where("problem = 'no id'")).collect()


def test_stream_into_collection(spark, coll, tmp_path):
    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame([(i, None, [float(s), 0.0], None, None, None, op, s) for i, op, s in r], records.CHANGE)
    rows(("a", "upsert", 1), ("b", "upsert", 2)).write.parquet(f"file://{source}")
    run = lambda: ingest.into_collection(spark.readStream.schema(records.CHANGE).parquet(f"file://{source}"), coll, f"file://{tmp_path}/state", once=True).awaitTermination()
    run()
    assert set(state(coll.latest())) == {"a", "b"}
    rows(("a", "delete", 3), ("b", "upsert", 4)).write.mode("append").parquet(f"file://{source}")
    run()
    run()
    assert state(coll.latest()) == {"b": (4.0, 0.0)} and coll.current_version() == 2


def test_running_latest_state(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "upsert"), ("a", 5, "delete"), ("a", 3, "upsert"), ("b", 2, "upsert")], "id string, seq bigint, op string").write.parquet(f"file://{source}")
    stream = spark.readStream.schema("id string, seq bigint, op string").parquet(f"file://{source}")
    ingest.latest_per_key(stream).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    for _ in range(20):
        if spark.table("latest").count():
            break
        time.sleep(0.2)
    assert {tuple(r) for r in spark.table("latest").collect()} == {("a", 5, "delete", False), ("b", 2, "upsert", True)}


def test_two_writers_get_versions_of_their_own(spark, store, coll):
    one, two = store.get("things"), store.get("things")
    one._next_version()  # a writer that has claimed version 1 and hasn't written yet
    assert two.upsert(batch(spark, ("b", [2, 0], None))) == 2
    assert one.append(one.checked(batch(spark, ("a", [1, 0], None))), "implicit", version=1) == 1
    assert state(coll.latest()) == {"a": (1, 0), "b": (2, 0)} and coll.versions().count() == 2


def test_one_transaction_a_collection(spark, store, coll):
    one, two = store.get("things"), store.get("things")
    t = one.transaction()
    with pytest.raises(TransactionError):
        two.transaction()
    with pytest.raises(TransactionError):
        two.commit(t.id)
    t.abort()
    assert coll.transaction_status(t.id) == "aborted" and coll.open_transaction() is None
    lost = two.transaction()
    lost.insert(batch(spark, ("a", [1, 0], None)))
    assert coll.open_transaction() == lost.id
    coll.abort(lost.id)  # as after a crash of the process that opened it
    with pytest.raises(TransactionError):
        lost.commit()
    with coll.transaction() as u:
        u.insert(batch(spark, ("b", [1, 0], None)))
    assert state(coll.latest()) == {"b": (1, 0)} and coll.transaction_status(u.id) == "complete" and coll.transaction_status(lost.id) == "aborted"


def test_small_files_are_replaced_whole(coll):
    files = coll.store.files
    for text in ("one", "two"):
        files.write("note", text)
        assert files.read("note") == text
    assert files.claim("mine") and not files.claim("mine")


def test_metadata_is_checked_on_write_and_query(spark, store):
    declared = {"fields": [{"name": "age", "values": list(range(25, 50))}, {"name": "color", "values": ["red", "blue", "green"]}], "conditions": [{"op": "And", "fields": ["age", "color"]}, {"op": "Or", "fields": ["age", "color"]}]}
    coll = store.create(Collection("a", dimension=2, metadata_schema=declared))
    row = lambda i, meta: spark.createDataFrame([(i, None, [1.0, float(len(i))], None, None, meta)], records.RECORD)
    coll.upsert(row("x", {"age": "30", "color": "red"}).union(row("yy", {"age": "31"})).union(row("zzz", None)))
    for bad in ({"age": "50"}, {"color": "pink"}, {"size": "3"}):
        with pytest.raises(InvalidFieldValue):
            coll.upsert(row("w", bad))
    assert coll.latest().count() == 3
    found = lambda where: {r["id"] for r in coll.search_dense([1.0, 0.0], where=where).collect()}
    assert found(None) == {"x", "yy", "zzz"} and found(is_("age", 31)) == {"yy"} and found(and_(is_("age", 30), is_("color", "red"))) == {"x"}
    with pytest.raises(InvalidFieldValue):
        found(is_("color", "pink"))
    with pytest.raises(SearchError):
        found(is_("weight", 1))


@pytest.fixture(scope="module")
def many(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vecs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = docs.join(vecs, docs["doc_id"] == vecs["vec_id"], "left")
    dims = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.pmod(F.col("doc_id") * (i + 3), F.lit(40))).cast("bigint").alias("dim"), ((F.pmod(F.col("doc_id"), F.lit(7)) + i + 1) / 4).cast("float").alias("val")))
    return found.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("document_id"), F.col("embedding").alias("dense"), F.array_distinct(dims).alias("sparse"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata")).persist()


def test_searches_through_indexes_are_those_of_the_records(spark, store, many):
    langs = sorted(r[0] for r in many.select(F.col("metadata")["lang"]).distinct().collect())
    coll = store.create(Collection("all", dimension=64, sparse=True, text=True, metadata_schema={"fields": [{"name": "lang", "values": langs}]}))
    for kind in ("dense", "sparse", "tf_idf"):
        coll.create_index(kind, **({"quantization": 64} if kind == "sparse" else {}))
    assert coll.indexing() == "indexing in progress: dense, sparse, tf_idf" or all(coll.built(k) is None for k in coll.indexes())
    coll.upsert(many.where("CAST(id AS INT) < 20"))
    assert all(coll.built(k) is None for k in coll.indexes()), "there are fewer records than are sampled"
    coll.upsert(many.where("CAST(id AS INT) >= 20"))
    assert all(coll.built(k).version == 2 for k in coll.indexes()) and coll.indexing() is None
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(5)
    terms = spark.createDataFrame([(q, d, float(d % 3 + 1)) for q in range(5) for d in range(q, 40, 3)], "query_id bigint, dim bigint, q double")
    some = [list(r["dense"]) for r in many.where("dense IS NOT NULL").orderBy("id").limit(5).collect()]
    vectors = spark.createDataFrame([*enumerate(some)], "query_id bigint, query array<float>")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))

    def all_agree(records):
        english = records.where(F.col("metadata")["lang"] == langs[0])
        assert same(coll.batch_text(asked), bm25.search(records, asked))
        own = bm25.scores(records, asked).join(english.select("id"), "id", "left_semi")
        assert same(coll.batch_text(asked, where=is_("lang", langs[0])), bm25.best(own))
        assert same(coll.batch_sparse(terms), sparse.search(sparse.postings(records.where("sparse IS NOT NULL")), terms))
        assert coll.batch_sparse(terms, threshold=0.5).count() > 0
        assert same(coll.search_dense(some[0]), dense.search(records, some[0])), "ef_search candidates by codes hold the best"
        assert same(coll.search_dense(some[1], where=is_("lang", langs[0])), dense.search(english, some[1]))
        legs = [dense.batch_search(records, vectors, 30), bm25.search(records, asked, 30)]
        assert same(coll.batch_hybrid(dense=vectors, text=asked), fusion.fuse(legs))

    all_agree(coll.latest())
    plan = coll.batch_text(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (" in plan or "INSET" in plan, "the terms asked reach the scan"
    # changes that the indexes don't have yet
    coll.upsert(many.where("id = '3'").withColumn("text", F.lit("one two three")).withColumn("sparse", F.array(F.struct(F.lit(5).cast("bigint").alias("dim"), F.lit(9.5).cast("float").alias("val")))))
    coll.delete(spark.createDataFrame([("4",)], "id string"))
    assert coll.indexing() == "indexing in progress: dense, sparse, tf_idf"
    all_agree(coll.latest())
    with coll.transaction() as t:
        t.delete(spark.createDataFrame([("6",)], "id string"))
    assert coll.indexing() is None and all(coll.built(k).version == 5 for k in coll.indexes())
    all_agree(coll.latest())
    coll.delete_index("dense")
    assert coll.built("dense") is None and coll.search_dense(some[0]).count() == 10


@pytest.mark.parametrize("storage", ["binary", "octal", "f16", "f32"])
def test_dense_codes_of_each_storage(spark, store, many, storage):
    coll = store.create(Collection(storage, dimension=64))
    coll.create_index("dense", storage=storage)
    with coll.transaction() as t:
        t.insert(many.where("dense IS NOT NULL"))
    q = list(many.where("id = '1'").first()["dense"])
    got, want = ([r["id"] for r in f.orderBy(F.desc("score"), "id").collect()] for f in (coll.search_dense(q), dense.search(coll.latest(), q)))
    assert got[0] == want[0] and len(set(got) & set(want)) >= 9
