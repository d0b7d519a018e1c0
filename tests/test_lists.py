"""Searches a document at a time, against those by joins and groups of postings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import bm25, lists, sparse

from .conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(int(i * 37 % 2000), " ".join(rng.choice(words, int(rng.integers(1, 25))))) for i in range(120)]
    rows += [(5000 + i, rows[i][1]) for i in range(40)] + [(9000, None), (9001, ""), (9002, "the"), (9003, "Größe w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, f"w{i} w{i} w{i + 1} w{i + 2} größe") for i in range(12)] + [(50, "nowhere"), (51, ""), (52, None), (53, "w1 " * 9)]
    return spark.createDataFrame(rows, "query_id int, text string")


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    return lists.build(docs, f"file://{tmp_path_factory.mktemp('lists')}", stemming=False)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("asked", [1 << 20, 0])
@pytest.mark.parametrize("bucketed", [False, True])
def test_text(docs, queries, built, monkeypatch, bucketed, asked):
    monkeypatch.setattr(lists, "ASKED", asked)
    monkeypatch.setattr(lists, "QUERIES", 5)
    want = rows(bm25.best(bm25.scores(docs, queries, stemming=False), 7, bucketed))
    assert len(want) > 70 and rows(bm25.list_search(built, queries, 7, bucketed)) == want
    assert rows(bm25.search(docs, queries, 7, bucketed, stemming=False)) == want


@pytest.mark.parametrize("asked", [1 << 20, 0])
def test_sparse(spark, queries, built, monkeypatch, asked):
    monkeypatch.setattr(lists, "ASKED", asked)
    monkeypatch.setattr(lists, "QUERIES", 5)
    q = queries.select("query_id", F.explode(F.split("text", " ")).alias("dim")).groupBy("query_id", "dim").agg(F.count("*").cast("double").alias("q"))
    q = q.withColumn("q", F.when(F.col("dim") == "w3", -1.5).when(F.col("dim") == "w4", 0.0).otherwise(F.col("q")))
    p = sparse.with_codes(built.postings(spark).select(F.col("term").alias("dim"), "id", F.col("count").cast("double").alias("val")), 8.0, 6)
    assert rows(lists.search(built, q, 7)) == rows(sparse.search(p, q, 7)) != []
    for options in ({}, {"threshold": 0.25}, {"threshold": 0.1}, {"rerank": True}, {"rerank": True, "oversample": None}, {"threshold": 0.25, "rerank": True}):
        assert rows(lists.quantized_search(built, q, 7, 8.0, **options)) == rows(sparse.quantized_search(p, q, 7, 8.0, **options)) != [], options
    own = q.withColumn("threshold", F.when(F.col("query_id") % 2 == 0, 0.25))
    assert rows(lists.quantized_search(built, own, 7, 8.0)) == rows(sparse.quantized_search(p, own, 7, 8.0))


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red dog"), (2, "fox"), (None, "cat"), (3, ""), (3, None), (4, ""), (4, "")], "id bigint, text string")
    built = lists.build(docs, f"file://{tmp_path}", stemming=False)
    got = {r["id"]: (r["length"], dict(zip(r["terms"], r["counts"]))) for r in built.table(spark).collect()}
    assert got == {1: (4, {"red": 2, "fox": 1, "dog": 1}), 2: (1, {"fox": 1}), None: (1, {"cat": 1}), 3: (0, {}), 4: (0, {})}
    assert (built.n_docs, built.total) == (7, 6)


def test_slices_and_products_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(lists, "POSTINGS", 10)
    monkeypatch.setattr(lists, "CELLS", 12)
    assert list(lists._slices(np.array([3, 4, 4, 50, 0, 0, 1, 1]), 3)) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)] and list(lists._slices(np.array([], int), 3)) == []
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 5)) * (rng.random((9, 5)) < 0.4)
    right = rng.normal(size=(5, 4))
    row, col = np.nonzero(a)
    assert np.allclose(lists._products(row, col, a[row, col], 9, 5, right), a @ right)


def test_ties_beyond_k_go_to_the_smallest_ids_of_each_bucket():
    s = np.array([[1.0, 2.0, 2.0, 2.0, -np.inf, 2.0], [0.0, -np.inf, 0.0, 0.0, 3.0, 0.0]])
    least = np.full(2, -np.inf)
    assert [v.tolist() for v in lists._best(s, least, 2, None)] == [[0, 0, 1, 1], [1, 2, 4, 0]] and least.tolist() == [2.0, 0.0]
    least = np.full(2, -np.inf)
    assert [v.tolist() for v in lists._best(s, least, 2, np.array([0, 1, 1, 7, 1, 7]))] == [[0, 0, 1, 1], [1, 3, 4, 0]]


@pytest.mark.parametrize("name", "bm25_batch bm25_bucketed bm25_stemmed bm25_without_index sparse_batch sparse_quantized sparse_rerank sparse_rerank_whole".split())
def test_queries_join_no_postings(spark, name):
    """Documents by queries are never rows: neither joined nor grouped, and what leaves a task is k a query or 5 k."""
    from sparkseek.queries import queries

    found = queries()[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan and ("HashAggregate" not in plan or name == "bm25_bucketed")


def test_mean_length_and_upper_bound_write_no_sorted_postings(spark):
    from sparkseek import queries

    before = dict(queries._BUILT)
    plan = queries.mean_document_length(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert queries._BUILT == before and plan.count("FileScan") == 1 and "Join" not in plan
    plan = queries.sparse_upper_bound(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dim" not in plan and "terms" not in plan.partition("ReadSchema")[2]
