import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.errors import DimensionMismatch, SearchError
from sparkseek.functions.filters import is_
from sparkseek.operators import ann, bm25, dense, fusion, lookup, sparse


@pytest.fixture(scope="module")
def vectors():
    return np.round(np.random.default_rng(1).normal(size=(120, 8)), 3)


@pytest.fixture(scope="module")
def records(spark, vectors):
    rows = [(f"r{i:03d}", [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [("null", None, 0), ("short", [1.0], 0), ("zero", [0.0] * 8, 0)]
    return spark.createDataFrame(rows, "id string, dense array<double>, label int").repartition(3)


def cosines(vectors, q):
    return np.round(vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q), 6)


def best(scores, k, way=-1):
    return sorted(range(len(scores)), key=lambda i: (way * scores[i], i))[:k]


def test_search_by_each_metric(records, vectors):
    q = [float(x) for x in vectors[5]]
    for metric, scores, way in (
        ("cosine", cosines(vectors, vectors[5]), -1),
        ("dotproduct", np.round(vectors @ vectors[5], 6), -1),
        ("euclidean", np.round(np.linalg.norm(vectors - vectors[5], axis=1), 6), 1),
    ):
        some = records.where("id like 'r%'")
        assert [r["id"] for r in dense.search(some, q, 7, metric).collect()] == [f"r{i:03d}" for i in best(scores, 7, way)]
    got = dense.search(records, q, 200).collect()
    assert len(got) == 120, "null, short and zero vectors have no cosine"
    assert [r["label"] for r in dense.search(records, q, 5, where=is_("label", 1), return_cols=("label",)).collect()] == [1] * 5
    by_dot = dense.search(records, q, 3, "dotproduct", final_score="cosine").collect()
    assert all(-1 <= r["score"] <= 1 for r in by_dot)
    with pytest.raises(SearchError):
        dense.search(records, q, metric="none")
    with pytest.raises(DimensionMismatch):
        dense.search(records, [])


def test_batches_agree_with_single_searches(spark, records, vectors):
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(4)], "query_id int, query array<double>")
    for metric in ("cosine", "dotproduct", "euclidean"):
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in dense.batch_search(records.where("id like 'r%'"), queries, 5, metric).collect()}
        for i in range(4):
            one = [(r["id"], r["score"]) for r in dense.search(records.where("id like 'r%'"), [float(x) for x in vectors[i]], 5, metric).collect()]
            assert [got[(i, k + 1)] for k in range(5)] == one
    assert dense.batch_search(records.limit(0), queries).collect() == [] and dense.batch_search(records, queries.limit(0)).collect() == []


def test_large_query_tables_are_joined(spark, records, vectors, monkeypatch):
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(3)], "query_id int, query array<double>")
    few = sorted(map(tuple, dense.batch_search(records, queries, 5).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 0)
    assert sorted(map(tuple, dense.batch_search(records, queries, 5).collect())) == few


def test_neighbours(records, vectors):
    got = [r["id"] for r in dense.neighbours(records, "r007", 4).collect()]
    assert got == [f"r{i:03d}" for i in best(cosines(vectors, vectors[7]), 5) if i != 7][:4]


def test_quantised_search_is_reranked_exactly(records, vectors):
    q = [float(x) for x in vectors[3]]
    got = dense.quantized_search(records.where("id like 'r%'"), q, 5, -4.0, 4.0).collect()
    assert [r["id"] for r in got] == [f"r{i:03d}" for i in best(cosines(vectors, vectors[3]), 5)]


def test_dimension_check(records):
    with pytest.raises(Exception, match="vector of other than 8 dimensions"):
        dense.check_dimension(records.withColumn("dense", F.col("dense").cast("array<float>")), "dense", 8).collect()


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 16)) * 4
    x = centres[rng.integers(0, 10, 600)] + rng.normal(size=(600, 16))
    records = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, dense array<double>").cache()
    index = ann.ClusterIndex.fit(records, 10)
    assigned = index.assign(records).cache()
    hits = 0
    for i in range(6):
        exact = {r["id"] for r in dense.search(records, [float(a) for a in x[i]], 5).collect()}
        hits += len(exact & {r["id"] for r in index.search(assigned, [float(a) for a in x[i]], 5, probes=3).collect()})
    assert hits >= 27
    assert ann.projection_search(records, [float(a) for a in x[0]], 3, width=8.0).first()["id"] == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_registered_clusters_against_brute_force(spark, sf, monkeypatch):
    """The lists that dense_topk_clusters reads, with every record as the query."""
    from sparkseek import queries

    seen = {}

    def search(index, assigned, query, k=10, probes=3, **options):
        seen.update(index=index, k=k, probes=probes)
        return assigned

    monkeypatch.setattr(ann.ClusterIndex, "search", search)
    rows = queries.dense_topk_clusters(spark, f"/root/testdata/{sf}").collect()
    x, cluster = np.array([r["dense"] for r in rows], float), np.array([r["cluster"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = np.argsort(-np.round(unit @ unit.T, 6), axis=1, kind="stable")[:, : seen["k"]]
    recall = np.mean([np.isin(cluster[exact[i]], seen["index"].probed(x[i], seen["probes"])).mean() for i in range(len(x))])
    assert recall >= 0.9, (recall, seen["probes"])
    print("recall", sf, recall, seen["probes"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_registered_product_codes_against_brute_force(spark, sf, monkeypatch):
    """The candidates that product_quantized_topk re-ranks, with every record as the query, and its rows for its own."""
    from sparkseek import queries
    from sparkseek.functions.quantize import ProductQuantizer

    v = queries._vectors(spark, f"/root/testdata/{sf}").collect()
    ids, x = np.array([r["id"] for r in v]), np.array([r["dense"] for r in v], float)
    exact = np.argsort(-np.round(x @ x.T, 6), axis=1, kind="stable")[:, :10]
    got = {r["id"] for r in queries.product_quantized_topk(spark, f"/root/testdata/{sf}").collect()}
    own = np.flatnonzero(ids == 0)[0]
    seen = {}

    def search(pq, encoded, query, k=10, candidates=10, **options):
        seen.update(pq=pq, candidates=candidates)
        return encoded

    monkeypatch.setattr(ProductQuantizer, "search", search, raising=False)
    codes = np.array([r["codes"] for r in queries.product_quantized_topk(spark, f"/root/testdata/{sf}").collect()])
    near = sum((x[:, i * 8 : i * 8 + 8] @ b.T)[:, codes[:, i]] for i, b in enumerate(seen["pq"].codebooks))
    some = np.argsort(-np.round(near, 6), axis=1, kind="stable")[:, : seen["candidates"]]
    recall = np.mean([np.isin(exact[i], some[i]).mean() for i in range(len(x))])
    print("recall", sf, recall, seen["candidates"], np.mean([np.isin(exact[i], some[i][:10]).mean() for i in range(len(x))]))
    assert recall >= 0.9 and len(got & set(ids[exact[own]].tolist())) >= 8


def test_sparse_search(spark):
    rng = np.random.default_rng(3)
    table = {(d, f"i{i}"): float(rng.integers(1, 9)) / 2 for i in range(40) for d in rng.choice(20, 6, replace=False).tolist()}
    postings = spark.createDataFrame([(d, i, v) for (d, i), v in table.items()], "dim bigint, id string, val double")
    query = [(1, 0.5), (2, 2.0), (3, 4.0), (19, 1.0)]
    exact = {}
    for d, q in query:
        for i in range(40):
            if (d, f"i{i}") in table:
                exact[f"i{i}"] = exact.get(f"i{i}", 0) + q * table[(d, f"i{i}")]
    want = sorted(exact.items(), key=lambda e: (-round(e[1], 6), e[0]))[:8]
    q = sparse.query_table(spark, query)
    assert [(r["id"], r["score"]) for r in sparse.search(postings, q, 8).collect()] == want
    code = lambda v: int(max(0, min(63, v / 5 * 63)))
    coded = sparse.with_codes(postings, 5.0, 6)
    for threshold in (None, 0.0, 0.3):
        low, cut = (0, 0) if threshold is None else (int(threshold * 64), int(min(64 * threshold, 255)))
        sums = {}
        for d, v in query:
            for i in range(40):
                if (d, f"i{i}") in table and (threshold is None or code(v) > low or code(table[(d, f"i{i}")]) >= cut):
                    sums[f"i{i}"] = sums.get(f"i{i}", 0) + code(v) * code(table[(d, f"i{i}")])
        got = sparse.quantized_search(coded, q, 8, 5.0, 6, threshold).collect()
        assert [(r["id"], r["score"]) for r in got] == sorted(sums.items(), key=lambda e: (-e[1], e[0]))[:8]
    own = q.withColumn("threshold", F.lit(0.3))
    assert sparse.quantized_search(coded, own, 8, 5.0, 6).collect() == sparse.quantized_search(coded, q, 8, 5.0, 6, 0.3).collect()
    reranked = [(r["id"], r["score"]) for r in sparse.quantized_search(coded, q, 8, 5.0, 6, rerank=True).collect()]
    assert reranked == want
    records = spark.createDataFrame([("a", [(1, 2.0), (3, 1.0)]), ("b", None)], "id string, sparse array<struct<dim:bigint,val:float>>")
    assert sorted(map(tuple, sparse.postings(records).collect())) == [(1, "a", 2.0), (3, "a", 1.0)]


def test_clipped_codes_lose_nothing_that_is_reranked(spark):
    """Values far above the upper bound, and below 0: more than the candidates of an oversample saturate alike."""
    rng = np.random.default_rng(8)
    table = {(d, i): float(rng.integers(-5, 90)) for i in range(200) for d in range(4)}
    postings = spark.createDataFrame([(d, i, v) for (d, i), v in table.items()], "dim bigint, id bigint, val double")
    queries = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 2, 1.5), (1, 3, -1.0)], "query_id bigint, dim bigint, q double")
    coded = sparse.with_codes(postings, 8.0, 6)
    exact = sorted(map(tuple, sparse.search(postings, queries).collect()))
    assert sorted(map(tuple, sparse.quantized_search(coded, queries, 10, 8.0, rerank=True, oversample=None).collect())) == exact
    assert sorted(map(tuple, sparse.quantized_search(coded, queries, 10, 8.0, rerank=True).collect())) != exact
    with pytest.raises(SearchError):
        sparse.quantized_search(coded, queries, 10, 8.0, threshold=0.2, rerank=True, oversample=None)


def test_sparse_rerank_whole_has_the_exact_rows_at_scale(spark):
    """On sf0.1, against the SQL of the exact scores."""
    import duckdb

    from sparkseek import queries

    at, c = "/root/testdata/sf0.1", duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    want = {(r[0], r[2]) for r in c.sql(queries.oracle_sql()["sparse_batch"]).fetchall()}
    got = {(r["query_id"], r["id"]) for r in queries.sparse_rerank_whole(spark, at).collect()}
    assert len(got & want) == len(want)


def test_bm25(spark):
    import math

    docs = spark.createDataFrame([(1, "red fox red"), (2, "red dog and the cat"), (513, "blue fox"), (4, ""), (5, None)], "id bigint, text string")
    queries = spark.createDataFrame([(0, "red red fox")], "query_id bigint, text string")
    terms = {1: ["red", "fox", "red"], 2: ["red", "dog", "cat"], 513: ["blue", "fox"], 4: []}
    avg = sum(map(len, terms.values())) / 4

    def score(i):
        total = 0
        for t in ("red", "fox"):
            c, df = terms[i].count(t), sum(t in w for w in terms.values())
            if c:
                total += c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(terms[i]) / avg)) * math.log(1 + (4 - df + 0.5) / (df + 0.5))
        return round(total, 6)

    hits = bm25.search(docs, queries, stemming=False)
    got = dict(map(tuple, hits.select("id", "score").collect()))
    assert got == {i: score(i) for i in (1, 2, 513)}
    assert {r["id"] for r in bm25.search(docs, queries, bucketed=True, stemming=False).collect()} == {1, 2}, "1 and 513 share a bucket"
    fixed = dict(map(tuple, bm25.search(docs, queries, stemming=False, avgdl=1.0).select("id", "score").collect()))
    assert fixed[1] < got[1]


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(ids)], "query_id int, rank int, id string")
    a, b = leg("xyz"), leg("yw")
    got = fusion.fuse([a, b]).collect()
    assert [r["id"] for r in got] == ["y", "x", "w", "z"]
    assert got[0]["score"] == round(1 / (61 + fusion.EPSILON) + 1 / (60 + fusion.EPSILON), 9)
    assert got == fusion.fuse([b, a]).collect(), "legs are alike"
    assert len(fusion.fuse([a, b], 2).collect()) == 2 and len(fusion.fuse([a, b], 2, truncate=False).collect()) == 4
    with pytest.raises(SearchError):
        fusion.fuse([a])
    hits = spark.createDataFrame([("p", 0.5), ("q", 0.9), ("o", 0.5)], "id string, score double")
    assert [r["id"] for r in fusion.as_leg(hits).orderBy("rank").collect()] == ["q", "o", "p"]


def test_lookup(spark):
    records = spark.createDataFrame([("a", "d1", "text a"), ("b", "d1", "text b"), ("c", None, None)], "id string, document_id string, text string")
    assert lookup.by_id(records, "b").count() == 1 and lookup.by_document(records, "d1").count() == 2
    asked = spark.createDataFrame([("a",), ("z",), (None,)], "id string")
    assert {r["id"]: r["present"] for r in lookup.exists(records, asked).collect()} == {"a": True, "z": False, None: False}
    hits = spark.createDataFrame([("a", 1.0)], "id string, score double")
    assert lookup.with_records(hits, records).first()["text"] is None and lookup.with_records(hits, records, text=True).first()["text"] == "text a"


def test_filters_and_columns_reach_the_scan(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")
    plan = dense.search(v, [0.1] * 64, where=is_("label", 3))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    plan = bm25.term_table(docs, stemming=False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_stemmed_search_against_plain_loops(spark, sf):
    import math
    from collections import Counter

    import regex

    from sparkseek.functions.stemmer import stem
    from sparkseek.functions.text import STOP_WORDS
    from sparkseek.queries import queries

    def terms(text):
        return [stem(w.lower()) for w in regex.findall(r"[\p{L}\p{N}_]+", text) if len(w.encode()) <= 40 and w.lower() not in STOP_WORDS]

    docs = {r["doc_id"]: Counter(terms(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] is not None}
    df = Counter(w for c in docs.values() for w in c)
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    got = {}
    for r in queries()["bm25_stemmed"](spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    asked = {r["item_id"]: set(terms(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    checked = 0
    for q, words in asked.items():
        scores = {}
        for i, c in docs.items():
            n = sum(c.values())
            s = [c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in words if c[w]]
            if s:
                scores[i] = round(sum(s), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [got[q][r + 1][1] for r in range(len(best))] == pytest.approx([x for _, x in best], abs=2e-6)
        checked += len(best)
    assert checked > 50


def test_matched_batches_are_products_of_blocks(spark, monkeypatch):
    """Each query among the records of its own label, in blocks of a few rows, with ties and copies; not pair by pair in the JVM."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[100:150] = x[:50]
    label = [None if i % 50 == 7 else int(i % 4) for i in range(300)]
    table = spark.createDataFrame([(i, v.tolist(), n) for i, (v, n) in enumerate(zip(x, label))] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0], 1), (903, [float("nan")] * 8, 1)], "id int, dense array<double>, label int")
    asked = table.select(F.col("id").alias("query_id"), F.col("dense").alias("query"), F.col("label").alias("own"))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 20 * 64)
    monkeypatch.setattr(dense, "SCORES", 100)
    for metric, exclude in (("cosine", False), ("dotproduct", True)):
        found = dense.batch_search(table, asked, 5, metric, match=("label", "own"), exclude_self=exclude)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "zip_with" not in plan
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for i in range(300):
            among = [j for j in range(300) if label[i] is not None and label[j] == label[i] and not (exclude and j == i)]
            s = np.round(x[among] @ x[i] / (np.linalg.norm(x[among], axis=1) * np.linalg.norm(x[i]) if metric == "cosine" else 1), 6) + 0.0
            want = sorted(zip(among, s.tolist()), key=lambda e: (-e[1], e[0]))
            if metric == "dotproduct" and label[i] == 1:
                want = sorted([*want, (901, 0.0)], key=lambda e: (-e[1], e[0]))
            assert [(n, j) for n, j, _ in sorted(got.get(i, []))] == [(n + 1, j) for n, (j, _) in enumerate(want[:5])]
        assert 903 not in got and 900 not in got


def test_single_precision_leaves_nothing_out():
    """The kernel against plain doubles, where scores are close, large, tied or few."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    for x in (base + rng.normal(size=(3000, 16)) * 1e-6, rng.normal(size=(3000, 16)) * 1e12, np.round(rng.normal(size=(3000, 16))), rng.normal(size=(7, 16)), np.zeros((40, 16))):
        q = np.concatenate([x[:20], rng.normal(size=(5, 16)), np.zeros((1, 16))])
        for metric in ("cosine", "dotproduct"):
            got = {}
            for b in dense._best(pa.array(range(len(q))), q, pa.array(range(len(x))), x, metric, 10):
                for r in b.to_pylist():
                    got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
            for i, v in enumerate(q):
                with np.errstate(all="ignore"):
                    s = np.einsum("j,ij->i", v, x) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v) if metric == "cosine" else 1)
                s = np.round(s, 6) + 0.0
                want = sorted(((j, e) for j, e in enumerate(s.tolist()) if np.isfinite(e)), key=lambda e: (-e[1], e[0]))[:10]
                assert [e for _, e in got.get(i, [])] == pytest.approx([e for _, e in want], abs=2e-6, rel=1e-12)
