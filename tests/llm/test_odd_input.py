"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import bpe, exact_dedup, line_dedup, lm_scoring, mixing, pii, quality, simhash, substring_dedup, topk

from .common import CLASHING, odd_docs, odd_rows, prose


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return odd_docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, None, None), (2, 1, 1), (7, 0, 0), (9, 0, None), (None, 1, 0), (5, 1, 0), (999, 0, 0), (13, 1, 0), (13, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = sorted((i for i, _ in odd_rows()), key=lambda x: (x is None, x))


def test_exact_dedup(docs, nothing):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert ids(out) == [1, 3, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, None]
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_near_dedup(docs, nothing):
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    # 2 and 16 (in capitals) are copies of 1, 8 of 7; texts without words, null texts and null ids stay
    assert ids(out) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, None, None]
    assert simhash.near_dedup(nothing).collect() == []


def test_line_dedup(docs, nothing):
    out = line_dedup.line_dedup(docs, max_docs=1)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == docs.columns
    rows = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    assert rows[13]["text"] == prose(2, 60) and rows[14]["text"] == prose(4, 60)
    assert rows[1]["text"] == "" and rows[1]["n_dropped"] == 1
    assert rows[3]["text"] == "" and rows[3]["n_dropped"] == 0 and rows[5]["text"] is None and rows[5]["n_lines"] == 0
    assert ids(out) == ALL
    assert line_dedup.line_dedup(nothing).collect() == []


def test_substring_dedup(docs, nothing):
    out = substring_dedup.repeats(docs)
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["partner"]) for r in out.collect()}
    assert got == {(1, 0, 120, 16), (2, 0, 120, 1), (16, 0, 120, 1), (7, 0, 40_000, 8), (8, 0, 40_000, 7)}
    assert substring_dedup.repeats(nothing).collect() == []


def test_bpe(docs, nothing):
    out = bpe.encode(docs)
    assert [c for c in out.columns if c not in ("tokens", "n_tokens", "round_trip")] == docs.columns
    rows = out.collect()
    assert all(r["round_trip"] == (None if r["text"] is None else True) and (r["tokens"] is None) == (r["text"] is None) for r in rows)
    assert all(r["n_tokens"] == 0 and r["tokens"] == [] for r in rows if r["text"] == "")
    assert all(r["decoded"] == r["text"] for r in bpe.decode(out).collect())
    assert bpe.encode(nothing).collect() == [] and bpe.decode(bpe.encode(nothing)).collect() == []


def test_lm_scoring(docs, nothing):
    for limit in (lm_scoring.BROADCAST_BYTES, 0):
        out = lm_scoring.score(docs, broadcast_bytes=limit)
        assert [c for c in out.columns if c not in lm_scoring.NEW] == docs.columns
        assert ids(out) == ALL
        for r in out.collect():
            assert (r["log_prob"] is None) == (r["n_words"] == 0) == (r["total_log_prob"] is None)
        rows = {r["doc_id"]: r["n_words"] for r in out.where("doc_id is not null").collect()}
        assert rows[5] == rows[3] == rows[10] == 0 and rows[9] == 1 and rows[7] == 40_000
        assert lm_scoring.score(nothing, broadcast_bytes=limit).collect() == []


def test_pii(spark, docs, nothing):
    assert pii.identifiers(docs).collect() == [] and pii.identifiers(nothing).collect() == []
    rows = [(1, "mail a@b.org now"), (1, "mail a@b.org now"), (2, "mail c@d.org now"), (None, "mail e@f.org"), (None, None), (3, ""), (4, " \n"), (5, "x" * 60_000 + " g@h.org " + "y" * 60_000), (6, "mail Ann now"), (7, "é\nmail 😀 i@j.org")]
    out = pii.identifiers(odd_docs(spark, rows))
    assert out.columns == ["doc_id", "kind", "value", "start", "end", "score", "seed"]
    got = sorted((str(r["doc_id"]), r["value"], r["start"], r["end"], r["seed"]) for r in out.collect())
    assert got == sorted([("1", "a@b.org", 5, 12, True)] * 2 + [("2", "c@d.org", 5, 12, True), ("None", "e@f.org", 5, 12, True), ("5", "g@h.org", 60_001, 60_008, True), ("7", "i@j.org", 9, 16, True), ("6", "Ann", 5, 8, False)])


def test_quality(docs, nothing, labels):
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert [c for c in out.columns if c != "quality_score"] == docs.columns and ids(out) == ALL
    scores = {r["doc_id"]: r["quality_score"] for r in out.where("doc_id is not null").collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[3] == scores[4] == scores[5]
    none = quality.fit(docs, labels.limit(0))
    assert none is None and {r["quality_score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.quality_filter(docs.withColumn("quality_score", F.lit("kept")), labels).columns == [*docs.columns, "quality_score"]
    assert quality.quality_filter(nothing, labels).collect() == []


def test_mixing(docs, nothing, labels):
    out = mixing.mix_rates(docs, labels)
    assert ids(out) == ALL
    for r in out.collect():
        assert abs(sum(r["posteriors"]) - 1) < 1e-9 and r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    same = {(r["rate"], r["copies"]) for r in out.where("doc_id = 2").collect()}
    assert len(same) == 1
    assert mixing.mix_rates(docs, labels, repeat=True).columns == docs.columns
    assert mixing.mix_rates(nothing, labels).collect() == [] and mixing.mix_rates(docs, labels.limit(0)).count() == len(ALL)


def test_top_k(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [0.0, 0.0]), (7, [1.0, None])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    got = sorted(tuple(r) for r in topk.top_k(v, 2).collect())
    assert got == [(1, 1, 2, 0.0), (1, 1, 2, 0.0), (1, 2, 6, 0.0), (1, 2, 6, 0.0), (2, 1, 1, 0.0), (2, 2, 1, 0.0), (6, 1, 1, 0.0), (6, 2, 1, 0.0)]
    assert topk.top_k(v.limit(0)).collect() == []


def test_stages(spark, docs, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= 2 * start.count(), name
