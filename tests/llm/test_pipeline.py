import corpus_pipeline

from sparkseek.llm import bpe


def test_stages_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= kept and (i == 4 or docs.columns == columns), name
        kept = now
    assert all(r["round_trip"] for r in docs.collect())
    whole = {(r["doc_id"], tuple(r["tokens"])) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r["doc_id"], tuple(r["tokens"])) for r in docs.collect()}


def test_clean_documents_stay(spark, sf):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0 and i in texts}
    good = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, sf).collect()}
    mixed = {r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, sf).collect()}
    assert len(clean & good) >= 0.95 * len(clean) and len(clean & mixed) >= 0.95 * len(clean)
    assert bpe.VOCABULARY.startswith("/opt/tokenizers")


def test_clean_documents_stay_where_toxic_ones_are_few(spark, tmp_path):
    words = {"clean": "river stone garden window paper morning travel", "toxic": "vile scum filth wretch curse spite venom", "junk": "click buy now free offer win deal"}
    domains = ["toxic" if i % 100 == 0 else "junk" if i % 10 == 1 else "clean" for i in range(1000)]
    rows = [(i, " ".join(w for k in range(6) for w in words[d].split()[(i + k) % 7 :]) + f" n{i}") for i, d in enumerate(domains)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.createDataFrame([(i, int(d != "junk"), int(d == "toxic")) for i, d in enumerate(domains)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = [r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).collect()]
    clean, toxic = ({i for i, d in enumerate(domains) if d == k} for k in ("clean", "toxic"))
    assert len(clean & set(mixed)) >= 0.95 * len(clean)
    assert sum(i in clean for i in mixed) <= 1.1 * len(clean), "and come about once"
    assert toxic <= set(mixed) and sum(i in toxic for i in mixed) <= 5 * len(toxic)
    assert sum(domains[i] == "junk" for i in mixed) < 0.1 * 100
