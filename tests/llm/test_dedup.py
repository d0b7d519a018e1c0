import numpy as np
import pytest

from sparkseek.llm import base, exact_dedup, line_dedup, simhash, substring_dedup

from .common import connected, prose, repeated_passages


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def near_pairs(prints, radius):
    return [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius]


def test_carry_save_counters_find_what_counting_finds():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, (30, simhash.BITS // 64), dtype=np.uint64)
    prints = centre[rng.integers(0, 30, 400)]
    for row in prints:
        for _ in range(rng.integers(0, 70)):
            row[rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    for radius in (0, 1, 7, 8, 50, 63, 64):
        sizes = np.array([1, 130, 3, 66, 200])
        i, j = simhash.pairs_of_sets(prints, sizes, radius, most=500)
        begin, expected = 0, set()
        for s in sizes:
            expected |= {(a + begin, b + begin) for a, b in near_pairs(prints[begin : begin + s], radius)}
            begin += s
        assert set(zip(i.tolist(), j.tolist())) == expected
        for side in (np.zeros(400, np.int64), rng.integers(0, 2, 400)):
            a, b = simhash.links_of_sets(prints, sizes, side, radius)
            if side.any():  # each tile sends its own
                begin = 0
                for s in sizes:
                    for t in (0, 1):
                        if not len(own := begin + np.flatnonzero(side[begin : begin + s] == t)):
                            continue
                        x, y = simhash.links_of_sets(prints[own], np.array([len(own)]), np.zeros(len(own), np.int64), radius)
                        a, b = np.append(a, own[x]), np.append(b, own[y])
                    begin += s
            assert connected(range(400), zip(a.tolist(), b.tolist())) == connected(range(400), expected)


def test_bit_sliced_sums_give_the_majority():
    rng = np.random.default_rng(2)
    count = np.array([0, 1, 2, 5, 64, 1000, 0, 3])
    features = rng.integers(0, 1 << 63, (count.sum(), 4), dtype=np.uint64)
    got, at = simhash.majority(features, count), 0
    for i, n in enumerate(count):
        bits = np.unpackbits(features[at : at + n].view(np.uint8).reshape(n, 32), axis=1, bitorder="little").sum(0) * 2 > n
        assert (np.packbits(bits, bitorder="little").view(np.uint64) == got[i]).all()
        at += n


def test_near_groups_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    import pyarrow as pa

    prints, _, count = simhash.fingerprints(pa.array([r["text"] for r in rows]))
    some = [i for i in range(len(rows)) if count[i]]
    pairs = [(rows[some[a]]["doc_id"], rows[some[b]]["doc_id"]) for a, b in near_pairs(prints[some], simhash.RADIUS)]
    group = {r["node"]: r["component"] for r in simhash.near_groups(docs).collect()}
    found = [p for p in pairs if group.get(p[0], p[0]) == group.get(p[1], p[1])]
    assert len(pairs) > 50 and len(found) >= 0.99 * len(pairs)
    every = connected([r["doc_id"] for r in rows], pairs)
    assert all(every[n] == every[c] for n, c in group.items()), "no one is joined with who isn't near"
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == {r["doc_id"] for r in rows if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"]}


def test_edited_copies_are_found_and_strangers_stay(spark):
    rows = []
    for i in range(40):
        words = prose(i, 200).split()
        rows.append((i, " ".join(words)))
        for at in range(i % 7, 200, 20):
            words[at] = f"new{i}{at}"
        rows.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == list(range(40))


def test_large_sets_are_cut_into_tiles_and_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    words = prose(5, 150).split()
    rows = [(i, " ".join([*words[: i % 100], f"w{i}", *words[i % 100 :]])) for i in range(60)]
    rows += [(1000 + i, " ".join([*words[:20], *prose(i, 100).split()])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    import pyarrow as pa

    prints, _, _ = simhash.fingerprints(pa.array([t for _, t in rows]))
    expected = connected(range(len(rows)), near_pairs(prints, simhash.RADIUS))
    assert sum(g == 0 for g in expected.values()) == 60 and len(set(expected.values())) > 20
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == sorted(rows[g][0] for g in set(expected.values()))


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1050)]
    got = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    links = [link for link in links if link[0] != link[1]]
    nodes = {n for link in links for n in link}
    assert got == connected(nodes, links)


def test_index_of_several_runs_keeps_the_smallest_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 2)
    index = exact_dedup.LsmIndex(spark, f"file://{tmp_path}/index")
    for rows in ([("x", 5), ("y", 3)], [("x", 2), ("x", 9), ("w", None)], [("z", 1)]):
        index.flush(spark.createDataFrame(rows, "text string, id bigint").coalesce(1).select(exact_dedup.digest("text").alias("digest"), "id"))
    assert index.runs == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert sorted((str(r["id"]), r["n"]) for r in index.read().collect()) == [("1", 1), ("2", 2), ("3", 1), ("5", 1), ("None", 1)]
    import hashlib

    of = lambda t: hashlib.md5(t.encode()).digest()
    assert [(r["id"], r["n"]) for r in index.find([of("x"), of("no")]).collect()] == [(2, 3)]
    index.compact()
    assert index.runs == [(1, 3, 1)] and sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run")) == ["run-1-3-1"]
    assert sorted((str(r["id"]), r["n"]) for r in index.read().collect()) == [("1", 1), ("2", 3), ("3", 1), ("None", 1)]
    assert exact_dedup.LsmIndex(spark, f"file://{tmp_path}/index").runs == [(1, 3, 1)]
    ask = spark.createDataFrame([("x",), ("no",), ("z",)], "text string").select(exact_dedup.digest("text").alias("digest"))
    assert {bytes(r["digest"]) for r in index.known(ask, (1, 3, 1)).collect()} == {of("x"), of("z")}
    words = index.filter_of((1, 3, 1))
    assert sorted(r[0] for r in ask.select(base.may_hold(spark, words)(exact_dedup.key_of("digest"))).collect()) == [False, True, True]


@pytest.mark.parametrize("size", [32 << 20, 8])
def test_batches_give_what_one_batch_gives(spark, docs, tmp_path, monkeypatch, size):
    monkeypatch.setattr(base, "FILTER_BYTES", size)  # a filter that is too small passes all, and loses nothing
    index = exact_dedup.LsmIndex(spark, f"file://{tmp_path}/index")
    ranked = docs.orderBy("doc_id").collect()
    got = []
    for i in range(0, 5):
        part = spark.createDataFrame(ranked[i * len(ranked) // 5 : (i + 1) * len(ranked) // 5], docs.schema)
        got += [r["doc_id"] for r in exact_dedup.exact_dedup(part, index=index).collect()]
        index = exact_dedup.LsmIndex(spark, f"file://{tmp_path}/index")  # opened again
    assert sorted(got) == sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect())
    seen = {}
    for r in ranked:
        seen.setdefault(r["text"], r["doc_id"])
    assert sorted(got) == sorted(seen.values()) and len(got) < len(ranked)


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), ("c", "u")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect()) == ["a", "c"]


@pytest.mark.parametrize("shared", [False, True])
def test_hits_are_verified_by_their_bytes(spark, monkeypatch, tmp_path, shared):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.when(text.isNotNull(), F.unhex(F.lit("00"))))
    index = exact_dedup.LsmIndex(spark, f"file://{tmp_path}/index") if shared else None
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs, index=index).collect()) == [1, 2, 4]
    if shared:
        more = spark.createDataFrame([(5, "b"), (6, "c"), (7, "c"), (8, None)], "doc_id bigint, text string")
        assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(more, index=index).collect()) == [6, 8]


def test_shared_lines(spark):
    rows = [(i, f"Shared  LINE\nown {i}\n\nshared line") for i in range(4)] + [(9, "own 9\nrare")]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), max_docs=3).collect()}
    assert out[0]["text"] == "own 0\n" and out[0]["n_lines"] == 4 and out[0]["n_dropped"] == 2
    assert out[9]["text"] == "own 9\nrare"


def test_words_of_other_scripts():
    import pyarrow as pa

    from .common import lower, words

    texts = ["МИР мир", "beta—gamma", "日本語。中文 字x", "Straße ÀÉ Œœ É", "हिन्दी भाषा", "", "a", "İx ẞß Ωω 한국어", "ไทย x", "_a1 b😀c", "A\u0301e", "ﬁ Ǆǆ Ⅷ ½", "x" * 70_000 + " Ж" * 70_000]
    data, off = base.text_buffer(pa.array(texts))
    h, start, end, first = base.words(data, off)
    of = {}
    for i, t in enumerate(texts):
        own = words(t)
        assert [data[a:b].tobytes().decode() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] == [t[a:b] for _, a, b in own]
        for w, x in zip(own, h[first[i] : first[i + 1]].tolist()):
            assert of.setdefault(w[0], x) == x, "the same word in lower case has the same hash"
    assert len(set(of.values())) == len(of)


def test_passages_of_other_scripts(spark):
    rng = np.random.default_rng(9)
    han = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 120))
    cyrillic = " ".join("".join(chr(c) for c in rng.integers(0x430, 0x450, 5)) for _ in range(60))
    rows = [(1, f"前書き。{han[:60]}。{han[60:]} one"), (2, f"two — {han}"), (3, f"a—{cyrillic}—b"), (4, f"c {cyrillic.upper()} d"), (5, "x")]
    got = {r["doc_id"]: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r["n_words"] for i, r in got.items()} == {1: 120, 2: 120, 3: 60, 4: 60}
    assert {i: r["partner"] for i, r in got.items()} == {1: 2, 2: 1, 3: 4, 4: 3}


def test_ids_with_several_texts_keep_their_passages(spark):
    one, two = prose(701, 80), prose(702, 80)
    rows = [(1, one), (2, one), (2, f"{two} {prose(703, 20)}"), (3, f"{prose(704, 20)} {two}"), (3, f"{prose(704, 20)} {two}")]
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["partner"]) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 0, 80, 2), (2, 0, 80, 1), (2, 0, 80, 3), (3, 20, 80, 2)}


@pytest.mark.parametrize("hot", [1 << 16, 2])
@pytest.mark.parametrize("least", [50, 7])
def test_passages_against_all_windows(spark, docs, least, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {tuple(r)[:5] for r in substring_dedup.repeats(docs, least).collect()}
    assert got == repeated_passages(texts, least) and got


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_pieces_tell_all_partners_and_where_they_change(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    one, two, three = (prose(i, 80) for i in (501, 502, 503))
    alone = lambda i: prose(600 + i, 30)
    texts = {1: f"{alone(1)} {one} {alone(2)}", 2: f"{alone(3)} {one} {alone(4)}", 3: f"{alone(5)} {one} {alone(6)}", 4: f"{alone(7)} {two} {three}", 5: f"{alone(8)} {two} {alone(9)}", 6: f"{alone(10)} {three} {alone(11)}"}
    # 4 has passages of 5 and 6 that overlap by all but a word, so that they make one run
    w = texts[4].split()
    texts[6] = f"{alone(10)} {' '.join(w[110 - 49 : 190])} {alone(11)}"
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    of = {}
    for r in substring_dedup.repeats(docs).collect():
        for p in r["pieces"]:
            of.setdefault(p["group"], {})[r["doc_id"]] = (p["start_word"], p["n_words"])
    assert {tuple(sorted(g)) for g in of.values()} == {(1, 2, 3), (4, 5), (4, 6)}
    for g in of.values():
        assert len({" ".join(texts[i].split()[a : a + n]) for i, (a, n) in g.items()}) == 1
    ends = {tuple(sorted(g)): g[4] for g in of.values() if 4 in g}
    assert ends[4, 5][0] == 30 and sum(ends[4, 6]) == 190


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(4)
    first = np.array([0, 30, 31, 400, 449, 499, 600])
    h = base.mix(rng.integers(0, 3, 600).astype(np.uint64))
    place, key = substring_dedup.winnow(h, first, 50)
    k = substring_dedup.anchor_words(50)
    assert (substring_dedup.rolling(h, k)[place] == key).all()
    for a, b in zip(first, first[1:]):
        for start in range(a, b - 50 + 1):
            assert ((place >= start) & (place + k <= start + 50)).any()
        assert not ((place >= a) & (place < b) & (place + k > b)).any()
    assert not ((place >= 400) & (place < 449)).any(), "49 words have no passage of 50"
