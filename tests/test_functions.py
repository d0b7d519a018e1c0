import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.errors import InvalidFieldValue, SearchError, UndeclaredCombination
from sparkseek.functions import filters, quantize, stemmer, text, vectors
from sparkseek.functions.filters import Field, MetadataSchema, Predicate, and_, is_, or_, parse_filter


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 17)], [float(x) for x in rng.uniform(-1, 1, 17)]) for i in range(20)]
    rows += [(20, [0.0] * 17, [1.0] * 17), (21, None, [1.0] * 17), (22, [1.0], [1.0, 2.0]), (23, [], [])]
    return spark.createDataFrame(rows, "i int, a array<float>, b array<float>")


def test_kernels(pairs):
    a, b = F.col("a"), F.col("b")
    half = lambda x: np.asarray(x, np.float16).astype(float)
    out = pairs.select("*", vectors.dot(a, b).alias("dot"), vectors.cosine(a, b).alias("cos"), vectors.euclidean(a, b).alias("l2"), vectors.half_dot(a, b).alias("hd"), vectors.half_euclidean(a, b).alias("hl"), vectors.half_hamming(a, b).alias("hh"), vectors.vector_sha256(a).alias("sha"))
    for r in out.collect():
        if r["i"] < 20:
            x, y = np.float32(r["a"]).astype(float), np.float32(r["b"]).astype(float)
            assert math.isclose(r["dot"], x @ y, abs_tol=1e-12) and math.isclose(r["l2"], np.linalg.norm(x - y), abs_tol=1e-12)
            assert math.isclose(r["cos"], x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs_tol=1e-12)
            assert math.isclose(r["hd"], half(x) @ half(y), abs_tol=1e-12) and math.isclose(r["hl"], np.linalg.norm(half(x) - half(y)), abs_tol=1e-12)
            assert r["hh"] == sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(np.float16(x).view(np.uint16), np.float16(y).view(np.uint16)))
            assert r["sha"] == hashlib.sha256(struct.pack("<17f", *x)).hexdigest()
        elif r["i"] == 20:
            assert r["cos"] is None and r["dot"] == 0
        elif r["i"] in (21, 22):
            assert r["dot"] is None and r["cos"] is None and r["l2"] is None and r["hd"] is None


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_bit_planes(pairs, bits):
    a, b = (quantize.subbyte_codes(F.col(c), bits) for c in "ab")
    pa, pb = quantize.bit_planes(a, bits), quantize.bit_planes(b, bits)
    out = pairs.where("i < 20").select(a.alias("ca"), b.alias("cb"), pa.alias("pa"), vectors.plane_dot(pa, pb, bits).alias("dot"), vectors.plane_dot(pa, pb, bits, "least_first").alias("swapped"), vectors.plane_hamming(pa, pb, bits).alias("ham"))
    for r in out.collect():
        x, y = np.array(r["ca"]), np.array(r["cb"])
        assert r["dot"] == x @ y and r["ham"] == sum(bin(p ^ q).count("1") for p, q in zip(x, y))
        turn = lambda v: sum((v >> i & 1) << (bits - 1 - i) for i in range(bits))
        assert r["swapped"] == turn(x) @ turn(y)
        assert (np.unpackbits(np.array(r["pa"][0], np.uint8))[:17] == x >> (bits - 1)).all()


def test_hamming_of_other_lengths_is_infinite(spark):
    row = spark.range(1).select(vectors.hamming(F.array(F.lit(255), F.lit(0)), F.array(F.lit(0), F.lit(1))).alias("x"), vectors.hamming(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("y")).first()
    assert row["x"] == 9 and row["y"] == float("inf")


def test_codes(spark):
    v = spark.createDataFrame([([-2.0, -1.0, 0.0, 0.5, 1.0, 2.0],)], "v array<double>")
    row = v.select(quantize.u8_codes(F.col("v")).alias("u"), quantize.subbyte_codes(F.col("v"), 2).alias("s"), quantize.subbyte_codes(F.col("v"), 2, clamp_top=False).alias("o"), quantize.half_values(F.col("v")).alias("h")).first()
    assert row["u"] == [0, 0, 127, 191, 255, 255] and row["s"] == [0, 0, 2, 3, 3, 3]
    assert row["o"][4] == 0, "1.0 overflows without clamping"
    assert row["h"] == [-2.0, -1.0, 0.0, 0.5, 1.0, 2.0]
    s = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (9.0,), (-1.0,)], "val double").select(quantize.sparse_code(F.col("val"), 5.0, 6).alias("c"))
    assert [r["c"] for r in s.collect()] == [0, 12, 31, 63, 0]
    assert [quantize.level_bits(n) for n in (16, 32, 64, 128, 256)] == [4, 5, 6, 7, 8]
    with pytest.raises(SearchError):
        quantize.level_bits(20)


def test_sampled_parameters(spark):
    v = spark.createDataFrame([([0.01] * 98 + [0.35, -0.6],)] * 2, "v array<double>")
    assert tuple(quantize.dense_range(v, "v").first()) == (-0.025, 0.025)
    assert tuple(quantize.dense_range(v, "v", 0.5).first()) == (-1.0, 0.4)
    assert tuple(quantize.dense_range(v.limit(0), "v").first()) == (-0.025, 0.025)
    p = spark.createDataFrame([(float(i % 4),) for i in range(100)], "val double")
    assert quantize.sparse_upper_bound(p).first()[0] == 3.0
    assert [r["i"] for r in quantize.first_rows(spark.createDataFrame([(3,), (1,), (2,)], "i int"), 2, "i").collect()] == [1, 2]


def test_kmeans(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 101, 102, 103, 104)], "x int")
    assert quantize.kmeans_1d(df, "x", [0.0, 50.0]) == [(2.0, 3), (102.5, 4)]
    assert quantize.is_imbalanced([1, 9]) and not quantize.is_imbalanced([4, 5]) and not quantize.is_imbalanced([])


def test_tokens_of_other_scripts(spark):
    """A token is a run of what has the Alphabetic property or is a number, and of underscores; a virama has neither."""
    want = {"हिन्दी भाषा": ["हिन", "दी", "भाषा"], "Ⅷ ½x ②": ["ⅷ", "½x", "②"], "عَرَبِي": ["عَرَبِي"], "МИР мир—x": ["мир", "мир", "x"], "日本語。中文": ["日本語", "中文"], "ไทยก": ["ไทยก"], "snake_case don't": ["snake_case", "don"], "😀 #!": [], "ẞtraße": ["ßtraße"]}
    df = spark.createDataFrame([*enumerate(want)], "id int, t string")
    got = {r["t"]: r["terms"] for r in df.select("t", text.terms(F.col("t"), stemming=False).alias("terms")).collect()}
    assert got == want
    counts = text.term_counts(df.union(spark.createDataFrame([(90, None), (91, "")], "id int, t string")), "id", "t", stemming=False).collect()
    assert {(r["id"], r["term"], r["count"], r["length"]) for r in counts} == {(i, w, ws.count(w), len(ws)) for i, ws in enumerate(want.values()) for w in ws}


def test_terms(spark):
    df = spark.createDataFrame([("The quick_brown fox's Élan, 42 " + "x" * 41,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.terms(F.col("t"), stemming=False)).collect()] == [["quick_brown", "fox", "élan", "42"], [], None]
    assert [r[0] for r in df.select(text.terms(F.col("t"))).collect()] == [["quick_brown", "fox", "élan", "42"], [], None]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("consolations", "consol"), ("knightly", "knight"), ("kneeling", "kneel"), ("knots", "knot"), ("knackeries", "knackeri"),
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"),
        ("say", "say"), ("cry", "cri"), ("by", "by"), ("generously", "generous"), ("communism", "communism"), ("arsenal", "arsenal"), ("dying", "die"), ("skies", "sky"), ("succeed", "succeed"), ("news", "news"),
        ("national", "nation"), ("relational", "relat"), ("conditional", "condit"), ("sensibility", "sensibl"), ("vietnamization", "vietnam"), ("agreed", "agre"), ("feed", "feed"), ("happily", "happili"),
        ("replacement", "replac"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rolling", "roll"), ("youth", "youth"), ("boyish", "boyish"), ("fluently", "fluentli"), ("at", "at"),
    ],
)
def test_stems(word, stem):
    assert stemmer.stem(word) == stem


def test_bit_widths_and_golden_encodings():
    assert [filters.width(n) for n in (2, 3, 33, 1024)] == [1, 2, 6, 10]
    with pytest.raises(SearchError):
        filters.width(1025)
    assert filters.bits_of(7, 5) == [0, 0, 1, 1, 1]
    schema = MetadataSchema((Field("age", tuple(range(1, 11))), Field("group", ("a", "b", "c"))), (("And", ("age", "group")), ("And", ("group", "age")), ("Or", ("age", "group"))))
    assert schema.encode(is_("age", 6)) == [[0, 1, 1, 0, 0, 0]]
    assert schema.encode(is_("age", 7, "NotEqual")) == [[1, -1, -1, -1, 0, 0]]
    assert schema.encode(and_(Predicate("age", 6), Predicate("group", "c"))) == [[0, 1, 1, 0, 1, 1]]
    assert schema.encode(or_(Predicate("age", 6), Predicate("group", "c"))) == [[0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 1]]
    assert len(schema.conditions) == 2 and schema.max_replicas() == 4 and len(schema.combinations()) == 30
    assert schema.replicas({"age": 6, "group": "a"}) == [[0] * 6, [0, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1], [0, 1, 1, 0, 0, 1]]


def test_schema_checks():
    schema = MetadataSchema((Field("status", ("todo", "done")), Field("n", (1, 2))))
    with pytest.raises(InvalidFieldValue):
        schema.check(is_("status", "never"))
    with pytest.raises(UndeclaredCombination):
        schema.check(and_(Predicate("status", "todo"), Predicate("n", 1)), strict=True)
    assert schema.check(and_(Predicate("status", "todo"), Predicate("n", 1)))
    with pytest.raises(InvalidFieldValue):
        schema.check_metadata({"n": 1 << 31})
    for wrong in (lambda: Field("x", (1, "a")), lambda: MetadataSchema((Field("x", (1,)), Field("x", (2,)))), lambda: MetadataSchema((Field("x", (1,)),), (("And", ("y",)),)), lambda: Field("x", tuple(range(2000)))):
        with pytest.raises(SearchError):
            wrong()
    assert schema.struct_type().simpleString() == "struct<status:string,n:int>"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a"), (3, None)], "n int, s string")
    got = lambda f: [tuple(r) for r in df.where(f.column()).collect()]
    assert got(is_("n", 1)) == [(1, "a")] and got(is_("n", 1, "NotEqual")) == [(2, "b"), (3, None)]
    assert got(and_(Predicate("n", 1), Predicate("n", 2))) == [], "no predicate replaces another of its field"
    assert got(or_(Predicate("n", 3), Predicate("s", "b"))) == [(2, "b"), (3, None)]
    assert got(or_(Predicate("n", 3), and_(Predicate("n", 1), Predicate("s", "a")))) == [(1, "a"), (3, None)]
    one = {"field_name": "n", "field_value": 2, "operator": "NotEqual"}
    assert parse_filter({"Is": one}) == is_("n", 2, "NotEqual")
    assert parse_filter({"And": [one, {"field_name": "s", "field_value": "a", "operator": "Equal"}]}) == and_(Predicate("n", 2, "NotEqual"), Predicate("s", "a"))
    assert parse_filter({"$or": [{"n": {"$eq": 3}}, {"s": {"$ne": "b"}}]}) == or_(Predicate("n", 3), Predicate("s", "b", "NotEqual"))
    for wrong in ({}, {"n": {"$gt": 1}}, {"And": []}, []):
        with pytest.raises(SearchError):
            parse_filter(wrong)


def test_kernels_over_nulls_and_other_lengths(spark):
    rows = [([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([1.0, None], [1.0, 2.0]), ([0.5, 2.0, 1.0], [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").coalesce(1)
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(vectors.half_dot(a, b), vectors.half_euclidean(a, b)).collect()]
    assert got == [(11.0, 8**0.5), (None, None), (None, None), (0.0, 0.0), (None, None), (3.5, 1.25**0.5)]
    assert [r[0] for r in df.select(quantize.half_values(a)).collect()] == [[1.0, 2.0], [1.0], None, [], [1.0, None], [0.5, 2.0, 1.0]]
    import hashlib
    import struct

    assert [r[0] for r in df.where("a IS NULL OR NOT exists(a, x -> x IS NULL)").select(vectors.vector_sha256(a)).collect()] == [None if x is None else hashlib.sha256(struct.pack(f"<{len(x)}f", *x)).hexdigest() for x, _ in rows if x is None or None not in x]


def test_planes_are_packed_from_codes_that_are_computed_once(spark):
    """Rows of several lengths, nulls and empty rows, and the codes once in the plan, not once a bit."""
    rows = [([0.5, -0.5, 0.9],), (None,), ([],), ([None, 0.99],), ([0.1 * i - 0.8 for i in range(17)],)]
    v = spark.createDataFrame(rows, "v array<double>").coalesce(1)
    codes = quantize.subbyte_codes(F.col("v"), 3)
    out = v.select(codes.alias("c"), quantize.bit_planes(codes, 3).alias("p"))
    for r in out.collect():
        if r["c"] is None:
            assert r["p"] is None
            continue
        c = np.array([0 if x is None else x for x in r["c"]], int)
        assert [[int(b) for b in np.packbits((c >> bit & 1).astype(np.uint8))] for bit in (2, 1, 0)] == r["p"]
    planes = v.select(quantize.bit_planes(codes, 3).alias("p"))
    assert planes._jdf.queryExecution().optimizedPlan().toString().count("FLOOR") <= 2, "codes were computed anew for each bit of each byte"
