import pytest
from pyspark.sql import functions as F

from plumbline.functions import text, values, vectors


def _one(spark, f, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "analyzer, given, tokens",
    [
        ("whitespace_lower", "Hello, World!", ["hello", "world"]),
        ("whitespace_lower", "  a\t\n--  b_c 'd' ÉTÉ... !!", ["a", "b_c", "d", "été"]),
        ("whitespace_lower", "x-y 3.14 x-y", ["x-y", "3.14", "x-y"]),
        ("whitespace_lower", "", []),
        ("whitespace_lower", " .,! ", []),
        ("whitespace_lower", None, None),
        ("ngram", "abcd", ["ab", "bc", "cd", "abc", "bcd"]),
        ("ngram", "A b", ["ab"]),
        ("ngram", "a", []),
        ("ngram", None, None),
        ("jieba", "中文分词", ["中文", "文分", "分词"]),
        ("jieba", "我 love 北京!", ["我", "love", "北京"]),
        ("jieba", "plain Text", ["plain", "text"]),
        ("jieba", "", []),
    ],
)
def test_tokens(spark, analyzer, given, tokens):
    assert _one(spark, lambda c: text.analyze(c, analyzer), given) == tokens


def test_long_runs_of_punctuation_stay_linear(spark):
    assert _one(spark, text.whitespace_lower, "a " + "=" * 100_000 + " b" + "!" * 100_000) == ["a", "b"]


@pytest.mark.parametrize("given, bits", [("0", 0), ("0xFF", 255), ("ffffffffffffffff", -1), ("0X8000000000000000", -(2**63)), (" 1f ", 31), ("000000000000000000001", 1), ("10000000000000000", None), ("xyz", None), ("", None)])
def test_hash_bits(spark, given, bits):
    assert _one(spark, values.hash_bits, given) == bits
    if bits is not None:
        assert values.hash_literal(given) == bits


@pytest.mark.parametrize("given, ok", [("2024-02-29", True), ("2023-02-29", False), ("1900-02-29", False), ("2000-02-29", True), ("0000-01-01", False), ("0001-01-01", True), ("9999-12-31", True), ("2024-13-01", False), ("2024-1-01", False), ("2024-01-01 ", False), ("24-01-01", False)])
def test_strict_dates(spark, given, ok):
    assert (_one(spark, values.strict_date, given) is not None) == ok


@pytest.mark.parametrize("given, ok", [("1.25", True), ("-0.5", True), ("1.255", False), ("123", True), ("1234", False), ("01", False), ("1e2", False), (".5", False), ("5.", False)])
def test_strict_decimals(spark, given, ok):
    assert (_one(spark, lambda c: values.strict_decimal(c, 5, 2), given) is not None) == ok


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    near = lambda m: [r[0] for r in df.select(vectors.nearness(F.col("v"), vectors.literal([1.0, 0.0]), m)).collect()]
    assert near("cosine") == pytest.approx([-0.4, -1.0])
    assert near("dot") == pytest.approx([3.0, 0.0])
    assert near("l2") == pytest.approx([-(20**0.5), -1.0])
    assert [tuple(r[0]) for r in df.select(vectors.normalized(F.col("v"))).collect()] == [pytest.approx((0.6, 0.8)), (0.0, 0.0)]


def test_quantized_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.26, 2.55])], "i int, v array<float>")
    got = {r.i: r.q for r in vectors.quantize(df, "v", "q").collect()}
    assert got == {1: pytest.approx([0.0, 1.0]), 2: pytest.approx([0.26, 2.55])}
    same = spark.createDataFrame([(1, [2.0, 2.0])], "i int, v array<float>")
    assert vectors.quantize(same, "v", "q").first().q == [2.0, 2.0]


def test_routing(spark):
    import zlib

    assert _one(spark, lambda c: values.route("users", c), "k1") == zlib.crc32(b"users\0k1") % 4096
