"""Scalar functions on literal strings, against their definition in Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import numeric as N, text as X


def one(spark, c, *values):
    return spark.createDataFrame([values], ", ".join(f"a{i} string" for i in range(len(values)))).select(c.alias("v")).first()[0]


def normalised(text, joiners=True):
    text = unicodedata.normalize("NFC", text)
    keep = "\n\t" + ("‌‍" if joiners else "")
    text = "".join(c for c in text if c in keep or unicodedata.category(c) not in ("Cc", "Cf"))
    return "\n".join(x.rstrip() for x in text.splitlines()).strip()


CASES = ["é plain", "a‌b‍c", "so­ft", "a\r\nb", "a\rb", "x y", "nbsp  \nend  ", "", "   ", "123 !?", "\n\n a \t\n", "tab\tin\tside", "a​b﻿", "क‍ष"]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("joiners", [True, False])
def test_normalize(spark, text, joiners):
    assert one(spark, X.normalize(F.col("a0"), joiners), text) == normalised(text, joiners)
    removed = sum(unicodedata.category(c) in ("Cc", "Cf") and c not in "\n\t" + ("‌‍" if joiners else "") for c in text)
    assert one(spark, X.control_count(F.col("a0"), joiners), text) == removed


def test_line_ends_first(spark):
    assert one(spark, X.normalize(F.col("a0"), False, lines_first=True), "a\r\nb\rc  \r\n") == "a\nb\nc"


@pytest.mark.parametrize("text,n", [("call 9876543210 now", 1), ("+91 9876543210", 1), ("91-9876543210", 1), ("19876543210", 0), ("5876543210", 0), (None, 0)])
def test_phone(spark, text, n):
    assert one(spark, X.pattern_count(F.col("a0"), X.PHONE), text) == n


def test_patterns(spark):
    t = "mail a.b@c.org or X@Y.COM, see https://x.y/z and HTTP://q at 10.0.0.1; api_key = \"abcdefgh1\" token: 'short'"
    assert [one(spark, X.pattern_count(F.col("a0"), p), t) for p in (X.EMAIL, X.URL, X.IPV4, X.SECRET)] == [2, 2, 1, 1]
    assert one(spark, X.ascii_script_ratio(F.col("a0")), "12 34") == 1.0
    assert abs(one(spark, X.ascii_script_ratio(F.col("a0")), "abcдва") - 0.5) < 1e-9


@pytest.mark.parametrize("n,label", [(0, "a"), (99, "a"), (100, "b"), (499, "b"), (500, "c"), (2000, "d"), (None, None)])
def test_band(spark, n, label):
    df = spark.createDataFrame([(n,)], "n int").select(X.band(F.col("n"), [0, 100, 500, 2000], list("abcd")).alias("v"))
    assert df.first()[0] == label


def test_spans(spark):
    t = "x<|b|>one\ntwo<|e|>y<|b|><|e|><|b|>open"
    assert one(spark, X.spans(F.col("a0"), "<|b|>", "<|e|>"), t) == ["one\ntwo", ""]


@pytest.mark.parametrize("token,want", [("\n", "newline/end"), ("<|endoftext|>", "newline/end"), (" ,", "punctuation"), ("  ", "punctuation"), ("a1", "number"), (" The", "function word"), ("Lily", "capitalised word"), ("cat", "other word")])
def test_categories(spark, token, want):
    assert one(spark, X.token_category(F.col("a0")), token) == want


@pytest.mark.parametrize("s,want", [("12", 12.0), (" 1e3 ", 1000.0), ("x1", None), ("", None), (None, None)])
def test_numeral(spark, s, want):
    assert one(spark, X.numeral(F.col("a0")), s) == want


def test_golden_numbers(spark):
    row = spark.range(1).select(
        N.cache_bytes(F.lit(32.0), 8.0, 128.0, 49152.0, 2.0).alias("kv"), (30e9 * N.bytes_per_weight("dp", F.lit(32.0)) / N.GIB).alias("dp"), (30e9 * N.bytes_per_weight("zero1", F.lit(8.0)) / N.GIB).alias("z1"),
        N.bytes_per_weight("zero1", F.lit(32.0)).alias("w1"), N.bytes_per_weight("zero2", F.lit(32.0)).alias("w2"), N.bytes_per_weight("zero3", F.lit(32.0)).alias("w3"), N.copies_sent("zero3", F.lit(32.0)).alias("c3"),
    ).first()
    assert round(row["kv"] / 1e9, 2) == 6.44 and round(row["dp"], 1) == 447.0 and round(row["z1"], 1) == 153.7
    assert (row["w1"], row["w2"], row["w3"], round(row["c3"], 3)) == (4.375, 2.4375, 0.5, 2.906)


def test_float_layouts(spark):
    x = spark.createDataFrame([(0.1,), (-2.5,), (1.0,)], "v double")
    rows = x.select("v", N.bits_float32("v").alias("b"), N.bits_bfloat16("v").alias("h")).select("v", "b", "h", N.decode_bits(F.col("b"), 8, 127).alias("f"), N.decode_bits(F.col("h"), 8, 127).alias("g"), N.quantised(F.col("v")).alias("q")).collect()
    assert rows[0]["b"] == "00111101110011001100110011001101" and rows[0]["h"] == "0011110111001101"
    assert abs(rows[0]["f"] - 0.1) < 1e-8 and rows[1]["f"] == rows[1]["g"] == rows[1]["q"] == -2.5
    assert rows[0]["q"] == 0.1015625


def test_meaning(spark):
    c = lambda v: N.meaning_code(F.lit(v))
    o = N.decoded(c(9.0), c(9.0))
    r = spark.range(1).select(o["sum"].alias("s"), o["product"].alias("p"), o["quotient"].alias("q"), N.meaning_code(F.lit(None).cast("double")).alias("z")).first()
    assert abs(r["s"] - 18) < 1e-9 and abs(r["p"] - 81.000018) < 1e-5 and r["q"] == 1 and tuple(r["z"]) == (0, 0, 0)


def test_normalised_ones(spark):
    a, b = N.normalised_ones(F.lit(4.0))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert abs(4 * r["a"] + (8192 - 4) * r["b"]) < 1e-6 and abs((4 * r["a"] ** 2 + 8188 * r["b"] ** 2) / 8192 - 1) < 1e-9


def test_sizes(spark):
    got = [spark.createDataFrame([(n,)], "n long").select(X.decimal_bytes(F.col("n")).alias("v")).first()[0] for n in (5, 50, 500, 6_442_450_944, 51_539_607_552)]
    assert got == ["5.00 B", "50.0 B", "500 B", "6.44 GB", "51.5 GB"]
    assert re.match(r"\d", got[0])
