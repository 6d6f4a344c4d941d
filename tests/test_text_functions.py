"""Column expressions against the plain engine and known values."""

import pytest
from pyspark.sql import functions as F

from tokenfjord.functions import text as X
from tokenfjord.operators import lexer, segment
from tokenfjord.operators.tokens import Kind, Token

VALID = ["311281-5189", "101275-5239", "500101-2880", "700269-1169", "010130-7789", "140543-3229", "120375-3509", "650376-0649"]
INVALID = ["01010-1019", "0101011019", "010101+1019", "010101-0000", "310354-2268", "01010A-1019", "", "010101-10199"]


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("x"))).collect()]


def test_identity_numbers(spark):
    assert column(spark, VALID + INVALID, X.is_ssn) == [True] * len(VALID) + [False] * len(INVALID)
    assert [lexer.valid_ssn(x) for x in VALID + INVALID] == [True] * len(VALID) + [False] * len(INVALID)
    assert column(spark, [None], X.is_ssn) == [False]


def test_roman_numerals(spark):
    cases = {"IV": 4, "XCIX": 99, "CDXLIV": 444, "MMXXIII": 2023, "MCMXCIX": 1999, "MMMCMXCIX": 3999, "IIII": None, "": None, "ABC": None}
    assert column(spark, list(cases), X.roman_value) == list(cases.values())
    assert all(lexer.roman_value(k) == v for k, v in cases.items() if v)


@pytest.mark.parametrize("name", ["&aacute;x&lt;", "&middot; &#x61; &#97; &#352; &#x1F600;", "&amp;lt;", "a & b", "&#x110000; &#1114112;", "&shy;&filig;", "", "&", "&;&#;&#x;"])
def test_html_escapes(spark, name):
    plain = segment._rewritten(Token(Kind.RAW, name, None, name), segment._HTML, segment.html_character).txt
    assert column(spark, [name], X.unescape_html) == [plain]


def test_composition_and_zero_width(spark):
    text = "Hákon ö Ý ñ te­st​﻿"
    assert column(spark, [text, None], X.normalise) == ["Hákon ö Ý ñ test", None]


def test_paragraph_marks(spark):
    assert column(spark, ["a\n\nb\n", "", None, "\n"], X.mark_paragraphs) == ["[[a]][[b]]", "[[]]", "[[]]", "[[]]"]
    assert [segment.mark_paragraphs(x) for x in ("a\n\nb\n", "", "\n")] == ["[[a]][[b]]", "[[]]", "[[]]"]


def test_white_space_is_that_of_str(spark):
    every = "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    odd = "x".join(c for c in every if c.isspace())
    assert column(spark, [odd], lambda c: F.size(X.words(c))) == [len(odd.split())]


def test_months_and_days(spark):
    assert column(spark, ["Janúar", "sept.", "Ágúst", "ágúst", "x"], X.month_number) == [1, 9, None, 8, None]
    frame = spark.createDataFrame([(2000, 2, 29), (1900, 2, 29), (2023, 13, 1), (1775, 1, 1), (2100, 12, 31)], "y int, m int, d int")
    assert [r[0] for r in frame.select(X.is_date(F.col("y"), F.col("m"), F.col("d"))).collect()] == [True, False, False, False, True]


def test_numbers_the_icelandic_way(spark):
    assert column(spark, ["1,234.56"], X.icelandic_number) == ["1.234,56"]
