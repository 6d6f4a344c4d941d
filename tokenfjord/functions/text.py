"""Column expressions for normalising and cutting text; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_SPACE = f"[{C.JAVA_SPACE}]"
_NOT_SPACE = f"[^{C.JAVA_SPACE}]"


def drop_zero_width(text: Column) -> Column:
    """Without soft hyphens and zero-width spaces."""
    return F.translate(text, C.ZERO_WIDTH, "")


def compose(text: Column) -> Column:
    """Vowels followed by a combining acute accent or diaeresis as one character."""
    for pair, letter in C.COMPOSED.items():
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return text


def normalise(text: Column) -> Column:
    """Both, in the order of the lexer."""
    return drop_zero_width(compose(text))


def unescape_html(text: Column) -> Column:
    """HTML escapes resolved in one pass; unknown names and impossible code points stay."""
    part = F.regexp_extract_all(text, F.lit(rf"(?s){C.HTML_PATTERN}|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in C.HTML_NAMES.items() for x in pair])

    def character(code: Column) -> Column:
        return F.when((code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def resolved(p: Column) -> Column:
        body = F.substring(p, 2, 12)
        body = F.regexp_replace(body, ";$", "")
        by_hex = F.when(p.rlike(r"^&#x[0-9a-fA-F]{1,8};$"), character(F.conv(F.substring(body, 3, 8), 16, 10).cast("long")))
        by_decimal = F.when(p.rlike(r"^&#[0-9]{1,10};$"), character(F.try_to_number(F.substring(body, 2, 10), F.lit("9999999999")).cast("long")))
        by_name = F.when(p.rlike(r"^&[a-zA-Z]+;$"), F.try_element_at(names, body))
        return F.coalesce(by_hex, by_decimal, by_name, p)

    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(part, resolved), ""))


def rough_tokens(text: Column) -> Column:
    """Words with the white space before them, as an array."""
    return F.regexp_extract_all(text, F.lit(rf"{_SPACE}*{_NOT_SPACE}+"), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, as an array."""
    return F.regexp_extract_all(text, F.lit(f"{_NOT_SPACE}+"), F.lit(0))


def hard_breaks(text: Column) -> Column:
    """The parts between empty lines."""
    return F.split(text, rf"\n{_SPACE}*\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def mark_paragraphs(text: Column) -> Column:
    """Each non-empty line between paragraph marks."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")
    return F.concat(F.lit("[["), F.array_join(kept, "]][["), F.lit("]]"))


def icelandic_number(text: Column) -> Column:
    """Points for thousands and a comma for decimals, from the English way."""
    return F.translate(text, ".,", ",.")


def is_alphabetic(text: Column) -> Column:
    return text.rlike(r"^\p{L}+$")


def is_date(y: Column, m: Column, d: Column) -> Column:
    """A day of the calendar in 1776 to 2100."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = F.element_at(F.array(*[F.lit(n) for n in C.MONTH_DAYS[1:]]), F.when(m.between(1, 12), m).otherwise(1).cast("int"))
    last = F.when((m == 2) & ~leap, 28).otherwise(days)
    return y.between(C.YEARS.start, C.YEARS.stop - 1) & m.between(1, 12) & d.between(1, last)


def is_ssn(text: Column) -> Column:
    """Whether the check digit of an identity number ``DDDDDD-DDDD`` is right."""
    digits = F.transform(F.split(F.regexp_replace(text, "[-–]", "0"), ""), lambda c: F.ascii(c) - 48)
    weighted = F.zip_with(F.slice(digits, 1, 9), F.array(*[F.lit(w) for w in C.SSN_WEIGHTS]), lambda a, b: a * b)
    total = F.aggregate(weighted, F.lit(0), lambda a, b: a + b)
    shape = text.rlike(r"^[^-–]{6}[-–][^-–]{4}$") & (F.length(text) == 11)
    return F.coalesce(shape & ((11 - total % 11) % 11 == F.ascii(F.substring(text, 10, 1)) - 48), F.lit(False))


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral; null if it is none."""
    values = F.create_map(*[F.lit(x) for pair in C.ROMAN_DIGITS.items() for x in pair])
    digits = F.regexp_extract_all(text, F.lit("|".join(C.ROMAN_DIGITS)), F.lit(0))
    total = F.aggregate(digits, F.lit(0), lambda n, d: n + F.element_at(values, d))
    return F.when((text != "") & text.rlike(f"^{C.ROMAN_PATTERN}$"), total)


def month_number(word: Column) -> Column:
    """1 to 12 for an Icelandic month name in any form; null for others."""
    months = F.create_map(*[F.lit(x) for pair in C.MONTHS.items() for x in pair])
    return F.when(word != C.NAME_LIKE_MONTH, F.try_element_at(months, F.lower(word)))
