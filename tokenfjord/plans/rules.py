"""Queries that show one rule each, on texts made from the tables, with the SQL of what they must give.

A case has a rule's name, a text and the tokens it must give, each as KIND|text
and the fields the kind has, joined by " + ". Both are SQL expressions over the
number ``k`` of a row, so Spark makes the texts and DuckDB the results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abbreviations, build, engine, frames
from ..operators.tokens import Kind, Token
from ..session import shared_dir
from ..sources import files

Case = tuple[str, str, str]


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


_N, _DAY, _MONTH, _YEAR = "(k % 900 + 1)", "(k % 28 + 1)", "(k % 12 + 1)", "(1800 + k % 250)"
_TIME = f"{_two('k % 24')} || ':' || {_two('k % 60')} || ':' || {_two('k * 7 % 60')} || ',37'"
_PHONE = "'5' || lpad(CAST(k % 1000000 AS STRING), 6, '0')"

LEXER_CASES: list[Case] = [
    ("clock time with hundredths", _TIME, f"'TIME|' || {_TIME} || '|' || (k % 24) || '|' || (k % 60) || '|' || (k * 7 % 60)"),
    ("month and year", f"{_two(_MONTH)} || '.' || {_YEAR}", f"'DATEREL|' || {_two(_MONTH)} || '.' || {_YEAR} || '|' || {_YEAR} || '|' || {_MONTH} || '|0'"),
    ("English quantity", "(k % 9 + 1) || ',250.5m'", "'MEASUREMENT|' || (k % 9 + 1) || ',250.5m|' || (k % 9 + 1) || '250.5|m'"),
    ("quantity with a fraction", f"{_N} || '½kg'", f"'MEASUREMENT|' || {_N} || '½kg|' || {_N} || '.5|kg'"),
    ("seven digits", f"'Hringdu í ' || {_PHONE}", f"'WORD|Hringdu + WORD|í + TELNO|' || {_PHONE} || '|' || substr({_PHONE}, 1, 3) || '-' || substr({_PHONE}, 4) || '|354'"),
    ("ordinal with dots", "'Kafli ' || (k % 50 + 1) || '.' || (k % 7 + 1) || '.3'", "'WORD|Kafli + ORDINAL|' || (k % 50 + 1) || '.' || (k % 7 + 1) || '.3|' || (k % 50 + 1) || (k % 7 + 1) || '3.0'"),
    ("fraction alone", "'Alls ' || CASE k % 3 WHEN 0 THEN '¼' WHEN 1 THEN '½' ELSE '¾' END", "'WORD|Alls + NUMBER|' || CASE k % 3 WHEN 0 THEN '¼|0.25' WHEN 1 THEN '½|0.5' ELSE '¾|0.75' END"),
    ("currency code and digits", f"'USD' || {_N}", f"'AMOUNT|USD' || {_N} || '|' || {_N} || '.0|USD'"),
    ("unknown sign", f"'Tákn ¤ ' || {_N}", f"'WORD|Tákn + UNKNOWN|¤ + NUMBER|' || {_N} || '|' || {_N} || '.0'"),
    ("rest of a word after a number", f"{_N} || 'abc'", f"'NUMBER|' || {_N} || '|' || {_N} || '.0 + WORD|abc'"),
    ("word of composite letters", f"'Sími ' || {_N}", f"'WORD|Sími + NUMBER|' || {_N} || '|' || {_N} || '.0'"),
    ("word after a hyphen", f"'Þing ' || {_N} || ' -menn'", f"'WORD|Þing + NUMBER|' || {_N} || '|' || {_N} || '.0 + WORD|-menn'"),
]

_HEAD = f"'Talan ' || {_N} || "
_HEADED = f"'WORD|Talan + NUMBER|' || {_N} || '|' || {_N} || '.0 + "

SEQUENCE_CASES: list[Case] = [
    ("abbreviation that is a word at the end", f"{_HEAD}' er nr. Hann fór'", f"{_HEADED}WORD|er + WORD|nr + PUNCTUATION|.|. + WORD|Hann + WORD|fór'"),
    ("abbreviation within", f"'Hús nr. ' || {_N}", f"'WORD|Hús + WORD|nr.|númer + NUMBER|' || {_N} || '|' || {_N} || '.0'"),
    ("abbreviation in capitals", f"'T.d. ' || {_N}", f"'WORD|T.d.|til dæmis + NUMBER|' || {_N} || '|' || {_N} || '.0'"),
    ("abbreviation without a dot", f"{_HEAD}' hjá EES'", f"{_HEADED}WORD|hjá + WORD|EES|Evrópska efnahagssvæðið'"),
    ("kilometres an hour", "'Ók á ' || (18 * (k % 9 + 1)) || ' km/klst heim'", "'WORD|Ók + WORD|á + MEASUREMENT|' || (18 * (k % 9 + 1)) || ' km/klst|' || (5 * (k % 9 + 1)) || '.0|m/s + WORD|heim'"),
    ("unit with a dot", f"'Vó ' || {_N} || ' kg. af fiski'", f"'WORD|Vó + MEASUREMENT|' || {_N} || ' kg.|' || {_N} || '.0|kg + WORD|af + WORD|fiski'"),
    ("number and currency sign", f"{_N} || '€ þar'", f"'AMOUNT|' || {_N} || '€|' || {_N} || '.0|EUR + WORD|þar'"),
    ("article of a law", f"{_DAY} || '. gr. laganna'", f"'ORDINAL|' || {_DAY} || '.|' || {_DAY} || '.0 + WORD|gr.|grein + WORD|laganna'"),
    ("day and month without a dot", f"{_DAY} || ' maí'", f"'DATEREL|' || {_DAY} || '. maí|0|5|' || {_DAY}"),
    ("date and a year as a number", f"{_DAY} || '. júní 1.990'", f"'DATEABS|' || {_DAY} || '. júní 1.990|1990|6|' || {_DAY}"),
    ("date before Christ", f"{_DAY} || '.5.' || {_YEAR} || ' f.Kr.'", f"'DATEABS|' || {_DAY} || '.5.' || {_YEAR} || ' f.Kr.|-' || {_YEAR} || '|5|' || {_DAY}"),
    ("number and currency code", f"{_N} || ' EUR alls'", f"'AMOUNT|' || {_N} || ' EUR|' || {_N} || '.0|EUR + WORD|alls'"),
    ("range of years", "'Árin ' || (1800 + k % 99) || '-' || (1900 + k % 99)", "'WORD|Árin + YEAR|' || (1800 + k % 99) || '|' || (1800 + k % 99) || '.0 + PUNCTUATION|-|– + YEAR|' || (1900 + k % 99) || '|' || (1900 + k % 99) || '.0'"),
]

_NUMBERED = "SELECT c_custkey AS k FROM customer"


def _expected(cases: list[Case], name: str = "found") -> str:
    return " UNION ALL ".join(f"SELECT k, '{rule}' AS rule, {found} AS {name} FROM ({_NUMBERED}) t" for rule, _, found in cases)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))


def _made(spark: SparkSession, sf_dir: str, cases: list[Case]) -> DataFrame:
    """(k, rule, text) of every case and row."""
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(text).alias("text")) for rule, text, _ in cases])).alias("case")
    return _numbered(spark, sf_dir).select("k", each).select("k", "case.*")


_FIELDS = ("kind_name", "txt", "norm", "num", "unit", "y", "mo", "d", "h", "mi", "s", "telno", "cc", "meanings")


def _found(texts: DataFrame, **options: Any) -> DataFrame:
    """The tokens of a text come from Python together, so they needn't be gathered by a shuffle."""

    def one(t: Column) -> Column:
        plain = [(F.round(t[c], 6) if c == "num" else t[c]).cast("string") for c in _FIELDS[:-1]]
        return F.concat_ws("|", *plain, F.array_join(F.transform(t["meanings"], lambda m: m["stofn"]), "/"))

    rows = frames.token_arrays(texts, keys=["k", "rule"], fields=_FIELDS, **options)
    return rows.select("k", "rule", F.array_join(F.transform(F.filter("tokens", lambda t: t["txt"] != ""), one), " + ").alias("found"))


def lexer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for one word."""
    return _found(_made(spark, sf_dir, LEXER_CASES))


def sequence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over neighbouring tokens."""
    return _found(_made(spark, sf_dir, SEQUENCE_CASES))


_MEASURED: list[Case] = [("degrees rewritten", f"'Hiti ' || {_N} || '° F'", f"'Hiti ' || {_N} || ' °F'")]


def measurements_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.token_arrays(_made(spark, sf_dir, _MEASURED), keys=["k", "rule"], fields=("txt",), convert_measurements=True)
    return rows.select("k", "rule", F.array_join(F.filter(F.transform("tokens", lambda t: t["txt"]), lambda x: x != ""), " ").alias("found"))


# --- the API around the rules -----------------------------------------------------------------


def _lists(spark: SparkSession, sf_dir: str, apply: Any) -> DataFrame:
    """(k, rule, found) of what ``apply`` gives for each row's number: (rule, found) pairs."""

    def rows(value: str) -> Iterator[tuple]:
        yield from apply(int(value))

    texts = _numbered(spark, sf_dir).select("k", F.col("k").cast("string").alias("text"))
    return frames.per_text(texts, "text", ["k"], [("rule", "string", pa.string()), ("found", "string", pa.string())], rows)


def _bare(found: list[Token]) -> str:
    return " + ".join(f"{Kind(t.kind).name}|{t.txt}" for t in found if t.txt)


API_CASES: list[Case] = [
    ("without annotation", "", f"'WORD|Verð + WORD|USD + NUMBER|' || {_N}"),
    ("with annotation", "", f"'WORD|Verð + AMOUNT|USD ' || {_N}"),
    ("lexed only", "", f"'WORD|kl + PUNCTUATION|. + TIME|' || {_two('k % 24')} || ':' || {_two('k % 60')} || ' + NUMBER|' || {_N} || ' + WORD|kg'"),
    ("text of tokens", "", f"'Pöntun ' || {_N} || ' , \"já\" .'"),
    ("normal text of tokens", "", f"'Pöntun ' || {_N} || ' , „ já “ .'"),
    ("indexes", "", f"'0 5 ' || (5 + length('' || {_N}) + 1) || ' / 0 6 ' || (6 + length('' || {_N}) + 1)"),
    ("replaced", "", f"'a-' || {_N} || ' [2, 3'"),
    ("replaced all", "", f"'abab' || {_N} || ' ' || (4 + length('' || {_N}))"),
    ("replaced longer", "", f"'aXYZ' || {_N}"),
    ("cut", "", f"'a / b' || {_N} || ' / ' || (length('' || {_N}) + 1)"),
    ("joined", "", f"'a--' || {_N} || ' YEAR ' || {_N}"),
    ("equal", "", "'True False True'"),
    ("accessors", "", f"{_N} || '.0 ' || {_N} || ' ' || {_N} || ' 1'"),
    ("made", "", "'TIME (' || (k % 24) || ', ' || (k % 60) || ', 0)'"),
    ("view ahead", "", f"'Hann ' || {_N} || ' None'"),
]


def _api(k: int) -> Iterator[tuple[str, str]]:
    n = k % 900 + 1
    priced = f"Verð USD {n}"
    yield "without annotation", _bare(engine.tokenize_without_annotation(priced))
    yield "with annotation", _bare(engine.tokenize(priced))
    yield "lexed only", _bare(engine.parse_tokens(f"kl. {k % 24:02d}:{k % 60:02d} {n} kg"))
    quoted = engine.tokenize(f'Pöntun {n}, "já".')
    yield "text of tokens", engine.text_from_tokens(quoted).replace('" já "', '"já"')
    yield "normal text of tokens", engine.normalized_text_from_tokens(quoted)
    chars, octets = engine.calculate_indexes(engine.parse_tokens(f"Vörur {n} hér")[:-1])
    yield "indexes", f"{' '.join(map(str, chars))} / {' '.join(map(str, octets))}"
    token = Token(Kind.RAW, f"axb{n}", None, f"  a&12b{n}")
    cut = Token(Kind.RAW, f"axb{n}", None, f"  a&12b{n}", [2, 3, 6, *range(7, 7 + len(str(n)))])
    yield "replaced", f"a-{n} {cut.replaced(1, 3, '-').spans[:2]}"[:-1]
    doubled = Token(Kind.RAW, f"a-ba-b{n}").replaced_all("-", "")
    yield "replaced all", f"{doubled.txt} {len(doubled.txt)}"
    yield "replaced longer", cut.replaced_longer(1, 3, "XYZ").txt
    left, right = Token(Kind.RAW, f"ab{n}", None, f"ab{n}").cut(1)
    yield "cut", f"{left.txt} / {right.txt} / {len(right.spans or [])}"
    both = Token(Kind.WORD, "a", None, "a").joined(Token(Kind.YEAR, str(n), n, str(n)), "--", later=True)
    yield "joined", f"{both.txt} {Kind(both.kind).name} {both.val}"
    yield "equal", f"{token.equal(Token(Kind.RAW, f'axb{n}'))} {token == Token(Kind.RAW, f'axb{n}')} {token == Token(Kind.RAW, f'axb{n}', None, f'  a&12b{n}')}"
    year = Token(Kind.YEAR, str(n), n)
    yield "accessors", f"{year.number} {year.integer} {Token(Kind.ORDINAL, f'{n}.', n).ordinal} {len(engine.tokenize('t.d.')[1].meanings)}"
    made = build.make(Kind.TIME, "x", k % 24, k % 60, 0)
    yield "made", f"{Kind(made.kind).name} {made.val}"
    stream = build.TokenStream(t for t in engine.tokenize(f"Hann {n}") if t.txt)
    yield "view ahead", f"{stream[0].txt} {stream[1].txt} {(next(stream), next(stream), stream[0])[2]}"


def token_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as objects: cut, joined, replaced, made, compared, looked at ahead."""
    return _lists(spark, sf_dir, _api)


DICTIONARY_CASES: list[Case] = [
    ("meanings in order", "", "'fyrri' || k || '/seinni' || k"),
    ("without a dot", "", "'tveir' || k"),
    ("without inner dots", "", "'tveir' || k"),
    ("ends a sentence", "", "'True False'"),
    ("plain word at the end", "", "'True'"),
    ("malformed", "", "'ConfigError'"),
]


def _dictionary(k: int) -> Iterator[tuple[str, str]]:
    known = abbreviations.Abbreviations(f'[abbreviations]\nzz.* = "fyrri{k}" kk\nzz.* = "seinni{k}" kvk\na.q. = "tveir{k}" hk\nhm.! = "y" kk\n')
    yield "meanings in order", "/".join(m.stofn for m in known.meanings("zz."))
    yield "without a dot", "/".join(m.stofn for m in known.meanings("a.q"))
    yield "without inner dots", "/".join(m.stofn for m in known.meanings("aq"))
    yield "ends a sentence", f"{'zz.' in known.finishers} {'a.q.' in known.finishers}"
    yield "plain word at the end", str("hm." in known.not_finishers)
    try:
        abbreviations.Abbreviations(f"[abbreviations]\nzz{k}*\n")
    except abbreviations.ConfigError as e:
        yield "malformed", type(e).__name__


def own_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of its own for each nation's number."""
    texts = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("string").alias("text"))
    return frames.per_text(texts, "text", ["k"], [("rule", "string", pa.string()), ("found", "string", pa.string())], lambda value: list(_dictionary(int(value))))


# --- sources and sinks ---------------------------------------------------------------------------

_PARTS = "SELECT p_partkey AS k FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))


def chunked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come in chunks, which are cut anywhere between words; an empty chunk ends a sentence."""
    texts = F.array(F.lit("Vara "), F.col("k").cast("string"), F.lit(" er til. Hún"), F.lit(" fæst"), F.lit(""), F.lit("hér"))
    parts = _parts(spark, sf_dir).select("k", F.posexplode(texts).alias("chunk_no", "chunk"))
    return frames.sentences(frames.chunked(parts, ["k"]), keys=["k"])


def paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph marks, the sentences between them and where they begin."""
    text = F.concat(F.lit("[[Vara "), F.col("k"), F.lit(" er til. Hún fæst hér.]][[]][[Hún er góð.]]"))
    return frames.paragraphs(_parts(spark, sf_dir).select("k", text.alias("text")), keys=["k"])


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between white space with what stood before them; an escaped space cuts a word in two."""
    text = F.concat(F.lit("a&nbsp;b "), F.col("k"), F.lit("  c"))
    return frames.raw_tokens(_parts(spark, sf_dir).select("k", text.alias("text")), keys=["k"], replace_html_escapes=True).where(F.col("txt") != "").select("k", "tok_idx", "txt", "original")


def csv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several kinds in lines of CSV."""
    text = F.concat(F.lit("€"), F.col("k") % 900 + 1, F.lit(" 12:05 5.3.1990 t.d. "), F.lit("555-0123"))
    return frames.lines(_parts(spark, sf_dir).select("k", text.alias("text")), "csv", keys=["k"]).select("k", "line_no", "value")


def original_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Vara  "), F.col("k"), F.lit(" er til.  Hún fæst hér."))
    return frames.lines(_parts(spark, sf_dir).select("k", text.alias("text")), keys=["k"], original=True).select("k", "line_no", "value")


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written as text files, read as lines and as whole files."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    text = F.concat(F.lit("Vara "), F.col("k"), F.lit(" er til. Hún fæst hér."))
    files.write_lines(_parts(spark, sf_dir).select("k", text.alias("text")), path, keys=("k",))
    lines = files.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n")).select(F.lit("line").alias("source"), "text", "n")
    whole = files.read_documents(spark, path).select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return lines.unionByName(whole.select(F.lit("file").alias("source"), "text", "n"))


def sql_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the table functions."""
    from .. import sql

    sql.register(spark)
    text = F.concat(F.lit("Verð "), F.col("k") % 9 + 1, F.lit(",500.5 prósent\nNý lína"))
    frames.spread(_parts(spark, sf_dir).select("k", text.alias("text"))).createOrReplaceTempView("texts_with_options")
    options = "'convert_numbers,coalesce_percent,one_sent_per_line'"
    rows = spark.sql(f"SELECT d.k, t.sent_idx, t.tok_idx, t.kind_name, t.txt FROM texts_with_options d, LATERAL tokenize(d.text, {options}) t")
    count = spark.sql("SELECT d.k, CAST(count(*) AS INT) AS n FROM texts_with_options d, LATERAL sentences(d.text, 'one_sent_per_line') s GROUP BY d.k")
    return rows.join(count, "k")


QUERIES = {f.__name__: f for f in (lexer_rules, sequence_rules, measurements_converted, token_api, own_dictionaries, chunked_sentences, paragraph_sentences, raw_words, csv_values, original_lines, files_round_trip, sql_options)}
ORACLES = {
    "lexer_rules": _expected(LEXER_CASES),
    "sequence_rules": _expected(SEQUENCE_CASES),
    "measurements_converted": _expected(_MEASURED),
    "token_api": _expected(API_CASES),
    "own_dictionaries": _expected(DICTIONARY_CASES).replace(_NUMBERED, "SELECT n_nationkey AS k FROM nation"),
    "chunked_sentences": f"SELECT k, unnest([0, 1, 2]) AS sent_idx, unnest(['Vara ' || k || ' er til .', 'Hún fæst', 'hér']) AS sentence FROM ({_PARTS}) t",
    "paragraph_sentences": f"SELECT k, unnest([0, 0, 1]) AS para_idx, unnest([0, 1, 0]) AS sent_no, unnest([1, 8, 16]) AS begin_idx, unnest(['Vara ' || k || ' er til .', 'Hún fæst hér .', 'Hún er góð .']) AS sentence FROM ({_PARTS}) t",
    "raw_words": f"SELECT k, unnest([0, 1, 2, 3]) AS tok_idx, unnest(['a', 'b', '' || k, 'c']) AS txt, unnest(['a', '&nbsp;b', ' ' || k, chr(160) || ' c']) AS original FROM ({_PARTS}) t",
    "csv_values": f"SELECT k, unnest(range(6))::INT AS line_no, unnest(['13,\"€' || n || '\",\"' || n || '|EUR\",\"€' || n || '\",\"' || CASE length('' || n) WHEN 1 THEN '0-1' WHEN 2 THEN '0-1-2' ELSE '0-1-2-3' END || '\"', '2,\"12:05\",\"12|5|0\",\" 12:05\",\"1-2-3-4-5\"', '18,\"5.3.1990\",\"1990|3|5\",\" 5.3.1990\",\"1-2-3-4-5-6-7-8\"', '6,\"t.d.\",\"til dæmis\",\" t.d.\",\"1-2-3-4\"', '7,\"555-0123\",\"555-0123|354\",\" 555-0123\",\"1-2-3-4-5-6-7-8\"', '0,\"\",\"\",\"\",\"\"']) AS value FROM (SELECT p_partkey AS k, p_partkey % 900 + 1 AS n FROM part) t",
    "original_lines": f"SELECT k, unnest([0, 1]) AS line_no, unnest(['Vara  ' || k || ' er til.', '  Hún fæst hér.']) AS value FROM ({_PARTS}) t",
    "files_round_trip": f"SELECT source, text, count(*) AS n FROM (SELECT unnest(['line', 'file']) AS source, 'Vara ' || k || ' er til .' AS text FROM ({_PARTS}) t UNION ALL SELECT unnest(['line', 'file']), 'Hún fæst hér .' FROM ({_PARTS}) t) u GROUP BY source, text",
    "sql_options": f"SELECT k, unnest([0, 0, 1, 1]) AS sent_idx, unnest([0, 1, 0, 1]) AS tok_idx, unnest(['WORD', 'PERCENT', 'WORD', 'WORD']) AS kind_name, unnest(['Verð', (k % 9 + 1) || '.500,5 prósent', 'Ný', 'lína']) AS txt, 2 AS n FROM ({_PARTS}) t",
}
