"""Queries over the tables of a folder, and the SQL that gives the same rows.

Three styles: text statistics straight from column expressions; round trips that
write a typed column as Icelandic text, tokenize it and read the value back; and
fixed inputs with known results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..operators import abbreviations, frames
from ..operators.tokens import Kind
from ..session import shared_dir
from ..streaming import texts as streams
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space of str patterns, for DuckDB's regular expressions.
_WS = r" \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = f"regexp_extract_all(text, '[^{_WS}]+')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(X.words(F.col("text"))).alias("place", "word"))


# --- text statistics ---------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents")
def rough_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(w, '\\p{{L}}+')) AS n_alphabetic FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents) GROUP BY lang")
def alphabetic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.is_alphabetic(F.col("word"))).alias("n_alphabetic"))


@query(f"SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents) GROUP BY lang, w)) WHERE rank <= 20")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _words(spark, sf_dir).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank.cast("long")).where("rank <= 20").select("lang", "word", "n", "rank")


@query(f"SELECT first, second, count(*) AS n FROM (SELECT doc_id, w AS first, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS second FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))) WHERE second IS NOT NULL GROUP BY first, second HAVING count(*) >= 20")
def frequent_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("word").over(Window.partitionBy("doc_id").orderBy("place"))
    pairs = _words(spark, sf_dir).withColumn("second", following).where("second is not null")
    return pairs.groupBy(F.col("word").alias("first"), "second").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"SELECT word FROM (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents WHERE lang = 'fr') EXCEPT SELECT word FROM (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents WHERE lang = 'en')")
def french_only_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass that keeps each word once a task: no word's occurrences meet in one."""
    both = table(spark, sf_dir, "documents").where("lang in ('fr', 'en')").select("lang", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    seen = both.groupBy("word").agg(F.bool_or(F.col("lang") == "fr").alias("fr"), F.bool_or(F.col("lang") == "en").alias("en"))
    return seen.where("fr and not en").select("word")


_STOP = ("the", "of", "and", "to", "in", "de", "la", "der", "die", "que", "le", "el")
_STOP_VALUES = ", ".join(f"('{w}')" for w in _STOP)


@query(f"SELECT lang, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents) WHERE lower(w) NOT IN (SELECT * FROM (VALUES {_STOP_VALUES})) GROUP BY lang")
def words_without_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in _STOP], "stop string")
    words = _words(spark, sf_dir).withColumn("stop", F.lower("word"))
    return words.join(F.broadcast(stop), "stop", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS n_words, count(*) AS n FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY source")
def words_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(column).alias("text")) for name, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("source").agg(F.sum(F.size(X.words(F.col("text")))).alias("n_words"), F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS tok_idx, coalesce(CAST(sum(length(w)) OVER o AS BIGINT), 0) AS char_start, coalesce(CAST(sum(strlen(w)) OVER o AS BIGINT), 0) AS byte_start FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[{_WS}]*[^{_WS}]+') AS ws FROM documents)) WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.rough_tokens(F.col("text"))).alias("tok_idx", "original"))
    return frames.offsets(rough).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "char_start", "byte_start")


#: Kinds that a word's shape alone decides, as patterns that Java and RE2 read alike.
_SHAPES = [("WORD", r"\p{L}+"), ("YEAR", "(177[6-9]|17[89][0-9]|1[89][0-9]{2}|20[0-9]{2}|2100)"), ("TELNO", "[4-8][0-9]{2}-[0-9]{4}"), ("SERIALNUMBER", "[0-9]{3}-[0-9]{4}"), ("NUMBER", "[+-]?[0-9]+(,[0-9]{3})*"), ("EMAIL", r"[\p{L}0-9._-]+@[\p{L}0-9-]+(\.[\p{L}0-9-]+)+")]
_CASES = " ".join(f"WHEN regexp_full_match(w, '{p}') THEN '{k}'" for k, p in _SHAPES)


@query(f"SELECT lang, kind, count(*) AS n FROM (SELECT lang, CASE {_CASES} ELSE 'MIXED' END AS kind FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents)) GROUP BY lang, kind")
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexer's fast path as one expression: kinds that need nothing but a word's shape."""
    kind = F.lit("MIXED")
    for name, pattern in reversed(_SHAPES):
        kind = F.when(F.col("word").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return _words(spark, sf_dir).groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(replace(replace(text, 'e', 'e' || chr(173)), chr(173), '')) AS digest FROM documents")
def zero_width_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit("e"), F.lit("e­"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.drop_zero_width(broken)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def composite_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.col("text")
    for pair, letter in C.COMPOSED.items():
        split = F.replace(split, F.lit(letter), F.lit(pair))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.compose(split)).alias("digest"))


_NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("amp", "&")]
_UNESCAPED = "html"
for _n, _c in _NAMED:
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_n};', '{_c}')"


@query(f"SELECT page_id, md5({_UNESCAPED}) AS digest, CAST(length({_UNESCAPED}) AS BIGINT) AS n FROM pages")
def html_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = X.unescape_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n"))


@query("SELECT doc_id, md5('[[' || array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ']][[') || ']]') AS digest FROM documents")
def paragraphs_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.mark_paragraphs(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(string_split_regex(text, '\\n\\s*\\n')) AS BIGINT) AS n_parts FROM documents")
def hard_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"), F.size(X.hard_breaks(F.col("text"))).cast("long").alias("n_parts"))


@query("SELECT l_orderkey, l_linenumber, translate(printf('%.2f', l_extendedprice), '.,', ',.') AS shown FROM lineitem")
def icelandic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = X.icelandic_number(F.format_string("%.2f", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"))


_KT = "lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')"
_SUM = " + ".join(f"(ascii(substr(kt, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(C.SSN_WEIGHTS) if w)


@query(f"SELECT c_custkey, (11 - ({_SUM}) % 11) % 11 = ascii(substr(kt, 10, 1)) - 48 AS valid FROM (SELECT c_custkey, {_KT} || '-' || lpad(CAST((c_custkey * 37) % 10000 AS VARCHAR), 4, '0') AS kt FROM customer)")
def identity_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kt = F.concat(F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), F.lit("-"), F.lpad(((F.col("c_custkey") * 37) % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_ssn(kt).alias("valid"))


@query("SELECT range AS n, CAST(range AS INTEGER) AS value FROM range(1, 4000)")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    places = []
    for size, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        shown = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        places.append(F.element_at(F.array(*map(F.lit, shown)), (F.floor(n / size) % 10 + 1).cast("int")))
    return spark.range(1, 4000).select(n.alias("n"), X.roman_value(F.concat(*places)).alias("value"))


@query("SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) = 2 THEN day(o_orderdate) < 29 OR day(last_day(o_orderdate)) = 29 ELSE true END AS BOOLEAN) AS valid FROM orders")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_date(F.year(d), F.month(d), F.dayofmonth(d)).alias("valid"))


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS value FROM orders")
def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, C._MONTHS)), F.month("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.month_number(name).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


_FORMS = abbreviations.load()
_FORM_VALUES = ", ".join("('{}')".format(f.replace("'", "''")) for f in sorted({*_FORMS.right, *_FORMS.wrong}))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) WHERE word IN (SELECT * FROM (VALUES {_FORM_VALUES})) GROUP BY word")
def abbreviation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = abbreviations.table(spark).select("form").distinct()
    return _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(forms), F.col("word") == F.col("form")).select("word", "n")


# --- round trips from typed columns ------------------------------------------------------


def parsed(df: DataFrame, text: Column, keys: Sequence[str], kind: Kind, fields: Sequence[str], **options: Any) -> DataFrame:
    """The fields of the tokens of a kind in a text made from each row."""
    return frames.tokens_of_kinds(df.select(*keys, text.alias("text")), [kind], keys=keys, fields=fields, **options)


def _grouped(number: Column) -> Column:
    """A number with points for thousands and a comma before two decimals."""
    return X.icelandic_number(F.format_number(number, 2))


_YMD = "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders"


@query(_YMD)
def dates_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "'Sent 'yyyy-MM-dd'.'"), ["o_orderkey"], Kind.DATEABS, ("y", "mo", "d"))


@query(_YMD)
def dates_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "'Sent þann 'd.M.yyyy' í pósti.'"), ["o_orderkey"], Kind.DATEABS, ("y", "mo", "d"))


@query(_YMD)
def dates_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, C._MONTHS)), F.month("o_orderdate"))
    text = F.concat(F.lit("Pöntunin var send "), F.dayofmonth("o_orderdate"), F.lit(". "), month, F.lit(" "), F.year("o_orderdate"), F.lit("."))
    return parsed(table(spark, sf_dir, "orders"), text, ["o_orderkey"], Kind.DATEABS, ("y", "mo", "d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, 0 AS d FROM orders")
def months_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, C._MONTHS)), F.month("o_orderdate"))
    return parsed(table(spark, sf_dir, "orders"), F.concat(F.lit("Send í "), month, F.lit(" "), F.year("o_orderdate")), ["o_orderkey"], Kind.DATEREL, ("y", "mo", "d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS num FROM orders")
def years_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.concat(F.lit("Það gerðist árið "), F.year("o_orderdate"), F.lit(".")), ["o_orderkey"], Kind.YEAR, ("num",))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "events"), F.date_format("ts", "'Skráð 'd/M/yyyy' kl. 'HH:mm:ss"), ["event_id"], Kind.TIMESTAMPABS, ("y", "mo", "d", "h", "mi", "s"))


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, 0 AS s FROM events")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "events"), F.date_format("ts", "'Fundurinn hófst klukkan 'HH:mm' í dag.'"), ["event_id"], Kind.TIME, ("h", "mi", "s"))


@query("SELECT o_orderkey, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS num, 'EUR' AS unit FROM orders")
def amounts_with_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.concat(F.lit("Verðið er €"), _grouped(F.col("o_totalprice"))), ["o_orderkey"], Kind.AMOUNT, ("num", "unit"))


@query("SELECT o_orderkey, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS num, 'ISK' AS unit FROM orders")
def amounts_in_krona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.concat(F.lit("Hann greiddi "), _grouped(F.col("o_totalprice")), F.lit(" kr. Síðan fór hann.")), ["o_orderkey"], Kind.AMOUNT, ("num", "unit"))


@query("SELECT o_orderkey, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS num, 'USD' AS unit FROM orders")
def amounts_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "orders"), F.concat(F.lit("Verðið er USD "), _grouped(F.col("o_totalprice")), F.lit(" samtals")), ["o_orderkey"], Kind.AMOUNT, ("num", "unit"))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS num FROM lineitem")
def numbers_icelandic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "lineitem"), F.concat(F.lit("Talan "), _grouped(F.col("l_extendedprice")), F.lit(" er rétt.")), ["l_orderkey", "l_linenumber"], Kind.NUMBER, ("num",))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS num FROM lineitem")
def numbers_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "lineitem"), F.concat(F.lit("Talan "), F.format_number("l_extendedprice", 2), F.lit(" er rétt.")), ["l_orderkey", "l_linenumber"], Kind.NUMBER, ("num",))


@query("SELECT l_orderkey, l_linenumber, translate(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT) + 10000) || '.5', '.,', ',.') AS txt FROM lineitem")
def numbers_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Talan "), F.format_number(F.floor("l_extendedprice") + 10000, 0), F.lit(".5 er ný."))
    return parsed(table(spark, sf_dir, "lineitem"), text, ["l_orderkey", "l_linenumber"], Kind.NUMBER, ("txt",), convert_numbers=True)


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity) * 1.0e-3 AS num, 'kg' AS unit FROM lineitem")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "lineitem"), F.concat(F.lit("Pakkinn vó "), F.floor("l_quantity"), F.lit(" g í gær.")), ["l_orderkey", "l_linenumber"], Kind.MEASUREMENT, ("num", "unit"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS DOUBLE) + 273.15 AS num, 'K' AS unit FROM lineitem")
def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "lineitem"), F.concat(F.lit("Hitinn var "), F.floor("l_quantity"), F.lit("° C í gær.")), ["l_orderkey", "l_linenumber"], Kind.MEASUREMENT, ("num", "unit"))


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.1f', l_discount * 100) AS DOUBLE) AS num FROM lineitem")
def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Afslátturinn var "), X.icelandic_number(F.format_string("%.1f", F.col("l_discount") * 100)), F.lit("% þá."))
    return parsed(table(spark, sf_dir, "lineitem"), text, ["l_orderkey", "l_linenumber"], Kind.PERCENT, ("num",))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS DOUBLE) AS num FROM lineitem")
def percent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Þetta var "), F.floor("l_quantity"), F.lit(" prósent rétt"))
    return parsed(table(spark, sf_dir, "lineitem"), text, ["l_orderkey", "l_linenumber"], Kind.PERCENT, ("num",), coalesce_percent=True)


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS num FROM lineitem")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "lineitem"), F.concat(F.lit("Þetta er "), F.col("l_linenumber"), F.lit(". grein laganna.")), ["l_orderkey", "l_linenumber"], Kind.ORDINAL, ("num",))


@query("SELECT c_custkey, '5' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS telno, '354' AS cc FROM customer")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Síminn er 5"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("."))
    return parsed(table(spark, sf_dir, "customer"), text, ["c_custkey"], Kind.TELNO, ("telno", "cc"))


@query("SELECT c_custkey, 'nr' || c_custkey || '@' || lower(c_mktsegment) || '.is' AS txt FROM customer")
def email_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Sendu á nr"), F.col("c_custkey"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".is, takk."))
    return parsed(table(spark, sf_dir, "customer"), text, ["c_custkey"], Kind.EMAIL, ("txt",))


@query("SELECT c_custkey, lower(c_mktsegment) || c_custkey || '.is' AS txt FROM customer")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Sjá "), F.lower("c_mktsegment"), F.col("c_custkey"), F.lit(".is."))
    return parsed(table(spark, sf_dir, "customer"), text, ["c_custkey"], Kind.DOMAIN, ("txt",))


@query("SELECT o_orderkey, unnest([0, 1, 2]) AS sent_idx FROM orders")
def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Pöntun "), F.col("o_orderkey"), F.lit(" var send. Hún kostaði "), _grouped(F.col("o_totalprice")), F.lit(" kr. Henni var skilað!"))
    return frames.sentences(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), keys=["o_orderkey"]).select("o_orderkey", "sent_idx")


@query("SELECT p_partkey, 'Vara númer ' || p_partkey || ', (' || p_size || ') er hér!' AS corrected FROM part")
def spaces_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Vara  númer "), F.col("p_partkey"), F.lit(" ,  ( "), F.col("p_size"), F.lit(" )   er hér !"))
    return frames.corrected(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), keys=["p_partkey"])


@query("SELECT p_partkey, 'Vara númer ' || p_partkey || ', „' || p_size || '“ er hér!' AS respaced FROM part")
def texts_respaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Vara númer "), F.col("p_partkey"), F.lit(', "'), F.col("p_size"), F.lit('" er hér!'))
    return frames.respaced(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), keys=["p_partkey"], normalize=True)


@query("SELECT n_nationkey, unnest(['6,\"Landið\",\"\",\"Landið\",\"0-1-2-3-4-5\"', '5,\"' || n_nationkey || '\",' || CASE n_nationkey WHEN 0 THEN '\"\"' ELSE CAST(n_nationkey AS VARCHAR) END || ',\" ' || n_nationkey || '\",\"' || CASE WHEN n_nationkey < 10 THEN '1' ELSE '1-2' END || '\"', '0,\"\",\"\",\"\",\"\"']) AS value FROM nation")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Landið "), F.col("n_nationkey")).alias("text"))
    return frames.lines(texts, "csv", keys=["n_nationkey"]).select("n_nationkey", "value")


@query('SELECT n_nationkey, unnest([\'{"k":"BEGIN SENT"}\', \'{"k":"NUMBER","t":"\' || (n_nationkey + 10) || \'","v":\' || (n_nationkey + 10) || \',"o":"\' || (n_nationkey + 10) || \'","s":[0,1]}\', \'{"k":"END SENT"}\']) AS value FROM nation')
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 10).cast("string").alias("text"))
    return frames.lines(texts, "json", keys=["n_nationkey"]).select("n_nationkey", "value")


@query(f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(len({_WORDS})) AS BIGINT) AS n_words FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the chunks of one document, and the words that they are cut into."""
    whole = frames.chunked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")
    raw = frames.raw_tokens(whole.withColumn("n_chunks", F.size("text").cast("long")), keys=["conv_id", "n_chunks"])
    return raw.groupBy("conv_id", "n_chunks").agg(F.count_if(F.col("txt") != "").alias("n_words"))


@query("SELECT lang, CAST(sum(len(" + _WORDS + ")) AS BIGINT) AS n_words FROM documents GROUP BY lang")
def streamed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files through the same expressions; the sink is read back."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    words = stream.select("lang", F.size(X.words(F.col("text"))).alias("n"))
    run = words.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("lang").agg(F.sum("n").alias("n_words"))


# --- whole documents through all phases ------------------------------------------------------


@query()
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each kind per language, by full tokenization."""
    return frames.kind_counts(table(spark, sf_dir, "documents"), keys=["lang"]).groupBy("lang", "kind_name").agg(F.sum("n").alias("n"))


@query()
def lexed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexer's tokens of each kind, from the vocabulary and its counts alone."""
    rows = frames.lexed_vocabulary(table(spark, sf_dir, "documents"), fields=("kind_name",))
    return rows.groupBy("kind_name").agg(F.sum("n").alias("n"))


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.vocabulary(table(spark, sf_dir, "documents"))


@query()
def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = frames.kind_counts(table(spark, sf_dir, "documents"), keys=["source", "lang"]).groupBy("source", "lang", "kind_name").agg(F.sum("n").alias("n"))
    return counted.rollup("lang", "kind_name").agg(F.sum("n").alias("n"), F.countDistinct("source").alias("sources"))


@query()
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sentences(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


@query("SELECT doc_id, md5(rtrim(text, chr(10) || ' ')) AS digest FROM documents")
def originals_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens' originals put together are the text."""
    rows = frames.token_arrays(table(spark, sf_dir, "documents"), fields=("original",))
    whole = F.array_join(F.transform("tokens", lambda t: F.coalesce(t["original"], F.lit(""))), "")
    return rows.select("doc_id", F.md5(F.rtrim(whole, F.lit("\n "))).alias("digest"))


@query()
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "documents").select("doc_id", X.mark_paragraphs(F.col("text")).alias("text"))
    return frames.paragraphs(marked, fields=["para_idx"]).groupBy("doc_id").agg(F.countDistinct("para_idx").alias("n_paragraphs"), F.count("*").alias("n_sentences"))


@query()
def documents_respaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.respaced(table(spark, sf_dir, "documents")).select("doc_id", F.md5("respaced").alias("digest"))


# --- fixed inputs -------------------------------------------------------------------------------


def _values(rows: list[tuple], name: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({k}, {quote(e)})' for k, _, e in rows)}) t(case_id, {name})"


def _inputs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t, _ in rows], "case_id int, text string")


@query(_values(fixtures.TOKENS, "found"))
def fixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.tokens(_inputs(spark, fixtures.TOKENS), keys=["case_id"], fields=("kind_name", "txt"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "tok_idx", F.concat_ws(":", "kind_name", "txt").alias("x")))), lambda r: r["x"])
    return rows.groupBy("case_id").agg(F.array_join(shown, " + ").alias("found"))


@query(_values(fixtures.KINDS, "kinds"))
def fixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.create_map(*[F.lit(x) for k, n in fixtures.LETTERS.items() for x in (int(Kind[n]), k)])
    rows = frames.token_arrays(_inputs(spark, fixtures.KINDS), keys=["case_id"], fields=("kind",))
    return rows.select("case_id", F.array_join(F.transform("tokens", lambda t: F.element_at(letters, t["kind"])), " ").alias("kinds"))


@query(_values(fixtures.NORMAL, "norm"))
def fixed_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.token_arrays(_inputs(spark, fixtures.NORMAL), keys=["case_id"], fields=("txt", "norm"))
    shown = F.filter(F.transform("tokens", lambda t: F.coalesce(t["norm"], t["txt"])), lambda x: x != "")
    return rows.select("case_id", F.array_join(shown, " ").alias("norm"))


@query(_values(fixtures.SPACES, "corrected"))
def fixed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.corrected(_inputs(spark, fixtures.SPACES), keys=["case_id"])


@query(_values(fixtures.SENTENCES, "sentences"))
def fixed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.sentences(_inputs(spark, fixtures.SENTENCES), keys=["case_id"])
    shown = F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda r: r["sentence"])
    return rows.groupBy("case_id").agg(F.array_join(shown, " | ").alias("sentences"))


@query(_values(fixtures.SENTENCES, "sentences"))
def sql_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, through the table function of the SQL surface."""
    from .. import sql

    sql.register(spark)
    _inputs(spark, fixtures.SENTENCES).createOrReplaceTempView("fixed_inputs")
    rows = spark.sql("SELECT i.case_id, s.sent_idx, s.sentence FROM fixed_inputs i, LATERAL sentences(i.text) s")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda r: r["sentence"])
    return rows.groupBy("case_id").agg(F.array_join(shown, " | ").alias("sentences"))


__all__ = ["ORACLES", "QUERIES", "streams"]
