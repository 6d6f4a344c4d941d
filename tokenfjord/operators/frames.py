"""Tokenizing DataFrames.

Documents are independent, so nothing here shuffles: one Arrow-batched pass over
the rows tokenizes them, with an engine per worker that lexes each distinct raw
token once. Python can't be pruned by Catalyst, so callers name the fields they
want and only those are built.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .engine import Engine, Options, engine, shown
from .spacing import correct_spaces, detokenize
from .tokens import BEGINS, ENDS, Kind, Token, kind_name

#: Rows of one Arrow batch that leaves a worker; bytes of text and texts taken at once.
OUT_ROWS, IN_BYTES, IN_ROWS = 20_000, 1 << 20, 10_000
#: Texts of at most so many characters are tokenized once in a task while they
#: are among so many different ones.
SHORT, MOST_SHORT = 100, 20_000

MEANING = pa.struct([("stofn", pa.string()), ("utg", pa.int32()), ("ordfl", pa.string()), ("fl", pa.string()), ("ordmynd", pa.string()), ("beyging", pa.string())])
_DATES = {Kind.DATEABS, Kind.DATEREL, Kind.DATE}
_STAMPS = {Kind.TIMESTAMPABS, Kind.TIMESTAMPREL, Kind.TIMESTAMP}


def _number(t: Token) -> float | None:
    if t.kind in (Kind.NUMBER, Kind.PERCENT, Kind.YEAR, Kind.ORDINAL):
        return float(t.val)
    if t.kind in (Kind.AMOUNT, Kind.NUMWLETTER):
        return float(t.val[0])
    return float(t.val[1]) if t.kind == Kind.MEASUREMENT else None


def _unit(t: Token) -> str | None:
    if t.kind in (Kind.AMOUNT, Kind.NUMWLETTER):
        return t.val[1]
    return t.val[0] if t.kind == Kind.MEASUREMENT else t.val if t.kind == Kind.CURRENCY else None


def _date_part(k: int) -> Callable[[Token], int | None]:
    return lambda t: t.val[k] if t.kind in _DATES or t.kind in _STAMPS else None


def _time_part(k: int) -> Callable[[Token], int | None]:
    return lambda t: t.val[k] if t.kind == Kind.TIME else t.val[k + 3] if t.kind in _STAMPS else None


#: Field name: Arrow type, and its value in a token.
FIELDS: dict[str, tuple[pa.DataType, Callable[[Token], Any]]] = {
    "kind": (pa.int32(), lambda t: int(t.kind)),
    "kind_name": (pa.string(), lambda t: kind_name(t.kind)),
    "txt": (pa.string(), lambda t: t.txt),
    "norm": (pa.string(), lambda t: t.val[1] if t.kind == Kind.PUNCTUATION else None),
    "tp": (pa.int32(), lambda t: t.val[0] if t.kind == Kind.PUNCTUATION else None),
    "num": (pa.float64(), _number),
    "is_int": (pa.bool_(), lambda t: isinstance(t.val, int) if t.kind in (Kind.NUMBER, Kind.PERCENT) else None),
    "unit": (pa.string(), _unit),
    "y": (pa.int32(), _date_part(0)),
    "mo": (pa.int32(), _date_part(1)),
    "d": (pa.int32(), _date_part(2)),
    "h": (pa.int32(), _time_part(0)),
    "mi": (pa.int32(), _time_part(1)),
    "s": (pa.int32(), _time_part(2)),
    "telno": (pa.string(), lambda t: t.val[0] if t.kind == Kind.TELNO else None),
    "cc": (pa.string(), lambda t: t.val[1] if t.kind == Kind.TELNO else None),
    "username": (pa.string(), lambda t: t.val if t.kind == Kind.USERNAME else None),
    "meanings": (pa.list_(MEANING), lambda t: [dict(zip(("stofn", "utg", "ordfl", "fl", "ordmynd", "beyging"), m, strict=True)) for m in t.val] if t.kind == Kind.WORD and t.val else None),
    "original": (pa.string(), lambda t: t.original),
    "origin_spans": (pa.list_(pa.int32()), lambda t: t.spans),
}
_SQL = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(MEANING): "array<struct<stofn:string,utg:int,ordfl:string,fl:string,ordmynd:string,beyging:string>>"}
PLACES = ("para_idx", "sent_idx", "tok_idx")

Rows = list[tuple]
#: Below so many bytes a core, rows are dealt out before they are tokenized: a
#: small file is one task otherwise, and tokenizing costs far more than a shuffle.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Small inputs over all cores; large ones as they are read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if cores > 1 and size < cores * SPREAD_BYTES else df


def per_text(df: DataFrame, text: str, keys: Sequence[str], columns: list[tuple[str, str, pa.DataType | Callable[[Sequence], pa.Array]]], rows: Callable[[Any], Iterable[tuple]], chunks: bool = False) -> DataFrame:
    """Key columns, and the columns of the rows that each text gives; ``columns`` has (name, SQL type, Arrow type).

    A null text gives no rows. With ``chunks`` the column holds arrays of strings.
    In place of an Arrow type a column may have a function that makes the array
    of its values. What a text gives depends on nothing else, so short texts that
    come again, as those made from a column of few values, are not tokenized again.
    """
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), *T.StructType.fromDDL(", ".join(f"`{n}` {s}" for n, s, _ in columns)).fields])
    names = [*keys, *(n for n, _, _ in columns)]
    key_names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rows] = {}
        seen, most = 0, MOST_SHORT

        def short(value: str) -> Rows:
            nonlocal most
            made = list(rows(value))
            if len(known) >= most:
                known.clear()
                most = MOST_SHORT if seen > 2 * MOST_SHORT else 0  # texts that hardly come again aren't worth it
            if most:
                known[value] = made
            return made

        for whole in batches:
            step = max(1, min(IN_ROWS, whole.num_rows * IN_BYTES // max(1, whole.column(text).nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                seen += batch.num_rows
                owner: list[int] = []
                found: Rows = []

                def out() -> pa.RecordBatch:
                    values = list(zip(*found, strict=True)) if found else [[]] * len(columns)
                    place = pa.array(owner, pa.int64())
                    kept = [batch.column(k).take(place) for k in key_names]
                    return pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) if isinstance(t, pa.DataType) else t(v) for v, (_, _, t) in zip(values, columns, strict=True))], names)

                for k, value in enumerate(batch.column(text).to_pylist()):
                    if value is None:
                        continue
                    if isinstance(value, str) and len(value) <= SHORT:
                        made = known.get(value)
                        if made is None:
                            made = short(value)
                        found += made
                        owner += [k] * len(made)
                        if len(found) >= OUT_ROWS:
                            yield out()
                            owner, found = [], []
                        continue
                    for row in rows(value):
                        found.append(row)
                        owner.append(k)
                        if len(found) >= OUT_ROWS:
                            yield out()
                            owner, found = [], []
                if found:
                    yield out()

    picked = [F.col(f"`{k}`") for k in dict.fromkeys([*keys, text])]
    return spread(df.select(*picked)).mapInArrow(run, schema)


def numbered(tokens: Iterable[Token]) -> Iterator[tuple[int, int, int, Token]]:
    """(paragraph, sentence, token) numbers of the tokens that have text, all from 0."""
    paragraph, sentence, place, opened = 0, -1, 0, False
    for t in tokens:
        if t.kind == Kind.S_BEGIN:
            sentence, place = sentence + 1, 0
        elif t.kind in (Kind.P_BEGIN, Kind.P_END):
            paragraph, opened = paragraph + opened, False
        elif t.kind not in ENDS and t.txt:
            yield paragraph, sentence, place, t
            place, opened = place + 1, True


def tokens(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), fields: Sequence[str] = tuple(FIELDS), chunks: bool = False, **options: Any) -> DataFrame:
    """One row per token: keys, para_idx, sent_idx, tok_idx and the named fields."""
    chosen = Options.of(options)
    getters = [FIELDS[f][1] for f in fields]
    columns = [(p, "int", pa.int32()) for p in PLACES] + [(f, _SQL[FIELDS[f][0]], FIELDS[f][0]) for f in fields]

    def rows(value: Any) -> Iterator[tuple]:
        for p, s, k, t in numbered(engine(chosen).tokenize(value)):
            yield (p, s, k, *(g(t) for g in getters))

    return per_text(df, text, keys, columns, rows, chunks)


def tokens_of_kinds(df: DataFrame, kinds: Sequence[int], text: str = "text", keys: Sequence[str] = ("doc_id",), fields: Sequence[str] = ("txt",), **options: Any) -> DataFrame:
    """One row per token of certain kinds: keys and the named fields, without places."""
    chosen, wanted = Options.of(options), frozenset(map(int, kinds))
    getters = [FIELDS[f][1] for f in fields]

    def rows(value: Any) -> list[tuple]:
        return [tuple([g(t) for g in getters]) for t in engine(chosen).of_kinds(value, wanted)]

    return per_text(df, text, keys, [(f, _SQL[FIELDS[f][0]], FIELDS[f][0]) for f in fields], rows)


def kind_counts(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), **options: Any) -> DataFrame:
    """(keys, kind_name, n): the number of tokens of each kind in each text."""
    chosen = Options.of(options)

    def rows(value: Any) -> list[tuple]:
        found = Counter([t.kind for t in engine(chosen).tokenize(value) if t.txt])
        return [(kind_name(k), n) for k, n in found.items() if k not in ENDS and k not in BEGINS]

    return per_text(df, text, keys, [("kind_name", "string", pa.string()), ("n", "long", pa.int64())], rows)


def _struct_lists(fields: Sequence[str]) -> Callable[[Sequence[list[Token]]], pa.Array]:
    """An array of lists of structs from lists of tokens, field by field."""
    types, getters = [FIELDS[f][0] for f in fields], [FIELDS[f][1] for f in fields]

    def make(lists: Sequence[list[Token]]) -> pa.Array:
        flat = [t for found in lists for t in found]
        ends = [0, *itertools.accumulate(map(len, lists))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([g(t) for t in flat], kind) for g, kind in zip(getters, types, strict=True)], list(fields)))

    return make


def token_arrays(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), fields: Sequence[str] = ("kind", "txt", "norm"), **options: Any) -> DataFrame:
    """One row per text with its tokens, sentence and paragraph marks included, as an array of structs."""
    chosen = Options.of(options)
    sql = f"array<struct<{','.join(f'{f}:{_SQL[FIELDS[f][0]]}' for f in fields)}>>"

    def rows(value: Any) -> Iterator[tuple]:
        yield (engine(chosen).tokenize(value),)

    return per_text(df, text, keys, [("tokens", sql, _struct_lists(fields))], rows)


def lexed(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), fields: Sequence[str] = ("kind", "txt", "original"), **options: Any) -> DataFrame:
    """The lexer's tokens alone, before any rule over the sequence."""
    chosen = Options.of(options)
    columns = [("tok_idx", "int", pa.int32())] + [(f, _SQL[FIELDS[f][0]], FIELDS[f][0]) for f in fields]

    def rows(value: Any) -> Iterator[tuple]:
        for k, t in enumerate(engine(chosen).parse_tokens(value)[:-1]):
            yield (k, *(FIELDS[f][1](t) for f in fields))

    return per_text(df, text, keys, columns, rows)


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the distinct words between white space, and how often they come."""
    words = F.explode(X.words(X.normalise(F.col(f"`{text}`"))))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lexed_vocabulary(df: DataFrame, text: str = "text", fields: Sequence[str] = ("kind", "txt"), **options: Any) -> DataFrame:
    """(word, n, tok_idx, fields): the lexer's tokens of each distinct word, once.

    Lexing a word depends on nothing around it, so lexer-level statistics need
    Python for the vocabulary only; the corpus itself is cut and counted by
    built-in expressions, with partial counts before the shuffle.
    """
    counted = vocabulary(df, text).withColumn("text", F.col("word"))
    return lexed(counted, "text", ["word", "n"], fields, **options)


def raw_tokens(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), **options: Any) -> DataFrame:
    """(keys, tok_idx, kind, txt, original): words between white space and the marks of breaks."""
    chosen = Options.of(options)
    columns = [("tok_idx", "int", pa.int32()), ("kind", "int", pa.int32()), ("txt", "string", pa.string()), ("original", "string", pa.string())]

    def rows(value: Any) -> Iterator[tuple]:
        for k, t in enumerate(engine(chosen).raw(value)):
            yield k, int(t.kind), t.txt, t.original

    return per_text(df, text, keys, columns, rows)


def sentences(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), **options: Any) -> DataFrame:
    """(keys, sent_idx, sentence): shallow tokenization."""
    chosen = Options.of(options)

    def rows(value: Any) -> Iterator[tuple]:
        yield from enumerate(engine(chosen).sentences(value))

    return per_text(df, text, keys, [("sent_idx", "int", pa.int32()), ("sentence", "string", pa.string())], rows)


def paragraphs(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), fields: Sequence[str] = ("para_idx", "sent_no", "begin_idx", "sentence"), **options: Any) -> DataFrame:
    """(keys, para_idx, sent_no, begin_idx, sentence), or some of these: paragraphs' sentences; those of punctuation only are left out."""
    from .engine import paragraphs as grouped
    from .engine import text_from_tokens

    chosen = Options.of(options)
    columns = [("para_idx", "int", pa.int32()), ("sent_no", "int", pa.int32()), ("begin_idx", "int", pa.int32()), ("sentence", "string", pa.string())]
    places, shown_too = [i for f in fields for i, c in enumerate(columns) if c[0] == f], "sentence" in fields

    def rows(value: Any) -> Iterator[tuple]:
        for p, found in enumerate(grouped(engine(chosen).tokenize(value))):
            for k, (begin, sentence) in enumerate(found):
                whole = p, k, begin, text_from_tokens(sentence) if shown_too else None
                yield tuple([whole[i] for i in places])

    return per_text(df, text, keys, [columns[i] for i in places], rows)


def respaced(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), normalize: bool = False, **options: Any) -> DataFrame:
    """(keys, respaced): tokenized and put together again with proper spaces."""
    chosen = Options.of(options)

    def rows(value: Any) -> Iterator[tuple]:
        yield (detokenize(engine(chosen).tokenize(value), normalize),)

    return per_text(df, text, keys, [("respaced", "string", pa.string())], rows)


def corrected(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, corrected): the text with the spaces between words and marks put right."""
    return per_text(df, text, keys, [("corrected", "string", pa.string())], lambda value: [(correct_spaces(value),)])


def offsets(token_rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token rows with char_start and byte_start, where each token's original begins in its text."""
    before = Window.partitionBy(*keys).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"{name}_start": F.coalesce(F.sum(size(F.col("original"))).over(before), F.lit(0)).cast("long") for name, size in (("char", F.length), ("byte", F.octet_length))}
    return token_rows.withColumns(starts)


def chunked(df: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "chunk_no", chunk: str = "chunk") -> DataFrame:
    """(keys, text): the chunks of each document in order, as an array that the functions above take as one text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(chunk).alias("c"))))
    return df.where(F.col(chunk).isNotNull()).groupBy(*keys).agg(F.transform(parts, lambda p: p["c"]).alias("text"))


# --- lines of the command's outputs ----------------------------------------------------------


def _shown_value(t: Token) -> Any:
    if t.kind == Kind.WORD:
        return [m[0] for m in t.val] if t.val is not None else None
    if t.kind == Kind.PUNCTUATION:
        return t.val[1]
    return list(t.val) if isinstance(t.val, tuple) else t.val


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def csv_line(t: Token) -> str | None:
    """kind, text, value, original and spans; a line of its own for a sentence's end."""
    if not t.txt:
        return '0,"","","",""' if t.kind == Kind.S_END else None
    value = _shown_value(t)
    if isinstance(value, list):
        value = _quoted("|".join(map(str, value)))
    elif isinstance(value, str):
        value = _quoted(value) if t.kind != Kind.CURRENCY else value
    spans = "[]" if t.spans is None else _quoted("-".join(map(str, t.spans)))
    return f"{int(t.kind)},{_quoted(t.txt)},{value or _quoted('')},{_quoted('' if t.original is None else t.original)},{spans}"


def json_line(t: Token) -> str:
    """k: kind, t: text, v: value, o: original, s: spans; what is missing is left out."""
    value = _shown_value(t)
    found = {"k": kind_name(t.kind)} | ({"t": t.txt} if t.txt else {}) | ({} if value is None else {"v": value})
    found |= ({} if t.original is None else {"o": t.original}) | ({} if t.spans is None else {"s": t.spans})
    return json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def output_lines(found: Iterable[Token], form: str = "text", original: bool = False, normalize: bool = False) -> Iterator[str]:
    """The lines that the command prints for tokens, as text, csv or json."""
    if form in ("csv", "json"):
        for t in found:
            line = csv_line(t) if form == "csv" else json_line(t)
            if line is not None:
                yield line
        return
    current: list[str] = []
    glue = "" if original and not normalize else " "
    for t in found:
        if t.kind in ENDS:
            if current:
                yield glue.join(current)
            current = []
        show = t.original or "" if original and not normalize else shown(t, normalize=normalize)
        if show and t.kind not in BEGINS:
            current.append(show)
    if current:
        yield glue.join(current)


def lines(df: DataFrame, form: str = "text", text: str = "text", keys: Sequence[str] = ("doc_id",), **options: Any) -> DataFrame:
    """(keys, line_no, value): the command's output lines of each text."""
    chosen = Options.of(options)

    def rows(value: Any) -> Iterator[tuple]:
        yield from enumerate(output_lines(engine(chosen).tokenize(value), form, chosen.original, chosen.normalize))

    return per_text(df, text, keys, [("line_no", "int", pa.int32()), ("value", "string", pa.string())], rows)


__all__ = ["FIELDS", "Engine", "Options", "chunked", "corrected", "kind_counts", "lexed", "lexed_vocabulary", "lines", "offsets", "paragraphs", "raw_tokens", "respaced", "sentences", "token_arrays", "tokens", "tokens_of_kinds", "vocabulary"]
