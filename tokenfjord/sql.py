"""SQL surface: table functions and scalar functions for a session."""

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@functools.cache
def _options(names: str | None):  # noqa: ANN202
    """Options from names apart by commas; ``no_`` before a name switches it off, ``name=value`` sets it."""
    from .operators.engine import Options

    found: dict = {}
    for name in filter(None, (n.strip() for n in (names or "").split(","))):
        key, given, value = name.partition("=")
        found[key.removeprefix("no_")] = value if given else not key.startswith("no_")
    unknown = found.keys() - Options.__dataclass_fields__.keys()
    if unknown:
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    return Options.of(found)


@F.udtf(returnType="para_idx int, sent_idx int, tok_idx int, kind int, kind_name string, txt string, norm string, num double, unit string")
class TokenTable:
    """``SELECT t.* FROM docs, LATERAL tokenize(text, 'convert_numbers,no_replace_composite_glyphs') t``"""

    def eval(self, text: str, options: str = "") -> Iterator[tuple]:
        from .operators.engine import engine
        from .operators.frames import FIELDS, numbered

        if text is not None:
            get = [FIELDS[f][1] for f in ("kind", "kind_name", "txt", "norm", "num", "unit")]
            for p, s, k, t in numbered(engine(_options(options)).tokenize(text)):
                yield (p, s, k, *(g(t) for g in get))


@F.udtf(returnType="sent_idx int, sentence string")
class SentenceTable:
    """``SELECT s.* FROM docs, LATERAL sentences(text, 'one_sent_per_line') s``"""

    def eval(self, text: str, options: str = "") -> Iterator[tuple]:
        from .operators.engine import engine

        if text is not None:
            yield from enumerate(engine(_options(options)).sentences(text))


def _each(texts: pd.Series, apply: Callable[[str], str]) -> pd.Series:
    return pd.Series([None if x is None else apply(x) for x in texts])


@F.pandas_udf(StringType())
def correct_spaces(texts: pd.Series) -> pd.Series:
    from .operators import spacing

    return _each(texts, spacing.correct_spaces)


@F.pandas_udf(StringType())
def tidy(texts: pd.Series) -> pd.Series:
    """Tokenized and put together again, with normal forms of punctuation."""
    from .operators import engine, spacing

    return _each(texts, lambda x: spacing.detokenize(engine.tokenize(x), normalize=True))


def register(spark: SparkSession) -> None:
    """tokenize and sentences as table functions, with options as a second argument; correct_spaces and tidy as functions of a text."""
    spark.udtf.register("tokenize", TokenTable)
    spark.udtf.register("sentences", SentenceTable)
    spark.udf.register("correct_spaces", correct_spaces)
    spark.udf.register("tidy", tidy)
