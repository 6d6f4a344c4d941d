"""Tokenizing streams of documents, whole or in chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import frames
from ..operators.engine import Options, engine

_BREAK = re.compile(r"\n\s*\n")


def tokens(stream: DataFrame, **options: Any) -> DataFrame:
    """As frames.tokens: nothing is kept between rows, so streams run in append mode."""
    return frames.tokens(stream, **options)


def sentences(stream: DataFrame, **options: Any) -> DataFrame:
    return frames.sentences(stream, **options)


def chunk_sentences(stream: DataFrame, idle: str = "10 minutes", **options: Any) -> DataFrame:
    """(doc_id, sent_idx, sentence) from a stream of (doc_id, chunk_no, chunk, ts).

    What stands before a document's last empty line is tokenized when the empty
    line has come; the rest is kept until more chunks come, an empty chunk asks
    for it, or the document has been idle. Chunks of one trigger go in the order
    of chunk_no.
    """
    chosen = Options.of(options)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, count = state.get if state.exists else ("", 0)
        flush = state.hasTimedOut
        if not flush:
            for chunk in pd.concat(list(batches)).sort_values("chunk_no")["chunk"]:
                held += "\n\n" if chunk == "" else chunk or ""
        cut = len(held) if flush else max((m.end() for m in _BREAK.finditer(held)), default=0)
        found = engine(chosen).sentences(held[:cut])
        held, first = held[cut:], count
        count += len(found)
        if flush and not held:
            state.remove()
        else:
            state.update((held, count))
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"doc_id": [key[0]] * len(found), "sent_idx": range(first, count), "sentence": found}).astype({"doc_id": "int64", "sent_idx": "int32"})

    return stream.select(F.col("doc_id").cast("long"), "chunk_no", "chunk").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, sent_idx int, sentence string", "held string, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def counts(stream: DataFrame, time: str = "ts", watermark: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events per window and group; late ones count up to the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, watermark).groupBy(window, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
