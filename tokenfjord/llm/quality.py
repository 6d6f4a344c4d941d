"""Quality by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs: one marked good is preferred to one
marked bad. The utility is linear in a document's features, and the logistic
loss of the pairs' feature differences is minimised. The cut is a quantile of
the training utilities: as large a share lies below it as the labels mark bad.
A score is the logistic function of the distance to the cut.

The fit uses at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their
doc_id, and ``PAIRS`` pairs drawn from them with a fixed seed; these are its
documented bounds. Every document is scored, whole.

Defined results: null and blank texts have zero features and a score like any
other; conflicting labels of a doc_id count by their mean; rows without a
doc_id are not held out and never learnt from; without labels of both kinds
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

TRAIN_ROWS = 6000
PAIRS = 30_000
ROUNDS = 400
RIDGE = 1e-3
FEATURES = ("symbols", "digits", "capitals", "stops", "bars", "bangs", "spaces", "high", "word_length", "distinct", "repeats", "marked", "capital_words", "size", "letters", "short")
_KINDS = np.zeros((256, 8), np.float64)
for _name, _chars in enumerate(("*#$%&@^~<>{}[]=+_\\", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:", "|", "!?", " \t\n\r", "")):
    _KINDS[[ord(c) for c in _chars], _name] = 1
_KINDS[128:, 7] = 1
_EDGE = b".,;:!?\"'()"
#: Words whose stripped forms are held at a time.
_BLOCK = 1 << 12


def features(text: bytes) -> np.ndarray:
    """What the score sees of a text; rates, so that a text's length matters little."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:8] = counts @ _KINDS / len(text)
    n = len(words)
    out[8] = min(30.0, (len(text) - n) / n) / 10
    out[9] = len(set(words)) / n ** 0.8
    out[10] = sum(map(bytes.__eq__, words, words[1:])) / n
    for at in range(0, n, _BLOCK):
        bare = [w.strip(_EDGE) for w in words[at : at + _BLOCK]]
        out[11] += sum(not (w.isalnum() or w[-1:] >= b"\x80" or not w) for w in bare)
        out[12] += sum(len(w) > 1 and w.isupper() for w in bare)
    out[11:13] /= n
    out[13] = np.log1p(n) / 10
    out[14] = (counts[97:123].sum() + counts[128:].sum()) / len(text)
    out[15] = n < 20
    return out


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``rest``; false for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def training_ids(labels: DataFrame, label: str, modulus: int, rest: int, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled rows that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    marked = marked.where(~held_out(F.col("doc_id"), modulus, rest)).groupBy("doc_id").agg(F.avg("label").alias("label"))
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [features(x).tolist() for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit_pairs(x: np.ndarray, good: np.ndarray) -> dict:
    """Bradley-Terry weights of the features, the cut and the scale of the utility."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / spread
    up, down = z[good], z[~good]
    draw = np.random.default_rng(7)
    pairs = up[draw.integers(0, len(up), PAIRS)] - down[draw.integers(0, len(down), PAIRS)]
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        lost = 1 / (1 + np.exp(np.clip(pairs @ w, -30, 30)))
        speed = 0.9 * speed + 0.1 * (pairs.T @ lost / PAIRS - RIDGE * w)
        w += speed
    utility = z @ w
    cut = float(np.quantile(utility, (~good).mean()))
    return {"mean": mean, "spread": spread, "w": w, "cut": cut}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, rest: int = 1, most: int = TRAIN_ROWS) -> dict | None:
    """The model, or None if the labels name no document or one kind only."""
    wanted = training_ids(labels, label, modulus, rest, most)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.join(F.broadcast(wanted), "doc_id").mapInArrow(_fit_batches, "doc_id long, label double, x array<double>")
    rows = found.groupBy("doc_id").agg(F.max(F.struct("label", "x")).alias("r")).select("doc_id", "r.*").collect()  # TRAIN_ROWS at most
    rows.sort(key=lambda r: r["doc_id"])
    good = np.array([r["label"] >= 0.5 for r in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return None
    return fit_pairs(np.array([r["x"] for r in rows]), good)


def scores(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    utility = (x - model["mean"]) / model["spread"] @ model["w"]
    return 1 / (1 + np.exp(-np.clip(utility - model["cut"], -30, 30)))


def score(docs: DataFrame, model: dict | None, modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t) for t in texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(x, shared.value).round(6))], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t) for t in texts(batch.column("text"))])
            yield batch.filter(pa.array(scores(x, shared.value).round(6) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
