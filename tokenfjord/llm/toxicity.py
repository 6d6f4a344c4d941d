"""Toxicity by weak supervision.

Many voters look at a text: each entry of a lexicon (whole words, and word
beginnings that carry the meaning in other languages) votes where it is dense
enough, and patterns vote on the density of all entries and on repeats of one.
A generative label model estimates by expectation maximisation how often each
voter fires on toxic and on other texts; the correlations that are left between
voters given the class are measured from the residuals, and correlated voters
share one vote. The given labels say where the rates start and no more: they
have no vote in a posterior. A linear classifier is trained on the posterior
labels and scores every document.

The lexicon is read off at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of
their doc_id, and so is the fit; that is their documented bound. Every document
is scored, whole.

Defined results: null and blank texts fire no voter and get the lowest score
class; conflicting labels count by their mean; rows without a doc_id are not
held out and never learnt from; without a toxic label every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, texts
from .quality import held_out, training_ids

TRAIN_ROWS = 6000
MODULUS, REST, CUT = 4, 2, 0.3
#: Lexicon entries at most, letters of a word beginning, toxic texts an entry must occur in, and its least odds.
ENTRIES = 64
BEGINNINGS = range(3, 9)
LEAST_TEXTS = {"word": 5, "beginning": 2}
LEAST_ODDS = 12.0
ROUNDS = 40
#: Texts that a voter's start counts for, and the correlation from which on voters share a vote.
PRIOR, CORRELATED = 500.0, 0.3
#: Hits a word from which on an entry votes, and those of all entries at which patterns do; hits of one entry that make a repeat.
DENSE, DENSITIES, REPEATS = 0.002, (0.004, 0.006, 0.008, 0.01, 0.013, 0.017), (2, 3)
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: bytes) -> str:
    """Lower-case words of letters between single spaces or more, with a space at both ends."""
    return f" {text.decode().lower().encode().translate(_LETTERS).decode()} "


def grams(text: bytes) -> set[str]:
    """The lexicon entries a text speaks for: its words, and beginnings that two of them share."""
    words = normal(text).split()
    starts = Counter(w[:n] for w in words for n in BEGINNINGS if n <= len(w))
    return {f" {w} " for w in words} | {f" {w}" for w, n in starts.items() if n > 1}


def choose(counted: list[tuple[str, int, float]]) -> list[str]:
    """Entries from (entry, toxic texts, odds), the most telling first.

    A beginning covers what its extensions would, so of two entries one of which
    begins the other only the more telling is taken.
    """
    chosen: list[str] = []
    for g, n, odds in sorted(counted, key=lambda x: (-x[1] * np.log(x[2]), x[0])):
        if len(chosen) < ENTRIES and not any(g.startswith(c) or c.startswith(g) for c in chosen):
            chosen.append(g)
    return chosen


class Voters:
    """Counts of the lexicon's entries in a text."""

    def __init__(self, entries: list[str]) -> None:
        self.entries = entries
        self.machine = ahocorasick.Automaton()
        for k, g in enumerate(entries):
            self.machine.add_word(g, k)
        if entries:
            self.machine.make_automaton()

    def counts(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(self.entries) + 1)
        if self.entries:
            for _, k in self.machine.iter(normal(text)):
                out[k] += 1
        out[-1] = max(1, text.count(b" ") + text.count(b"\n"))
        return out


def votes(counts: np.ndarray) -> np.ndarray:
    """1 where a voter fires: each entry, then the patterns."""
    hits, size = counts[:, :-1], counts[:, -1]
    total, most = hits.sum(1), hits.max(1, initial=0)
    dense = [(total >= 2) & (total >= least * size) for least in DENSITIES]
    return np.column_stack([(hits > 0) & (hits >= DENSE * size[:, None]), *dense, *(most >= n for n in REPEATS)]).astype(float)


def inputs(counts: np.ndarray) -> np.ndarray:
    """What the linear classifier sees."""
    hits = counts[:, :-1]
    total, distinct = hits.sum(1), (hits > 0).sum(1)
    return np.column_stack([np.log1p(hits), np.log1p(total), np.log1p(distinct), total >= 2, distinct >= 2, total >= 4, np.minimum(1, 20 * total / counts[:, -1])]).astype(float)


def label_model(fired: np.ndarray, label: np.ndarray) -> dict:
    """Rates of firing by class, shares of correlated voters, and the posterior of each text.

    Rates start from the labels, and expectation maximisation moves them on all
    texts with that start as a prior; the posterior comes from the votes alone.
    """
    start = np.array([(fired[label == c].sum(0) + 0.5) / ((label == c).sum() + 1) for c in (0, 1)])
    rate, share = start.copy(), np.ones(fired.shape[1])
    balance, posterior = float(label.mean()), label.astype(float)
    for _ in range(ROUNDS):
        weights = np.stack([1 - posterior, posterior])
        rate = np.clip((weights @ fired + PRIOR * start) / (weights.sum(1, keepdims=True) + PRIOR), 1e-5, 1 - 1e-5)
        residual = fired - posterior[:, None] * rate[1] - (1 - posterior[:, None]) * rate[0]
        spread = np.sqrt((residual**2).mean(0)) + 1e-6
        correlation = np.abs(residual.T @ residual / len(fired) / np.outer(spread, spread))
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + np.where(correlation > CORRELATED, correlation, 0).sum(1))
        log = [share * (fired * np.log(rate[c]) + (1 - fired) * np.log(1 - rate[c])) for c in (0, 1)]
        gain = (log[1] - log[0]).sum(1) + np.log(balance / (1 - balance))
        posterior = 1 / (1 + np.exp(-np.clip(gain, -30, 30)))
    return {"rate": rate, "share": share, "balance": balance, "posterior": posterior}


def fit_linear(x: np.ndarray, target: np.ndarray) -> dict:
    """Logistic regression on soft labels, by damped Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1e-3 * len(x))
    ridge[-1] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - target) + ridge * w
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "spread": spread, "w": w}


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        toxic, other = Counter(), Counter()
        for text, label in zip(texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            (toxic if label >= 0.5 else other).update({"", *grams(text)})
        names = sorted(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[g] for g in names], pa.int64()), pa.array([other[g] for g in names], pa.int64())], ["gram", "toxic", "other"])


def mine(known: DataFrame) -> list[str]:
    """The lexicon, from (label, text) rows; counts are added up on the executors."""
    counted = materialize(known.select("label", "text").mapInArrow(_gram_batches, "gram string, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "lexicon")
    totals = counted.where("gram = ''").first()
    if totals is None or not totals["toxic"] or not totals["other"]:
        return []
    odds = (F.col("toxic") / totals["toxic"]) / ((F.col("other") + 0.5) / totals["other"])
    telling = counted.where("gram <> ''").where(F.col("toxic") >= F.when(F.col("gram").endswith(" "), LEAST_TEXTS["word"]).otherwise(LEAST_TEXTS["beginning"])).select("gram", "toxic", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    best = telling.orderBy((F.col("toxic") * F.log("odds")).desc(), "gram").limit(50 * ENTRIES)
    return choose([tuple(r) for r in best.collect()])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict | None:
    """Lexicon, label model and classifier; None without labels of both kinds or a lexicon."""
    wanted = training_ids(labels, "toxic", MODULUS, REST, most)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = narrow.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    known = materialize(known, "toxicity-train")
    entries = mine(known)
    if not entries:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(entries)
        for batch in pieces(batches):
            rows = [voters.counts(t).tolist() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "counts"])

    rows = sorted(known.mapInArrow(count, "doc_id long, label double, counts array<double>").collect(), key=lambda r: r["doc_id"])  # TRAIN_ROWS at most
    counts = np.array([r["counts"] for r in rows])
    model = label_model(votes(counts), np.array([r["label"] >= 0.5 for r in rows]))
    return {"entries": entries, "model": model, "linear": fit_linear(inputs(counts), model.pop("posterior"))}


def scores(many: list[bytes], model: dict | None, voters: Voters | None) -> np.ndarray:
    if model is None or voters is None:
        return np.zeros(len(many))
    x = inputs(np.array([voters.counts(t) for t in many]).reshape(len(many), -1))
    linear = model["linear"]
    z = (x - linear["mean"]) / linear["spread"] @ linear["w"][:-1] + linear["w"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(shared.value["entries"]) if shared.value else None
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts(batch.column("text")), shared.value, voters).round(6))], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
