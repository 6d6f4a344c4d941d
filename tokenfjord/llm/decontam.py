"""Benchmark decontamination by a generalised suffix automaton of test items.

The automaton holds the normalised word sequences of the items; a document's
words stream through it and the longest matching length is tracked. Where that
length reaches a window, the matched words are hit, and the automaton's states
name the items. Only stretches whose neighbouring word pairs all occur in the
items can reach a window, so the rest of a document is skipped by a table
lookup over word pairs.

The items are dealt by a hash into automata of about ``AUTOMATON_WORDS`` words,
which executors build and pack into sorted arrays (about 70 bytes a word, and
each distinct word once). One pass over the documents takes as many automata as
fit ``PASS_BYTES``, which bounds what is broadcast; further ones mean further
passes whose results are merged per row.

Defined results: null texts have no words; a null item_id is named ``null``;
items with the same id count once; equal rows get equal results.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, row_hash, texts

WINDOW = 8
#: Items named at least so often make a document contaminated.
ITEMS = 2
#: Words of items that one automaton takes, on average; while it is built a word takes about 700 bytes.
AUTOMATON_WORDS = 250_000
#: Packed automata that one pass over the documents takes; one alone may be larger.
PASS_BYTES = 128 << 20
#: Share of hit words from which on a document is dropped instead of cleaned.
COVERAGE = 0.5
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Builder:
    """Grows a generalised suffix automaton over word ids."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        new = self.next[last].get(w)
        if new is not None:
            return new if self.length[new] == self.length[last] + 1 else self._split(last, w, new)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state, at = len(self.next) - 1, last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][w]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, w, target)
        return state

    def _split(self, at: int, w: int, target: int) -> int:
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        copy = self.link[target] = len(self.next) - 1
        while at >= 0 and self.next[at].get(w) == target:
            self.next[at][w] = copy
            at = self.link[at]
        return copy


def _sets_of(found: dict[int, set[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, where each one's items end, items) of sets of item numbers."""
    states = sorted(found)
    return np.array(states, np.int64), np.cumsum([0, *(len(found[x]) for x in states)]), np.array([i for x in states for i in sorted(found[x])], np.int64)


class Automaton:
    """A packed generalised suffix automaton over word ids, with the items of each window.

    Steps are looked up by bisection in one sorted array of (state, word) keys.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for name, words in items if words]
        self.least = min([window, *(len(words) for _, words in coded)])
        self.pairs = np.zeros(1 << _TABLE_BITS, bool)
        grown = Builder()
        for _, words in coded:
            grown.add(words)
            codes = np.array(words, np.int64)
            self.pairs[self._slot(codes[:-1], codes[1:])] = True
        sizes = np.fromiter(map(len, grown.next), np.int64, len(grown.next))
        keys = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes) | np.fromiter((w for x in grown.next for w in x), np.uint64, int(sizes.sum()))
        targets = np.fromiter((t for x in grown.next for t in x.values()), np.uint32, len(keys))
        order = np.argsort(keys)
        self.keys, self.targets = array("Q", keys[order].tobytes()), array("I", targets[order].tobytes())
        self.link, self.length = array("i", grown.link), array("I", grown.length)
        del grown, keys, targets
        names = {name: i for i, name in enumerate(sorted({name for name, _ in coded}))}
        self.names = list(names)
        found: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        for name, words in coded:
            for state, length in self._trail(words):
                if length >= window:
                    found.setdefault(self._shortest(state), set()).add(names[name])
                elif length == len(words):
                    whole.setdefault(state, set()).add(names[name])
        self.items, self.whole = _sets_of(found), _sets_of(whole)

    def pack(self) -> bytes:
        kept = {k: v for k, v in vars(self).items() if k not in ("ids", "pairs")}
        return pickle.dumps(kept | {"words": b" ".join(self.ids), "table": np.packbits(self.pairs)}, protocol=5)

    @classmethod
    def unpack(cls, packed: bytes) -> Automaton:
        self = cls.__new__(cls)
        kept = pickle.loads(packed)
        self.ids = {w: k for k, w in enumerate(kept.pop("words").split(), 1)}
        self.pairs = np.unpackbits(kept.pop("table")).astype(bool)
        vars(self).update(kept)
        return self

    def _step(self, state: int, w: int) -> int:
        """The state after a word; -1 if there is none."""
        key = state << 32 | w
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _trail(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        state = length = 0
        for w in words:
            step = self._step(state, w)
            while step < 0 and state:
                state = self.link[state]
                length = self.length[state]
                step = self._step(state, w)
            if step < 0:
                state = length = 0
            else:
                state, length = step, length + 1
            yield state, length

    def _shortest(self, state: int) -> int:
        """The state that holds the last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _named(self, sets: tuple[np.ndarray, np.ndarray, np.ndarray], state: int) -> set[str]:
        states, ends, items = sets
        at = int(np.searchsorted(states, state))
        if at == len(states) or states[at] != state:
            return set()
        return {self.names[i] for i in items[ends[at] : ends[at + 1]].tolist()}

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << _TABLE_BITS) - 1)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Runs [from, to) of hit words, and the items that occur."""
        none = np.empty((0, 2), np.int64)
        if len(words) < self.least or not self.ids:
            return none, set()
        get = self.ids.get
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        if self.least == 1:
            live, extra = ids > 0, 0
        else:
            live, extra = (ids[:-1] > 0) & (ids[1:] > 0), 1
            live[live] = self.pairs[self._slot(ids[:-1][live], ids[1:][live])]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8))).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= self.least - extra]
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, end in edges.tolist():
            for i, (state, length) in enumerate(self._trail(ids[start : end + extra].tolist()), start):
                longest = 0
                if length >= self.window:
                    longest = length
                    found |= self._named(self.items, self._shortest(state))
                if len(self.whole[0]):
                    at = state
                    while at > 0:
                        if self.length[at] <= length and (short := self._named(self.whole, at)):
                            found |= short
                            longest = max(longest, self.length[at])
                        at = self.link[at]
                if longest:
                    runs.append((i + 1 - longest, i + 1))
        return merged(runs) if runs else none, found


def merged(runs: list[tuple[int, int]] | np.ndarray) -> np.ndarray:
    """Disjoint runs that cover the same places."""
    spans = np.array(sorted(map(tuple, runs)), np.int64).reshape(-1, 2)
    if len(spans) < 2:
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], 1)


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(part, n_bytes, packed): automata of about most_words words each, built on the executors; none without words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-int(total) // most_words))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")).repartition(min(parts, 4096), "part").sortWithinPartitions("part", "item", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if any(words for _, words in waiting):
                packed = Automaton(waiting, window).pack()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(packed)], pa.int64()), pa.array([packed], pa.binary())], ["part", "n_bytes", "packed"])

        for batch in batches:
            for k, name, text in zip(batch.column("part").to_pylist(), batch.column("item").to_pylist(), texts(batch.column("text")), strict=True):
                if k != part:
                    yield from made()
                    part, waiting = k, []
                waiting.append((name, words_of(text)))
        yield from made()

    return materialize(dealt.mapInArrow(build, "part int, n_bytes long, packed binary"), "automata")


def passes(spark: SparkSession, made: DataFrame, most_bytes: int = PASS_BYTES) -> list[Any]:
    """Broadcasts of lists of packed automata, each of at most ``most_bytes`` or one automaton."""
    groups: list[list[int]] = []
    size = 0
    for part, n in sorted(map(tuple, made.select("part", "n_bytes").collect())):  # a number per AUTOMATON_WORDS words
        if not groups or size + n > most_bytes:
            groups.append([])
            size = 0
        groups[-1].append(part)
        size += n
    shared = []
    for group in groups or [[]]:
        packed = [bytes(r[0]) for r in made.where(F.col("part").isin(group)).orderBy("part").select("packed").collect()] if group else []
        shared.append(spark.sparkContext.broadcast(packed))
    return shared


class Matcher:
    """All automata of one pass."""

    def __init__(self, packed: list[bytes]) -> None:
        self.automata = [Automaton.unpack(x) for x in packed]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Runs [from, to) of hit words, and the items that occur."""
        each = [a.hits(words) for a in self.automata]
        found = set().union(*(x for _, x in each))
        if not found:
            return np.empty((0, 2), np.int64), found
        return (each[0][0] if len(each) == 1 else merged([tuple(r) for runs, _ in each for r in runs.tolist()])), found


SCAN = "doc_id long, row_hash long, n_words long, runs array<struct<a:long,b:long>>, items array<string>"


def _scanner(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in pieces(batches):
            n, runs, items = [], [], []
            for text in texts(batch.column("text")):
                words = words_of(text)
                hit, found = matcher.hits(words)
                n.append(len(words))
                runs.append([{"a": a, "b": b} for a, b in hit.tolist()])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row_hash", "n_words", "runs", "items"])

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS, most_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, row_hash, n_words, runs, items) of every row; runs are disjoint word ranges."""
    return _scan(docs, passes(docs.sparkSession, automata(benchmark, window, most_words), most_bytes))


def _scan(docs: DataFrame, shared: list[Any]) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col("text").cast("string").alias("text"))
    each = [narrow.mapInArrow(_scanner(one), SCAN) for one in shared]
    if len(each) == 1:
        return each[0]
    every = each[0]
    for other in each[1:]:
        every = every.unionByName(other)
    both = every.groupBy("doc_id", "row_hash", "n_words").agg((F.count("*") / len(each)).cast("int").alias("copies"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = both.withColumn("runs", F.aggregate(F.array_sort("runs"), F.array().cast("array<struct<a:long,b:long>>"), _join_runs))
    return both.select("doc_id", "row_hash", "n_words", "runs", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def _join_runs(done, run):  # noqa: ANN001, ANN202
    last = F.element_at(done, -1)
    longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], run["b"]).alias("b"))
    return F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["b"] < run["a"]), F.concat(done, F.array(run))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS, most_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    n_items = F.size("items").cast("long")
    return scan(docs, benchmark, window, most_words, most_bytes).select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_items >= ITEMS).alias("contaminated"))


def without(text: str, runs: np.ndarray) -> str:
    """The text without the given word ranges and what stands between their words."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_A_TO_Z))]
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


_A_TO_Z = {c: c + 32 for c in range(65, 91)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most_items: int = ITEMS, most_words: int = AUTOMATON_WORDS, most_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents with matched spans removed, all columns kept.

    A span is removed where a window or longer matches. A document that names
    ``most_items`` items, or more than ``coverage`` of whose words are hit, is
    dropped. Clean documents pass unchanged; n_chars is counted anew. All
    automata's matches in the text as given are added up first.
    """
    shared = passes(docs.sparkSession, automata(benchmark, window, most_words), most_bytes)
    if len(shared) == 1:
        return docs.mapInArrow(_cleaner(shared[0], coverage, most_items), docs.schema)
    found = _scan(docs, shared).where(F.size("items") > 0).dropDuplicates(["doc_id", "row_hash"])
    found = found.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("row_hash").alias("__hash"), F.col("runs").alias("__runs"), F.size("items").alias("__items"))
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), row_hash(docs).alias("__hash"))  # the hash tells a null from a zero
    joined = keyed.join(found, ["__id", "__hash"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__runs", "__items")
    return joined.mapInArrow(_cutter(len(docs.columns), coverage, most_items), docs.schema)


def _cleaner(shared: Any, coverage: float, most_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in pieces(batches):
            hits = []
            for text in texts(batch.column("text")):
                hit, found = matcher.hits(words_of(text))
                hits.append((hit, len(found)))
            yield _cut(batch, hits, coverage, most_items)

    return clean


def _cutter(width: int, coverage: float, most_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As _cleaner, with the matches in two columns after the first ``width``."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            runs, items = (batch.column(width + k).to_pylist() for k in (0, 1))
            hits = [(np.array([(x["a"], x["b"]) for x in r or ()], np.int64).reshape(-1, 2), n or 0) for r, n in zip(runs, items, strict=True)]
            yield _cut(batch.select(batch.schema.names[:width]), hits, coverage, most_items)

    return clean


def _cut(batch: pa.RecordBatch, hits: list[tuple[np.ndarray, int]], coverage: float, most_items: int) -> pa.RecordBatch:
    """The rows that stay, without their hit words; hits has each row's runs and its number of items."""
    keep, changed = [], {}
    for i, (text, (hit, n_items)) in enumerate(zip(texts(batch.column("text")), hits, strict=True)):
        share = int((hit[:, 1] - hit[:, 0]).sum()) / max(1, len(words_of(text))) if len(hit) else 0
        keep.append(n_items < most_items and share <= coverage)
        if len(hit) and keep[-1]:
            changed[i] = without(text.decode(), hit)
    if changed:
        for name in ("text", "n_chars"):
            if name in batch.schema.names:
                at = batch.schema.get_field_index(name)
                values = batch.column(at).to_pylist()
                for i, text in changed.items():
                    values[i] = text if name == "text" else len(text)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
    return batch.filter(pa.array(keep, pa.bool_()))


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_NEXT = ", ".join(f"lead(w, {k}) OVER (PARTITION BY r ORDER BY p) AS w{k}" for k in range(1, WINDOW))
#: Words apart by spaces, for each length of a window; null where the text ends before.
_SQL_GRAMS = " ".join(f"WHEN {n} THEN " + " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))]) for n in range(1, WINDOW + 1))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS words FROM documents),
i AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS words FROM benchmark),
dw AS (SELECT *, {_SQL_NEXT} FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM d)),
iw AS (SELECT *, {_SQL_NEXT} FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM i)),
win AS (SELECT DISTINCT item, n, CASE n {_SQL_GRAMS} END AS g FROM iw JOIN (SELECT r, item, least({WINDOW}, len(words)) AS n FROM i) USING (r)),
hit AS (SELECT DISTINCT r, p, n, item FROM (SELECT r, p, n, CASE n {_SQL_GRAMS} END AS g FROM dw, (SELECT DISTINCT n FROM win)) JOIN win USING (n, g)),
cov AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_items, 0) >= {ITEMS} AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN named USING (r)
"""
