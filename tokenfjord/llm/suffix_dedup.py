"""Repeated byte strings by column-wise multi-string suffix sorting.

A byte goes if it lies in a ``WINDOW``-byte string that starts at another place
too, in the same document or in another. The steps:

1. *Anchors.* Of the hashed ``GRAM``-byte strings in each window the least is its
   anchor, so equal windows have their anchors at equal places. Only anchors
   whose hash occurs twice go on. Nothing that repeats is lost by this.
2. *Contexts.* Around each such anchor lie all windows that hold it: ``LEFT``
   bytes before it and ``WINDOW`` from it on. Equal contexts are counted and
   kept once; aligned at the anchor, they are the strings of the collection.
3. *Column-wise construction.* From the last column to the first, each round
   inserts one symbol of every string. A stable sort by that symbol, applied to
   the order of the round before, gives the order of the suffixes that start
   there, and the common prefixes of neighbours follow from range minima of the
   old ones. The symbols come from external files that are written once and
   read column by column, so the memory of a round is a few numbers per string.
   Since equal windows are aligned, only suffixes of one column meet, and a
   round costs the number of strings instead of the size of all suffixes so far.
   A suffix whose common prefix with a neighbour reaches the window marks it.
4. *Spans.* Marked windows of a context share its anchor, so they form one span.
   The spans are joined back to the documents and merged.

Groups of one anchor with more than ``MOST_GROUP`` different contexts, such as
those of a passage that very many documents share, would land in one task. Their
contexts are dealt anew: the columns at which a window may start are cut into
parts. All windows of a part share the bytes from its last start to its first
end, so contexts meet by the hash of those bytes; and a context is trimmed to
what its windows of the part can reach, so that contexts that differ elsewhere
become equal and are kept once. Groups that are still too large are cut into
more parts, until a part is a single window and a count decides.

Defined results: a null text is empty; equal rows cover each other; documents
shorter than the window lose nothing.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, row_hash, texts
from .decontam import merged

WINDOW = 400
GRAM = 64
LEFT = WINDOW - GRAM
#: Different contexts of one group that one task takes, and the parts that larger groups are cut into, in turn.
MOST_GROUP = 16_384
PARTS = (4, 16, 64, LEFT + 1)
#: Strings that are sorted together, and bytes that are scanned together.
BLOCK_STRINGS = 32_768
SLAB = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            one = np.full(n, base, np.uint64)
            one[0] = 1
            _powers[name] = np.cumprod(one)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM-byte string."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over each n neighbours."""
    have = 1
    while 2 * have <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows that lie in one of the strings ending at ``ends``."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data)
    key = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 marks windows that cross an end
    n = LEFT + 1
    least = _sliding(key, n, np.minimum)  # by window start
    for end in ends[:-1].tolist():
        least[max(0, end - WINDOW + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * LEFT, np.uint32)
    padded[LEFT : LEFT + len(least)] = least
    chosen = np.flatnonzero((_sliding(padded, n, np.maximum) == key))
    return chosen, h[chosen]


KEYS = "k_id long, k_hash long"


def _keys(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), row_hash(docs).alias("k_hash")]


def _slabs(many: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(rows, offsets in the row, joined bytes): short texts together, long ones in overlapping parts."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, text in enumerate(many):
        if len(text) < WINDOW:
            continue
        if len(text) > SLAB:
            for at in range(0, len(text) - WINDOW + 1, SLAB):
                yield [k], [at, SLAB + WINDOW - 1], text[at : at + SLAB + WINDOW - 1]
            continue
        rows.append(k)
        parts.append(text)
        size += len(text)
        if size >= SLAB:
            yield rows, [0, *map(len, parts)], b"".join(parts)
            rows, parts, size = [], [], 0
    if rows:
        yield rows, [0, *map(len, parts)], b"".join(parts)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for rows, (shift, *sizes), joined in _slabs(texts(batch.column("text"))):
            data = np.frombuffer(joined, np.uint8)
            ends = np.cumsum(sizes)
            ends[-1] = len(data)
            places, hashes = anchors(data, ends)
            if not len(places):
                continue
            which = np.searchsorted(ends, places, "right")
            within = places - np.r_[0, ends[:-1]][which] + shift
            order = np.lexsort((hashes, which))
            which, within, hashes = which[order], within[order], hashes[order]
            new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (hashes[1:] != hashes[:-1])])
            owner = pa.array(np.array(rows)[which[new]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k_id").take(owner), batch.column("k_hash").take(owner), pa.array(hashes[new].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[new, len(within)].astype(np.int32)), pa.array(within))],
                ["k_id", "k_hash", "gram", "places"],
            )


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    for batch in pieces(batches, most_bytes=2 << 20):
        ids, hashes = batch.column("k_id").to_pylist(), batch.column("k_hash").to_pylist()
        for k, text in enumerate(texts(batch.column("text"))):
            found: dict[tuple[int, bytes], list[int]] = {}
            for p in batch.column("places")[k].as_py():
                start = max(0, p - LEFT)
                found.setdefault((p - start, text[start : p + WINDOW]), []).append(p)
            items = list(found.items())
            for at in range(0, len(items), 4096):
                part = items[at : at + 4096]
                wide = [xxhash.xxh3_128_intdigest(c, left) for (left, c), _ in part]
                columns = [
                    pa.array([ids[k]] * len(part), pa.int64()),
                    pa.array([hashes[k]] * len(part), pa.int64()),
                    pa.array(np.array([xxhash.xxh64_intdigest(c[left : left + GRAM]) for (left, c), _ in part], np.uint64).view(np.int64)),
                    pa.array(np.array([w & (1 << 64) - 1 for w in wide], np.uint64).view(np.int64)),
                    pa.array(np.array([w >> 64 for w in wide], np.uint64).view(np.int64)),
                    pa.array([left for (left, _), _ in part], pa.int32()),
                    pa.array([c for (_, c), _ in part], pa.binary()),
                    pa.array([ps for _, ps in part], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)


CONTEXTS = f"{KEYS}, anchor long, c1 long, c2 long, left int, context binary, places array<long>"


class ColumnFile:
    """Symbols of aligned strings in an external file, written in blocks of strings and read column by column."""

    ROWS = 4096

    def __init__(self, contexts: list[bytes], left: np.ndarray, width: int) -> None:
        self.file = tempfile.TemporaryFile()
        self.n = len(contexts)
        for at in range(0, self.n, self.ROWS):
            part = contexts[at : at + self.ROWS]
            block = np.zeros((len(part), width), np.uint8)
            for k, c in enumerate(part):
                start = LEFT - left[at + k]
                block[k, start : start + len(c)] = np.frombuffer(c, np.uint8)
            self.file.write(np.ascontiguousarray(block.T).tobytes())
        self.width = width

    def column(self, j: int) -> np.ndarray:
        parts, base = [], 0
        for at in range(0, self.n, self.ROWS):
            rows = min(self.ROWS, self.n - at)
            self.file.seek(base + j * rows)
            parts.append(self.file.read(rows))
            base += rows * self.width
        return np.frombuffer(b"".join(parts), np.uint8)

    def close(self) -> None:
        self.file.close()


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both included, of each pair."""
    gap = hi - lo + 1
    out = values[hi]
    wide = np.flatnonzero(gap > 1)
    if not len(wide):
        return out
    lo, hi, gap = lo[wide], hi[wide], gap[wide]
    level = np.frexp(gap)[1] - 1
    table, found = values, np.empty(len(wide), values.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        here = np.flatnonzero(level == k)
        found[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << k) + 1])
    out[wide] = found
    return out


def repeated_windows(contexts: list[bytes], left: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The first and last column at which each aligned string has a window that another string has there.

    Columns count from ``LEFT`` before the anchor; -1 where there is none.
    """
    m, width = len(contexts), LEFT + window
    first, last = np.full(m, -1), np.full(m, -1)
    if m < 2:
        return first, last
    start = LEFT - left
    stop = start + np.fromiter(map(len, contexts), np.int64, m)
    symbols = ColumnFile(contexts, left, width)
    order, common = np.arange(m), np.zeros(m, np.uint16)
    for j in range(width - 1, -1, -1):
        key = symbols.column(j).astype(np.uint16) + np.uint16(1)
        key[(j < start) | (j >= stop)] = 0
        ranked = key[order]
        step = np.argsort(ranked, kind="stable")
        ranked, order = ranked[step], order[step]
        same = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] > 0))
        fresh = np.zeros(m, np.uint16)
        if len(same):
            fresh[same + 1] = np.minimum(_range_minima(common, step[same] + 1, step[same + 1]) + np.uint16(1), window)
        common = fresh
        if j <= LEFT:
            full = common >= window
            if full.any():
                full[:-1] |= full[1:]
                rows = order[full]
                first[rows] = j
                last[rows] = np.maximum(last[rows], j)
    symbols.close()
    return first, last


MARKS = "c1 long, c2 long, first int, last int"


def _marks(batch: pa.Table) -> pa.RecordBatch:
    contexts, left, mult = batch.column("context").to_pylist(), batch.column("left").to_numpy(), batch.column("mult").to_numpy()
    start = LEFT - left
    stop = start + np.array([len(c) for c in contexts])
    first, last = repeated_windows(contexts, left)
    twice = (mult > 1) & (stop - start >= WINDOW)  # all windows of a context that comes twice
    first, last = np.where(twice, start, first), np.where(twice, stop - WINDOW, last)
    keep = pa.array(first >= 0)
    out = pa.table([batch.column("c1"), batch.column("c2"), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["c1", "c2", "first", "last"]).filter(keep)
    return out


def _sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and anchor; whole groups of one part are sorted in blocks.

    A context may come in several parts, and must not meet itself.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def by_part(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part = table.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield from _marks(table.slice(x, y - x)).to_batches()

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK_STRINGS:
            continue
        table = pa.Table.from_batches(held)
        part, anchor = table.column("part").to_numpy(), table.column("anchor").to_numpy()
        last = np.flatnonzero((part != part[-1]) | (anchor != anchor[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from by_part(table.slice(0, cut))
            table = table.slice(cut)
        held, size = table.to_batches(), table.num_rows
    if size:
        yield from by_part(pa.Table.from_batches(held))


GROUPS = "part int, anchor long, c1 long, c2 long, context binary, left int, mult long"


def _part_batches(parts: int):  # noqa: ANN202
    edges = [k * (LEFT + 1) // parts for k in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "context", 1 << 19):
            rows = []
            for c1, c2, context, left, mult in zip(*(batch.column(x).to_pylist() for x in ("c1", "c2", "context", "left", "mult")), strict=True):
                start = LEFT - left
                for part, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                    a, b = high - 1 - start, low + WINDOW - start
                    if a < 0 or b > len(context):  # no window of the context starts in this part
                        continue
                    first = max(low - start, 0)
                    trimmed = context[first : high - 1 + WINDOW - start]
                    wide = xxhash.xxh3_128_intdigest(trimmed, (part << 10) + start + first)
                    rows.append((part, xxhash.xxh64_intdigest(context[a:b]), wide & (1 << 64) - 1, wide >> 64, trimmed, LEFT - start - first, mult, c1, c2))
            if rows:
                part, key, t1, t2, trimmed, left, mult, c1, c2 = zip(*rows, strict=True)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, t1, t2)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *signed, pa.array(trimmed, pa.binary()), pa.array(left, pa.int32()), pa.array(mult, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], ["part", "anchor", "c1", "c2", "context", "left", "mult", "o1", "o2"])

    return run


def _distinct(rows: DataFrame) -> DataFrame:
    """Each context once, with the sum of its counts."""
    return rows.groupBy("part", "anchor", "c1", "c2").agg(F.first("context").alias("context"), F.first("left").alias("left"), F.sum("mult").alias("mult"))


def _sorted_marks(groups: DataFrame) -> DataFrame:
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "part", "anchor").sortWithinPartitions("part", "anchor").mapInArrow(_sort_batches, MARKS)


def _group_marks(groups: DataFrame, narrow: DataFrame, parts: tuple[int, ...], most_group: int) -> DataFrame:
    """Marks of the contexts of groups; those too large are cut into parts[0] parts, and so on."""
    hot = materialize(narrow.groupBy("part", "anchor").count().where(F.col("count") > most_group).select("part", "anchor"), "suffix-hot")
    if hot.isEmpty():
        return _sorted_marks(groups)
    cold = _sorted_marks(groups.join(hot, ["part", "anchor"], "left_anti"))
    large = groups.join(hot, ["part", "anchor"], "left_semi").dropDuplicates(["c1", "c2"])
    dealt = materialize(large.mapInArrow(_part_batches(parts[0]), f"{GROUPS}, o1 long, o2 long"), "suffix-parts")
    owners = dealt.select("c1", "c2", "o1", "o2").distinct()
    if len(parts) > 1:
        found = _group_marks(_distinct(dealt), dealt.select("part", "anchor", "c1", "c2").distinct(), parts[1:], most_group)
    else:
        found = dealt.groupBy("part", "c1", "c2").agg(F.sum("mult").alias("n")).where("n > 1").select("c1", "c2", F.col("part").alias("first"), F.col("part").alias("last"))
    back = found.join(owners, ["c1", "c2"]).select(F.col("o1").alias("c1"), F.col("o2").alias("c2"), "first", "last")
    return cold.unionByName(back)


def marks(contexts: DataFrame, most_group: int | None = None) -> DataFrame:
    """(c1, c2, first, last) of each context with repeated windows."""
    counted = contexts.select(F.lit(0).alias("part"), "anchor", "c1", "c2", "context", "left", F.size("places").cast("long").alias("mult"))
    found = _group_marks(_distinct(counted), counted.select("part", "anchor", "c1", "c2").distinct(), PARTS, most_group or MOST_GROUP)
    return found.groupBy("c1", "c2").agg(F.min("first").alias("first"), F.max("last").alias("last"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _spans(rows: list[dict] | None) -> np.ndarray:
    if not rows:
        return np.empty((0, 2), np.int64)
    found = [np.stack([p - LEFT + r["first"], p - LEFT + r["last"] + WINDOW], 1) for r in rows for p in [np.array(r["places"], np.int64)]]
    return merged(np.unique(np.concatenate(found), axis=0))


def _without(text: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for text, marked in zip(texts(batch.column("text")), batch.column("marked"), strict=True):
            spans = _spans(marked.as_py())
            rows.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_without(text, spans)).hexdigest()))
        n, removed, runs, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept)], [x.split()[0] for x in REPORT.split(", ")])


def marked(docs: DataFrame, most_group: int | None = None) -> DataFrame:
    """(doc_id, text, marked): each row with the contexts whose windows repeat."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_keys(docs))
    scanned = rows.select("k_id", "k_hash", "text").where(F.octet_length("text") >= WINDOW)
    found = materialize(scanned.mapInArrow(_anchor_batches, f"{KEYS}, gram long, places array<long>"), "suffix-anchors")
    twice = found.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).where("n > 1").drop("n")
    places = found.join(twice, "gram").groupBy("k_id", "k_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    contexts = rows.select("k_id", "k_hash", "text").join(places, ["k_id", "k_hash"]).mapInArrow(_context_batches, CONTEXTS)
    contexts = materialize(contexts, "suffix-contexts")
    spans = contexts.select("k_id", "k_hash", "c1", "c2", "places").join(materialize(marks(contexts, most_group), "suffix-marks"), ["c1", "c2"])
    by_row = spans.groupBy("k_id", "k_hash").agg(F.collect_list(F.struct("places", "first", "last")).alias("marked"))
    return rows.join(materialize(by_row, "suffix-spans"), ["k_id", "k_hash"], "left").select("doc_id", "text", "marked")


def report(docs: DataFrame, most_group: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return marked(docs, most_group).mapInArrow(_report_batches, REPORT)


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        kept = [_without(t, _spans(m.as_py())).decode("utf-8", "replace") for t, m in zip(texts(batch.column("text")), batch.column("marked"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept)], ["doc_id", "text"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without repeated strings; a character cut in two becomes U+FFFD."""
    return marked(docs).mapInArrow(_clean_batches, "doc_id long, text string")
