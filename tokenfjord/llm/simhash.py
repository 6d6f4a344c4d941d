"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Four differing bits leave at
least one segment with one differing bit at most, so two linked fingerprints
agree on that segment once the bit is replaced by a wildcard. Each distinct
fingerprint is indexed under its 64 one-wildcard segment variants; rows with an
equal variant meet by hash partitioning on it and are verified on all 64 bits.

Inside a variant's rows the linked ones are found by a breadth-first walk that
drops what it has reached, and a spanning set of links leaves the task instead
of all pairs: a group of thousands of near copies costs about as much as its
size. Large groups are first cut again by five sub-segments of the remaining
bits, one of which must agree exactly.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; equal rows get equal results; a null doc_id never becomes a
component_id unless the whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, row_hash, texts
from .connect import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Rows of one variant from which on they are cut by sub-segments first.
LARGE = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the 4-word shingles of a UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        return int.from_bytes(digest(joined, SEED), "big")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        block = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in block]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = np.array([fingerprint(x) for x in texts(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(found)], ["doc_id", "row_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp) of every row; fp is the fingerprint as a signed long."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, row_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint under its 64 one-wildcard segment variants."""
    keys = []
    for low, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            keys.append(rest.bitwiseOR(F.lit((low + bit) << 32)))
    return fps.select(F.explode(F.array(*keys)).alias("variant"), "fp")


def _near(one: np.ndarray, many: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Fingerprints of ``many`` within ``most`` bits; wide ones have a row of words each."""
    bits = np.bitwise_count(one ^ many)
    return (bits if bits.ndim == 1 else bits.sum(1, dtype=np.uint16)) <= most


def _walk(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of links between distinct fingerprints, by breadth-first search."""
    left, links = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        root = frontier[0]
        while frontier and len(left):
            hit = _near(frontier.pop(), left)
            if hit.any():
                reached = left[hit]
                links += [(int(root), int(x)) for x in reached]
                frontier += list(reached)
                left = left[~hit]
    return links


def _large(variant: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """As _walk, for many rows: cut by five sub-segments of the bits outside the variant's."""
    low, width = next(s for s in SEGMENTS if s[0] <= variant >> 32 < s[0] + s[1])
    other = [b for b in range(64) if not low <= b < low + width]
    links = []
    for part in np.array_split(np.array(other, np.uint64), 5):
        mask = np.uint64(sum(1 << int(b) for b in part))
        key = fps & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                links += _walk(fps[group])
    return links


def _links_of(variant: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links among rows sorted by variant, all rows of each variant being there."""
    cuts = np.flatnonzero(np.diff(variant)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(variant)]
    sizes = ends - starts
    small = np.repeat(sizes <= 32, sizes)
    found = []
    v, f = variant[small], fps[small]
    for step in range(1, min(32, int(sizes[sizes <= 32].max(initial=1)))):
        hit = np.flatnonzero((v[step:] == v[:-step]) & _near(f[step:], f[:-step]))
        if len(hit):
            found.append(np.stack([f[hit], f[hit + step]], 1))
    for a, b in zip(starts[sizes > 32], ends[sizes > 32], strict=True):
        group = np.unique(fps[a:b])
        links = _walk(group) if len(group) <= LARGE else _large(int(variant[a]), group)
        if links:
            found.append(np.array(links, np.uint64))
    if not found:
        return np.empty((0, 2), np.uint64)
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs, axis=0)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_v, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def out(v: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = _links_of(v, f).view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        v = batch.column("variant").to_numpy(zero_copy_only=False)
        f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(v):
            continue
        waiting.append((v, f))
        if v[0] == v[-1] and (len(waiting) == 1 or waiting[0][0][-1] == v[0]):
            continue  # one variant only so far
        kept_v, kept_f = np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting])
        cut = int(np.searchsorted(kept_v, kept_v[-1]))
        waiting = [(kept_v[cut:], kept_f[cut:])]
        if cut:
            yield from out(kept_v[:cut], kept_f[:cut])
    if waiting:
        yield from out(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within four bits."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(fps.select("fp").distinct().repartition(n, "fp"))  # all tasks share the explosion
    met = index.repartition(n, "variant").sortWithinPartitions("variant")
    return met.mapInArrow(_link_batches, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp, component_id, keep_id, keep_hash) of every row.

    keep_id and keep_hash name the row of the component that stays when one is
    to stay: the smallest doc_id, null last, then the smallest row hash.
    """
    marked = materialize(fingerprints(docs), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first")
    per_fp = marked.groupBy("fp").agg(first)
    found = materialize(links(marked), "simhash-links")
    roots = components(found)
    rooted = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "simhash-roots")
    linked = roots.select("root").distinct()
    best = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first").alias("best"))
    label = rooted.join(best, "root", "left").select("fp", F.coalesce("best", "first").alias("best"))
    return marked.join(label, "fp").select("doc_id", "row_hash", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_hash"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of at most four bits."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(0))  # the hash tells a null from a zero


def keep_first(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs that ``labelled`` (keep_id, keep_hash) names, one of those equal in every column."""
    keep = labelled.select(_key("keep_id").alias("k_id"), F.col("keep_hash").alias("k_hash")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key("doc_id").alias("k_id"), row_hash(docs).alias("k_hash"))
    return packed.join(keep, ["k_id", "k_hash"], "left_semi").dropDuplicates(["k_id", "k_hash"]).select("row.*")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which one of each component of the 64-bit links stays, all columns kept.

    Of rows that are equal in every column one stays, too.
    """
    return keep_first(docs, classes(docs))
