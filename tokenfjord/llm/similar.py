"""Near duplicates by shingle similarity: wide SimHash, deletion-variant signatures, exact check.

Two texts are near duplicates if the sets of their word shingles have a Jaccard
similarity of ``similarity`` or more. Sets that similar have fingerprints that
differ in 15 % of the bits on average, so a 64-bit fingerprint with few
differing bits misses nearly all of them. Here a fingerprint has 192 bits, each
the majority of the distinct shingles, and ten segments of 18 bits. It is indexed
under the 180 one-wildcard variants of its segments; fingerprints with an equal
variant meet by hash partitioning on it, and those within ``MOST_BITS`` bits are
candidates. A walk over a variant's rows gives a spanning set of them instead of
all pairs. Candidates are then verified on their whole shingle sets.

A pair at a similarity of exactly 0.8 shares a variant with a probability of
0.91, one at 0.85 with 0.95, at 0.9 with 0.99, and a walk can go around a link
by candidates that the check rejects. So an exact pass follows: in any fixed
order of all shingles, two sets with a similarity of s or more share one of
their first n - ceil(s n) + 1. Sets that are still in different classes and meet
at such a shingle are checked, unless their sizes, the shingle's places or the
parities of their hashes in SKETCH buckets (sets differ by as many shingles as
parities, at least) rule the similarity out. Every link is then within a class. In that order frequent
shingles come last; which these are is read from a sample, and decides only how
many sets meet. Groups of a shingle are dealt over tasks by pairs of blocks.

Defined results: texts with equal shingle sets are one class without a check;
texts without words have fingerprint zero and are one class; a null doc_id comes
last among those that may stay.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, pieces, remove, row_hash, texts, written
from .connect import components, spread_join
from .simhash import _LOWER, _key, _near, keep_first

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
WORDS = 3
#: (lowest bit, width) of the segments.
SEGMENTS = tuple((18 * k, 18) for k in range(10))
#: Differing bits of 192 up to which a pair is checked: 29 expected at a similarity of 0.8, with a deviation of 5.
MOST_BITS = 41
#: Candidates of one text that one task checks.
MOST_PARTNERS = 1024
#: Of this many texts one is read for frequent shingles; those that SAMPLE_LEAST of them have count, and MOST_FREQUENT at most.
SAMPLE, SAMPLE_LEAST, MOST_FREQUENT = 16, 3, 100_000
SKETCH = 512
#: Sets of one shingle in a block; each pair of blocks is dealt on its own.
MOST_BLOCK = 512
_BLOCK = 1 << 15
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; of fewer words, of the whole sequence."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - size], ends[size - 1 :]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of the wide fingerprint: each bit is the majority over the hashes."""
    out = np.zeros(WORDS, np.uint64)
    for k, odd in enumerate(_MIX):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _BLOCK):
            mixed = (hashes[at : at + _BLOCK] ^ np.uint64(odd)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def segment(fps: np.ndarray, low: int, width: int) -> np.ndarray:
    word, shift = divmod(low, 64)
    value = fps[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value = value | (fps[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << width) - 1)


def variants(fps: np.ndarray) -> np.ndarray:
    """The one-wildcard segment variants of each fingerprint, a row each."""
    keys = []
    for low, width in SEGMENTS:
        value = segment(fps, low, width)
        keys += [(value & ~np.uint64(1 << bit)) | np.uint64((low + bit) << 32) for bit in range(width)]
    return np.stack(keys, 1).astype(np.int64)


def fewest_shared(n: int, least: float) -> int:
    """The fewest shingles that a set of n shares with any set of that similarity."""
    few = round(least * n)
    while few > 0 and (few - 1) / n >= least:
        few -= 1
    while few < n and few / n < least:
        few += 1
    return few


def prefix(hashes: np.ndarray, least: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set, one of which any set of that similarity has among its first, too.

    ``frequent`` is ascending; those come last, by their rank.
    """
    n = len(hashes)
    if not n:
        return hashes
    most = min(n, n - fewest_shared(n, least) + 1)
    if not len(frequent):
        return hashes[:most]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    common = frequent[at] == hashes
    first = hashes[~common][:most]
    if len(first) == most:
        return first
    return np.concatenate([first, hashes[common][np.argsort(rank[at[common]])][: most - len(first)]])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """In each of SKETCH bits, the parity of the number of hashes that fall there."""
    counts = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _fingerprint_batches(size: int, least: float, frequent: np.ndarray, rank: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps, digests, sizes, odd, first = [], [], [], [], []
            for x in texts(batch.column("text")):
                hashes = shingles(x, size)
                fps.append(fingerprint(hashes))
                digests.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                odd.append(sketch(hashes))
                first.append(prefix(hashes, least, frequent, rank))
            found = np.array(fps, np.uint64).reshape(-1, WORDS).view(np.int64)
            starts = np.r_[0, np.cumsum([len(x) for x in first])].astype(np.int32)
            columns = [*(pa.array(found[:, k]) for k in range(WORDS)), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(first).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), *columns], ["doc_id", "row_hash", *SET, "size", "sketch", "prefix"])

    return run


def _shingle_batches(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.concatenate([shingles(x, size) for x in texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    return run


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the shingles that are frequent in a sample of the texts, hashes ascending."""
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    counts = some.mapInArrow(_shingle_batches(size), "shingle long").groupBy("shingle").count().where(F.col("count") >= SAMPLE_LEAST)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()
    hashes = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], -order  # the most frequent is last of all


FP = [f"f{k}" for k in range(WORDS)]
#: What tells a shingle set from others.
SET = [*FP, "digest"]
_FP_SCHEMA = ", ".join(f"{c} long" for c in FP)


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], 1)


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            fps = _columns(batch.slice(at, 1000), FP)
            keys = variants(fps)
            repeated = np.repeat(fps, keys.shape[1], 0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(repeated[:, k]) for k in range(WORDS))], ["variant", *FP])


def _walk(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning candidates among distinct fingerprints: (one, those first reached from it)."""
    left, found = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            hit = _near(one, left, MOST_BITS)
            if hit.any():
                reached = left[hit]
                found.append((one, reached))
                frontier += list(reached)
                left = left[~hit]
    return found


def candidates(variant: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Candidates among rows sorted by variant, all rows of each variant being there: two fingerprints a row."""
    cuts = np.flatnonzero(np.diff(variant)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(variant)]
    sizes = ends - starts
    small = np.repeat(sizes <= 8, sizes)
    found = [np.empty((0, 2 * WORDS), np.uint64)]
    v, f = variant[small], fps[small]
    for step in range(1, min(8, int(sizes[sizes <= 8].max(initial=1)))):
        hit = np.flatnonzero(v[step:] == v[:-step])
        hit = hit[_near(f[hit], f[hit + step], MOST_BITS)]
        found.append(np.hstack([f[hit], f[hit + step]]))
    for a, b in zip(starts[sizes > 8], ends[sizes > 8], strict=True):
        for one, reached in _walk(fps[a:b]):
            found.append(np.hstack([np.broadcast_to(one, reached.shape), reached]))
    pairs = np.concatenate(found)
    swap = np.zeros(len(pairs), bool)
    tied = np.ones(len(pairs), bool)
    for k in range(WORDS):
        swap |= tied & (pairs[:, k] > pairs[:, WORDS + k])
        tied &= pairs[:, k] == pairs[:, WORDS + k]
    pairs[swap] = np.roll(pairs[swap], WORDS, 1)
    return np.unique(pairs[~tied], axis=0)


_PAIR = [f"{side}{k}" for side in "ab" for k in range(WORDS)]


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def out(v: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = candidates(v, f).view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2 * WORDS)], _PAIR)

    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("variant").to_numpy(zero_copy_only=False)
        waiting.append((v, _columns(batch, FP)))
        if v[0] == v[-1] and (len(waiting) == 1 or waiting[0][0][-1] == v[0]):
            continue  # one variant only so far
        v, f = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
        cut = int(np.searchsorted(v, v[-1]))
        waiting = [(v[cut:], f[cut:])]
        if cut:
            yield from out(v[:cut], f[:cut])
    if waiting:
        yield from out(*(np.concatenate([x[k] for x in waiting]) for k in (0, 1)))


def _set_batches(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(x, size).tobytes() for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "hashes"])

    return run


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct hashes; 1 if both are empty."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def _check_batches(least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "hashes"), "others"):
            sides = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("hashes", "others"))
            keep = [similarity_of(a, b) >= least for a, b in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _live_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, those of shingles that several classes have, with their number."""
    waiting: list[pa.RecordBatch] = []

    def out(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shingle, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "root"))
        starts = np.r_[0, np.flatnonzero(np.diff(shingle)) + 1]
        sizes = np.diff(np.r_[starts, len(shingle)])
        live = np.repeat(np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts), sizes)
        if live.any():
            yield rows.append_column("n", pa.array(np.repeat(sizes, sizes))).filter(pa.array(live))

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        v = batch.column("shingle").to_numpy(zero_copy_only=False)
        if v[0] == v[-1] and (len(waiting) == 1 or waiting[0].column("shingle")[-1].as_py() == v[0]):
            continue  # one shingle only so far
        rows = pa.concat_batches(waiting)
        cut = int(np.searchsorted(rows.column("shingle").to_numpy(zero_copy_only=False), v[-1]))
        waiting = [rows.slice(cut)]
        if cut:
            yield from out(rows.slice(0, cut))
    if waiting:
        yield from out(pa.concat_batches(waiting))


def meeting(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of sets of different classes that can have the similarity, by a shingle among the first of both.

    ``sets`` has id, root, size, sketch and prefix. Without the tests all pairs
    of a shingle's sets would do; of a pair's shared shingles the first passes
    them if the pair is similar.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = sets.select("id", "root", "size", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "id", "root", (F.col("size").cast("long") * (1 << 31) + F.col("size") - F.col("place")).alias("sizes"))
    live = spread.repartition(n, "shingle").sortWithinPartitions("shingle").mapInArrow(_live_batches, "shingle long, id long, root long, sizes long, n long")
    size, after = F.shiftright("sizes", 31), F.col("sizes").bitwiseAND((1 << 31) - 1)  # with the shingle, those from it on
    live = materialize(live, "similar-live").withColumn("blocks", F.ceil(F.col("n") / MOST_BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    zero = F.lit(0).cast("long")
    one = live.select("shingle", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), F.col("id").alias("a"), F.col("root").alias("a_root"), size.alias("a_size"), after.alias("a_after"))
    other = live.select("shingle", F.explode(F.sequence(zero, F.col("block"))).alias("low"), F.col("block").alias("high"), F.col("id").alias("b"), F.col("root").alias("b_root"), size.alias("b_size"), after.alias("b_after"))
    shared = F.least("a_after", "b_after")
    possible = (F.col("a_root") != F.col("b_root")) & ((F.col("low") < F.col("high")) | (F.col("a") < F.col("b"))) & (shared / (F.col("a_size") + F.col("b_size") - shared) >= least)
    pairs = one.join(other.hint("shuffle_merge"), ["shingle", "low", "high"]).where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
    both = F.col("a_size") + F.col("b_size")
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(SKETCH // 64)])
    return pairs.where((both - differ) / (both + differ) >= least).select("a", "b")


def similar_pairs(pairs: DataFrame, per_set: DataFrame, narrow: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets have the similarity."""
    counts = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(per_set.select("id", _key("first.doc_id").alias("k_id"), F.col("first.row_hash").alias("k_hash")), "id")
    found = narrow.select(_key("doc_id").alias("k_id"), F.col("row_hash").alias("k_hash"), "text").join(wanted, ["k_id", "k_hash"]).dropDuplicates(["id"])
    sets, path = written(found.select("id", "text").mapInArrow(_set_batches(size), "id long, hashes binary"), "similar-sets")
    one = sets.join(counts, "id").select(F.col("id").alias("a"), "hashes", "n")
    other = sets.select(F.col("id").alias("b"), F.col("hashes").alias("others"))
    checked = spread_join(pairs.join(other, "b"), one, "a", F.col("b"), max(MOST_PARTNERS, pairs.count() // 10_000)).select("a", "b", "hashes", "others").mapInArrow(_check_batches(least), "a long, b long")
    links = materialize(checked, "similar-links")
    remove(pairs.sparkSession, path)
    return links


def indexed_pairs(per_set: DataFrame) -> DataFrame:
    """(a, b): candidates of the fingerprints' index, and sets of equal fingerprints with the first of them."""
    n = int(per_set.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_fp = materialize(per_set.groupBy(*FP).agg(F.min("id").alias("id"), F.count("*").alias("sets")), "similar-fingerprints")
    index = per_fp.select(*FP).repartition(n, *FP).mapInArrow(_variant_batches, f"variant long, {_FP_SCHEMA}")
    met = index.repartition(n, "variant").sortWithinPartitions("variant", *FP)
    near = met.mapInArrow(_candidate_batches, ", ".join(f"{c} long" for c in _PAIR)).distinct()
    for side in "ab":
        near = near.join(per_fp.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{k}") for k, c in enumerate(FP)]), [f"{side}{k}" for k in range(WORDS)])
    equal = per_set.join(per_fp.where("sets > 1").select(*FP, F.col("id").alias("a")), FP).where("id <> a").select("a", F.col("id").alias("b"))
    return near.select("a", "b").unionByName(equal)


def classes(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, row_hash, keep_id, keep_hash) of every row: the row of its class that stays.

    That is the one with the smallest doc_id, null last, then the smallest row hash.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, row_hash long, {_FP_SCHEMA}, digest long, size int, sketch array<long>, prefix array<long>"
    whole, path = written(narrow.mapInArrow(_fingerprint_batches(size, least, *frequent_shingles(docs, size)), schema), "similar-whole")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first")
    per_set = materialize(whole.groupBy(*SET).agg(first, *[F.first(c).alias(c) for c in ("size", "sketch", "prefix")]).withColumn("id", F.monotonically_increasing_id()), "similar-distinct")
    marked = materialize(whole.select("doc_id", "row_hash", *SET), "similar-fp")
    remove(spark, path)
    del whole
    forget(spark)

    pairs = materialize(indexed_pairs(per_set), "similar-candidates")
    roots = components(similar_pairs(pairs, per_set, narrow, size, least))
    rooted = materialize(per_set.select("id", *SET, "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "similar-indexed")
    del pairs, roots
    forget(spark)

    left = materialize(meeting(per_set.join(rooted.select("id", "root"), "id"), least), "similar-left")
    links = similar_pairs(left, per_set, narrow, size, least)
    for side in "ab":
        links = links.join(rooted.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root")), side)
    joined = components(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    forget(spark)
    rooted = materialize(rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").select(*SET, "first", F.coalesce("whole", "root").alias("root")), "similar-roots")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    label = spread_free(rooted, best)
    return marked.join(label, SET).select("doc_id", "row_hash", F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_hash"))


def spread_free(rooted: DataFrame, best: DataFrame) -> DataFrame:
    """Each shingle set with its class's best; only classes of several sets are joined."""
    many = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    heads = best.join(many, "root")
    most = max(MOST_PARTNERS, rooted.count() // 10_000)
    in_classes = rooted.join(many.select("root"), "root", "left_semi")
    alone = rooted.join(many.select("root"), "root", "left_anti").select(*SET, F.col("first").alias("best"))
    return spread_join(in_classes.select(*SET, "root"), heads, "root", F.col("digest"), most).select(*SET, "best").unionByName(alone)


def drop_similar(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The documents of which one of each class stays, all columns kept; of rows equal in every column one stays."""
    return keep_first(docs, classes(docs, size, least))
