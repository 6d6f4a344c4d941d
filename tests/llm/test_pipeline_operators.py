"""The operators of the pipeline against brute force, round trips and held-out labels."""

import hashlib
import io
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfjord.llm import connect, decontam, mixing, quality, queries, simhash, similar, token_store
from tokenfjord.llm import common
from tokenfjord.llm.common import row_hash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("key", T.StringType())])
ODD = [
    (1, "a b c d e f", "en", "s1", 11, "x", "k"),
    (1, "a b c d e f", "en", "s1", 11, "x", "k"),
    (2, "", "en", "s1", 0, None, None),
    (3, None, None, None, None, None, None),
    (None, "one two three four five", "en", "s2", 23, None, None),
    (None, None, None, None, None, None, None),
    (4, " \t\n ", "de", "s2", 4, None, None),
    (5, "orð " * 30_000, "is", "s1", 120_000, None, None),
    (6, "A B C D E F", "en", "s3", 11, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fp); the smallest doc_id reachable of each row."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in fps:
        if d is not None:
            least[find(f)].append(d)
    return [(d, min(least[find(f)], default=None)) for d, f in fps]


def test_simhash_matches_brute_force(spark, tiny, odd):
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
        want = sorted(((d, f"{f:016x}", c) for (d, f), (_, c) in zip(fps, brute_components(fps), strict=True)), key=str)
        got = sorted(map(tuple, simhash.near_duplicate_classes(docs).collect()), key=str)
        assert got == want


def test_links_join_everything_within_four_bits(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in draw.choice(64, draw.integers(0, 7), replace=False)) for b in base for _ in range(60)]
    fps = list(enumerate(sorted(set(near))))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for _, f in fps], "fp long")
    root = {r[0]: r[1] for r in connect.components(simhash.links(frame)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for (d, f), (_, c) in zip(fps, brute_components(fps), strict=True):
        s = int(np.uint64(f).view(np.int64))
        got[root.get(s, s)].add(d)
        want[c].add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_variant_groups_equal_the_plain_walk():
    draw = np.random.default_rng(5)
    low = draw.integers(0, 1 << 43, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([low ^ np.uint64(sum(1 << int(x) for x in draw.choice(43, 3, replace=False))) for _ in range(30)]) << np.uint64(21))

    def classes(links):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        out = defaultdict(list)
        for f in root:
            out[find(f)].append(f)
        return sorted(map(sorted, out.values()))

    assert classes(simhash._walk(fps)) == classes(simhash._large(0, fps))


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
    assert ids == [1, 2, 5, None]
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in connect.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_mix_equals_its_sql_and_meets_targets(spark, small, odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    got = sorted(map(tuple, queries.op1_mix_sources(spark, small).collect()))
    assert got == want
    for rows in (mixing.plan(spark.read.parquet(f"{small}/documents.parquet")), mixing.plan(odd)):
        per = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
        for r in per.collect():
            assert abs(r["taken"] - r["target"]) < 1 and r["over"] <= 0
    assert mixing.plan(odd.limit(0)).count() == 0


def test_small_buckets_do_not_change_the_mix(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = sorted(map(tuple, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, mixing.plan(docs).collect())) == one


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 1000), ("null", None, 0)], "source_key string, source string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["=a"] == 30 and got["null"] == 0
    assert abs(got["=b"] - 1980 * 2 / 3) < 1e-9 and abs(got["=c"] - 1980 / 3) < 1e-9


def test_mixed_texts_have_the_taken_words(spark, odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    planned = mixing.plan(odd).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == planned
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])


def brute_hits(text, items):
    def norm(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    words, hit, named = norm(text), set(), set()
    for name, item in items:
        item = norm(item)
        n = min(8, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(words) - n + 1):
            if windows and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                named.add("null" if name is None else str(name))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(named) >= 2


SHORT = [(900, "the of"), (901, "Schnell!"), (None, "a b c d"), (902, ""), (903, None), (904, "b c d e f g h i j k"), (905, "c d")]


@pytest.mark.parametrize(("most_words", "most_bytes"), [(10, 1), (10, 1 << 30), (1_000_000, 1 << 30)])
def test_decontamination_matches_brute_force(spark, tiny, odd, most_words, most_bytes):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    for docs, items in ((spark.read.parquet(f"{tiny}/documents.parquet"), bench.where("item_id < 12")), (odd, spark.createDataFrame(SHORT, "item_id long, text string"))):
        plain = [tuple(r) for r in items.select("item_id", "text").collect()]
        want = sorted(((r[0], *brute_hits(r[1], plain)) for r in docs.select("doc_id", "text").collect()), key=str)
        got = sorted(map(tuple, decontam.report(docs, items, most_words=most_words if docs is odd else most_words * 30, most_bytes=most_bytes).collect()), key=str)
        assert got == want


def test_no_benchmark_passage_survives(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    before = {r["doc_id"]: r for r in decontam.report(docs, bench).collect()}
    out = decontam.decontaminate(docs, bench)
    texts = {r["doc_id"]: r for r in out.collect()}
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert any(r["n_hit"] for r in before.values())
    for d, r in before.items():
        if not r["n_hit"]:
            assert texts[d]["text"] == original[d]
        if r["contaminated"]:
            assert d not in texts
    after = decontam.report(out, bench).agg(F.sum("n_items")).first()[0]
    assert after == 0
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())


def test_quality_ranks_held_out_documents(spark, small, odd):
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [(r["quality"], got[r["doc_id"]]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.95
    assert quality.score(odd, None).count() == len(ODD)
    assert quality.train(odd, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")) is None


def test_token_store_round_trip(spark, tiny, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        want = defaultdict(list)
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want[r["doc_id"]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = token_store.store_documents(spark, docs, queries.vocabulary_path()).collect()
        assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == k) for k in want}
        start = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == start
            start += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda x: (x is None, x))
    assert token_store.store_documents(spark, odd.limit(0), queries.vocabulary_path()).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    many = ["".join(chr(c) for c in range(0x260)), "".join(f"{chr(c)}A {chr(c)}" for c in range(0x240)), "w " * 700_000, "é" * 1_500_000, "Don't STOP''S", "a b ́c é <|endoftext|> x", "\x1c\x1d 12 345", "日本 語😀 ΣΑΣ İ", "", "a\rb\x0bc\x0c d"]
    encoder = token_store.Encoder(queries.vocabulary_path(), cache=4)
    for t, ids in zip(many * 2, encoder.encode([t.encode() for t in many]) * 2, strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids + [2]


def test_reader_opens_only_what_is_asked_for():
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    sink = Sink()
    writer = token_store.Writer(sink, 2, frame_bytes=64)
    docs = [np.arange(n, dtype="<u4") for n in (3, 0, 100, 31, 32, 33, 1)]
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader = token_store.Reader(pa.BufferReader(sink.kept))
    for k in (2, 0, 6, 1, 5, 3, 4):
        assert reader.ids(k).tolist() == docs[k].tolist()
    broken = bytearray(sink.kept)
    broken[12] ^= 1
    with pytest.raises(Exception):
        token_store.Reader(pa.BufferReader(bytes(broken))).ids(0)
    import zstandard

    frames = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.kept), read_across_frames=True).read()
    assert frames == b"".join(d.astype("<u2").tobytes() for d in docs)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_similar_documents_against_all_pairs(spark, small):
    """No class joins what no chain of links joins, and at least 0.9 of all links are within a class."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [brute_shingles(r["text"]) for r in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    linked = [(rows[a]["doc_id"], rows[b]["doc_id"]) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8]
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    kept = {r["doc_id"]: r["keep_id"] for r in similar.classes(docs).collect()}
    assert len(linked) > 20 and all(find(d) == find(k) for d, k in kept.items())
    assert np.mean([kept[a] == kept[b] for a, b in linked]) >= 0.9
    assert {r["doc_id"] for r in similar.drop_similar(docs).collect()} == set(kept.values())


def test_edited_copies_and_odd_rows(spark, odd):
    draw = np.random.default_rng(2)
    rows, base = [], [f"w{x}" for x in draw.integers(0, 900, 400)]
    for k in range(300):  # each a chain's link: a few words further from the first
        words = list(base)
        for at in draw.integers(0, 400, 3):
            words[at] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"x{x}" for x in draw.integers(0, 10**6, 60))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["keep_id"] for r in similar.classes(docs).collect()}
    assert set(kept.values()) == {0, *range(1000, 1050)}
    out = similar.drop_similar(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [1, 2, 5]
    assert similar.drop_similar(odd.limit(0)).count() == 0


def brute_classes(rows, size=5, least=0.8):
    """doc_id to the smallest doc_id that a chain of links reaches, over all pairs."""
    sets = [brute_shingles(t, size) for _, t in rows]
    where, root = defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s or {()}:
            where[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :]}:
        if jaccard(sets[a], sets[b]) >= least:
            root[find(a)] = find(b)
    first = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first[find(i)], d)
    return {d: first[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [similar.MOST_BLOCK, 3])
def test_no_link_is_lost(spark, monkeypatch, block):
    """Pairs just above and below the threshold, a frequent passage, groups whose walks go around links."""
    monkeypatch.setattr(similar, "MOST_BLOCK", block)
    draw, rows = np.random.default_rng(4), []
    word = lambda n: [f"v{x}" for x in draw.integers(0, 10**6, n)]
    for k in range(300):
        base = word(int(draw.integers(60, 140)))
        other = list(base)
        for at in draw.choice(len(base) // 5, max(1, len(base) // 45), replace=False):
            other[5 * at] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    passage, base = word(40), word(200)
    rows += [(1000 + k, " ".join(word(20) + passage)) for k in range(60)]
    for k in range(60):  # most at 0.75 to 0.85 from each other
        at = int(draw.integers(0, 180))
        rows.append((2000 + k, " ".join(base[:at] + word(int(draw.integers(8, 20))) + base[at + 14 :])))
    rows += [(3000 + k, t) for k, t in enumerate([None, "", " ", "a", "A", "a b", "a b c d e", "a b c d e f"])]
    want = brute_classes(rows)
    got = {r["doc_id"]: r["keep_id"] for r in similar.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 30 < sum(want[2 * k] == want[2 * k + 1] for k in range(300)) < 290


def test_classes_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for size, least in ((5, 0.8), (3, 0.6)):
        assert {r["doc_id"]: r["keep_id"] for r in similar.classes(docs, size, least).collect()} == brute_classes(rows, size, least)


def test_similar_sets_share_a_first_shingle():
    draw = np.random.default_rng(5)
    frequent = np.unique(draw.integers(0, 400, 50).astype(np.uint64))
    rank = draw.permutation(len(frequent))
    for _ in range(2000):
        pool = draw.permutation(400)[: int(draw.integers(1, 60))].astype(np.uint64)
        a, b = (np.sort(pool[draw.random(len(pool)) < 0.9]) for _ in range(2))
        for least in (0.5, 0.8, 1.0):
            if len(a) and similar.similarity_of(a, b) >= least:
                first = set(similar.prefix(a, least, frequent, rank).tolist()) & set(similar.prefix(b, least, frequent, rank).tolist())
                assert first
            bits = int(np.bitwise_count((similar.sketch(a) ^ similar.sketch(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b))
    assert similar.fewest_shared(10, 0.8) == 8 and similar.fewest_shared(11, 0.8) == 9 and similar.fewest_shared(1, 0.8) == 1


def test_similarity_of_sets():
    a, b = (np.array(x, np.uint64) for x in ([1, 2, 3, 4], [2, 3, 4, 9]))
    assert similar.similarity_of(a, b) == 0.6 and similar.similarity_of(a[:0], b[:0]) == 1 and similar.similarity_of(a, a) == 1
    assert len(similar.variants(np.zeros((2, similar.WORDS), np.uint64))[0]) == 180


def test_hubs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(connect, "HUB_LINKS", 5)
    links = spark.createDataFrame([(i, 0) for i in range(1, 200)] + [(500, 199), (600, 601)], "a long, b long")
    got = {r["node"]: r["root"] for r in connect.components(links).collect()}
    assert got == {i: 0 for i in [*range(200), 500]} | {600: 600, 601: 600}


def test_rows_that_differ_in_a_map_only_stay(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", {"k": 1}, [{"x": 1}]), (1, "a b c d e f", {"k": 2}, [{"x": 1}]), (1, "a b c d e f", {"k": 2}, [{"x": 2}])], "doc_id long, text string, m map<string,int>, n array<map<string,int>>")
    keys = [r[0] for r in rows.select(row_hash(rows)).collect()]
    assert len(set(keys)) == 3


def test_tables_of_an_application_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(common, "own_folder", lambda spark: f"{common.shared_dir(spark)}/to-be-deleted")
    kept = common.materialize(spark.range(3).toDF("id"), "some")
    assert kept.count() == 3
    common.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(f"{common.shared_dir(spark)}/to-be-deleted/*").count()


def test_decontamination_sql_equals_brute_force(odd):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    rows = [(r[0], r[1]) for r in ODD] + [(20, "the of the OF x a b c d e f g h i j k l c d"), (21, "Schnell! c d")]
    con.executemany("insert into documents values (?, ?)", rows)
    con.executemany("insert into benchmark values (?, ?)", SHORT)
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    got = con.sql(f"select {columns} from ({queries.oracle_sql()['op7_decontaminate']})").fetchall()
    assert sorted(got, key=str) == sorted(((d, *brute_hits(t, SHORT)) for d, t in rows), key=str)
