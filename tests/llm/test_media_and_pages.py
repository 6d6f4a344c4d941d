"""WARC, telephony, toxicity and main text: round trips, planted cases and brute force."""

import gzip
import hashlib
import io
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from tokenfjord.llm import queries, telephony, toxicity, warc, wrapper

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("host", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "h") for i, u, h in rows], PAGES)


def test_warc_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    assert sorted(map(tuple, queries.op3_warc(spark, small).collect())) == sorted(con.sql(warc.ORACLE).fetchall())


def test_warc_of_odd_pages(spark):
    long = "x" * 100
    rows = [(5, "http://a/ü x\r\n", long), (3, None, long), (9, "http://b", long), (None, "http://c", long), (3, "http://a", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, None, None), (7, "u", "é" * 60), (8, "u", "é" * 60), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30_000)]
    got = sorted(map(tuple, warc.archive_pages(pages(spark, rows)).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((x for x, _, y in rows if (y or "").encode() == data and x is not None), default=None)
        revisit = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_normaliser_gives_one_member_per_record():
    records = [warc.record(k, f"http://x/{k}", b"p" * n, "00", "response", None) for k, n in enumerate((0, 5, 3_000_000, 17))]
    for stream in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(records[0] + records[1]) + gzip.compress(records[2] + records[3])):
        sink = io.BytesIO()
        index = list(warc.split_members(io.BytesIO(stream), sink))
        assert [gzip.decompress(sink.getvalue()[o : o + n]) for o, n, _ in index] == records
    with pytest.raises(ValueError):
        list(warc.split_members(io.BytesIO(gzip.compress(records[2][:-100])), io.BytesIO()))


def plain_adpcm(block):
    sample, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [sample]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            diff = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if n & 8 else sample + diff))
            index = max(0, min(88, index + telephony.MOVES[n & 7]))
            out.append(sample)
    return out


def test_adpcm_blocks_match_a_plain_decoder():
    data = np.random.default_rng(2).integers(0, 256, 192 * 7, dtype=np.uint8)
    got = telephony.decode_adpcm(data)
    assert [r.tolist() for r in got] == [plain_adpcm(data[k : k + 192].tobytes()) for k in range(0, len(data), 192)]


def test_expansion_tables():
    # fixed points of the two public companding laws
    assert [int(telephony.MULAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0xEF)] == [-32124, 0, 32124, 0, 132]
    assert [int(telephony.ALAW[c]) for c in (0xD5, 0x55, 0xAA, 0x2A, 0x80)] == [8, -8, 32256, -32256, 5504]
    assert len(set(telephony.ALAW.tolist())) == 256 and len(set(telephony.MULAW.tolist())) == 255


def test_stored_audio_is_lossless(spark, tiny):
    odd = [(1, None), (2, ""), (3, "a"), (4, "b" * 192), (5, "c" * 193), (None, "é" * 5000), (7, "c" * 193), (8, "x" * 500_000)]
    for docs in (spark.createDataFrame(odd, "doc_id long, text string"), spark.read.parquet(f"{tiny}/documents.parquet")):
        media = telephony.store(docs)
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        want = []
        for d, t in rows:
            p = t + b" " * (-len(t) % 192 or 192 * (not t))
            want.append((d, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        got = telephony.features(media).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        by_payload = {}
        for r in got:
            assert by_payload.setdefault(r["payload_sha256"], tuple(r)[4:]) == tuple(r)[4:]
    assert {r["feature"].split(";")[0] for r in got} == {"codec=mulaw", "codec=alaw", "codec=ima_adpcm"}
    pcm = telephony.store_pcm(media).collect()
    crcs = {r["doc_id"]: r["feature"].rsplit("=", 1)[1] for r in got}
    assert all(str(zlib.crc32(r["pcm"])) == crcs[r["doc_id"]] and r["rate"] == 16000 for r in pcm)


def test_features_come_from_stored_pcm(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    media = telephony.store(docs)
    got = telephony.features(media)
    files = got.inputFiles()
    assert files and all("/telephony-pcm-" in f for f in files)  # nothing but the stored PCM is read
    want = {hashlib.sha256(m).hexdigest(): telephony.describe(codec, pcm) for m in [r["media"] for r in media.collect()] for codec, _, pcm in telephony.decode_batch([m])}
    assert {r["media_sha256"]: r["feature"] for r in got.collect()} == want


def test_pcm_is_packed_without_loss():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 7, 1000, 1001):
        for pcm in (draw.integers(-32768, 32768, n).astype(np.int16), draw.choice(np.array([-32768, 32767], np.int16), n)):
            assert telephony.unpack(telephony.pack(pcm)).tolist() == pcm.tolist()
    pcm = telephony.resample(draw.integers(-32768, 32768, 500).astype(np.int16))
    assert telephony.unpack(telephony.pack(pcm)).tolist() == pcm.tolist() and not any(telephony.pack(pcm)[1000:])


def test_toxicity_of_held_out_documents(spark, small):
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]
    hit = sum(t and p for t, p in held)
    assert hit >= 0.8 * sum(t for t, _ in held) and hit >= 0.8 * sum(p for _, p in held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0] * 4
    words = " ".join(["fine words here"] * 5)
    docs = spark.createDataFrame([(k, words + (" vile grot vile" if k % 3 == 0 else "")) for k in range(90)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r["predicted"] == (r["doc_id"] < 90 and r["doc_id"] % 3 == 0) for r in got)


def expected(page):
    """The article of a page of the synthetic tables, by its markup alone."""
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    out = []
    for part in re.split(r"</?(?:p|h1)>", article):
        text = re.sub(r"<[^>]*>", "", part.replace("<br>", " "))
        import html

        text = " ".join(html.unescape(text).split())
        if text:
            out.append(text)
    return "\n\n".join(out)


def test_main_text_of_the_tables(spark, tiny):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in queries.op9_main_text(spark, tiny).collect():
        assert r["text"] == expected(rows[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def test_template_is_induced_from_pages_of_a_host(spark):
    def page(k):
        return f"<html><body><div><p>Old Harbour Gazette</p><p>Story {k} begins &amp; goes on</p><div><p>It ends with {k * 7}.</p></div></div><div>All rights kept by us</div></body></html>"

    rows = [(k, f"https://one.example/{k}", page(k)) for k in range(8)] + [(100, "http://two.example/", page(100)), (101, None, None), (None, "x", ""), (102, "http://ONE.example:80/q", page(3))]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages(spark, rows)).collect()}
    for k in range(8):
        assert got[k] == f"Story {k} begins & goes on\n\nIt ends with {k * 7}."
    assert got[102] == got[3]
    assert got[100].startswith("Old Harbour Gazette\n\nStory 100") and got[101] == "" and got[None] == ""
    assert wrapper.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><h1>T</h1><p>a<br>b &lt;c&gt;\n d<p>e", "T\n\na b <c> d\n\ne"),
        ("<article><header><h1>T</h1></header>x<div class='comments'><p>no</p></div><form>f</form><aside>s</aside>y</article>", "T\n\nx\n\ny"),
        ("<body><header>H</header><nav>N</nav><div id=cookie-notice>C</div><p>Body text</p><footer>F</footer>", "Body text"),
        ("plain & simple", "plain & simple"),
        ("<p>a<b>b</p>c<script>if (a</b) '</p>'</script>d<!-- x > y -->e", "ab\n\ncde"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\n\ntwo\n\nx\n\ny"),
        ("<article></article><p>z", "z"),
        ("<article><header class='entry-header'><h1 class=header>T</h1></header><p>x</p></article>", "T\n\nx"),
        ("<div class=site-header>no</div><h2 class='page-header'>T</h2><p>x", "T\n\nx"),
        ("<p>unclosed <a href='x>y'>link", "unclosed link"),
        ("<p style='display: none'>hid</p><p hidden>hid</p><p>shown</p>", "shown"),
    ],
)
def test_main_text_cases(page, text):
    assert wrapper.main_text(wrapper.parse(page)) == text


def test_alignment_is_the_largest_ordered_match():
    tree = lambda s: [(d, t, x) for d, t, x in s]
    a = tree([(0, "#root", ""), (1, "p", "a"), (1, "div", ""), (2, "p", "b"), (1, "p", "c")])
    b = tree([(0, "#root", ""), (1, "div", ""), (2, "p", "b"), (2, "p", "x"), (1, "p", "c"), (1, "p", "d")])
    assert sorted(wrapper.align(a, b)) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    assert wrapper.align(a, []) == []
