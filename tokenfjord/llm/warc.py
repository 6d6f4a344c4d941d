"""WARC archives: monolithic gzip files, their normaliser, and reading back.

``write_archives`` writes each task's records into one gzip stream, as many
crawlers do. ``normalise`` inflates such a file once from front to back,
rewrites every record as a gzip member of its own and writes a sidecar index of
offsets, so that a reader can fetch one record. ``read_archives`` reads the
members through that index.

Of records with one payload of at least ``LEAST_REVISIT`` bytes, the one with
the smallest page_id is the response and the others revisit it.

Defined results: a null html is an empty payload; rows that share the smallest
page_id are all responses; a null page_id comes after all others, and is never
referred to while there is another; a null url leaves the target out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, scratch, texts

LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip header and trailer
HEAD_LIMIT = 1 << 20

FILES = "path string, index string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decide(pages: DataFrame) -> DataFrame:
    """pages with digest, record_type and refers_to.

    Only payloads that come more than once are joined; AQE splits a hot one.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    counted = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(materialize(counted, "warc-repeats"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def inflate(source: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, read once from front to back."""
    engine = zlib.decompressobj(GZIP)
    while data := source.read(chunk):
        while data:
            plain = engine.decompress(data, chunk)
            if plain:
                yield plain
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(GZIP)
    if plain := engine.flush():
        yield plain


def split_members(source: BinaryIO, sink: Any, level: int = 6) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite each record of ``source`` as one gzip member; (offset, length, head) of each.

    A record's body passes through in chunks, so memory doesn't grow with it.
    """
    plain, held, offset = inflate(source), b"", 0
    while True:
        while b"\r\n\r\n" not in held:
            more = next(plain, None)
            if more is None:
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
            held += more
            if b"\r\n\r\n" not in held and len(held) > HEAD_LIMIT:
                raise ValueError("a record's head is too long")
        end = held.index(b"\r\n\r\n") + 4
        head = _head(held[:end])
        left, engine, size = end + int(head["content-length"]) + 4, zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
        while left:
            if not held:
                held = next(plain, b"")
                if not held:
                    raise ValueError("the archive ends inside a record")
            packed = engine.compress(held[:left])
            sink.write(packed)
            size += len(packed)
            left, held = left - len(held[:left]), held[left:]
        packed = engine.flush()
        sink.write(packed)
        yield offset, size + len(packed), head
        offset += size + len(packed)


def _places(uri: str) -> tuple[Any, str, str, str]:
    from pyspark import TaskContext

    task = TaskContext.get()
    store, root = fs.FileSystem.from_uri(uri)
    return store, f"{root}/part-{task.partitionId():06d}", f"{root}/.own-{task.partitionId():06d}-{task.taskAttemptId()}", root


def _row(path: str, index: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "index", "n_records", "n_bytes"])


def _archiver(uri: str, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, final, own, _ = _places(uri)
        sink, engine, n, size = None, zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
        for batch in pieces(batches, "html"):
            sink = sink or store.open_output_stream(own, compression=None)
            rows = batch.select(["page_id", "url", "digest", "record_type", "refers_to"]).to_pylist()
            for row, payload in zip(rows, texts(batch.column("html")), strict=True):
                packed = engine.compress(record(row["page_id"], row["url"], payload, row["digest"], row["record_type"], row["refers_to"]))
                sink.write(packed)
                n, size = n + 1, size + len(packed)
        if sink:
            sink.write(engine.flush())
            sink.close()
            store.move(own, f"{final}.warc.gz")
            yield _row(f"{final}.warc.gz", "", n, size)

    return write


def write_archives(pages: DataFrame, uri: str, level: int = 1) -> DataFrame:
    """Write the decided pages as monolithic gzip archives; one row per file."""
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    return materialize(pages.mapInArrow(_archiver(uri, level), FILES), "warc-files")


def _normaliser(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, own, root = _places(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                final, n, size = f"{root}/{path.rsplit('/', 1)[-1]}", 0, 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(own, compression=None) as sink, store.open_output_stream(f"{own}.idx", compression=None) as index:
                    for offset, length, head in split_members(source, sink):
                        fields = (offset, length, head["warc-type"], head["warc-record-id"], head.get("warc-target-uri", "-"))
                        index.write("\t".join(map(str, fields)).encode() + b"\n")
                        n, size = n + 1, offset + length
                store.move(own, final)
                store.move(f"{own}.idx", f"{final}.idx")
                yield _row(final, f"{final}.idx", n, size)

    return run


def normalise(files: DataFrame, uri: str) -> DataFrame:
    """One member per record and a sidecar index for each file of ``files``."""
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    dealt = files.repartition(max(1, files.count()), "path")
    return materialize(dealt.mapInArrow(_normaliser(uri), FILES), "warc-normal")


def read_record(source: Any, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC head, HTTP head, payload) of the member at ``offset``."""
    source.seek(offset)
    plain = zlib.decompress(source.read(length), GZIP)
    end = plain.index(b"\r\n\r\n") + 4
    head = _head(plain[:end])
    block = plain[end : end + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    return head, _head(block[:cut]), block[cut:]


def _back(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for file in batch.to_pylist():
                out: list[tuple] = []
                with store.open_input_stream(file["index"], compression=None) as index:
                    places = [line.split(b"\t") for line in index.read().splitlines()]
                with store.open_input_file(file["path"]) as source:
                    for offset, length, *_ in places:
                        head, http, payload = read_record(source, int(offset), int(length))
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        size, kind = int(http["content-length"]), head["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{head['warc-record-id']} does not match its digest")
                        out.append((_page(head["warc-record-id"]), size, digest, kind, _page(head.get("warc-refers-to"))))
                ids, sizes, digests, kinds, refers = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(refers, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(files: DataFrame, uri: str) -> DataFrame:
    """What the normalised archives hold, record by record through their indexes."""
    return files.repartition(max(1, files.count()), "path").mapInArrow(_back(uri), RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; the monolithic files go once they are rewritten."""
    spark = pages.sparkSession
    first, second = scratch(spark, "warc-monolithic"), scratch(spark, "warc")
    files = normalise(write_archives(decide(pages), first), second)
    store, root = fs.FileSystem.from_uri(first)
    store.delete_dir(root)
    return read_archives(files, second)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
