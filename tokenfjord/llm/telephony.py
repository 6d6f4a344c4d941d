"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV containers.

A payload's bytes are the coded samples themselves (mu-law and A-law: one byte
a sample; ADPCM: blocks of 192 bytes), so storing is lossless. Reading expands
mu-law and A-law by lookup tables and decodes ADPCM blocks with numpy, one
nibble of all blocks of a batch at a time; the 8 kHz samples are resampled to
16 kHz 16-bit PCM, which is stored, too. Features are computed from the PCM read
back. It is stored without loss by prediction: every second sample, and the
differences of those between from what their four neighbours give, in blocks of
many documents that are compressed Arrow streams.

Defined results: a null text is empty and is padded to one block; equal texts
give equal rows; the codec follows from the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, texts

BLOCK = 192
RATE = 8000
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: WAV format tags of the codecs.
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
BLOCK_SAMPLES = (BLOCK - 4) * 2 + 1
#: How media are written: long pages hold many documents.
DENSE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}
#: Bytes of media whose PCM makes a block, and the level of its compression.
PCM_BLOCK, PCM_LEVEL = 4 << 20, 12

# Fixed values of the IMA ADPCM format: quantiser steps and index moves.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + nibble: the difference, and 16 * the next index."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    following = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


MULAW, ALAW = _mulaw_table(), _alaw_table()
DIFFERENCE, FOLLOWING = _adpcm_tables()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """int16 samples [blocks, BLOCK_SAMPLES] of whole blocks of bytes.

    A block starts with its first sample and its step index; an index beyond
    the table counts as the last.
    """
    blocks = data.reshape(-1, BLOCK)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    out[0] = sample
    at = 1
    for column in body:
        for nibble in (column & 15, column >> 4):
            place = index + nibble
            sample = np.clip(sample + DIFFERENCE[place], -32768, 32767)
            index = FOLLOWING[place]
            out[at] = sample
            at += 1
    return out.T


def between(pcm: np.ndarray) -> np.ndarray:
    """After each sample the one half-way to the next: the four nearest are weighed -1, 9, 9, -1 over 16."""
    x = np.pad(pcm.astype(np.int32), (1, 2), "edge")
    return np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767).astype(np.int16)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = between(pcm)
    return out


def pack(pcm: np.ndarray) -> bytes:
    """Any int16 samples without loss: the even ones, then what the odd ones differ by from the prediction, modulo 2^16."""
    if not len(pcm):
        return b""
    even, odd = pcm[::2], pcm[1::2]
    return even.astype("<i2").tobytes() + (odd - between(even)[: len(odd)]).astype("<i2").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The samples of ``pack``."""
    both = np.frombuffer(packed, "<i2").astype(np.int16)
    out, half = np.empty_like(both), (len(both) + 1) // 2
    if len(both):
        out[::2] = both[:half]
        out[1::2] = both[half:] + between(both[:half])[: len(both) - half]
    return out


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of a block."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file whose data chunk is the payload."""
    tag = TAGS[codec]
    if codec == "ima_adpcm":
        samples = len(payload) // BLOCK * BLOCK_SAMPLES
        form = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
    else:
        samples = len(payload)
        form = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(media: bytes) -> tuple[str, bytes]:
    """(codec, data chunk) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, ""
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(c for c, t in TAGS.items() if t == tag)
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_batch(media: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, payload, 16 kHz PCM) of each file; ADPCM blocks of all files are decoded together."""
    parsed = [parse_wav(m) for m in media]
    blocks = [np.frombuffer(p, np.uint8) for c, p in parsed if c == "ima_adpcm"]
    decoded = decode_adpcm(np.concatenate(blocks)) if blocks else np.empty((0, BLOCK_SAMPLES), np.int16)
    out, at = [], 0
    for codec, payload in parsed:
        if codec == "ima_adpcm":
            n = len(payload) // BLOCK
            pcm = decoded[at : at + n].ravel()
            at += n
        else:
            pcm = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)]
        out.append((codec, payload, resample(pcm)))
    return out


def describe(codec: str, pcm: np.ndarray) -> str:
    """Features of 16 kHz PCM as text."""
    wide = pcm.astype(np.float32)
    power = float(np.dot(wide, wide)) / len(pcm)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    peak = int(max(pcm.max(), -int(pcm.min())))
    return f"codec={codec};rate={2 * RATE};samples={len(pcm)};peak={peak};rms={power**0.5:.1f};crossings={crossings};pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        many = texts(batch.column("text"))
        media = [wav(p, CODECS[zlib.crc32(p) % len(CODECS)]) for p in map(padded, many)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in many], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a WAV file, written to the shared folder and read back."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(narrow.mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary"), "telephony", **DENSE)


def _block(rows: pa.RecordBatch) -> bytes:
    """A batch as an Arrow stream, its buffers compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PCM_LEVEL))) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each stored block."""
    for batch in pieces(batches, "block", 1 << 20):
        for block in batch.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())


PCM = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "rate", "packed"]


def _pcm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "media", PCM_BLOCK):
        media = batch.column("media").to_pylist()
        decoded = decode_batch(media)
        payloads = [p for _, p, _ in decoded]
        order = sorted(range(len(decoded)), key=lambda k: decoded[k][0])  # like samples are stored together
        columns = [
            batch.column("doc_id").take(pa.array(order)),
            batch.column("n_bytes").take(pa.array(order)),
            pa.array([len(payloads[k]) for k in order], pa.int64()),
            pa.array([hashlib.sha256(payloads[k]).digest() for k in order], pa.binary()),
            pa.array([zlib.crc32(payloads[k][-16:]) for k in order], pa.int64()),
            pa.array([len(media[k]) for k in order], pa.int64()),
            pa.array([hashlib.sha256(media[k]).digest() for k in order], pa.binary()),
            pa.array([decoded[k][0] for k in order]),
            pa.array([2 * RATE] * len(order), pa.int32()),
            pa.array([pack(decoded[k][2]) for k in order], pa.large_binary()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([_block(pa.RecordBatch.from_arrays(columns, PCM))], pa.binary())], ["block"])


def _stored_pcm(media: DataFrame) -> DataFrame:
    """Blocks of the PCM of a media table, packed, with digests of the files: written to the shared folder and read back."""
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(_pcm_batches, "block binary"), "telephony-pcm")


def _unpacked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        for batch in pieces(iter([block]), "packed"):
            pcm = pa.array([unpack(x).astype("<i2").tobytes() for x in batch.column("packed").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rate"), pcm], ["doc_id", "rate", "pcm"])


def store_pcm(media: DataFrame) -> DataFrame:
    """(doc_id, rate, pcm): the resampled PCM of a media table, written to the shared folder and read back."""
    return _stored_pcm(media).mapInArrow(_unpacked_batches, "doc_id long, rate int, pcm binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for rows in _blocks(batches):
        columns = {c: pa.array([x.hex() for x in rows.column(c).to_pylist()]) if c.endswith("sha256") else rows.column(c) for c in names[:-1]}
        described = [describe(codec.as_py(), unpack(x.as_py())) for codec, x in zip(rows.column("codec"), rows.column("packed"), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(described)], names)


def features(media: DataFrame) -> DataFrame:
    """Digests of the stored files and features of their resampled PCM, which is stored and read back."""
    return _stored_pcm(media).mapInArrow(_feature_batches, FEATURES)
