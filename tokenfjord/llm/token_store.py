"""Token ids in seekable files of independent zstandard frames.

File layout, one file per range of ascending doc_ids::

    frame*        zstandard frames of little-endian ids, whole documents each
                  unless one document alone is larger than a frame
    doc table     a skippable frame: per document doc_id (with a null flag),
                  first frame, offset in ids inside it, and number of ids
    seek table    a skippable frame: per data frame its compressed and plain
                  size and the low 32 bits of the plain bytes' XXH64, then the
                  number of frames, a flag byte and the closing magic number

The seek table is the public "seekable format" of zstandard with checksums, so
other readers can use it; the doc table is one more skippable frame, which they
pass over. A reader fetches the tail, then only the frames of the documents it
is asked for.

Files are written under a task's own name and renamed when complete, so a task
that runs twice leaves one whole file with the same content. Ids are stored in
two bytes while the vocabulary allows.

Defined results: a null or empty text has the end id alone; a null doc_id comes
last; rows with one doc_id are ordered by their text's hash.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, scratch, texts

END_ID = 2
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Pre-tokens whose ids a worker remembers; with their keys and ids they take at most about 80 MB.
CACHE = 500_000
#: Characters of a pre-token that is remembered: three words of six, ten bits each.
KEY_CHARS, KEY_BITS, KEY_WORD = 18, 10, 6
#: Characters cut into pre-tokens at once, about.
PART_CHARS = 1 << 17
#: Input as stored that one file takes, about, while that makes at most MOST_FILES; beyond, files grow.
FILE_BYTES, MOST_FILES = 16 << 20, 1 << 20
_SEEK_MAGIC, _SKIP_SEEK, _SKIP_DOCS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_DOC = np.dtype([("doc_id", "<i8"), ("none", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u8")])

#: The normaliser and the pattern of word_bpe files, which the cutting below follows.
_WORD_BPE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_BPE_NORMAL = ["NFC", "Replace", "Lowercase"]
#: Characters from this one on, and three below that have no lower case of one character below it, go to the library.
_NEAR = 0x240
_SPACE, _LETTER, _NUMBER, _OTHER, _FAR = range(5)


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and class of the characters below _NEAR; the last entry stands for all others."""
    lower, kind = np.arange(_NEAR + 1, dtype=np.uint32), np.full(_NEAR + 1, _OTHER, np.uint8)
    for code in range(_NEAR):
        small, group = chr(code).lower(), unicodedata.category(chr(code))[0]
        kind[code] = _SPACE if code in _WHITE or code in (0x85, 0xA0) else _LETTER if group == "L" else _NUMBER if group == "N" else _OTHER
        if len(small) == 1 and ord(small) < _NEAR:
            lower[code] = ord(small)
        else:
            kind[code] = _FAR
    kind[_NEAR] = _FAR
    return lower, kind


_WHITE = (9, 10, 11, 12, 13, 32)
_LOWER, _KIND = _character_tables()


class Memory:
    """A hash table of packed pre-tokens, by linear probing over whole arrays.

    A row holds the three words of a key and its number plus one; equality is of
    whole keys, so no two pre-tokens are ever confused.
    """

    def __init__(self, limit: int) -> None:
        self.bits = max(4, (2 * limit - 1).bit_length())
        self.rows = np.zeros((1 << self.bits, 4), np.uint64)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed ^= keys[:, 2] * np.uint64(0x165667B19E3779F9)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for the unknown."""
        out = np.full(len(keys), -1, np.int64)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            rows = self.rows[slots]
            want = keys if len(left) == len(keys) else keys[left]
            same = (rows[:, 0] == want[:, 0]) & (rows[:, 1] == want[:, 1]) & (rows[:, 2] == want[:, 2]) & (rows[:, 3] > 0)
            out[left[same]] = rows[same, 3].astype(np.int64) - 1
            on = ~same & (rows[:, 3] > 0)
            left, slots = left[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys in their order."""
        numbers = np.arange(self.n + 1, self.n + 1 + len(keys), dtype=np.uint64)
        self.n += len(keys)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.rows[slots, 3] == 0
            _, first = np.unique(slots[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.rows[slots[mine], :3] = keys[left[mine]]
            self.rows[slots[mine], 3] = numbers[left[mine]]
            on = np.ones(len(left), bool)
            on[mine] = False
            left, slots = left[on], (slots[on] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Ids of whole texts, where each short pre-token is encoded once.

    Texts are lower-cased and cut into pre-tokens here, by array operations that
    follow the vocabulary file's own pattern; below U+0240 its normal form
    changes nothing. New pre-tokens are encoded by the library, many at a time,
    and remembered under their packed characters. Long pre-tokens, and chunks
    between ASCII white space that have other characters or a special token, go
    to the library as they are; neither its normaliser nor its cutting looks
    across white space. A vocabulary file of another kind is left to the library
    altogether.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: The same vocabulary for pre-tokens, which are cut and lower-cased already.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.library.get_vocab()
        self.width = 2 if max(words.values()) < 1 << 16 else 4
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True
        with open(path) as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        cutting, normal = (spec.get(k) or {} for k in ("pre_tokenizer", "normalizer"))
        patterns = [x.get("pattern", {}).get("Regex") for x in cutting.get("pretokenizers", ())]
        self.known = patterns[:1] == [_WORD_BPE] and [x["type"] for x in normal.get("normalizers", ())] == _WORD_BPE_NORMAL
        self.limit = cache
        self.clear()

    def clear(self) -> None:
        self.memory = Memory(self.limit)
        self.ids = np.empty(1 << 12, "<u4")
        self.ends = np.zeros(1, np.int64)

    def _kinds(self, text: str, codes: np.ndarray) -> np.ndarray:
        """Each character's class; whole chunks that go to the library are _FAR."""
        kinds = _KIND[np.minimum(codes, _NEAR)]
        far = kinds == _FAR
        for word in self.special:
            at = text.find(word)
            while at >= 0:
                far[at] = True
                at = text.find(word, at + 1)
        if far.any():
            white = (codes == 32) | (codes >= 9) & (codes <= 13)
            edges = np.flatnonzero(np.r_[True, white[1:] != white[:-1]])
            hit = np.add.reduceat(far, edges, dtype=np.int64) > 0
            kinds[np.repeat(hit, np.diff(np.r_[edges, len(codes)]))] = _FAR
        return kinds

    @staticmethod
    def _starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character."""
        changed = np.r_[True, kinds[1:] != kinds[:-1]]
        starts = (kinds != _SPACE) & (changed | (kinds == _NUMBER))
        marks = np.flatnonzero(changed & (kinds == _OTHER) & (codes == 39))
        one, two = codes[np.minimum(marks + 1, len(codes) - 1)], codes[np.minimum(marks + 2, len(codes) - 1)]
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(long, 3, 0))
        marks, size = marks[size > 0], size[size > 0]
        inside = kinds[marks + size - 1] == _LETTER  # False beyond the text's end or in another chunk
        marks, size = marks[inside], size[inside]
        starts[marks + 1] = False
        after = marks + size
        after = after[after < len(codes)]
        starts[after] |= kinds[after] == _LETTER
        return starts

    @staticmethod
    def _keys(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Packed characters of pre-tokens that stand one after the other in ``codes``."""
        first = np.cumsum(sizes) - sizes
        within = np.arange(len(codes)) - np.repeat(first, sizes)
        word = within // KEY_WORD
        shifted = codes.astype(np.uint64) << ((within - KEY_WORD * word) * KEY_BITS).astype(np.uint64)
        at = np.flatnonzero(within == word * KEY_WORD)
        keys = np.zeros((len(sizes), 3), np.uint64)
        keys[np.repeat(np.arange(len(sizes)), -(-sizes // KEY_WORD)), word[at]] = np.add.reduceat(shifted, at)
        return keys

    def _encoded(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens without white space, one after the other, and each one's number of ids."""
        found, sizes = [], []
        for at in range(0, len(many), 2000):
            part = many[at : at + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(part):  # a pre-token without an end mark: one by one
                each = [e.ids for e in self.words.encode_batch_fast(part, add_special_tokens=False)]
                ids = np.array([i for e in each for i in e], "<u4")
                stops = np.cumsum([len(e) for e in each])
            found.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        return np.concatenate([np.empty(0, "<u4"), *found]), np.concatenate([np.empty(0, np.int64), *sizes])

    def _put(self, ids: np.ndarray) -> int:
        """Store ids behind those remembered; where they start."""
        used = int(self.ends[-1])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used + 2 * len(ids), "<u4")])
        self.ids[used : used + len(ids)] = ids
        return used

    def _known(self, keys: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The numbers of keys; ``words`` gives the pre-tokens at places."""
        found = self.memory.find(keys)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        order = new[np.lexsort(keys[new].T)]
        first = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(1)]
        if self.memory.n + int(first.sum()) > self.limit and self.memory.n:
            self.clear()
            return self._known(keys, words)
        ids, sizes = self._encoded(words(order[first]))
        self._put(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        found[order] = self.memory.n - 1 + np.cumsum(first)
        if self.memory.n + len(sizes) <= self.limit:
            self.memory.add(keys[order[first]])
        else:  # more than fits, in one part of a text: remembered for this part only
            self.memory.n += len(sizes)
        return found

    def _part(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each pre-token starts in the text, its number of ids)."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        none = np.empty(0, np.int64)
        if not len(codes):
            return np.empty(0, "<u4"), none, none
        kinds = self._kinds(text, codes)
        low = _LOWER[np.minimum(codes, _NEAR)]
        starts = self._starts(low, kinds)
        at = np.flatnonzero(starts)
        if not len(at):
            return np.empty(0, "<u4"), none, none
        shown = kinds != _SPACE
        number = np.cumsum(starts)[shown] - 1
        sizes = np.bincount(number, minlength=len(at))
        short = (kinds[at] != _FAR) & (sizes <= KEY_CHARS)
        lowered = low.astype("<u4").tobytes().decode("utf-32-le")
        if short.all():
            keys, inner = self._keys(low[shown], sizes), at
        else:
            keys, inner = self._keys(low[shown][short[number]], sizes[short]), at[short]
        lengths = sizes if short.all() else sizes[short]
        k = self._known(keys, lambda places: [lowered[a : a + n] for a, n in zip(inner[places].tolist(), lengths[places].tolist(), strict=True)])
        begin, count = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[short], count[short] = self.ends[k], self.ends[k + 1] - self.ends[k]
        if not short.all():
            rest = np.flatnonzero(~short)
            units = [text[a : a + n] if far else lowered[a : a + n] for a, n, far in zip(at[rest].tolist(), sizes[rest].tolist(), (kinds[at[rest]] == _FAR).tolist(), strict=True)]
            names = {u: i for i, u in enumerate(dict.fromkeys(units))}
            each = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(list(names), add_special_tokens=False)]
            many = np.array([len(e) for e in each], np.int64)
            base = self._put(np.concatenate(each)) + np.cumsum(many) - many
            place = np.fromiter(map(names.__getitem__, units), np.int64, len(units))
            begin[rest], count[rest] = base[place], many[place]
        stops = np.cumsum(count)
        return self.ids[np.arange(int(stops[-1])) + np.repeat(begin - stops + count, count)], at, count

    def encode(self, many: list[bytes], end_id: int = END_ID) -> list[np.ndarray]:
        """The ids of each text, each with the end id appended."""
        decoded = [x.decode() for x in many]
        if not self.known:
            return [np.array([*e.ids, end_id], "<u4") for e in self.library.encode_batch_fast(decoded, add_special_tokens=False)]
        out: list[list[np.ndarray]] = [[] for _ in many]
        waiting: list[tuple[int, str]] = []

        def flush() -> None:
            ids, at, count = self._part("\n".join(t for _, t in waiting))
            edges = np.cumsum([0, *(len(t) + 1 for _, t in waiting)])
            total = np.r_[0, np.cumsum(count)][np.searchsorted(at, edges)].tolist()
            for (k, _), a, b in zip(waiting, total, total[1:], strict=False):
                out[k].append(ids[a:b])
            waiting.clear()

        held = 0
        for k, text in enumerate(decoded):
            at = 0
            while at < len(text):
                end = at + PART_CHARS
                while end < len(text) and text[end] not in " \t\n\r":
                    end += 1
                waiting.append((k, text[at:end]))
                held += len(waiting[-1][1])
                if held >= PART_CHARS:
                    flush()
                    held = 0
                at = end
        if waiting:
            flush()
        last = np.array([end_id], "<u4")
        return [np.concatenate([*found, last]) for found in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; what it remembers serves the next task, too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Writer:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, sink: Any, width: int = 4, frame_bytes: int = FRAME_BYTES) -> None:
        self.sink, self.kind, self.frame_bytes = sink, f"<u{width}", frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = self.n_ids = self.n_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.kind).tobytes()
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        unit = int(self.kind[2:])
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.size // unit, len(ids)))
        step = max(unit, self.frame_bytes // unit * unit)
        for at in range(0, len(data), step):
            if at:
                self._flush()
            self.waiting.append(data[at : at + step])
            self.size += len(self.waiting[-1])
        self.n_ids += len(ids)

    def _flush(self) -> None:
        plain = b"".join(self.waiting)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.n_bytes += len(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        body = np.array(self.docs, _DOC).tobytes()
        table = struct.pack("<IB", len(self.docs), int(self.kind[2:])) + body
        self.sink.write(_skippable(_SKIP_DOCS, table + struct.pack("<I", len(table) + 12)))
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEK_MAGIC)
        self.sink.write(_skippable(_SKIP_SEEK, seek))
        self.sink.close()


class Reader:
    """Random access to one file: only the frames of the documents asked for are read."""

    def __init__(self, source: Any) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != _SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._read(start + 8, 12 * n), "<u4").reshape(-1, 3)
        (length,) = struct.unpack("<I", self._read(start - 4, 4))
        table = self._read(start - length, length - 4)
        count, self.width = struct.unpack("<IB", table[8:13])
        self.docs = np.frombuffer(table[13:], _DOC, count)
        self.offsets = np.r_[0, np.cumsum(self.frames[:, 0], dtype=np.int64)]
        self.held = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            packed, size, check = map(int, self.frames[k])
            plain = zstandard.ZstdDecompressor().decompress(self._read(int(self.offsets[k]), packed), max_output_size=size)
            if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, plain)
        return self.held[1]

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the doc table."""
        doc = self.docs[place]
        left, at, k, found = int(doc["n"]), int(doc["at"]), int(doc["frame"]), []
        while left:
            part = np.frombuffer(self.frame(k), f"<u{self.width}")[at : at + left]
            found.append(part)
            left, at, k = left - len(part), 0, k + 1
        return np.concatenate(found or [np.empty(0)]).astype("<u4")


MANIFEST = "file_no int, path string, n_docs long, n_ids long, n_bytes long"


def _writer(path: str, vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, writer, coder = TaskContext.get(), None, encoder(vocabulary)
        store, root = fs.FileSystem.from_uri(path)
        final = f"{root}/part-{task.partitionId():06d}.zst"
        own = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in pieces(batches, most_bytes=1 << 20):
            writer = writer or Writer(store.open_output_stream(own, compression=None), coder.width)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(texts(batch.column("text")), end_id), strict=True):
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            store.move(own, final)
            row = [task.partitionId(), final, len(writer.docs), writer.n_ids, writer.n_bytes]
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]]), *(pa.array([x], pa.int64()) for x in row[2:])], ["file_no", "path", "n_docs", "n_ids", "n_bytes"])

    return write


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of docs below ``path`` in ascending doc_id order; the manifest, one row per file."""
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = max(spark.sparkContext.defaultParallelism, min(-(-stored // FILE_BYTES), MOST_FILES))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_writer(path, vocabulary, end_id), MANIFEST), "token-manifest")


def _read_files(scheme: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(scheme)
        for batch in batches:
            for file in batch.to_pylist():
                with store.open_input_file(file["path"]) as source:
                    reader = Reader(source)
                    n, crc = [], []
                    for place in range(len(reader.docs)):
                        ids = reader.ids(place)
                        n.append(len(ids))
                        crc.append(zlib.crc32(ids.tobytes()))
                starts = file["start"] + np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
                ids = pa.array(reader.docs["doc_id"].astype(np.int64), mask=reader.docs["none"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_store(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file_no", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    parts = max(1, manifest.count())
    return files.repartition(parts, "file_no").mapInArrow(_read_files(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write docs to a store and return what reading it back gives."""
    path = path or scratch(spark, "token-store")
    return read_store(write_store(docs, path, vocabulary), path)
