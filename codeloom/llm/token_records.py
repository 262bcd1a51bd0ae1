"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A data file is a sequence of frames, little-endian:

    length of the payload, 8 bytes | masked CRC-32 of those 8 bytes, 4 | payload | masked CRC-32 of the payload, 4 | 0x0A

masked(c) = ((c >> 15) | (c << 17)) + 0xA282EAD8 modulo 2**32, so that a checksum over data that hold checksums stays sound.
A payload is a flag byte (1: doc_id is null, 2: ids take four bytes, else two), doc_id in 8 bytes, and the ids. Files are in
ascending doc_id order, within and among each other. The index, a Parquet table beside them, has for each record its file's
number, offset, length, doc_id, number of ids, and place among the ids of its file: shuffled reads fetch by offset.

Files are written and committed by Spark's text writer, with 0x0A as line separator, so they can lie in any store that Spark
reaches, and a retried task leaves no halves. A row of the writer holds frames of ROW_BYTES about, or one that is longer, and a
file holds FILE_ROWS of them at most, so files are of bounded size even where long texts follow one another.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .shared import fresh_path, shuffle_partitions

#: Text that goes into one task, about; a reader holds a file.
FILE_BYTES = 32 << 20
ROW_BYTES, FILE_ROWS = 1 << 20, 32
#: Words whose ids a worker remembers, some 40 bytes each.
REMEMBERED = 1_500_000

_HEAD = struct.Struct("<QI")
_LEAD = struct.Struct("<Bq")
_ENCODERS: dict = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its last byte, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every frame; ValueError where a length, checksum or end is wrong."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"a frame is cut off at {at}")
        length, check = _HEAD.unpack_from(data, at)
        end = at + 12 + length
        if masked(data[at : at + 8]) != check or end + 5 > len(data):
            raise ValueError(f"a length is wrong at {at}")
        payload = bytes(view[at + 12 : end])
        if struct.unpack_from("<I", data, end)[0] != masked(payload) or data[end + 4] != 10:
            raise ValueError(f"a payload is wrong at {at}")
        yield at, payload
        at = end + 5


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return _LEAD.pack((doc_id is None) + 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flag, doc_id = _LEAD.unpack_from(payload)
    return None if flag & 1 else doc_id, np.frombuffer(payload, "<u4" if flag & 2 else "<u2", offset=_LEAD.size).astype("<u4")


def record_at(data: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the record at an offset."""
    length, _ = _HEAD.unpack_from(data, at)
    return unpack(next(frames(data[at : at + 12 + length + 5]))[1])


class Encoder:
    """Texts to ids.

    Where the tokenizer's words never cross ASCII white space, which it drops, each word is encoded once: it is known by 64 bits
    of hash and its length, in an open table that starts anew when it is full. Whether that is so is tried on PROBES; other
    tokenizers encode whole texts.
    """

    #: Joined by white space of all kinds, these must encode to what they do alone.
    PROBES = ("Hello", "world!", "it's", "a_b", "x.y", "ÀÉ", "e\u0301", "1234", "...", "日本語", "<s>", "in", "to", "into", "##a", "\u2581b", "the", "é")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mask = np.uint64((1 << (4 * REMEMBERED // 3 - 1).bit_length()) - 1)
        self._clear()
        whole = lambda x: self.library.encode(x, add_special_tokens=False).ids
        alone = [i for w in self.PROBES for i in whole(w)]
        self.by_word = all(whole(a + gap.join(self.PROBES) + a) == alone for gap in (" ", "  ", "\n", "\t", "\r\n", " \x0b\x0c") for a in ("", gap))

    def _clear(self) -> None:
        size = int(self.mask) + 1
        self.keys, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.start, self.width, self.known = np.zeros(1, np.int64), np.zeros(0, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; -1 for new ones."""
        slot = (h & self.mask).astype(np.int64)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            out[todo] = self.number[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != h[todo])]
        return out

    def _add(self, h: np.ndarray, texts: list[str], width: np.ndarray) -> None:
        """Encodes new words, all different."""
        for k in range(0, len(h), 20_000):
            got = [e.ids for e in self.library.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, total), np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.start = np.concatenate([self.start, self.used + np.cumsum(sizes)])
            self.used += total
        self.width = np.concatenate([self.width, width.astype(np.int32)])
        todo, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):  # of those that want one free slot, the first takes it; the others go on
            free = todo[self.number[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            taken = free[one]
            self.number[slot[taken]] = self.known + taken
            self.keys[slot[taken]] = h[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            busy = todo[self.keys[slot[todo]] != h[todo]]
            slot[busy] = (slot[busy] + 1) & int(self.mask)
        self.known += len(h)

    def encode(self, column: pa.Array, end: int | None) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        tail = np.array([] if end is None else [end], np.uint32)
        if not self.by_word:
            for text in column:
                yield np.append(np.array(self.library.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32), tail)
            return
        held: list[np.ndarray] = []
        now = 0
        for first, h, begin, stop, at, data in words.located(column):
            while now < first:  # the text before is complete
                yield np.concatenate([*held, tail])
                held, now = [], now + 1
            n = self._find(h)
            new = np.flatnonzero(n < 0)
            if len(new):
                if self.known + len(new) > REMEMBERED:
                    self._clear()
                    new = np.arange(len(h))
                hashes, one = np.unique(h[new], return_index=True)
                one = new[one]
                raw = data.tobytes()
                self._add(hashes, [raw[a:b].decode() for a, b in zip(begin[one].tolist(), stop[one].tolist(), strict=True)], stop[one] - begin[one])
                n = self._find(h)
            if np.any(self.width[n] != stop - begin):
                raise ValueError("two words share a hash")
            size = self.start[n + 1] - self.start[n]
            ends = np.cumsum(size)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[n] - (ends - size), size)]
            cut = np.append(0, ends)[at]
            for k in range(len(at) - 1):
                held.append(ids[cut[k] : cut[k + 1]])
                if k < len(at) - 2:
                    yield np.concatenate([*held, tail])
                    held, now = [], now + 1
        if len(column):
            yield np.concatenate([*held, tail])


def encoder(path: str) -> Encoder:
    """This process's encoder of a file. Tasks reach it by the module's name, so that it outlives them."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rows(frames: Iterator[bytes]) -> Iterator[bytes]:
    """Frames as the writer's rows, each without its last 0x0A."""
    held, size = [], 0
    for one in frames:
        if held and size + len(one) > ROW_BYTES:
            yield b"\n".join(held)
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield b"\n".join(held)


def write(docs: DataFrame, tokenizer: str, path: str, end: int | None = 1) -> None:
    """Encodes docs (doc_id, text) with a tokenizer file of the tokenizers library and writes path/data and path/index.

    tokenizer is a path on every machine. end is appended to each document. Null and empty texts have no ids but that; null
    doc_ids come first; rows that repeat a doc_id are records of their own, in the order of a hash of their texts. Texts of any
    length are one record. An empty table gives no records. Other columns don't matter.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(shuffle_partitions(spark), -(-size // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # both, so that no doc_id holds a range up
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)

        def frames() -> Iterator[bytes]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    for d, i in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text"), end), strict=True):
                        yield frame(pack(d, i))

        for row in _rows(frames()):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).text(f"{path}/data")
    _index(spark, path).write.parquet(f"{path}/index")


def _number() -> Column:
    """A file's number, in the order of files: its task's and which of the task's files it is."""
    part = lambda k: F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("long")
    return (part(1) * (1 << 24) + part(2)).alias("file")


def _index(spark: SparkSession, path: str) -> DataFrame:
    """Every record's place, from the data files themselves; checks all checksums."""
    names = ["file", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"]
    kinds = (pa.int64(),) * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for offset, payload in frames(content.as_py()):
                    doc_id, ids = unpack(payload)
                    rows.append((number, offset, len(payload) + 17, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(_number(), "content").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32, file, offset, length of every record.

    The files' sums run within the files of a task, and over tasks in one window, which has a row for each.
    """
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("task", F.shiftright("file", 24))
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = totals.groupBy("task").agg(F.sum("total").alias("total")).select("task", before(Window.orderBy("task")).alias("base"))
    inside = totals.select("file", "task", before(Window.partitionBy("task").orderBy("file")).alias("inside"))
    first = inside.join(tasks, "task").select("file", (F.col("base") + F.col("inside")).alias("base"))
    return index.join(first, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the records whose file and offset are in wanted, for reads in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist(), strict=True):
                data = content.as_py()
                got = [record_at(data, at) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([i.tolist() for _, i in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    files = files.select(_number(), "content")
    per_file = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    return files.join(per_file, "file").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<long>")


def export(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """write() to a new place in the shared folder, then read()."""
    path = fresh_path(docs.sparkSession, "token-records")
    write(docs, tokenizer, path, end)
    return read(docs.sparkSession, path)
