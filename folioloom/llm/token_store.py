"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending order of their key:

    blocks    entries (shared u8, own u8, bytes u32, rest of the key, payload), then their crc32 u32; keys share
              prefixes within a block, the first one is whole; a block ends once it holds `block_bytes`
    index     for each block: first key (9 bytes), offset u64, size u32
    bloom     a bit array; a key sets `hashes` bits
    footer    index at u64, blocks u32, bloom at u64, bloom bits u64, hashes u32, documents u64, ids u64, width u32, magic

A key is a presence byte and the identifier as 8 big-endian bytes with its sign bit turned, so that byte order is
number order and a null identifier comes first. Payloads are little-endian ids of the width in the footer, 2 bytes
where the vocabulary allows it, else 4. Shards follow one another in
key order, so a reader finds a document by the shard's range, its filter, a binary search of the index and one block.

Null or empty texts hold the end id alone. Repeated identifiers are kept, each with its own ids; a lookup returns all
of them. Rows with equal identifiers are ordered by the hash of their text. Very long texts are entries of blocks of
their own size. An empty table gives no shard and no rows. Other columns are ignored, whatever their names. The folder
needs a scheme that both Spark and pyarrow know.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder

MAGIC = b"FLSST\x00\x00\x01"
FOOTER = struct.Struct("<QIQQIQQI8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<9sQI")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bits(key: bytes, bits: int, hashes: int) -> list[int]:
    both = xxhash.xxh3_128_intdigest(key)
    first, step = both & 2**64 - 1, both >> 64 | 1
    return [(first + i * step) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard to an open stream; add() keys in ascending order."""

    def __init__(self, out, block_bytes: int = 1 << 16, bits_per_key: int = 10, hashes: int = 7, width: int = 4):
        self.width = width
        self.out, self.block_bytes, self.bits_per_key, self.hashes = out, block_bytes, bits_per_key, hashes
        self.at = self.tokens = 0
        self.block: list[bytes] = []
        self.size, self.last, self.first = 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: as little-endian u32."""
        payload = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        assert not self.keys or key >= self.keys[-1], "keys must ascend"
        shared = len(os.path.commonprefix([self.last, key]))
        if not self.block:
            self.first = key
        entry = ENTRY.pack(shared, len(key) - shared, len(payload)) + key[shared:]
        self.block += [entry, payload]
        self.size += len(entry) + len(payload)
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // 4
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append(INDEX.pack(self.first, self.at, len(data)))
            self._write(data)
            self.block, self.size, self.last = [], 0, b""

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(self.index))
        bits = max(64, self.bits_per_key * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[_bits(key, bits, self.hashes)] = 1
        bloom_at = self.at
        self._write(np.packbits(bloom, bitorder="little").tobytes())
        self._write(FOOTER.pack(index_at, len(self.index), bloom_at, bits, self.hashes, len(self.keys), self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard through a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.index_at, self.blocks, self.bloom_at, self.bits, self.hashes, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard, or cut short")
        self.index = list(INDEX.iter_unpack(file.read_at(self.bloom_at - self.index_at, self.index_at)))
        self._bloom: bytes | None = None

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self.file.read_at((self.bits + 7) // 8, self.bloom_at)
        return all(self._bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bits, self.hashes))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[i]
        data = self.file.read_at(size, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        p, key = 0, b""
        while p < size - 4:
            shared, own, n = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + own]
            p += own
            yield key, data[p : p + n] if self.width == 4 else np.frombuffer(data, "<u2", n // 2, p).astype("<u4").tobytes()
            p += n

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The ids (little-endian u32) of all documents of this identifier."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        low, high = 0, len(self.index)
        while low < high:  # the first block that begins at the key or beyond it
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        for i in range(max(0, low - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [payload for k, payload in self.block(i) if k == key]
        return found

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)


def open_shard(uri: str) -> ShardReader:
    where, path = fs.FileSystem.from_uri(uri)
    return ShardReader(where.open_input_file(path))


def _write(uri: str, path: str, end_id: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(uri)
        own = encoder(path)
        encode, end, part = own.encode, np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        width = 2 if max(own.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"  # a task that runs again writes a file of its own; the manifest tells which counts
        writer = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    where.create_dir(folder, recursive=True)
                    writer = ShardWriter(where.open_output_stream(f"{folder}/{name}"), block_bytes, width=width)
                writer.add(key_of(doc), encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{uri}/{name}"]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.tokens], pa.int64()), pa.array([id_of(writer.keys[0])], pa.int64()), pa.array([id_of(writer.keys[-1])], pa.int64())], ["shard", "uri", "n_docs", "n_ids", "first_id", "last_id"])

    return run


def write_shards(spark: SparkSession, docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2, block_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards under `uri`, a folder that all executors share; returns the manifest, a row for each shard."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return rows.select("doc_id", "text").mapInArrow(_write(uri, tokenizer, end_id, block_bytes), "shard int, uri string, n_docs long, n_ids long, first_id long, last_id long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            out: list[tuple] = []
            for key, payload in open_shard(uri):
                out.append((id_of(key), start, len(payload) // 4, zlib.crc32(payload)))
                start += len(payload) // 4
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """Reads every block of the shards of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = manifest.select("shard", "uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return starts.repartition(n, "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, **kw) -> tuple[DataFrame, str]:
    """Shards in the shared scratch folder: their manifest and the folder."""
    scratch = Scratch(spark, "tokens")
    return scratch.store(write_shards(spark, docs, scratch.sub("shards"), tokenizer, end_id, **kw), "manifest"), scratch.sub("shards")
