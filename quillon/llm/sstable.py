"""Token-id output as sorted-string-table shards (operator 8).

A shard holds the documents of one range of identifiers, in ascending order; ranges follow the bytes and rows of the input, so
that a shard stays near ``SHARD_BYTES`` and ``SHARD_ROWS`` at any size::

    block*   a zstd frame of entries, each: u16 shared key bytes | u16 further key bytes | u32 value bytes | key bytes | value
    index    u32 entries, then per block: u64 place | u32 bytes | u16 key bytes | last key of the block
    bloom    u64 bits, then the bits; 7 probes per key
    footer   64 bytes: magic, version, places of index and bloom, documents, ids

Keys share their beginning with the key before, within a block. A key is one byte (0 for a null id, else 1) and the
id as eight big-endian bytes with the sign flipped, so byte order is id order. A value is the ids as little-endian
unsigned integers of ``width`` bytes. A lookup asks the Bloom filter, then searches the index, then one block.

Nulls, ties: a null text is empty; a null id comes first; rows of one id follow one another, in the order of a hash of their
ids, and may fill several shards. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, map_file, new_path, pieces, replace_column, write_file
from quillon.llm.tokens import WordEncoder

MAGIC, VERSION = b"QSST", 1
FOOTER = struct.Struct("<4sHHQQQQQQ4x4x")
ENTRY, BLOCK = struct.Struct("<HHI"), struct.Struct("<QIH")
PROBES = 7
#: Ids' bytes and documents of a shard, on average, at most.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 1 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def shard_bytes(rows: Iterator[tuple[int | None, np.ndarray]], width: int, block_size: int) -> Iterator[bytes]:
    """The file of rows that come in ascending order of id; one block is in memory at a time, besides the index and the keys."""
    index, keys, at, n_ids = [], [], 0, 0
    block, last = bytearray(), b""
    compress = zstandard.ZstdCompressor(3).compress
    for doc_id, ids in rows:
        key, value = key_of(doc_id), ids.astype(f"<u{width}").tobytes()
        shared = 0
        while block and shared < min(len(key), len(last)) and key[shared] == last[shared]:
            shared += 1
        block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        last, n_ids = key, n_ids + len(ids)
        keys.append(key)
        if len(block) >= block_size:
            yield (frame := compress(bytes(block)))
            index.append((at, len(frame), last))
            at, block = at + len(frame), bytearray()
    if block:
        yield (frame := compress(bytes(block)))
        index.append((at, len(frame), last))
        at += len(frame)
    index_bytes = struct.pack("<I", len(index)) + b"".join(BLOCK.pack(a, n, len(k)) + k for a, n, k in index)
    bits = max(64, 10 * len(keys))
    bloom = bytearray((bits + 7) // 8)
    for key in keys:
        for p in _probes(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    yield index_bytes
    yield struct.pack("<Q", bits) + bytes(bloom)
    yield FOOTER.pack(MAGIC, VERSION, width, at, len(index_bytes), at + len(index_bytes), 8 + len(bloom), len(keys), n_ids)


class Shard:
    """A memory-mapped shard: ``scan`` in order, ``get`` by id."""

    def __init__(self, uri: str):
        self.data = map_file(uri)
        magic, version, self.width, at, n, self.bloom_at, _, self.docs, self.ids = FOOTER.unpack(bytes(self.data[-FOOTER.size :]))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not a shard of version {VERSION}")
        raw, p, self.blocks, self.lasts = bytes(self.data[at : at + n]), 4, [], []
        for _ in range(struct.unpack_from("<I", raw)[0]):
            place, size, k = BLOCK.unpack_from(raw, p)
            self.blocks.append((place, size))
            self.lasts.append(raw[p + BLOCK.size : p + BLOCK.size + k])
            p += BLOCK.size + k

    def _block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        place, size = self.blocks[number]
        raw, p, key = zstandard.ZstdDecompressor().decompress(bytes(self.data[place : place + size])), 0, b""
        while p < len(raw):
            shared, more, n = ENTRY.unpack_from(raw, p)
            p += ENTRY.size
            key = key[:shared] + raw[p : p + more]
            p += more
            yield key, np.frombuffer(raw, f"<u{self.width}", n // self.width, p)
            p += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.blocks)):
            for key, ids in self._block(number):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id lists of one document; [] if it isn't there."""
        key = key_of(doc_id)
        bits = struct.unpack("<Q", bytes(self.data[self.bloom_at : self.bloom_at + 8]))[0]
        if not all(self.data[self.bloom_at + 8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        found, number = [], bisect_left(self.lasts, key)
        while number < len(self.blocks):
            for k, ids in self._block(number):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
            number += 1
        return found


def width_of(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def encoded(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, ids, size): each whole text's ids and the end id, as little-endian integers as wide as the vocabulary needs, and their bytes."""
    width = width_of(vocabulary)

    def run(batches):
        encoder = WordEncoder.of(tokenizer)
        for piece in pieces(batches):
            ids, offsets = encoder.encode(replace_column(piece, "text"))
            ids = np.insert(ids, offsets[1:], end_id).astype(f"<u{width}")
            offsets = offsets + np.arange(len(offsets))
            yield pa.record_batch([replace_column(piece, "doc_id"), pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets * width), pa.py_buffer(ids)]).cast(pa.binary()), pa.array(np.diff(offsets) * width)], names=["doc_id", "ids", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, size long")


def write_shards(rows: DataFrame, folder: str, shards: int, vocabulary: int, block_size: int = 64 << 10) -> DataFrame:
    """Write (doc_id, ids) as shards of ascending id ranges; returns the manifest (path, docs, ids, key, tie, part): its paths are those of
    the attempts that were committed; ``key``, ``tie`` and ``part`` are those of a shard's first document and give the shards' order."""
    width = width_of(vocabulary)

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        key, tie, part = key_of(first.column(0)[0].as_py()), first.column(2)[0].as_py(), first.column(3)[0].as_py()

        def documents():
            for b in chain([first], batches):
                yield from zip(b.column(0).to_pylist(), (np.frombuffer(x.as_buffer(), f"<u{width}") for x in b.column(1)))

        name = write_file(f"{folder}/shard-{key.hex()}.sst", shard_bytes(documents(), width, block_size))
        made = Shard(name)
        yield pa.RecordBatch.from_pydict({"path": [name], "docs": [made.docs], "ids": [made.ids], "key": [key], "tie": pa.array([tie], pa.int64()), "part": pa.array([part], pa.int32())})

    # rows of one id are told apart by a hash of their ids, so that a repeated id is dealt to several shards
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("part").asc()]
    keyed = rows.select("doc_id", "ids", F.xxhash64("ids").alias("tie"), F.spark_partition_id().alias("part"))
    spread = keyed.repartitionByRange(shards, *order)
    return spread.sortWithinPartitions(*order).mapInArrow(run, "path string, docs long, ids long, key binary, tie long, part int")


def read_shards(manifest: DataFrame, shards: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    The only global step is a running sum over one row per shard."""
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("key", "tie", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[list] = [[], [], [], []]
                for doc_id, ids in Shard(path).scan():
                    for column, value in zip(out, (doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    base += len(ids)
                    if len(out[0]) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("path", "base").repartition(shards, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """Encode, write the shards into a new shared folder, and read them back."""
    ids = cut(encoded(docs, tokenizer, end_id, vocabulary), "ids")  # encoded once: the range sampling below reads files
    size, rows = ids.agg(F.sum("size"), F.count("*")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_BYTES), -(-rows // SHARD_ROWS))
    manifest = cut(write_shards(ids, new_path(spark, "sst"), shards, vocabulary), "manifest")
    return read_shards(manifest, shards)
