"""What the corpus operators share: the cluster's folder for intermediate results and text splitting on Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). A machine's own one serves only a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.options(**{"compression": "zstd", **(options or {})}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a shared folder, and the path within it; runs in tasks as well as on the driver."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterator[bytes]) -> str:
    """Write under a name of this attempt, which is returned: the rows of the attempt that Spark commits name the files that count, so
    repeated, speculative and half-done attempts leave files that nobody reads."""
    store, path = filesystem(attempt := f"{uri}.{uuid.uuid4().hex}")
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
    return attempt


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have: the wanted ones, with as many underscores before them as it takes."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def map_file(uri: str) -> np.ndarray:
    """The bytes of a shared file, memory-mapped. From a store that can't be mapped a private copy is fetched and unlinked at once."""
    store, path = filesystem(uri)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(path) as source:
        while block := source.read(8 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)


def pieces(batches, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece stays near ``most`` bytes (one longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]] if raw[-1] > raw[0] else np.zeros(0, np.uint8)
    return data, raw - raw[0]


def one_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace every run of ASCII white space within a text by one space."""
    white = WHITE[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = white[1:] & white[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    drop[starts] = False
    out = np.where(white, np.uint8(32), data)[~drop]
    gone = np.concatenate([[0], np.cumsum(drop)])
    return out, offsets - gone[offsets]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it. ``inside`` marks word bytes (default: not white)."""
    word = ~WHITE[data] if inside is None else inside[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def take_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array; the spans ascend and don't overlap."""
    to = np.concatenate([[0], np.cumsum(end - begin)])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin] = 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[inside])])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, size), end to end."""
    to = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)


def crc_of(column: str):
    """crc32 of an id's text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def replace_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
