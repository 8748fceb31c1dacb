"""Exact top-k search by tiled matrix products (operator 11).

The queries are packed into blocks of bounded size and written once to the shared folder. Each task keeps the candidates where
they lie, as shards of bounded size, reads the blocks one after another, multiplies tiles of both, and selects each tile's best;
what leaves the task is one row per shard and block, with the queries' top lists. The lists are merged as a tree: each level
joins those of ``FAN`` neighbouring shards, block by block, so no task sees more than ``FAN`` lists of a block and neither
vectors nor scores are shuffled.

Nulls, ties: see ``vectors`` for what takes no part. Equal scores go by smaller vec_id. A row of the query's own id is no
candidate for it; repeated rows are candidates each, and repeated queries have a list each. Fewer candidates give shorter
lists; an empty table gives no rows. Long vectors: a block and a shard are bounded in bytes. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, filesystem, new_path
from quillon.llm.vectors import TILE, TopLists, matrices, packed, products, unpacked, usable_rows

#: Queries and bytes of a block, at most (one longer vector is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: Bytes of a shard's matrix, at most about.
SHARD_BYTES = 48 << 20
FAN = 16
LISTS = "block long, part long, queries binary, n binary, ids binary, scores binary"


def _gathered(batches, most: int, rows: int):
    """(ids, matrix) of runs of rows with vectors of one length, each of at most about ``most`` bytes and ``rows`` rows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[int, int] = {}

    def whole(size: int):
        ids, parts = zip(*held.pop(size))
        sizes.pop(size)
        return np.concatenate(ids), np.concatenate(parts)

    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        for at, matrix in matrices(batch.column(1)):
            size = matrix.shape[1]
            step = max(1, min(rows, most // max(8 * size, 8)))
            for a in range(0, len(at), step):
                part = matrix[a : a + step]
                if sizes.get(size, 0) + len(part) > step:
                    yield whole(size)
                held.setdefault(size, []).append((numbers[at[a : a + step]], part))
                sizes[size] = sizes.get(size, 0) + len(part)
    for size in list(held):
        yield whole(size)


def _lists_row(block: int, part: int, queries: bytes, lists: TopLists) -> pa.RecordBatch:
    row, _, ids, scores = lists.entries()
    n = np.bincount(row, minlength=len(lists.scores)).astype(np.uint16)
    cells = [pa.array([block]), pa.array([part]), *(pa.array([x], pa.binary()) for x in (queries, n.tobytes(), ids.tobytes(), scores.tobytes()))]
    return pa.record_batch(cells, names=["block", "part", "queries", "n", "ids", "scores"])


def _lists(n: bytes, ids: bytes, scores: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(n, np.uint16).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, numbers = np.full((len(sizes), k), TopLists.NONE), np.zeros((len(sizes), k), np.int64)
    out[row, place] = np.frombuffer(scores, np.int64)
    numbers[row, place] = np.frombuffer(ids, np.int64)
    return out, numbers


def query_blocks(queries: DataFrame, block_rows: int = BLOCK_ROWS) -> str:
    """Write the queries (vec_id, embedding) as blocks; the folder."""
    spark, count = queries.sparkSession, queries.count()

    def pack(batches):
        for ids, matrix in _gathered(batches, BLOCK_BYTES, block_rows):
            yield pa.record_batch([pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32()), pa.array([packed(matrix)], pa.binary())], names=["ids", "size", "matrix"])

    folder = new_path(spark, "query-blocks")
    rows = queries.repartition(max(1, -(-count // block_rows))).mapInArrow(pack, "ids binary, size int, matrix binary")
    rows.withColumn("block", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return folder


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` highest inner products with the rows of ``candidates`` of
    other ids. Both have vec_id and embedding."""
    spark = queries.sparkSession
    read = lambda df: usable_rows(df).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    folder = query_blocks(read(queries), block_rows)

    def tiles(batches):
        store, path = filesystem(folder)
        blocks, part = None, TaskContext.get().partitionId()
        for ids, matrix in _gathered(batches, shard_bytes, 1 << 30):
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            if np.abs(matrix).max(initial=0) < 1 << 15:
                matrix = matrix.astype(np.float32)
            blocks = blocks or pads.dataset(path, format="parquet", filesystem=store)
            for batch in blocks.to_batches(columns=["block", "ids", "size", "matrix"], batch_size=4, batch_readahead=1, fragment_readahead=1):
                for block, own, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                    numbers = np.frombuffer(own, np.int64)
                    q, lists, every = unpacked(data, len(numbers), size), TopLists(len(numbers), k), np.arange(len(numbers))
                    for a in range(0, len(ids), TILE):
                        scores, here = products(q, matrix[a : a + TILE]), ids[a : a + TILE]
                        # the ids ascend: a query's own rows are one run
                        left, right = np.searchsorted(here, numbers), np.searchsorted(here, numbers, side="right")
                        for r in np.flatnonzero(left < right):
                            scores[r, left[r] : right[r]] = -np.inf
                        lists.add(every, scores, here)
                    yield _lists_row(block, part, own, lists)

    lists = cut(read(candidates).mapInArrow(tiles, LISTS), "top-lists")

    def merge(rows: pa.Table) -> pa.Table:
        total = None
        for n, ids, scores in zip(*(rows[c].to_pylist() for c in ("n", "ids", "scores"))):
            found = _lists(n, ids, scores, k)
            if total is None:
                total = TopLists(len(found[0]), k)
            total.merge(np.arange(len(found[0])), *found)
        return pa.Table.from_batches([_lists_row(rows["block"][0].as_py(), rows["part"][0].as_py(), rows["queries"][0].as_py(), total)])

    parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        lists = lists.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(merge, LISTS)
        parts = -(-parts // fan)
        if parts == 1:
            break

    def rows(batches):
        for batch in batches:
            for own, n, ids, scores in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                sizes = np.frombuffer(n, np.uint16).astype(np.int64)
                rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                columns = [np.repeat(np.frombuffer(own, np.int64), sizes), rank.astype(np.int32), np.frombuffer(ids, np.int64), np.frombuffer(scores, np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
