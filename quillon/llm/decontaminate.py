"""Benchmark decontamination by a distributed positional inverted index (operator 5).

``build_index`` stores the postings of every word of the training texts: one row per segment (a run of documents of
bounded size), holding its terms and, per term, the ascending positions of its occurrences, as bytes (a row of numbers costs the JVM several times
as much); documents stand so many
positions apart that no match runs over a border: one for phrases, a window and twice the slack for proximity. ``search`` takes benchmark windows (each run of ``window`` words of
an item, distinct ones once) in blocks of bounded size, and in each segment takes the positions of a window's rarest term, moves them by the
term's offset, and keeps those that the lists of the other terms, rarest first, hold at their own offsets. With
``slack`` over 0 a place of the document matches if each term stands at most that many words off its own place from there
(proximity match); hit are the document's words under the window as it lies at such places. Segments are independent: nothing of
the corpus is shuffled, and a passage that many documents share is found in each by its own task. A hit names its windows;
which items have them is a join of the hits alone, so neither the driver nor a task holds all items of a common window.

Nulls, ties: null has no words; an item without words has no window; one of fewer words than ``window`` is one window.
Null item ids are dropped from the items of a hit, not from the hit. Repeated documents get a row each; items of one id
are one item. An empty benchmark hits nothing; an empty corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, cut, free_names, pieces, replace_column, spread, take_words, text_bytes, word_spans

WINDOW = 10
#: Distinct windows of the benchmark that are searched for at once; more are further blocks.
BLOCK_WINDOWS = 50_000
CANDIDATES = 1 << 20
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True

#: ``words`` are the terms' bytes end to end; ``ends``, ``counts`` and ``postings`` are 32-bit integers.
INDEX = "doc_ids array<long>, sizes array<int>, words binary, ends binary, counts binary, postings binary"
#: A segment is a row of megabytes. Unasked, a writer counts its memory only every 100 rows, and a reader takes a whole row group at once.
ROW_GROUPS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
HITS = "segment long, at int, doc_id long, n_words long, runs array<struct<begin: int, end: int>>, windows array<long>"


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    begin, end, before = word_spans(data, offsets, INSIDE)
    return take_words(data, begin, end), before


def gap_for(window: int, slack: int) -> int:
    """How many positions documents must stand apart."""
    return window + 2 * slack if slack else 1


def build_index(docs: DataFrame, gap: int = 1) -> DataFrame:
    """Write the postings of all words of ``docs`` (doc_id, text) to the shared folder; documents stand ``gap`` positions apart."""

    def run(batches):
        for piece in pieces(batches):
            words, before = _words(replace_column(piece, "text"))
            coded = words.dictionary_encode()
            codes, sizes = coded.indices.to_numpy(), np.diff(before)
            positions = (np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * gap, sizes)).astype(np.int32)
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)

            def one(values: pa.Array, kind: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))

            terms = coded.dictionary
            ends = np.cumsum(pc.binary_length(terms).to_numpy()).astype(np.int32)
            text = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[: ends[-1] if len(ends) else 0]
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (text, ends, counts, positions[order])]
            yield pa.record_batch([one(replace_column(piece, "doc_id"), pa.int64()), one(pa.array(sizes), pa.int32()), *raw], names=["doc_ids", "sizes", "words", "ends", "counts", "postings"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)
    return cut(rows.withColumn("segment", F.monotonically_increasing_id()), "index", ROW_GROUPS)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, item_id): the distinct windows of each item (item_id, text)."""

    def run(batches):
        for piece in pieces(batches, most=1 << 20):
            words, before = _words(replace_column(piece, "text"))
            words = words.to_pylist()
            lists, ids = [], []
            for item, a, b in zip(replace_column(piece, "item_id").to_pylist(), before.tolist(), before[1:].tolist()):
                for k in range(a, max(b - window, a) + 1 if b > a else a):
                    lists.append(words[k : min(k + window, b)])
                    ids.append(item)
            yield pa.record_batch([pa.array(lists, pa.list_(pa.binary())), pa.array(ids, pa.int64())], names=["words", "item_id"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "words array<binary>, item_id long").distinct()


class Block:
    """The windows of one block as arrays: their numbers, a vocabulary, and a padded matrix of term numbers."""

    def __init__(self, rows: list[tuple[tuple[bytes, ...], int]], window: int):
        number: dict[bytes, int] = {}
        self.names = np.array([name for _, name in rows], np.int64)
        self.terms = np.full((len(rows), window), -1, np.int32)
        for row, (words, _) in zip(self.terms, rows):
            row[: len(words)] = [number.setdefault(bytes(w), len(number)) for w in words]
        self.sizes = (self.terms >= 0).sum(1)
        self.vocabulary = pa.array(list(number), pa.binary())


def occurrences(block: Block, terms: pa.Array, counts: np.ndarray, postings: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, position of its rarest term there) of every occurrence in one segment. Which term is the rarest depends on the segment, so
    it may itself stand off its place."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.vocabulary) or not len(postings):
        return none
    own = pc.fill_null(pc.index_in(block.vocabulary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, span = np.cumsum(counts) - counts, int(postings.max()) + 1 + 2 * slack
    matrix = np.where(block.terms >= 0, own[block.terms], -2)
    there = np.flatnonzero((matrix != -1).all(1))  # every term occurs in this segment
    if not len(there):
        return none
    matrix = matrix[there]
    rarity = np.where(matrix >= 0, counts[np.maximum(matrix, 0)], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * span + postings
    mass = np.cumsum(rarity[np.arange(len(there)), order[:, 0]])
    found, at = [], 0
    while at < len(there):
        to = max(at + 1, int(np.searchsorted(mass, (mass[at - 1] if at else 0) + CANDIDATES, side="right")))
        rows = np.arange(at, to)
        rarest = matrix[rows, order[rows, 0]]
        row = np.repeat(rows, counts[rarest])
        seen = postings[spread(starts[rarest], counts[rarest])].astype(np.int64)
        place = seen - order[row, 0]
        if slack:
            off = np.arange(-slack, slack + 1)
            row, seen, place = np.repeat(row, len(off)), np.repeat(seen, len(off)), (place[:, None] + off).ravel()
        else:
            keep = place >= 0
            row, seen, place = row[keep], seen[keep], place[keep]
        for k in range(1, matrix.shape[1]):
            offset = order[row, k]
            term = matrix[row, offset]
            live = term >= 0
            target = term * span + place + offset
            near = np.searchsorted(keys, target - slack * live)
            hit = keys[np.minimum(near, len(keys) - 1)]
            good = ~live | (hit >= target - slack) & (hit <= target + slack) & (near < len(keys)) & (hit // span == term)
            row, seen, place = row[good], seen[good], place[good]
            if not len(row):
                break
        if len(row):
            found.append((there[row], place, seen))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def _segment_hits(block: Block, row: dict, slack: int, gap: int) -> pa.RecordBatch:
    sizes = np.asarray(row["sizes"], np.int64)
    ends, counts, postings = (np.frombuffer(row[n], np.int32) for n in ("ends", "counts", "postings"))
    terms = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), row["words"]])
    window, place, seen = occurrences(block, terms, counts.astype(np.int64), postings.astype(np.int64), slack)
    base = np.cumsum(sizes + gap) - sizes - gap
    doc = np.searchsorted(base, seen, side="right") - 1
    mark = np.zeros(int((sizes + gap).sum()) + 2, np.int64)
    begin, end = np.maximum(place, base[doc]), np.minimum(place + block.sizes[window], base[doc] + sizes[doc])
    there = begin < end
    np.add.at(mark, begin[there], 1)
    np.add.at(mark, end[there], -1)
    on = np.cumsum(mark) > 0
    edge = np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc_of_run = np.searchsorted(base, begin, side="right") - 1
    n_runs = np.bincount(doc_of_run, minlength=len(sizes))
    pairs = np.unique(np.stack([doc, block.names[window]], 1), axis=0) if len(window) else np.zeros((0, 2), np.int64)
    n_windows = np.bincount(pairs[:, 0], minlength=len(sizes))
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    runs = pa.StructArray.from_arrays([pa.array(begin - base[doc_of_run], pa.int32()), pa.array(stop - base[doc_of_run], pa.int32())], ["begin", "end"])
    return pa.record_batch(
        [pa.array(np.full(len(sizes), row["segment"])), pa.array(np.arange(len(sizes)), pa.int32()), row["doc_ids"], pa.array(sizes), pa.ListArray.from_arrays(offsets(n_runs), runs), pa.ListArray.from_arrays(offsets(n_windows), pa.array(pairs[:, 1]))],
        names=["segment", "at", "doc_id", "n_words", "runs", "windows"],
    )


def search(index: DataFrame, windows: DataFrame, window: int = WINDOW, slack: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, runs, items) of every document of an index whose gap is ``gap_for(window, slack)``: its hit word runs, disjoint and in order, and the item ids.
    Only documents with hits leave the search.

    The distinct windows go to the tasks in blocks of about ``block_windows``; each block is one pass over the index, and its
    hits are written before the next block is sent."""
    spark, gap = index.sparkSession, gap_for(window, slack)
    windows = cut(windows, "windows")
    distinct = cut(windows.select("words").distinct().withColumn("name", F.monotonically_increasing_id()), "distinct")
    of_items = cut(windows.where("item_id is not null").join(distinct, "words").select("name", "item_id"), "items")
    blocks = max(1, -(-distinct.count() // block_windows))
    every = None
    for k in range(blocks):
        rows = [(r.words, r.name) for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).toLocalIterator()]
        block = spark.sparkContext.broadcast(Block(rows, window))

        def run(batches, block=block):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                    kinds = {"segment": lambda v: v.as_py(), "doc_ids": lambda v: v.values, "sizes": lambda v: v.values.to_numpy()}
                    yield _segment_hits(block.value, {n: kinds.get(n, lambda v: v.as_buffer())(v) for n, v in row.items()}, slack, gap)

        part = cut(index.select("segment", "doc_ids", "sizes", "words", "ends", "counts", "postings").mapInArrow(run, HITS).where("size(runs) > 0"), "hits")
        block.unpersist()
        every = part if every is None else every.unionByName(part)
    if blocks > 1:
        merged = every.groupBy("segment", "at").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("all"), F.flatten(F.collect_list("windows")).alias("windows"))
        join = """aggregate(all, cast(array() as array<struct<begin: int, end: int>>), (done, r) -> CASE
            WHEN size(done) > 0 AND element_at(done, -1).end >= r.begin
            THEN concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).begin AS begin, greatest(element_at(done, -1).end, r.end) AS end)))
            ELSE concat(done, array(r)) END)"""
        every = merged.select("segment", "at", F.expr(join).alias("runs"), "windows")
    hit = every.select("segment", "at", F.explode("windows").alias("name")).join(of_items, "name")
    items = hit.groupBy("segment", "at").agg(F.collect_set("item_id").alias("items"))
    found = every.select("segment", "at", "runs").join(items, ["segment", "at"], "left")
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("at", "d")).select("segment", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words"))
    none = lambda column, kind: F.coalesce(column, F.array().cast(kind)).alias(column)
    return docs.join(found, ["segment", "at"], "left").select("doc_id", "n_words", none("runs", "array<struct<begin: int, end: int>>"), none("items", "array<long>"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs, items) of every document."""
    found = search(build_index(docs, gap_for(window, slack)), windows_of(benchmark, window), window, slack, block_windows)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"), "runs", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns. Each row goes by its own text: others of its id, or without one, stay."""
    (row,) = free_names(docs, "row")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    named = docs.select(key.alias("doc_id"), "text")
    gone = cut(contamination(named, benchmark).where("contaminated").select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return docs.withColumn(row, key).join(gone, row, "left_anti").drop(row)
