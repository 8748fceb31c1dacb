"""Exact duplicates by content-defined chunk recipes (operator 3).

Each text (white-space runs made one space) is cut where a rolling hash of its last 32 bytes says so, so equal texts
are cut alike wherever they stand. A document becomes the ordered list of its chunks' identifiers, and documents are
compared by these short lists; no long text is moved. An identifier is a 64-bit hash, and it is verified: chunk
contents meet once, by content, and where one hash has several contents, their rank goes into the recipe too, so two
recipes are equal only if the texts are.

Nulls, ties: null text is empty text; empty texts equal one another (no chunk). A null doc_id counts as the largest.
Repeated rows are copies like others: exactly one row of a group stays, and of rows with the smallest id an arbitrary
one. An empty table gives no rows. ``groups`` reads no other columns; ``keep_one`` keeps all, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, free_names, one_space, pieces, replace_column, text_bytes

LEAST, MEAN, MOST = 512, 2048, 16_384
#: A random 32-bit value per byte: the first 256 outputs of a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk boundaries of each text (its ends included). A boundary depends on the 32 bytes before it, none before the text."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):  # after these, h[i] is the gear hash of bytes i-31 .. i
        later = h.copy()
        later[step:] += h[:-step] << np.uint32(step)
        h = later
    # the mean includes the least size that is skipped after each cut
    marks = np.flatnonzero(h < np.uint32((1 << 32) // (MEAN - LEAST))) + 1
    lo, hi = np.searchsorted(marks, offsets[:-1]), np.searchsorted(marks, offsets[1:])
    found = []
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist()):
        points, at = [start], start
        if end - start > LEAST:
            for m in [*marks[a:b].tolist(), end]:
                while m - at > MOST:
                    at += MOST
                    points.append(at)
                if LEAST <= m - at and m < end:
                    at = m
                    points.append(m)
        if end > start:
            points.append(end)
        found.append(points)
    return found


def _chunks(column: pa.Array, bits: int):
    """For each text: its normalised bytes and its chunks as (hash, start, end)."""
    data, offsets = one_space(*text_bytes(column))
    raw = data.tobytes()
    mask = (1 << bits) - 1
    for points, start, end in zip(cut_points(data, offsets), offsets[:-1].tolist(), offsets[1:].tolist()):
        hashes = [xxhash.xxh3_64_intdigest(raw[a:b]) & mask for a, b in zip(points, points[1:])]
        yield raw, start, end, [h - (1 << 64) if h >> 63 else h for h in hashes], points


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, uid, text_sha256, recipe): the ordered chunk hashes of each row. ``uid`` names the row from here on."""

    def run(batches):
        for piece in pieces(batches):
            shas, lists = [], []
            for raw, start, end, hashes, _ in _chunks(replace_column(piece, "text"), bits):
                shas.append(hashlib.sha256(raw[start:end]).hexdigest())
                lists.append(hashes)
            yield pa.record_batch([replace_column(piece, "doc_id"), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text_sha256", "recipe"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_sha256 string, recipe array<long>").withColumn("uid", F.monotonically_increasing_id())


def collisions(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(hash, content) of all distinct chunks, and the hashes with several contents. A task sends a content that it has just
    seen once, and Spark's partial aggregation sends it once per task."""

    def run(batches):
        for piece in pieces(batches):
            seen: dict[int, bytes] = {}
            other: list[tuple[int, bytes]] = []
            for raw, _, _, hashes, points in _chunks(replace_column(piece, "text"), bits):
                for h, a, b in zip(hashes, points, points[1:]):
                    content = raw[a:b]
                    if seen.setdefault(h, content) != content:
                        other.append((h, content))
            rows = [*seen.items(), *other]
            yield pa.record_batch([pa.array([h for h, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())], names=["hash", "content"])

    contents = docs.select(F.col("text").cast("string")).mapInArrow(run, "hash long, content binary").groupBy("hash", "content").agg(F.lit(1).alias("one"))
    several = contents.groupBy("hash").count().where("count > 1").select("hash")
    return contents, several


def _ranked(contents: DataFrame, several: DataFrame) -> DataFrame:
    return contents.join(several, "hash", "left_semi").select("hash", "content", (F.row_number().over(Window.partitionBy("hash").orderBy("content")) - 1).alias("rank"))


def _ranks_of(docs: DataFrame, ranked: DataFrame, bits: int) -> DataFrame:
    """(text_sha256, ranks): for texts with a chunk of rank over 0, 'position:rank' of each, in order."""

    def run(batches):
        for piece in pieces(batches):
            out: list[list] = [[], [], [], []]
            for raw, start, end, hashes, points in _chunks(replace_column(piece, "text"), bits):
                sha = hashlib.sha256(raw[start:end]).hexdigest()
                for i, (h, a, b) in enumerate(zip(hashes, points, points[1:])):
                    for column, value in zip(out, (sha, i, h, raw[a:b])):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["text_sha256", "at", "hash", "content"])

    chunks = docs.select(F.col("text").cast("string")).mapInArrow(run, "text_sha256 string, at int, hash long, content binary")
    hit = chunks.join(ranked.where("rank > 0"), ["hash", "content"]).select("text_sha256", "at", "rank").distinct()
    return hit.groupBy("text_sha256").agg(F.expr("transform(array_sort(collect_list(struct(at, rank))), x -> concat_ws(':', x.at, x.rank))").alias("ranks"))


def groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, uid, keep_id, group_size, kept, text_sha256) of every row. ``bits`` narrows the chunk hash, for tests."""
    made = cut(recipes(docs, bits), "recipes")
    contents, several = collisions(docs, bits)
    several = cut(several, "collisions")
    if several.isEmpty():  # the usual case: every 64-bit identifier stands for one content
        made = made.withColumn("ranks", F.lit(None).cast("array<string>"))
    else:
        made = made.join(_ranks_of(docs, _ranked(contents, several), bits), "text_sha256", "left")
    key = F.xxhash64(F.col("recipe"), F.coalesce("ranks", F.array().cast("array<string>")))
    made = made.withColumn("key", key)
    # one row per recipe, summed in each task first; a recipe that a third of all rows share is one row of each task
    alike = made.groupBy("key", "recipe", "ranks").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("keep"))
    several_rows = alike.where("group_size > 1")
    joined = made.alias("m").join(several_rows.alias("g"), (F.col("m.key") == F.col("g.key")) & (F.col("m.recipe") == F.col("g.recipe")) & F.col("m.ranks").eqNullSafe(F.col("g.ranks")), "left")
    alone = F.col("g.keep").isNull()
    return joined.select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.uid").alias("uid"), F.when(alone, F.col("m.doc_id")).otherwise(F.col("g.keep.doc_id")).alias("keep_id"), F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("m.uid") == F.col("g.keep.uid"))).alias("kept"), F.col("m.text_sha256").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = cut(groups(docs).select("doc_id", "text_sha256", "kept"), "kept")
    # whole documents are moved only to drop rows, by id and text
    dropped = found.where("not kept").select("doc_id", "text_sha256").distinct()
    (own,) = free_names(docs, "own")
    marked = docs.withColumn(own, F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))

    def same(other: DataFrame):
        return marked.doc_id.cast("long").eqNullSafe(other.doc_id) & (marked[own] == other.text_sha256)

    clean = marked.join(dropped, same(dropped), "left_anti")
    # of repeated rows (one id, one text) one may stay while others go: those are told apart by nothing, so one is taken
    kept = found.where("kept").select("doc_id", "text_sha256")
    repeated = cut(kept.join(dropped, kept.doc_id.eqNullSafe(dropped.doc_id) & (kept.text_sha256 == dropped.text_sha256), "left_semi").distinct(), "repeated")
    if not repeated.isEmpty():
        clean = clean.unionByName(marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", own]))
    return clean.drop(own)
