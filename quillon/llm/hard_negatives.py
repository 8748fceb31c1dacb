"""Hard-negative mining over K-means inverted lists with stored radii (operator 13).

The lists: centroids are fitted by Spark's K-means on a bounded sample; every row goes to its nearest centroid; a cluster is cut
into segments of bounded size (by a hash of the id, so a hot cluster is many segments), each a file with ids, labels and vectors,
and a directory row with its count and radius (the largest distance of a member to the centroid). The search: anchors are dealt
into blocks of neighbours. For an anchor a and a member x of a cluster with centroid c and radius r, a.x lies within
a.c - |a|r and a.c + |a|r (Cauchy-Schwarz). A block visits the clusters by descending upper bound (the highest among its anchors),
skips for each search those whose bounds miss its window, and a search is over once the bounds fall strictly below its kth
score. One pass finds each anchor's positives (same label), a second one the negatives of each positive, whose window is
a share of the positive's score. All results are exact: bounds only save work, whatever the sample was.

Nulls, ties: see ``vectors``; rows with a null label take no part either. Equal scores go by smaller vec_id. Rows of the anchor's
own id are no positives of it; repeated rows count each; repeated anchors have results each. An anchor without positives has no
rows, nor has a positive with a negative score (its window is empty). Vectors of other lengths than the commonest have lists of their
own by length, with a zero centroid. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, filesystem, map_file, new_path, write_file
from quillon.llm.vectors import TILE, TopLists, matrices, packed, products, unpacked, usable_rows

#: Rows of the sample that the centroids are fitted on, about, and clusters, at most.
SAMPLE, CLUSTERS, ROUNDS = 50_000, 1024, 6
#: Rows of a segment, about; anchors of a block, at most; searches that a tile is masked for at once.
SEGMENT, BLOCK, SEARCHES = 16_384, 2048, 256
#: Components of a segment, about, and of a block's anchors, at most.
SEGMENT_NUMBERS, BLOCK_NUMBERS = 1 << 21, 1 << 23


def centroids(rows: DataFrame, size: int, count: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the scaled vectors of length ``size``, fitted on the rows whose ids' hashes are low enough to leave about ``sample``."""
    share = min(1.0, sample / max(count, 1))
    low = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = cut(rows.where(F.size("embedding") == size).where(low).select(array_to_vector(F.transform("embedding", lambda x: F.floor(x * 256.0).cast("double"))).alias("features")), "sample")
    clusters = int(np.clip(np.sqrt(count) / 2, 1, CLUSTERS))
    if not size or not chosen.limit(1).count():
        return np.zeros((1, size))
    return np.array(KMeans(k=max(clusters, 2), maxIter=ROUNDS, seed=1, initMode="random").fit(chosen).clusterCenters()).reshape(-1, size)


def nearest(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre; minus one minus their length for vectors of another length than the centres'."""
    if matrix.shape[1] != centres.shape[1]:
        return np.full(len(matrix), -1 - matrix.shape[1])
    out = np.empty(len(matrix), np.int64)
    for a in range(0, len(matrix), TILE):
        out[a : a + TILE] = np.argmin(np.square(centres).sum(1) - 2 * matrix[a : a + TILE] @ centres.T, axis=1)
    return out


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, vec_id, label, anchor, size, vector) of every row (vec_id, label, anchor, embedding)."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            for at, matrix in matrices(batch.column(3)):
                own = batch.take(pa.array(at))
                blobs = [packed(m) for m in matrix]
                yield pa.record_batch([pa.array(nearest(matrix, sent.value)), *own.columns[:3], pa.array(np.full(len(at), matrix.shape[1], np.int32)), pa.array(blobs, pa.binary())], names=["cluster", "vec_id", "label", "anchor", "size", "vector"])

    return rows.select("vec_id", "label", "anchor", "embedding").mapInArrow(run, "cluster long, vec_id long, label long, anchor boolean, size int, vector binary")


def _matrix(blobs: list[bytes], size: int) -> np.ndarray:
    return np.concatenate([unpacked(b, 1, size).astype(np.float64) for b in blobs]) if blobs else np.zeros((0, size))


class Lists:
    """The inverted lists as tasks see them: centroids and radii by cluster, and the files of each cluster's segments."""

    def __init__(self, directory: str, centres: np.ndarray):
        store, path = filesystem(directory)
        rows = pads.dataset(path, format="parquet", filesystem=store).to_table(columns=["cluster", "size", "n", "radius", "file"]).to_pylist()
        self.segments: dict[int, list[dict]] = {}
        for r in rows:
            self.segments.setdefault(r["cluster"], []).append(r)
        self.clusters = np.array(sorted(self.segments), np.int64)
        self.radius = np.array([max(r["radius"] for r in self.segments[c]) for c in self.clusters.tolist()])
        self.centres = np.zeros((len(self.clusters), centres.shape[1]))
        own = self.clusters >= 0
        self.centres[own] = centres[self.clusters[own]]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(middle, norm, slack): a score lies within the middle +- (norm x radius + slack); the slack covers rounding."""
        size = min(anchors.shape[1], self.centres.shape[1])
        norm = np.sqrt(np.square(anchors).sum(1))[:, None]
        slack = 1e-9 * norm * (np.sqrt(np.square(self.centres).sum(1)) + self.radius) + 1e-3
        return anchors[:, :size] @ self.centres[:, :size].T, norm, slack

    @staticmethod
    def load(segment: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, matrix); the ids ascend."""
        data, n = map_file(segment["file"]), segment["n"]
        return data[: 8 * n].view(np.int64), data[8 * n : 16 * n].view(np.int64), unpacked(data[16 * n :], n, segment["size"])


def inverted_lists(rows: DataFrame, centres: np.ndarray, segment: int = SEGMENT) -> str:
    """Write every row of ``rows`` (as ``assigned`` gives them) into the segments' files; the folder of their directory."""
    spark = rows.sparkSession
    folder = new_path(spark, "lists")

    def write(group: pa.Table) -> pa.Table:
        order = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        cluster, size, n = group["cluster"][0].as_py(), group["size"][0].as_py(), group.num_rows
        matrix = _matrix(group["vector"].to_pylist(), size)[order]
        away = np.square(matrix - centres[cluster] if cluster >= 0 else matrix).sum(1).max()
        parts = [group["vec_id"].to_numpy()[order].astype("<i8").tobytes(), group["label"].to_numpy()[order].astype("<i8").tobytes(), packed(matrix)]
        name = write_file(f"{folder}/{cluster}-{group['cut'][0].as_py()}", iter(parts))
        return pa.table({"cluster": [cluster], "size": pa.array([size], pa.int32()), "n": [n], "radius": [float(np.sqrt(away)) * (1 + 1e-12)], "file": [name]})

    # rows of a cluster are dealt by the hash of their ids over as many segments as its count asks for
    most = F.greatest(F.lit(1), F.least(F.lit(segment), F.lit(SEGMENT_NUMBERS) / F.greatest(F.max("size"), F.lit(1))))
    cuts = rows.groupBy("cluster").agg(F.ceil(F.count("*") / most).alias("cuts"))
    dealt = rows.join(cuts, "cluster").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    directory = dealt.groupBy("cluster", "cut").applyInArrow(write, "cluster long, size int, n long, radius double, file string")
    path = f"{folder}-directory"
    directory.write.parquet(path)
    return path


def visit(lists: Lists, anchors: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> TopLists:
    """The ``k`` best members for each search: search s is for anchor ``owner[s]``, scores from ``low[s]`` to ``high[s]`` (inclusive), labels equal to the
    anchor's (without rows of its id) or different."""
    found = TopLists(len(owner), k)
    if not len(owner) or not len(lists.clusters):
        return found
    middle, norm, slack = lists.bounds(anchors)
    upper = middle + norm * lists.radius + slack
    order = np.argsort(-upper.max(0), kind="stable")
    for c in order.tolist():
        if upper[:, c].max() < found.last.min():
            break  # every list is full, and no cluster from here on reaches any kth score
        for segment in lists.segments[int(lists.clusters[c])]:
            reach = norm[:, 0] * segment["radius"] + slack[:, c]
            top, bottom = (middle[:, c] + reach)[owner], (middle[:, c] - reach)[owner]
            live = np.flatnonzero((top >= found.last) & (top >= low) & (bottom <= high))
            if not len(live):
                continue
            ids, labels, matrix = Lists.load(segment)
            who, line = np.unique(owner[live], return_inverse=True)
            for a in range(0, len(ids), TILE):
                scores = products(anchors[who], matrix[a : a + TILE])
                good = (labels[a : a + TILE] == own_labels[who][:, None]) == same
                if same:
                    good &= ids[a : a + TILE] != own_ids[who][:, None]
                scores[~good] = -np.inf
                for b in range(0, len(live), SEARCHES):
                    s, lines = live[b : b + SEARCHES], line[b : b + SEARCHES]
                    mine = scores[lines]
                    if not same:
                        mine[(mine < low[s][:, None]) | (mine > high[s][:, None])] = -np.inf
                    found.add(s, mine, ids[a : a + TILE])
    return found


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), sample: int = SAMPLE, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``rows`` (vec_id, label, embedding) for which
    ``is_anchor`` holds: for each of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is at least
    ``share`` (a fraction) of the positive's and not above it."""
    spark = rows.sparkSession
    usable = usable_rows(rows).where("label is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    common = usable.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), "size").first()
    size, count, n_anchors = (common.size, common.n, common.anchors) if common else (0, 0, 0)
    centres = centroids(usable, size, count, sample)
    every = cut(assigned(usable, centres), "assigned")
    directory = inverted_lists(every, centres, segment)
    sent = spark.sparkContext.broadcast(centres)
    over, under = share
    block = max(1, min(block, BLOCK_NUMBERS // max(size, 1)))

    def search(batches):
        lists, held = None, []

        def block_rows(group: list[pa.RecordBatch]):
            nonlocal lists
            lists = lists or Lists(directory, sent.value)
            table = pa.Table.from_batches(group)
            ids, labels, sizes = (table[c].to_numpy() for c in ("vec_id", "label", "size"))
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                anchors = _matrix(table["vector"].take(pa.array(at)).to_pylist(), length)
                every, free = np.arange(len(at)), np.full(len(at), np.inf)
                first = visit(lists, anchors, ids[at], labels[at], every, -free, free, True, positives)
                owner, _, positive, score = first.entries()
                # whole numbers n with over * p <= under * n <= under * p
                low = np.array([-(-over * p // under) for p in score.tolist()], np.int64)
                open_ = np.flatnonzero(low <= score)
                owner, positive, score, low = owner[open_], positive[open_], score[open_], low[open_]
                second = visit(lists, anchors, ids[at], labels[at], owner, low, score, False, negatives)
                search_, place, negative, reached = second.entries()
                yield pa.record_batch([pa.array(c) for c in (ids[at][owner[search_]], positive[search_], (place + 1).astype(np.int32), negative, score[search_], reached)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                held.append(batch.slice(a, block))
                if sum(b.num_rows for b in held) >= block:
                    yield from block_rows(held)
                    held = []
        if held:
            yield from block_rows(held)

    # neighbours share a block: anchors are dealt by ranges of their clusters
    blocks = max(-(-n_anchors // block), min(n_anchors // 32, 4 * spark.sparkContext.defaultParallelism), 1)
    return every.where("anchor").repartitionByRange(blocks, "cluster", "vec_id").mapInArrow(search, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
