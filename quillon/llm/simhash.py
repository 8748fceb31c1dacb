"""SimHash near-duplicates by sharded BK-trees (operator 7).

Equal fingerprints are one entry. Two fingerprints that differ in at most ``radius`` bits agree wholly on some
``blocks - radius`` of ``blocks`` bit blocks, so each entry goes to one shard per choice of agreeing blocks, keyed by
their bits: no link is lost, and no shard sees unrelated entries. The number of blocks follows the number of entries so
that shards stay small. In a shard a BK-tree (children keyed by their integer Hamming distance to the parent) is walked
for each entry along edges within the radius only; the tree is kept and walked as arrays, level by level. A shard
reports a spanning forest of its links, never its pairs, and the forests are joined to components in Spark. The trees
stay with their shards and are not broadcast, since all trees together grow with the input.

Nulls, ties: a null or blank text has fingerprint zero, linked like any other. A null doc_id has a fingerprint and is
linked, but names a component only if it has no other id. Repeated rows are rows of their own. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, cut, free_names, one_space, pieces, replace_column, spread, text_bytes, word_spans
from quillon.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Entries of random bits that a shard holds on average, at most.
SHARD_ENTRIES = 64
#: Query-node pairs that a walk holds at once.
WALK_PAIRS = 1 << 20
#: What ``keep_one`` links: sets of five-word shingles with a similarity of 4/5 at least.
ALIKE_SHINGLE, ALIKE = 5, (4, 5)
#: Its candidates: fingerprints within this radius, or one of so many bands of so many least hashes equal.
ALIKE_RADIUS, BANDS, BAND_ROWS = 6, 24, 5
#: Rows and shingles that are compared in one group, and rows that a larger group is first compared with.
GROUP_ROWS, GROUP_SHINGLES, PIVOTS = 512, 1 << 20, 8
MIX = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (3, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def shingles_of(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles end to end, and the number of each text."""
    data, offsets = one_space(*text_bytes(column))
    data = LOWER[data]
    begin, end, before = word_spans(data, offsets)
    n_words = np.diff(before)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.concatenate([np.arange(a, a + k) for a, k in zip(before[:-1].tolist(), counts.tolist())]) if counts.sum() else np.zeros(0, np.int64)
    last = np.minimum(first + shingle, np.repeat(before[1:], counts)) - 1
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist())), np.uint64, len(first))
    return hashes, counts


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One uint64 per text: a bit is set if it is set in over half of the shingles' hashes."""
    return summed(*shingles_of(column, shingle))


def summed(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints of texts with these shingles."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    at = 0
    while at < len(full):  # a block of shingles at a time: their bits take 64 bytes each
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 17), side="right")))
        own = hashes[done : ends[to - 1]]
        starts = (ends[at:to] - counts[full[at:to]] - done).astype(np.int64)
        sums = np.zeros((to - at, 64), np.int64)
        for cell in range(0, len(own), 1 << 17):  # one very long text is summed in slices
            bits = np.unpackbits(own[cell : cell + (1 << 17)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            if to - at == 1:
                sums[0] += bits.sum(0, dtype=np.int64)
            else:
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        ones = 2 * sums > counts[full[at:to]][:, None]
        out[full[at:to]] = np.packbits(ones, axis=1).view(">u8")[:, 0].astype(np.uint64)
        at = to
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for piece in pieces(batches):
            yield pa.record_batch([replace_column(piece, "doc_id"), pa.array(fingerprints_of(replace_column(piece, "text")).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def masks_for(entries: int, radius: int = RADIUS) -> list[int]:
    """The bit masks of the shards: every choice of blocks on which a pair may agree."""
    blocks = radius + 1
    while blocks < 2 * radius and entries > SHARD_ENTRIES << (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return masks


class BKForest:
    """One BK-tree per shard, for shards that stand together in ``shards``. Nodes are the entries themselves."""

    def __init__(self, shards: np.ndarray, codes: np.ndarray):
        n = len(codes)
        self.codes, self.distance = codes, np.zeros(n, np.int64)
        parent = np.full(n, -1, np.int64)
        # level by level: the first entry of each group is its node, the others go on to the child of their distance
        starts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        at, node = np.arange(n), self.root.copy()
        rest = at != node
        at, node = at[rest], node[rest]
        while len(at):
            d = np.bitwise_count(codes[at] ^ codes[node]).astype(np.int64)
            group = node * 65 + d
            order = np.argsort(group, kind="stable")
            at, node, d, group = at[order], node[order], d[order], group[order]
            head = np.concatenate([[True], group[1:] != group[:-1]])
            parent[at[head]], self.distance[at[head]] = node[head], d[head]
            leader = at[head][np.cumsum(head) - 1]
            at, node = at[~head], leader[~head]
        self.order = np.argsort(parent, kind="stable")  # children of a node stand together
        self.first = np.searchsorted(parent[self.order], np.arange(n + 1))

    def near(self, queries: np.ndarray, radius: int):
        """Yield (query, node) arrays of all nodes within the radius, query < node, for entries that query their own shard."""
        query, node = queries, self.root[queries]
        while len(query):
            if len(query) > WALK_PAIRS:
                half = len(query) // 2
                yield from self._walk(query[:half], node[:half], radius)
                query, node = query[half:], node[half:]
                continue
            yield from self._walk(query, node, radius)
            return

    def _walk(self, query: np.ndarray, node: np.ndarray, radius: int):
        stack = [(query, node)]
        while stack:
            query, node = stack.pop()
            d = np.bitwise_count(self.codes[query] ^ self.codes[node]).astype(np.int64)
            hit = (d <= radius) & (query < node)
            if hit.any():
                yield query[hit], node[hit]
            kids = self.first[node + 1] - self.first[node]
            q, far = np.repeat(query, kids), np.repeat(d, kids)
            to = np.concatenate([[0], np.cumsum(kids)])
            child = self.order[np.arange(to[-1]) + np.repeat(self.first[node] - to[:-1], kids)]
            go = np.abs(self.distance[child] - far) <= radius
            q, child = q[go], child[go]
            for k in range(0, len(q), WALK_PAIRS):
                stack.append((q[k : k + WALK_PAIRS], child[k : k + WALK_PAIRS]))


def spanning_links(shards: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The least entry number that each entry is linked to within its shard, through others too."""
    forest = BKForest(shards, codes)
    root = np.arange(len(codes))
    for k in range(0, len(codes), 4096):
        for query, node in forest.near(np.arange(k, min(k + 4096, len(codes))), radius):
            while True:
                a, b = root[query], root[node]
                if not (open_ := a != b).any():
                    break
                lo, hi = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
                np.minimum.at(root, hi, lo)
                while (flat := root[root]).tobytes() != root.tobytes():
                    root = flat
    return root


def links(codes: DataFrame, masks: list[int], radius: int = RADIUS) -> DataFrame:
    """(a, b) edges that join all entries of (fp) that are linked, a forest per shard."""
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(masks)])
    sharded = codes.select("fp", F.explode(keys).alias("k")).select("fp", F.xxhash64("k.table", "k.bits").alias("shard"))

    def forest(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard, code = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in (0, 1))
        root = spanning_links(shard, code.view(np.uint64), radius)
        linked = root != np.arange(len(root))
        return pa.record_batch([pa.array(code[linked]), pa.array(code[root[linked]])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(shard, shard[-1])) if shard[0] != shard[-1] else 0
            if last and sum(b.num_rows for b in held) + last >= 1 << 17:  # whole shards are done, the last may go on
                yield forest([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield forest(held)

    return sharded.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = cut(fingerprints(docs), "fingerprints")
    codes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")  # summed in tasks first: copies don't pile up
    roots = components(links(codes.select("fp"), masks_for(codes.count(), radius), radius))
    named = roots.join(codes, roots.node == codes.fp).select("node", "root", "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    by_code = cut(codes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    return rows.join(by_code, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def text_key():
    """What tells texts of one id apart."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def distinct_shingles(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    to = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(hashes[a:b]) for a, b in zip(to.tolist(), to[1:].tolist())]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set (none empty); sets of similarity s share one with probability 1 - (1 - s**BAND_ROWS)**BANDS."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i, (a, b, c) in enumerate(MIX.T):
        least = np.minimum.reduceat((flat ^ b) * a, starts)
        keys[:, i // BAND_ROWS] = (keys[:, i // BAND_ROWS] ^ least ^ (least >> np.uint64(31))) * c
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, own, fp, node, bands) of every row; ``node`` stands for its set of shingles (a 64-bit hash of all of them)."""

    def run(batches):
        for piece in pieces(batches):
            hashes, counts = shingles_of(replace_column(piece, "text"), ALIKE_SHINGLE)
            sets = distinct_shingles(hashes, counts)
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            bands = iter(band_keys(full).view(np.int64).tolist() if (full := [s for s in sets if len(s)]) else [])
            lists = pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch(
                [replace_column(piece, "doc_id"), replace_column(piece, "own"), pa.array(summed(hashes, counts).view(np.int64)), pa.array(nodes), lists],
                names=["doc_id", "own", "fp", "node", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key().alias("own"))
    return rows.mapInArrow(run, "doc_id long, own string, fp long, node long, bands array<long>")


def candidates(nodes: DataFrame, radius: int = ALIKE_RADIUS) -> DataFrame:
    """(a, b) edges that join all (node, fp, bands) that may be alike, a star per band key and per fingerprint."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    by_band = keyed.join(several, "key").select(F.col("node").alias("a"), "b")
    codes = cut(nodes.groupBy("fp").agg(F.min("node").alias("b")), "codes")
    by_code = nodes.join(codes, "fp").select(F.col("node").alias("a"), "b")
    linked = links(codes.select("fp"), masks_for(codes.count(), radius), radius)
    for end in ("a", "b"):
        linked = linked.join(codes.select(F.col("fp").alias(end), F.col("b").alias(f"node_{end}")), end)
    return by_band.unionByName(by_code).unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).where("a <> b").distinct()


def alike(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets with the similarity, enough to join all that are joined by such pairs or by their label.

    Where there are two sides, sets of the first are compared with those of the second only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, number, found = np.zeros(len(code), bool), np.arange(len(sets)), []
    part = np.unique(label, return_inverse=True)[1]
    for q in np.flatnonzero(side == 0).tolist():
        to = (side == 1 if side.any() else number > q) & (part != part[q])
        to = np.flatnonzero(to & (np.minimum(sizes, sizes[q]) * ALIKE[1] >= np.maximum(sizes, sizes[q]) * ALIKE[0]))
        if not len(to):
            continue
        own = code[starts[q] : starts[q] + sizes[q]]
        mark[own] = True
        common = np.add.reduceat(mark[code[spread(starts[to], sizes[to])]], np.cumsum(sizes[to]) - sizes[to], dtype=np.int64)
        mark[own] = False
        hit = to[common * ALIKE[1] >= (sizes[to] + sizes[q] - common) * ALIKE[0]]
        found += [(q, k) for k in hit.tolist()]
        part[np.isin(part, part[hit])] = part[q]
    return found


def matches(groups: DataFrame) -> DataFrame:
    """(a, b): the verified links within each group of (group, side, node, label, shingles)."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        side, node, label = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2, 3))
        found = alike([x.values.to_numpy(zero_copy_only=False).view(np.uint64) for b in held for x in b.column(4)], side, label)
        return pa.record_batch([pa.array(node[[k[i] for k in found]] if found else [], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else []
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column(0)[0].as_py() != group[a]:
                    yield linked(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield linked(held)

    return groups.select("group", "side", "node", "label", "shingles").repartition("group").sortWithinPartitions("group", "side").mapInArrow(run, "a long, b long")


def _parts():
    return F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_SHINGLES), F.lit(1)).cast("int").alias("parts")


def _part(seed: int):
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")


def verified(sets: DataFrame) -> DataFrame:
    """(a, b): links of similar sets that join all within each root of (root, node, n, shingles).

    A small root is one group. The rows of a larger one are first compared with a few of them, which joins a dense group;
    after that only blocks that are not yet joined are compared, pair by pair, so that no task holds more than two."""
    parted = sets.join(sets.groupBy("root").agg(_parts()), "root")
    label = F.col("node").alias("label")
    found = cut(matches(parted.where("parts = 1").select(F.col("root").alias("group"), F.lit(0).alias("side"), "node", label, "shingles")), "alike")
    big = cut(parted.where("parts > 1"), "large")
    if big.isEmpty():
        return found
    few = big.groupBy("root", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("class")).agg(F.min("node").alias("node")).select("node")
    asked = big.join(few, "node", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    all_rows = big.withColumn("part", _part(1)).withColumn("side", F.lit(1))
    first = asked.unionByName(all_rows.select(*asked.columns)).withColumn("group", F.xxhash64("root", "part"))
    joined = cut(matches(first.select("group", "side", "node", label, "shingles")), "alike")
    labels = components(joined).select("node", F.col("root").alias("to"))
    rows = cut(big.drop("parts").join(labels, "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to"), "labelled")
    many = rows.groupBy("root", "label").agg(F.count("*").alias("of")).where(F.col("of") >= GROUP_ROWS // 4).select("root", "label", F.col("label").alias("pool"))
    pooled = rows.join(many, ["root", "label"], "left")
    pools = cut(pooled.groupBy("root", "pool").agg(_parts()), "pools")
    block = F.xxhash64("root", F.col("pool").isNull(), "pool", "part").alias("block")
    same = (F.col("r.root") == F.col("p.root")) & F.col("r.pool").eqNullSafe(F.col("p.pool"))
    placed = pooled.alias("r").join(pools.alias("p"), same).select("r.*", "p.parts").withColumn("part", _part(2)).select("node", "label", "shingles", block)
    blocks = pools.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", "pool", block)
    other = blocks.select("root", F.col("pool").alias("pool_b"), F.col("block").alias("block_b"))
    pairs = cut(blocks.join(other, "root").where("block <= block_b and coalesce(pool <> pool_b, true)").select("block", "block_b", F.xxhash64("block", "block_b").alias("group")), "pairs")
    left = placed.join(pairs, "block").withColumn("side", F.lit(0))
    right = placed.join(pairs.where("block < block_b").select(F.col("block_b").alias("block"), "group"), "block").withColumn("side", F.lit(1))
    wanted = ["group", "side", "node", "label", "shingles"]
    last = cut(matches(left.select(*wanted).unionByName(right.select(*wanted))), "alike")
    return found.unionByName(joined).unionByName(last)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(root, node, n, shingles) of the texts that ``wanted`` (own, root, node) names."""

    def run(batches):
        for piece in pieces(batches):
            sets = distinct_shingles(*shingles_of(replace_column(piece, "text"), ALIKE_SHINGLE))
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([replace_column(piece, "root"), replace_column(piece, "node"), pa.array([len(s) for s in sets], pa.int64()), lists], names=["root", "node", "n", "shingles"])

    rows = docs.select(F.col("text").cast("string"), text_key().alias("own")).join(wanted, "own")
    return rows.select("root", "node", "text").mapInArrow(run, "root long, node long, n long, shingles array<long>")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, own, kept_id, kept_own) of every row: its component's row with the smallest id (null last), then text key."""
    rows = cut(sketches(docs), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("least")
    nodes = cut(rows.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    maybe = components(candidates(nodes.select("node", "fp", "bands")))
    wanted = nodes.join(maybe, "node").select(F.col("least.own").alias("own"), "root", "node")
    roots = components(verified(cut(shingle_sets(docs, wanted), "shingles")))
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    firsts = named.groupBy("root").agg(F.min("least").alias("kept"))
    by_node = cut(named.join(firsts, "root").select("node", "kept"), "components")
    return rows.join(by_node, "node").select("doc_id", "own", F.col("kept.doc_id").alias("kept_id"), F.col("kept.own").alias("kept_own"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group that similar texts join (Jaccard similarity of five-word shingles, 0.8 at least): the one with
    the smallest id (a null id only where there is no other). Rows are told apart by id and text; of equal ones one stays."""
    found = cut(similar(docs), "similar")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("own") == F.col("kept_own"))
    (own,) = free_names(docs, "own")
    marked = docs.withColumn(own, text_key())

    def same(other: DataFrame):
        return marked.doc_id.cast("long").eqNullSafe(other.doc_id) & (marked[own] == other.own)

    gone = found.where(~stays).select("doc_id", "own").distinct()
    stay = marked.join(gone, same(gone), "left_anti")
    repeated = cut(found.where(stays).groupBy("doc_id", "own").count().where("count > 1").select("doc_id", "own"), "repeated")
    if not repeated.isEmpty():
        once = marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", own])
        stay = stay.join(repeated, same(repeated), "left_anti").unionByName(once)
    return stay.drop(own)
