"""Variable-capacity best-fit packing (operator 9).

Documents are dealt to packing groups of near-equal token mass; each group is packed by best-fit decreasing over all
permitted lengths at once: an item goes to the open bin that it leaves fullest; where none takes it, the bin size with
the least cost per token that the group's remaining items can fill is opened; at the end each bin shrinks to the
smallest permitted length that holds its contents. A document longer than the largest length is cut into pieces of that
length and a rest. Only identifiers and lengths are shuffled.

Nulls, ties: a null text is empty; every document has its end token, so none vanishes. Rows of one id are items of
their own. Order is by length (descending), id (null first), piece. An empty table packs nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, pieces, replace_column
from quillon.llm.tokens import count_tokens

LENGTHS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 8_000_000
#: Items of a packing group, on average, at most: very short documents fill a group by their number.
GROUP_ITEMS = 200_000


def cost(length: int) -> float:
    """What a sequence costs: a share that grows with its length, and attention's square."""
    return 64 + length + length * length / 16_384


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin, place in the bin and bin length of each size; sizes in descending order, none over the largest length."""
    lengths = tuple(sorted(lengths))
    left = sum(sizes)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has r tokens of room
    used: list[int] = []
    bins, places = [], []
    for size in sizes:
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            # the tokens that could fill a bin of each length are this item and all that come after it
            capacity = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), c))
            chosen, room = len(used), capacity
            used.append(0)
        bins.append(chosen)
        places.append(used[chosen])
        used[chosen] += size
        left -= size
        if room > size:
            by_room.setdefault(room - size, []).append(chosen)
            rooms |= 1 << (room - size)
    final = [next(c for c in lengths if c >= u) for u in used]
    return bins, places, [final[b] for b in bins]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens): the ids of each whole text and one end id."""

    def run(batches):
        for piece in pieces(batches):
            yield pa.record_batch([replace_column(piece, "doc_id"), pa.array(count_tokens(replace_column(piece, "text"), tokenizer) + 1, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def best_fit_pack(lengths: DataFrame, permitted: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP_TOKENS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, piece, doc_offset, n_tokens, bin_id, bin_offset, bin_length) for (doc_id, n_tokens) rows.

    The number of groups follows the totals, so a group stays near ``group_tokens`` tokens and ``group_items`` items at any
    size of input; pieces are dealt by their row and number, so neither a repeated id nor a very long document fills one group."""
    most = max(permitted)
    # rows are numbered once and stored, so a repeated task deals them alike
    lengths = cut(lengths.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")), "lengths")
    n_pieces = F.floor((F.col("n_tokens") - 1) / most) + 1
    tokens, n_items = lengths.agg(F.sum("n_tokens"), F.sum(n_pieces)).first()
    groups = max(1, round((tokens or 0) / group_tokens), round((n_items or 0) / group_items))
    items = lengths.select("doc_id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece")).select(
        "doc_id", "row", "piece", (F.col("piece").cast("long") * most).alias("doc_offset"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).cast("int").alias("size")
    )
    grouped = items.withColumn("pack", F.pmod(F.xxhash64("row", "piece", F.lit(9)), F.lit(groups)).cast("int")).drop("row")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")], null_placement="at_start"))
        bins, places, final = pack(rows["size"].to_pylist(), permitted)
        first = rows["pack"][0].as_py() << 32
        columns = {"doc_id": rows["doc_id"], "piece": rows["piece"], "doc_offset": rows["doc_offset"], "n_tokens": rows["size"].cast(pa.int64())}
        return pa.table(columns | {"bin_id": np.array(bins, np.int64) + first, "bin_offset": np.array(places, np.int64), "bin_length": np.array(final, np.int64)})

    return grouped.groupBy("pack").applyInArrow(run, "doc_id long, piece int, doc_offset long, n_tokens long, bin_id long, bin_offset long, bin_length long")


def packed_documents(docs: DataFrame, tokenizer: str, permitted: tuple[int, ...] = LENGTHS) -> DataFrame:
    return best_fit_pack(token_lengths(docs, tokenizer), permitted)
