"""Change batches and live queries, as batch operators and as Structured Streaming jobs with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillon.functions import hashing
from quillon.operators.collection import Registry
from quillon.sources.store import Store


def debounced(changes: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Changes (collection, op, id, ts, seq) gathered until a (collection, op) is idle for ``gap``: per window its ids' number, and
    the last change. A watermark may bound a stream's state: it only batches notices, no record depends on it."""
    source = changes.withWatermark("ts", watermark) if watermark else changes
    window = F.session_window("ts", gap)
    return source.groupBy("collection", "op", window.alias("w")).agg(F.count("*").alias("n_changes"), F.max("seq").alias("last_seq")).select("collection", "op", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n_changes", "last_seq")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _pieces(changes: DataFrame, gap: int) -> DataFrame:
    """Changes as pieces of windows (collection, op, id, _piece, _first, _to, _n, _row): pieces of one number are surely of one window, since a
    slice of time is as long as the gap (in microseconds)."""
    rest = [c for c in changes.columns if c not in ("collection", "op", "id")]
    at = micros(F.col("ts"))
    return changes.select("collection", "op", "id", (at - F.pmod(at, F.lit(gap))).alias("_piece"), F.col("ts").alias("_first"), F.col("ts").alias("_to"), F.lit(1).cast("long").alias("_n"), F.struct(*rest).alias("_row"))


def _windows(pieces: DataFrame, gap: int) -> DataFrame:
    """Pieces joined to windows (collection, op, _first, _to, id, _n, _row): a piece that begins a gap or more after all before it opens one."""
    spans = pieces.groupBy("collection", "op", "_piece").agg(F.min("_first").alias("_first"), F.max("_to").alias("_to"))
    order = Window.partitionBy("collection", "op").orderBy("_first", "_piece")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (micros(F.col("_first")) - micros(before) >= gap)).cast("int")
    counted = spans.withColumn("_opens", opens).withColumn("_window", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("collection", "op", "_window")  # as the spans already lie
    ends = counted.select("collection", "op", "_piece", F.min("_first").over(whole).alias("_begin"), F.max("_to").over(whole).alias("_end"))
    keyed = pieces.join(ends, ["collection", "op", "_piece"])
    last = keyed.groupBy("collection", "op", "_begin", "_end", "id").agg(F.sum("_n").alias("_n"), F.max_by("_row", "_row.seq").alias("_row"))
    return last.select("collection", "op", F.col("_begin").alias("_first"), F.col("_end").alias("_to"), "id", "_n", "_row")


def _told(windows: DataFrame, gap: int) -> DataFrame:
    end = F.col("_to") + F.make_dt_interval(secs=F.lit(gap) / F.lit(1_000_000))
    return windows.select("collection", "op", F.col("_first").alias("begin"), end.alias("end"), "id", F.col("_n").alias("n_changes"), "_row.*")


def batches(changes: DataFrame, gap_seconds: float) -> DataFrame:
    """Changes (collection, op, id, ts, seq, ...) gathered until a (collection, op) is idle for the gap: for each window and id the last change
    (collection, op, begin, end, id, n_changes, and the other columns).

    Changes are first counted by slices of time as long as the gap, whose changes are always of one window; only slices are put in order, so
    neither a busy collection nor a long window is gathered in a task."""
    gap = round(gap_seconds * 1_000_000)
    return _told(_windows(_pieces(changes, gap), gap), gap)


class Debouncer:
    """Windows that stay open across micro-batches: the same as ``batches`` over all changes, however they are cut, if a change comes ``delay``
    seconds after later ones at most. A change that comes later still is never lost: it joins an open window or makes one of its own.

    A window ends when a change of any collection is a gap and the delay later than its last one, or by ``flush``. Open windows are rows of a
    store (one for each window and id, whatever the number of changes), cut into buckets by id, so a busy collection isn't one task's state; they, the
    ended windows and the clock change in one commit, numbered by the micro-batch. A repeated micro-batch finds its windows as they were told."""

    def __init__(self, store: Store, gap_seconds: float, delay: float = 0):
        self.store, self.gap, self.delay = store, round(gap_seconds * 1_000_000), round(delay * 1_000_000)

    def take(self, changes: DataFrame, batch: int) -> DataFrame:
        """The windows that end with this micro-batch."""
        return self._step(changes, batch, changes.agg(F.max(micros(F.col("ts")))).first()[0])

    def flush(self, batch: int) -> DataFrame | None:
        """End all windows, as a clock does when no more changes come; None if no change ever came."""
        return self._step(None, batch, None, every=True) if self.store.read("open") is not None else None

    def _step(self, changes: DataFrame | None, batch: int, newest: int | None, every: bool = False) -> DataFrame:
        store, buckets = self.store, list(range(self.store.buckets))

        def build(now: dict):
            held, clock = store.read("open", manifest=now), store.read("clock", manifest=now)
            seen = [r.at for r in clock.collect()] if clock is not None else []
            at = max([x for x in [*seen, newest] if x is not None], default=None)
            pieces = [] if changes is None else [_pieces(changes, self.gap)]
            if held is not None:
                pieces.append(held.withColumn("_piece", micros(F.col("_first"))).select("collection", "op", "id", "_piece", "_first", "_to", "_n", "_row"))
            found = store.scratch(_windows(pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1]), self.gap))
            ended = F.lit(True) if every else F.lit(False) if at is None else micros(F.col("_to")) + self.gap + self.delay <= at
            clock_row = store.spark.createDataFrame([("clock", at)], "name string, at long")
            return {"open": ("replace", "id", found.where(~ended), buckets), "ended": ("replace", "id", found.where(ended), buckets), "clock": ("replace", "name", clock_row, buckets)}

        try:
            store.commit(build, "changes", batch)
        finally:
            store.clear_scratch()
        return _told(store.read("ended"), self.gap)


def notices(events: DataFrame) -> DataFrame:
    """What subscribers to a collection's own changes (type, ids, ...) hear: upserts and removals; a clear is the removal of what it took.
    Reloads, and clears of nothing, are silent."""
    kind = F.when(F.col("type").isin("upsert", "remove"), F.col("type")).when((F.col("type") == "clear") & (F.array_size("ids") > 0), "remove")
    return events.withColumn("type", kind).where("type is not null")


def deliver(stream: DataFrame, gap_seconds: float, registry: Registry, subscribers: list[Callable[[str, DataFrame], None]], checkpoint: str, windows: Debouncer | None = None) -> StreamingQuery:
    """Each micro-batch's ended windows: a collection's hooks run first, then its subscribers. Without ``windows``, which keeps them open from one
    micro-batch to the next, the end of a micro-batch ends its windows. A micro-batch that is repeated after a failure is told again, the same."""

    def run(rows: DataFrame, epoch: int) -> None:
        tell_windows(windows.take(rows, epoch) if windows else batches(rows, gap_seconds), registry, subscribers)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tell_windows(ended: DataFrame, registry: Registry, subscribers: list[Callable[[str, DataFrame], None]]) -> None:
    found = ended.persist()
    for row in found.select("collection").distinct().collect():
        own = found.where(F.col("collection") == row.collection)
        registry.after(row.collection, own)
        for tell in subscribers:
            tell(row.collection, own)
    found.unpersist()


def removed(before: DataFrame, now: DataFrame, id_column: str) -> DataFrame:
    """Ids that left a subscription's result."""
    return before.select(id_column).join(now.select(id_column), id_column, "left_anti")


def all_emission(before: DataFrame, now: DataFrame) -> DataFrame:
    """What a subscription of all records tells (id, pos, cursor): each id in its place, and a delete for each that left. Nothing where number
    and order are as before. Both are (id, pos)."""
    changed = before.alias("b").join(now.alias("n"), "id", "full_outer").agg(F.bool_or(~F.col("b.pos").eqNullSafe(F.col("n.pos")))).first()[0]
    told = now.select("id", "pos", F.lit("active").alias("cursor")).unionByName(removed(before, now, "id").select("id", F.lit(None).cast("long").alias("pos"), F.lit("delete").alias("cursor")))
    return told if changed else told.limit(0)


def fanned_out(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """A cursor of each change (collection, id, ...) for each client that watches its collection (client, collection)."""
    return changes.join(watches, "collection")


def hash_of(result: DataFrame, id_column: str) -> DataFrame:
    """One row: the hash of the ordered ids of ``result`` (pos, id)."""
    return hashing.result_hash(result, "pos", id_column)


class LiveQuery:
    """Runs a query again after each batch of changes and calls back when the ordered ids' hash is new, else ``on_same`` if given. A run that
    was overtaken by a later one says nothing; a disabled query gives ``default``."""

    def __init__(self, query: Callable[[], DataFrame], on_change: Callable[[DataFrame], None], id_column: str = "id", on_same: Callable[[], None] | None = None, default: DataFrame | None = None):
        self.query, self.on_change, self.id, self.last = query, on_change, id_column, None
        self.on_same, self.default, self.disabled, self.run = on_same, default, False, 0

    def refresh(self, batch: DataFrame | None = None, epoch: int = 0) -> None:
        self.run += 1
        own = self.run
        if self.disabled:
            if self.default is not None:
                self.on_change(self.default)
            return
        result = self.query()
        now = hash_of(result, self.id).first()[0]
        if own != self.run:
            return
        if now != self.last:
            self.last = now
            self.on_change(result)
        elif self.on_same:
            self.on_same()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Subscriptions:
    """The last answer of each subscription, so that only what differs is told; forgotten when it ends."""

    def __init__(self):
        self._last: dict[str, tuple] = {}

    def tell(self, name: str, answer: tuple, emit: Callable[[tuple], None]) -> bool:
        """Emit ``answer`` (such as total, count and hash of the order) if it isn't the last one."""
        if self._last.get(name) == answer:
            return False
        self._last[name] = answer
        emit(answer)
        return True

    def end(self, name: str) -> None:
        self._last.pop(name, None)


def merge_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Late entries are never dropped: each batch is merged by entry id and its records are replayed, so there is no watermark."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
