"""What a server sends each client, as a stream with keyed state: the filter (what a client is known to have), tombstones, cursors in flight and
cursors that wait, for each (client, collection, id).

Events (client, collection, id, kind, seq, is_delete, last_entry_id, hash, authoritative, ok) are of three kinds: ``cursor`` (a record's state to
be told), ``claim`` (what a client says it has: a hash is a live record, none a delete) and ``ack`` (the answer to the cursor in flight; ``ok`` null
where none came in time, which only sends it again). A micro-batch is a turn: answers count first, then claims, then the cursors that wait are
squashed and, if nothing of the record is in flight, decided; so the order of rows within a micro-batch matters only by ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["client", "collection", "id"]
EVENTS = "client string, collection string, id string, kind string, seq long, is_delete boolean, last_entry_id string, hash string, authoritative boolean, ok boolean"
SENT = "client string, collection string, id string, is_delete boolean, last_entry_id string, hash string, authoritative boolean, seq long"
FILTER = "client string, collection string, id string, known_hash string, known_last string, confirmed_deleted boolean"
_CURSOR = ("is_delete", "last_entry_id", "hash", "authoritative", "seq")
_TYPES = ("boolean", "string", "string", "boolean", "long")
STATE = "known boolean, known_hash string, known_last string, confirmed_deleted boolean, " + ", ".join(f"{part}_{name} {kind}" for part in ("sent", "next") for name, kind in zip(_CURSOR, _TYPES, strict=True))


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Two cursors of a record squashed: a delete beats all, the last among deletes; else the greatest last id. Authoritative if one of them is."""
    if a is None or b is None:
        return a or b
    rank = lambda c: (c[0], "" if c[0] else c[1] or "", c[4])
    best = max(a, b, key=rank)
    return (*best[:3], a[3] or b[3], best[4])


def turn(state: tuple, acks: tuple | None, claims: tuple, waits: tuple | None) -> tuple[tuple, tuple | None]:
    """A record's state after a turn, and the cursor that is sent, if any. ``acks`` is (seq, ok) of the last answer, ``claims`` the last live claim
    (seq, hash, last id) and the seq of the last deleted one."""
    known, has, last, deleted, flying, queue = state
    live, gone = claims
    if acks is not None and flying is not None:
        ok, (delete, at, code, authoritative, seq) = acks[1], flying
        if ok and delete:
            known, has, last, deleted = False, None, None, True  # final
        elif ok and (known or authoritative):
            known, has, last = True, code, at
        elif ok is False and delete:
            known, has, last = True, None, at  # a deletion that is pending
        # what failed stands before what came later: its number is below theirs
        first = min(queue[4], waits[4] if waits else queue[4]) if queue else waits[4] if waits else seq + 1
        queue = queue if ok else better((*flying[:4], min(seq, first - 1)), queue)
        flying = None
    if live is not None:
        known, has, last = True, live[1], live[2]
        deleted = False if gone is None or gone < live[0] else deleted
    if gone is not None and (live is None or live[0] < gone):
        deleted = True
    queue, out = better(queue, waits), None
    if flying is None and queue is not None:
        delete, at, code, authoritative, seq = queue
        if deleted:
            pass
        elif not known and delete and not authoritative:
            deleted = True  # cursors that are older than the delete can't bring the record back
        elif not known:
            out = queue if authoritative else None
        elif has is None:
            out = (True, max(at or "", last or "") if delete else last, None, authoritative, seq)
        elif delete or not (code == has and at == last or (at or "") < (last or "")):
            out = queue
        queue, flying = None, out
    return (known, has, last, deleted, flying, queue), out


class _Record(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        r = initialState
        self._save((True, r.known_hash, r.known_last, bool(r.confirmed_deleted), None, None))

    def _save(self, state: tuple) -> None:
        none = (None,) * len(_CURSOR)
        self.state.update((*state[:4], *(state[4] or none), *(state[5] or none)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        acks = live = gone = waits = None
        for r in rows:  # of any number only the last of each kind is held
            if r.kind == "ack":
                acks = max(acks or (r.seq, r.ok), (r.seq, r.ok), key=lambda x: x[0])
            elif r.kind == "claim" and r.hash is not None:
                live = max(live or (r.seq, r.hash, r.last_entry_id or ""), (r.seq, r.hash, r.last_entry_id or ""), key=lambda x: x[0])
            elif r.kind == "claim":
                gone = max(r.seq, gone) if gone is not None else r.seq
            elif r.kind == "cursor":
                waits = better(waits, (bool(r.is_delete), r.last_entry_id, r.hash, bool(r.authoritative), r.seq))
        held = self.state.get() if self.state.exists() else None
        if held is None:
            before = (False, None, None, False, None, None)
        else:
            flying, queue = tuple(held[4:9]), tuple(held[9:14])
            before = (*held[:4], flying if flying[0] is not None else None, queue if queue[0] is not None else None)
        after, out = turn(before, acks, (live, gone), waits)
        if after != before:
            self._save(after)
        if out is not None:
            yield Row(client=key[0], collection=key[1], id=key[2], is_delete=out[0], last_entry_id=out[1], hash=out[2], authoritative=out[3], seq=out[4])

    def close(self) -> None:
        pass


def dispatching(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The stream of what is sent (``SENT``), given the stream of events and the filter at its start (client, collection, id, known_hash, known_last,
    confirmed_deleted). The session needs ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's (``keyed_state``)."""
    start: GroupedData | None = known.groupBy(*KEY) if known is not None else None
    return events.groupBy(*KEY).transformWithState(_Record(), SENT, "append", "None", start)


#: Records whose state one partition keeps. A partition is one task, and a record's turn takes milliseconds there; it is also a RocksDB of its own,
#: whose files take some megabytes even when it is empty.
PARTITION = 5_000


def keyed_state(spark: SparkSession, records: int | None = None) -> None:
    """State in RocksDB, with changes since the last snapshot as checkpoint, so that a turn costs what it touches. A stream keeps the number of
    partitions that it began with: with ``records``, the number of (client, collection, id) to expect, it follows them, else the session's
    setting stays. Since the setting is the session's own, give a stream a session (``newSession``)."""
    if records is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(max(1, -(-records // PARTITION))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def filter_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The filter and tombstones as a stream's checkpoint has them (client, collection, id, known_hash, known_last, confirmed_deleted)."""
    held = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    value = held.select("key.*", "value.*")
    return value.where("known or confirmed_deleted").select(*KEY, F.when(F.col("known"), F.col("known_hash")).alias("known_hash"), F.when(F.col("known"), F.col("known_last")).alias("known_last"), "confirmed_deleted")
