"""A collection's live records kept up from its log: a batch of entries reads the heads of the records it touches, never the whole log.

A store holds ``log`` (all entries), ``heads`` (for each record what its log replays to, hidden or not, and its last entry) and ``changes`` (what
the last batch changed), cut into buckets by record. Entries that come after a record's head are replayed from that head. A record with an
entry that comes before its head (late, or sent again) is replayed from its own log, of which only such records' buckets are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import audit
from quillon.operators.receiver import LOG
from quillon.sources.store import Store

HEADS = "record_id string, shadow string, hidden boolean, last_id string"


def _states(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """New heads of the records of ``entries``, from their old ones if given."""
    base = heads.select("record_id", F.col("shadow").alias("base"), F.col("hidden").alias("base_hidden")) if heads is not None else None
    last = entries.groupBy("record_id").agg(F.max("entry_id").alias("last_id"))
    state = audit.replay_full(entries, base).join(last, "record_id")
    return state.select("record_id", "shadow", (F.col("shadow").isNotNull() & F.col("live").isNull()).alias("hidden"), "last_id")


def live_of(heads: DataFrame) -> DataFrame:
    """(record_id, live) of the records that are there and not deleted."""
    return heads.where("shadow is not null and not hidden").select("record_id", F.col("shadow").alias("live"))


def changes_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, op, before, after) of live records (record_id, live) that differ; op is insert, update or delete."""
    both = before.withColumnRenamed("live", "before").join(after.withColumnRenamed("live", "after"), "record_id", "full_outer")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("record_id", op.alias("op"), "before", "after")


def applied(store: Store, entries: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
    """Put entries (record_id, entry_id, type, record, ops; more columns are left out) into the store's log, and its heads and changes in line with
    them, in one commit. False for a batch of ``source`` that was there. Entries that the log has already, by record and entry id, count once,
    as do repeated ones within a batch; entries without a record_id, entry_id or type are left out. An empty batch leaves the heads as they are."""
    spark, fields = store.spark, T.StructType.fromDDL(LOG)

    def build(now: dict):
        valid = entries.where("record_id is not null and entry_id is not null and type is not null")
        came = store.scratch(valid.select(*[F.col(f.name).cast(f.dataType) for f in fields]).dropDuplicates(["record_id", "entry_id"]))
        touched = store.touched(came.select("record_id"))
        heads = store.read("heads", touched, now)
        heads = spark.createDataFrame([], HEADS) if heads is None else heads
        firsts = came.groupBy("record_id").agg(F.min("entry_id").alias("first_id"))
        mine = store.scratch(firsts.join(heads, "record_id", "left").withColumn("late", F.coalesce(F.col("first_id") <= F.col("last_id"), F.lit(False))))
        late, known = mine.where("late").select("record_id"), mine.where("not late and last_id is not null")

        states, news = _states(came.join(late, "record_id", "left_anti"), known), came
        again = store.touched(late)
        if again:
            old = store.read("log", again, now).join(late, "record_id", "left_semi")
            repeated = old.select("record_id", "entry_id")
            news = came.join(repeated, ["record_id", "entry_id"], "left_anti")
            states = states.unionByName(_states(old.unionByName(news.join(late, "record_id", "left_semi"))))
        states = store.scratch(states)
        rows = heads.join(states.select("record_id"), "record_id", "left_anti").unionByName(states)
        changes = changes_of(live_of(mine), live_of(states))
        every = list(range(store.buckets))
        return {"log": ("append", "record_id", news, []), "heads": ("replace", "record_id", rows, touched), "changes": ("replace", "record_id", changes, every)}

    try:
        return store.commit(build, source, batch)
    finally:
        store.clear_scratch()


def view(store: Store, schema: str | None = None, ids: DataFrame | None = None, manifest: dict | None = None) -> DataFrame | None:
    """The live records (record_id, live), or with a DDL ``schema`` their columns, as a manifest has them; with ``ids`` (one column) of those only, from
    their buckets. None before the first batch."""
    heads = store.read("heads", store.touched(ids) if ids is not None else None, manifest)
    if heads is None:
        return None
    if ids is not None:
        heads = heads.join(ids.toDF("record_id").distinct(), "record_id", "left_semi")
    live = live_of(heads)
    return live if schema is None else live.select("record_id", F.from_json("live", schema).alias("_")).select("record_id", "_.*")


def keeping(folder: str, buckets: int, source: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch of entries is applied once, also when a stream starts again from its checkpoint."""

    def micro_batch(rows: DataFrame, number: int) -> None:
        applied(Store(rows.sparkSession, folder, buckets), rows, source, number)

    return micro_batch


def rebuilt(store: Store) -> DataFrame:
    """Heads from the whole log, to compare with those that are kept."""
    return _states(store.read("log"))

