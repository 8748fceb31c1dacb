"""What a server does with a client's request: audits merge, records are replayed, log and live rows are persisted in one commit, and what
the client has otherwise than the merged state is told it by cursors.

A request is (record_id, client_hash: null where the client has the record as deleted) and its entries (record_id, entry_id, type, record, ops).
A client's branches only anchor its changes and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.operators import audit
from quillon.sources.store import Store

LOG = "record_id string, entry_id string, type int, record string, ops array<struct<op: string, path: string, value: string, position: string, hash: string>>"
LIVE = "record_id string, live string, hash string"


def statuses(known: DataFrame, request: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id, client_hash, status): ``branched`` where there is nothing to merge; of records that aren't known (record_id) and don't begin with
    a created entry ``deleted`` if the client deletes them anyway, else ``orphan``; ``merged`` of the others. All but orphans succeed."""
    own = entries.where("type <> 4").groupBy("record_id").agg(F.min_by("type", "entry_id").alias("first"), F.bool_or(F.col("type") == 2).alias("deletes"))
    heads = request.groupBy("record_id").agg(F.max("client_hash").alias("client_hash"))
    seen = heads.join(own, "record_id", "left").join(known.select("record_id").distinct().withColumn("known", F.lit(True)), "record_id", "left")
    status = F.when(F.col("first").isNull(), "branched").when(F.col("known") | (F.col("first") == 0), "merged").when(F.col("deletes"), "deleted").otherwise("orphan")
    return seen.select("record_id", "client_hash", status.alias("status"))


def outcome(log: DataFrame, live: DataFrame, request: DataFrame, entries: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(news, states, answers) of a request, given the server's log and live rows (record_id, live, hash) of its records at least: the entries that
    the log lacks; (record_id, live, hash, last_id) of the records that merged, live null for deleted ones; and (record_id, status, cursor, last_id,
    hash), where cursor is ``active`` or ``delete`` if the client differs from the merged state. ``keep`` may write what is used more than once."""
    ids = request.select("record_id").distinct()
    mine, here = log.join(ids, "record_id", "left_semi"), live.join(ids, "record_id", "left_semi")
    status = keep(statuses(mine.select("record_id").union(here.select("record_id")), request, entries))
    good = status.where("status = 'merged'").select("record_id")
    news = keep(audit.merge_news(mine, entries.where("type <> 4").join(good, "record_id", "left_semi")).select(*mine.columns))
    merged = mine.join(good, "record_id", "left_semi").unionByName(news)
    last = merged.groupBy("record_id").agg(F.max("entry_id").alias("last_id"))
    states = keep(audit.replay_full(merged).select("record_id", "live").withColumn("hash", hashing.json_hashes("live")).join(last, "record_id", "left"))
    before = here.select("record_id", "hash").join(mine.groupBy("record_id").agg(F.max("entry_id").alias("last_id")), "record_id", "full_outer")
    now = before.join(good, "record_id", "left_anti").select("record_id", "hash", "last_id").unionByName(states.select("record_id", "hash", "last_id")).withColumn("there", F.lit(True))
    told = status.join(now, "record_id", "left")
    differs = F.col("there") & (F.col("status").isin("branched", "merged")) & ~F.col("hash").eqNullSafe(F.col("client_hash"))
    cursor = F.when(differs & F.col("hash").isNotNull(), "active").when(differs, "delete")
    answers = told.withColumn("cursor", cursor).select("record_id", "status", "cursor", F.when(F.col("cursor").isNotNull(), F.col("last_id")).alias("last_id"), F.when(F.col("cursor") == "active", F.col("hash")).alias("hash"))
    return news, states, answers


def receive(store: Store, request: DataFrame, entries: DataFrame, source: str, batch: int) -> bool:
    """Merge a client's batch into the store's tables ``log`` and ``live`` and put its answers into ``answers:<source>``, all in one commit; False for
    a batch that was received before. Only the buckets of its records are read; the log is added to, live rows are written anew."""
    spark = store.spark

    def build(now: dict):
        touched = store.touched(request.select("record_id"))
        log = store.read("log", touched, now)
        live = store.read("live", touched, now)
        log, live = (spark.createDataFrame([], kind) if df is None else df for df, kind in ((log, LOG), (live, LIVE)))
        news, states, answers = outcome(log, live, request, entries, store.scratch)
        rows = live.join(states.select("record_id"), "record_id", "left_anti").unionByName(states.where("live is not null").select("record_id", "live", "hash"))
        every = list(range(store.buckets))
        return {"log": ("append", "record_id", news, []), "live": ("replace", "record_id", rows, touched), f"answers:{source}": ("replace", "record_id", answers, every)}

    try:
        return store.commit(build, source, batch)
    finally:
        store.clear_scratch()
