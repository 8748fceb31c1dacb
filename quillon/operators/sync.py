"""Two-way synchronisation as set operations over one batch: squash, filter, acknowledge, apply, reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.audit import branches, deleted_state, merged, pending_state, without_trail


def squashed(cursors: DataFrame) -> DataFrame:
    """One cursor per (collection, id): a delete beats all, the last enqueued among deletes; else the greatest last id. ``authoritative``
    is true if any of them was. An aggregation, not a window: a hot id is reduced in each task."""
    rank = F.struct(F.col("is_delete").alias("d"), F.when(F.col("is_delete"), F.lit("")).otherwise(F.col("last_entry_id")).alias("l"), F.col("seq").alias("s"))
    best = cursors.groupBy("collection", "id").agg(F.max_by(F.struct("is_delete", "last_entry_id", "hash", "seq"), rank).alias("c"), F.max("authoritative").alias("authoritative"))
    return best.select("collection", "id", "c.*", "authoritative")


def dispatched(cursors: DataFrame, state: DataFrame) -> DataFrame:
    """What a client is sent: cursors (squashed) against its filter state (collection, id, known_hash, known_last, confirmed_deleted)."""
    joined = cursors.join(state.withColumn("known", F.lit(True)), ["collection", "id"], "left")
    known, deleted = F.coalesce("known", F.lit(False)), F.coalesce("confirmed_deleted", F.lit(False))
    decision = (
        F.when(deleted, "drop:deleted")
        .when(~known & ~F.col("authoritative") & F.col("is_delete"), "tombstone")
        .when(~known & ~F.col("authoritative"), "drop:unknown")
        .when(~known, "send")
        .when(F.col("known_hash").isNull(), "send:delete")
        .when(F.col("is_delete"), "send:delete")
        .when((F.col("known_hash") == F.col("hash")) & (F.col("known_last") == F.col("last_entry_id")), "drop:same")
        .when(F.col("last_entry_id") < F.col("known_last"), "drop:older")
        .otherwise("send")
    )
    return joined.select("collection", "id", decision.alias("decision"))


def acknowledged(state: DataFrame, acks: DataFrame) -> DataFrame:
    """The filter state after acknowledgements (collection, id, ok, is_delete, hash, last_entry_id, authoritative). A delete that failed is
    pending, known by its last id."""
    joined = state.withColumn("known", F.lit(True)).join(acks, ["collection", "id"], "full_outer")
    known, acked = F.coalesce("known", F.lit(False)), F.col("ok").isNotNull()
    gone, failed = acked & F.col("is_delete") & F.col("ok"), acked & F.col("is_delete") & ~F.col("ok")
    written = acked & ~F.col("is_delete") & F.col("ok")
    keep = known | (written & F.col("authoritative")) | gone | failed
    return joined.where(keep).select(
        "collection", "id", F.when(gone | failed, None).when(written, F.col("hash")).otherwise(F.col("known_hash")).alias("known_hash"),
        F.when(written | failed, F.col("last_entry_id")).otherwise(F.col("known_last")).alias("known_last"), (gone | F.coalesce("confirmed_deleted", F.lit(False))).alias("confirmed_deleted"),
    )


def requeued(cursors: DataFrame, acks: DataFrame, later: DataFrame) -> DataFrame:
    """The queue after a dispatch: failed or unanswered cursors stand before those that came later (seq below all theirs), squashed."""
    failed = cursors.join(acks.where("ok").select("collection", "id"), ["collection", "id"], "left_anti")
    first, most = later.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0], failed.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    moved = failed.withColumn("seq", F.col("seq") + (first - 1 - most))
    return squashed(moved.unionByName(later.select(*moved.columns)))


def mirrored(request: DataFrame) -> DataFrame:
    """The filter that a client's request (collection, id, hash, last_entry_id) claims: a hash is a live record, none a delete."""
    gone = F.col("hash").isNull()
    return request.select("collection", "id", F.col("hash").alias("known_hash"), F.when(~gone, F.coalesce("last_entry_id", F.lit(""))).alias("known_last"), gone.alias("deleted"))


def filter_updated(state: DataFrame, claims: DataFrame) -> DataFrame:
    """A filter state (collection, id, known_hash, known_last, confirmed_deleted) after claims (as ``mirrored`` gives them): live ones replace
    hash and last id and clear a tombstone that came too early; deletes confirm one and leave what is known of the record."""
    joined = state.withColumn("known", F.lit(True)).join(claims.select("collection", "id", F.col("known_hash").alias("h"), F.col("known_last").alias("l"), "deleted"), ["collection", "id"], "full_outer")
    live = F.coalesce(~F.col("deleted"), F.lit(False))
    return joined.select(
        "collection", "id", F.when(live, F.col("h")).otherwise(F.col("known_hash")).alias("known_hash"), F.when(live, F.col("l")).otherwise(F.col("known_last")).alias("known_last"),
        F.when(live, False).otherwise(F.coalesce("deleted", F.lit(False)) | F.coalesce("confirmed_deleted", F.lit(False))).alias("confirmed_deleted"),
    )


def server_writes(live: DataFrame, entries: DataFrame, records: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A client's records (record_id, ...) and log after writes by the server: the records replace theirs, each audit becomes a branch at its
    anchor (record_id, anchor)."""
    fields = {"record_id": F.col("record_id"), "entry_id": F.col("entry_id"), "type": F.col("type")}
    fresh = branches(anchors).select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema])
    return live.join(records.select("record_id"), "record_id", "left_anti").unionByName(records.select(*live.columns)), without_trail(entries, anchors).unionByName(fresh)


def server_deletes(live: DataFrame, entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A client's records and log after deletes by the server (record_id), and (record_id, action): who has pending changes loses the record
    but keeps the audit, to be sent once more (``markAsDeleted``); others lose both (``remove``); unknown ids do nothing."""
    state = ids.select("record_id").distinct().join(pending_state(entries).select("record_id", "has_pending"), "record_id", "left").join(live.select("record_id", F.lit(True).alias("here")), "record_id", "left")
    action = state.where("has_pending is not null or here").select("record_id", F.when(F.col("has_pending"), "markAsDeleted").otherwise("remove").alias("action"))
    return live.join(ids.select("record_id"), "record_id", "left_anti"), without_trail(entries, action.where("action = 'remove'")), action


def answered(*responses: DataFrame) -> DataFrame:
    """The union of answers (collection, id), each id once."""
    union = responses[0]
    for other in responses[1:]:
        union = union.unionByName(other)
    return union.select("collection", "id").distinct()


def requested(entries: DataFrame, live: DataFrame, only_pending: bool = True) -> DataFrame:
    """What a client sends (record_id, hash, entry_id, type): all entries of its audits, of those with pending changes unless it sends all,
    with the live record's hash (record_id, hash), null for deleted ones. A row per entry, so no audit is gathered."""
    wanted = pending_state(entries).where("has_pending").select("record_id") if only_pending else entries.select("record_id").distinct()
    return entries.join(wanted, "record_id", "left_semi").join(live.select("record_id", "hash"), "record_id", "left").select("record_id", "hash", "entry_id", "type")


def acknowledged_audits(entries: DataFrame, live: DataFrame, acks: DataFrame) -> DataFrame:
    """A client's log after acknowledgements (record_id, last_entry_id): audits of live records (record_id) collapse to a branch at that
    entry, those of deleted ones go unless entries came after it."""
    later = entries.join(acks, "record_id").where("entry_id > last_entry_id").drop("last_entry_id")
    anchored = acks.join(live.select("record_id", F.lit(True).alias("here")), "record_id", "left").join(later.select("record_id").distinct().withColumn("more", F.lit(True)), "record_id", "left").where("here or more")
    fields = {"record_id": F.col("record_id"), "entry_id": F.col("last_entry_id"), "type": F.lit(4)}
    fresh = anchored.join(entries.select("record_id").distinct(), "record_id", "left_semi").select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema])
    return without_trail(entries, acks).unionByName(later).unionByName(fresh)


def client_applied(local: DataFrame, cursors: DataFrame) -> DataFrame:
    """What a client does with each cursor (id, is_delete, last_entry_id), given its state (id, has_record, branch_only, branch_id)."""
    joined = cursors.join(local.withColumn("known", F.lit(True)), "id", "left")
    none, delete = F.col("known").isNull(), F.col("is_delete")
    outcome = (
        F.when(none & ~delete, "apply").when(none, "done")
        .when(~F.col("has_record") & ~delete, "refuse").when(~F.col("has_record"), "done")
        .when(delete, "apply delete")
        .when(~F.col("branch_only"), "skip pending")
        .when(F.col("last_entry_id") < F.col("branch_id"), "skip stale")
        .otherwise("apply")
    )
    return joined.select("id", outcome.alias("outcome"))


def received(server: DataFrame, client: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged log of a client batch, and each record's answer (record_id, status): ``merged``, ``orphan``, or ``orphan deleted``. A
    client's branches only anchor its changes and are left out before audits merge."""
    known = server.select("record_id").distinct().withColumn("known", F.lit(True))
    seen = client.groupBy("record_id").agg(F.min_by("type", F.when(F.col("type") != 4, F.col("entry_id"))).alias("first"), F.max((F.col("type") == 2).cast("int")).alias("deletes")).join(known, "record_id", "left")
    adopt = F.coalesce("known", F.lit(False)) | F.coalesce(F.col("first") == 0, F.lit(False))
    status = seen.select("record_id", F.when(adopt, "merged").when(F.col("deletes") == 1, "orphan deleted").otherwise("orphan").alias("status"))
    good = status.where("status = 'merged'").select("record_id")
    return merged(server, client.where("type <> 4").join(good, "record_id", "left_semi")), status


def disparities(server: DataFrame, client: DataFrame) -> DataFrame:
    """Cursors for records whose client hash (id, client_hash) isn't the server's (id, server_hash, null: deleted)."""
    joined = client.join(server, "id")
    kind = F.when(F.col("server_hash").isNull() & F.col("client_hash").isNotNull(), "delete").when(F.col("server_hash").isNotNull() & ~F.col("server_hash").eqNullSafe(F.col("client_hash")), "active")
    return joined.select("id", kind.alias("cursor")).where("cursor is not null")


def reconciled(client_ids: DataFrame, server_ids: DataFrame) -> DataFrame:
    """Ids that a client holds and the server doesn't: to be deleted there."""
    return client_ids.join(server_ids, "id", "left_anti")


def states(entries: DataFrame, live: DataFrame, only_pending: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """(record_id, last_id, active): audited records, active if a live record stands beside the audit; all, those with pending changes, or
    some ids (record_id)."""
    if ids is not None:
        entries = entries.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    last = entries.groupBy("record_id").agg(F.max("entry_id").alias("last_id"))
    if only_pending:
        last = last.join(pending_state(entries).where("has_pending"), "record_id", "left_semi")
    return last.join(live.select("record_id", F.lit(True).alias("_l")), "record_id", "left").select("record_id", "last_id", F.coalesce("_l", F.lit(False)).alias("active"))


def cursors(entries: DataFrame, live: DataFrame, hash_column: str, authoritative: bool) -> DataFrame:
    """Cursors of all live records that aren't tombstoned, from one snapshot of log and live records, so the two always agree. Records
    without an audit have an empty last id. ``authoritative`` ones may introduce a record to a client, those of a change stream not."""
    last = entries.groupBy("record_id").agg(F.max("entry_id").alias("last_entry_id"))
    dead = deleted_state(entries).where("is_deleted").select("record_id")
    return live.join(dead, "record_id", "left_anti").join(last, "record_id", "left").select("record_id", F.coalesce("last_entry_id", F.lit("")).alias("last_entry_id"), F.col(hash_column).alias("hash"), F.lit(authoritative).alias("authoritative"))


def integrity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(id, issue): missing, extra or mismatched records by (id, hash)."""
    joined = expected.select("id", F.col("hash").alias("e"), F.lit(True).alias("_e")).join(found.select("id", F.col("hash").alias("f"), F.lit(True).alias("_f")), "id", "full_outer")
    issue = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("e").eqNullSafe(F.col("f")), "mismatch")
    return joined.select("id", issue.alias("issue")).where("issue is not null")


def latest_of_clients(versions: DataFrame) -> DataFrame:
    """Last writer wins over clients' copies (id, client, last_entry_id, value): the greatest last id, the first client on ties."""
    first = F.struct(F.col("last_entry_id"), (-F.col("client")).alias("c"))
    return versions.groupBy("id").agg(F.max_by("client", first).alias("client"), F.max_by("value", first).alias("value"))
