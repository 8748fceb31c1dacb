"""The audit log: append-only entries from which live records are derived.

Entries are (record_id, entry_id, type, record, ops, ...): type 0 created, 1 updated, 2 deleted, 3 restored, 4 branched.
Identifiers sort by time. Everything that a fold isn't needed for is an aggregation over ``record_id``, summed in each task
before the shuffle; only edits within a field need a fold, which streams them in order and holds one field at a time.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import structure

CREATED, UPDATED, DELETED, RESTORED, BRANCHED = range(5)


def when_type(*types: int) -> Column:
    return F.col("type").isin(*types)


def grouped(entries: DataFrame) -> DataFrame:
    """(record_id, entries): each record's entries in order."""
    rest = [c for c in entries.columns if c not in ("record_id", "entry_id")]
    return entries.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", *rest))).alias("entries"))


def created(records: DataFrame, id_column: str, entry_id: Column) -> DataFrame:
    """One created entry per record, with the record as JSON."""
    return records.select(F.col(id_column).cast("string").alias("record_id"), entry_id.alias("entry_id"), F.lit(CREATED).alias("type"), F.to_json(F.struct("*")).alias("record"))


def last_entries(entries: DataFrame) -> DataFrame:
    """(record_id, n_entries, last_id, branch_id): the greatest id and the first branch."""
    return entries.groupBy("record_id").agg(F.count("*").alias("n_entries"), F.max("entry_id").alias("last_id"), F.min(F.when(when_type(BRANCHED), F.col("entry_id"))).alias("branch_id"))


def deleted_state(entries: DataFrame) -> DataFrame:
    """(record_id, is_deleted): whether the last of deleted and restored is deleted."""
    last = F.max_by("type", F.when(when_type(DELETED, RESTORED), F.col("entry_id")))
    return entries.groupBy("record_id").agg(last.alias("_t")).select("record_id", F.coalesce(F.col("_t") == DELETED, F.lit(False)).alias("is_deleted"))


def pending_state(entries: DataFrame) -> DataFrame:
    """(record_id, has_pending, has_history, is_branch_only). Pending: without a branch any entry; with one, any change after the first."""
    branch = F.min(F.when(when_type(BRANCHED), F.col("entry_id"))).alias("b")
    change = F.when(~when_type(CREATED, BRANCHED), F.col("entry_id"))
    sums = entries.groupBy("record_id").agg(branch, F.max(change).alias("c"))
    return sums.select("record_id", F.when(F.col("b").isNull(), True).otherwise(F.coalesce(F.col("c") > F.col("b"), F.lit(False))).alias("has_pending"), F.col("c").isNotNull().alias("has_history"), F.col("c").isNull().alias("is_branch_only"))


def pending_count(entries: DataFrame) -> DataFrame:
    return pending_state(entries).agg(F.count_if("has_pending").alias("pending"))


def audits_of(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of some records (record_id); ids without an audit give none."""
    return entries.join(ids.select("record_id").distinct(), "record_id", "left_semi")


def without_trail(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The log without the audits of some records."""
    return entries.join(ids.select("record_id").distinct(), "record_id", "left_anti")


def cleared(live: DataFrame, entries: DataFrame, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """Live records (record_id) and log after a clear. Records with pending changes stay unless ``everything`` goes; so do records without
    an audit, since only audited ones are cleared."""
    if everything:
        return live.limit(0), entries.limit(0)
    done = pending_state(entries).where("not has_pending").select("record_id")
    return live.join(done, "record_id", "left_anti"), entries.join(done, "record_id", "left_anti")


def branches(anchors: DataFrame) -> DataFrame:
    """A lone branched entry at each anchor (record_id, anchor)."""
    return anchors.select("record_id", F.col("anchor").alias("entry_id"), F.lit(BRANCHED).alias("type"))


def _ends(own: Column, side: str = "") -> list[Column]:
    """What the validity of an audit depends on, from the entries that are ``own``: its first type, its last type and number of operations
    (null: none given), and how many entries there are."""
    place = F.when(own, F.col("entry_id"))
    return [F.min_by("type", place).alias(f"{side}first"), F.max_by(F.struct("type", "n_ops"), place).alias(f"{side}last"), F.count_if(own).alias(f"{side}n")]


def _reason(full: bool, side: str = "") -> Column:
    first, last, n = (F.col(f"{side}{name}") for name in ("first", "last", "n"))
    anchored, update = first.isin(CREATED, BRANCHED), last["type"] == UPDATED
    if full:
        return F.when(~anchored, "does not start with an anchor").when((n == 2) & update & (last["n_ops"] == 0), "anchor with an empty update")
    return (
        F.when(n > 2, "more than two entries").when(~anchored, "does not start with an anchor").when(n == 1, F.lit(None))
        .when(update & last["n_ops"].isNull(), "update without operations").when(update & (last["n_ops"] > 0), "update with operations").when(~update & (last["type"] != DELETED), "second entry is no update or delete")
    )


def _outlined(entries: DataFrame) -> DataFrame:
    return entries.select("record_id", "entry_id", "type", F.array_size("ops").alias("n_ops"))


def validated(entries: DataFrame, full: bool = True) -> DataFrame:
    """(record_id, reason): why an audit isn't a full one, or a sync-only one; null if it is. Aggregations only."""
    return _outlined(entries).groupBy("record_id").agg(*_ends(F.lit(True))).select("record_id", _reason(full).alias("reason"))


def collapsed(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each record's audit as one branch at its anchor (record_id, anchor) and what follows it: all entries after the anchor where the audit
    has it, else those after its id that aren't branches. Records without an anchor stay."""
    own = entries.groupBy("record_id", "entry_id").agg(F.lit(True).alias("here"))
    known = anchors.join(own, (anchors.record_id == own.record_id) & (anchors.anchor == own.entry_id), "left").select(anchors.record_id, "anchor", F.coalesce("here", F.lit(False)).alias("here"))
    joined = entries.join(known, "record_id", "left")
    later = joined.where(F.col("anchor").isNull() | (F.col("entry_id") > F.col("anchor")) & (F.col("here") | ~when_type(BRANCHED))).drop("anchor", "here")
    fields = {"record_id": F.col("record_id"), "entry_id": F.col("anchor"), "type": F.lit(BRANCHED)}
    branch = anchors.where("anchor is not null").join(entries.select("record_id").distinct(), "record_id", "left_semi")
    return later.unionByName(branch.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema]))


def merge_decisions(server: DataFrame, client: DataFrame, full: bool = True) -> DataFrame:
    """(record_id, decision) of a client's audits: ``adopt`` where the server has none; ``merge`` where the client's is valid, or has changes
    only (in full mode) and the server's is valid; else ``keep`` the server's. One aggregation over both sides."""
    ours = F.col("ours")
    both = _outlined(server).withColumn("ours", F.lit(True)).unionByName(_outlined(client).withColumn("ours", F.lit(False))).where("record_id is not null")
    changes = F.bool_and(ours | when_type(UPDATED, DELETED, RESTORED)).alias("changes_only")
    sums = both.groupBy("record_id").agg(*_ends(ours, "server_"), *_ends(~ours, "client_"), changes).where("client_n > 0")
    by_server = F.lit(full) & F.col("changes_only")
    good = (~by_server & _reason(full, "client_").isNull()) | (by_server & _reason(full, "server_").isNull())
    return sums.select("record_id", F.when(F.col("server_n") == 0, "adopt").when(good, "merge").otherwise("keep").alias("decision"))


def merge_news(server: DataFrame, client: DataFrame, full: bool = True) -> DataFrame:
    """What a server's log takes in of a client's: of audits that merge, the changes (no created, no branched entries) that the server lacks;
    audits of which the server has nothing whole; of others nothing. A repeated entry of the client counts once."""
    decided = merge_decisions(server, client, full)
    offered = client.join(decided.where("decision <> 'keep'"), "record_id").where((F.col("decision") == "adopt") | ~when_type(CREATED, BRANCHED)).drop("decision")
    return offered.join(server.select("record_id", "entry_id"), ["record_id", "entry_id"], "left_anti").dropDuplicates(["record_id", "entry_id"])


def merged(server: DataFrame, client: DataFrame, full: bool = True) -> DataFrame:
    """The server's log with what it takes in of a client's."""
    return server.unionByName(merge_news(server, client, full))


def replay_scalar(entries: DataFrame, fields: dict[str, Column], payload: Column | None = None) -> DataFrame:
    """(record_id, live, fields...) of records whose updates set top-level scalars; no fold, one aggregation.

    ``fields`` gives for each field whether an entry sets it (its column has the value). A restored entry copies the shadow
    unless ``payload`` says that it brings a record. What sets a field last is never older than the last entry that resets all, and once there
    is one, the last switch between live and deleted is never a restore from before it; so neither needs the other's place."""
    brings = payload if payload is not None else F.lit(False)
    reset = when_type(CREATED) | (when_type(RESTORED) & brings)
    switch = F.when(when_type(CREATED, DELETED, RESTORED), F.col("entry_id"))
    values = [F.max_by(name, F.when(reset | (when_type(UPDATED) & sets), F.col("entry_id"))).alias(name) for name, sets in fields.items()]
    sums = entries.groupBy("record_id").agg(F.bool_or(reset).alias("_reset"), (F.max_by("type", switch) != DELETED).alias("live"), *values)
    return sums.where("_reset").drop("_reset")


def as_of(entries: DataFrame, entry_id) -> DataFrame:
    """The log before an entry id: replay it to travel in time."""
    return entries.where(F.col("entry_id") < entry_id)


def _operation(op: dict) -> dict:
    return op | {"value": None if op["value"] is None else json.loads(op["value"])}


def _read(e: dict) -> dict:
    record = None if e["record"] is None else json.loads(e["record"])
    return {"entry_id": e["entry_id"], "type": e["type"], "record": record, "ops": [_operation(o) for o in e["ops"] or []]}


def _text(record) -> str | None:
    return None if record is None else json.dumps(record, sort_keys=True, ensure_ascii=False)


def _ordered(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows with equal keys in one partition, one after the other and in order: tasks stream them, and Spark's sort spills. They are dealt by a
    hash of the keys: by the keys themselves Spark leaves the step out above a union whose sides lie so, and adaptive joins then move the sides."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return (pa.RecordBatch.from_pylist(list(some), schema) for some in batched(rows, 256))


def _strings(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(name, pa.string()) for name in names]


def _folded(rows: DataFrame) -> DataFrame:
    """(record_id, field, value, there) of ordered rows: for each field of a known record one without an operation, with the last snapshot's
    entry (``since``) and text (``start``) and the last operation on the whole field (``at``, ``whole``), then all edits within the field."""

    def fields(batches):
        for (record_id, field), edits in groupby(_rows(batches), itemgetter("record_id", "field")):
            first = next(edits)
            if first["op"] is not None:
                continue  # the record has no snapshot to edit
            since, at, whole = first["since"], first["at"], first["whole"]
            if whole is None:
                holder = {k: v for k, v in json.loads(first["start"]).items() if k == field}
            else:
                holder = {} if whole["op"] == "remove" else {field: _operation(whole)["value"]}
            for e in edits:
                here = e["place"]["entry_id"], e["place"]["n"]
                if (since is None or here[0] >= since) and (at is None or here > (at["entry_id"], at["n"])):
                    structure.apply(holder, _operation(e["op"]))
            yield {"record_id": record_id, "field": field, "value": _text(holder.get(field)), "there": field in holder}

    schema = pa.schema([*_strings("record_id", "field", "value"), ("there", pa.bool_())])
    return rows.mapInArrow(lambda batches: _batches(fields(batches), schema), "record_id string, field string, value string, there boolean")


def replay_full(entries: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(record_id, live, shadow) as JSON, for entries with record (a JSON object) and ops (array of op, path, value JSON, position, hash); a
    record that ``base`` (record_id, base, and base_hidden if there is such a column) has starts from there. Entries without a record_id belong to
    no record.

    Aggregations, combined in each task, find each record's last snapshot, whether it is hidden, and the last operation that sets or removes
    a field as a whole. Operations touch one field each, so what is folded is one row a field and the edits within it, by record and field."""
    mine = entries.where("record_id is not null")
    snapshot = F.when(when_type(CREATED, RESTORED) & F.col("record").isNotNull(), F.col("entry_id"))
    switch = F.when(when_type(DELETED, RESTORED) | snapshot.isNotNull(), F.col("entry_id"))
    heads = mine.groupBy("record_id").agg(F.max(snapshot).alias("since"), F.max_by("record", snapshot).alias("start"), (F.max_by("type", switch) == DELETED).alias("hidden"))
    if base is not None:
        before = base.select("record_id", "base", (F.col("base_hidden") if "base_hidden" in base.columns else F.lit(False)).alias("was_hidden"))
        heads = heads.join(before, "record_id", "left").withColumns({"start": F.coalesce("start", "base"), "hidden": F.coalesce("hidden", "was_hidden")}).drop("base", "was_hidden")
    heads = heads.withColumn("hidden", F.coalesce("hidden", F.lit(False)))

    path = F.col("op.path")
    field = F.regexp_replace(F.regexp_extract(path, structure.STEP, 0), "^0+(?=[0-9]+$)", "")
    sets = (F.size(F.regexp_extract_all(path, F.lit(structure.STEP), F.lit(0))) == 1) & F.col("op.op").isin("remove", "replace", "add")
    edits = mine.where(when_type(UPDATED) & F.col("entry_id").isNotNull()).select("record_id", "entry_id", F.posexplode("ops").alias("n", "op"))
    edits = edits.select("record_id", field.alias("field"), F.struct("entry_id", "n").alias("place"), "op", sets.alias("sets")).where("field <> ''")
    place = F.when(F.col("sets"), F.col("place"))
    # a field's rows stay apart from its record's others, so a hot record is spread over its fields
    sums = edits.groupBy("record_id", "field").agg(F.max(place).alias("at"), F.max_by("op", place).alias("whole"))
    sums = sums.join(heads.where("start is not null"), "record_id")
    counts = F.col("since").isNull() | (F.col("at.entry_id") >= F.col("since"))  # what precedes the snapshot doesn't
    sums = sums.select("record_id", "field", "since", "hidden", *[F.when(counts, F.col(c)).alias(c) for c in ("at", "whole")], "start")
    firsts = sums.withColumn("start", F.when(F.col("whole").isNull(), F.col("start")))
    rows = firsts.unionByName(edits.where("not sets").drop("sets"), allowMissingColumns=True)
    changes = _folded(_ordered(rows, ["record_id", "field"], F.col("place").asc_nulls_first())).groupBy("record_id").agg(F.collect_list(F.struct("field", "value", "there")).alias("changes"))

    def assembled(batches):
        for r in _rows(batches):
            shadow = None if r["start"] is None else json.loads(r["start"])
            for c in r["changes"] or []:
                shadow.pop(c["field"], None)
                if c["there"]:
                    shadow[c["field"]] = None if c["value"] is None else json.loads(c["value"])
            yield {"record_id": r["record_id"], "live": None if r["hidden"] else _text(shadow), "shadow": _text(shadow)}

    schema = pa.schema(_strings("record_id", "live", "shadow"))
    return heads.join(changes, "record_id", "left").mapInArrow(lambda batches: _batches(assembled(batches), schema), "record_id string, live string, shadow string")


OPS = "array<struct<op: string, path: string, value: string, position: string, hash: string>>"


def differences(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ops: the structural difference of two JSON columns."""

    @F.pandas_udf(OPS)
    def run(a, b):
        def one(x, y):
            ops = structure.diff(json.loads(x), json.loads(y)) if x and y else []
            return [o | {"value": json.dumps(o["value"], sort_keys=True) if o["op"] in ("add", "replace") else None} for o in ops]

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return pairs.withColumn("ops", run(old, new))


def flat_differences(old: DataFrame, new: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(record_id, path, old_value, new_value): one row per changed flat column; columns only, no Python."""
    cells = [F.struct(F.lit(c).alias("path"), F.col(f"o.{c}").cast("string").alias("old_value"), F.col(f"n.{c}").cast("string").alias("new_value"), (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias("changed")) for c in columns]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{id_column}") == F.col(f"n.{id_column}"))
    return joined.select(F.col(f"o.{id_column}").cast("string").alias("record_id"), F.inline(F.array(*cells))).where("changed").drop("changed")


def rebased(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Three-way rebase of flat columns (c_old, c_mine, c_theirs): mine where I changed it, else theirs."""
    rest = [c for c in versions.columns if not any(c.startswith(f"{k}_") for k in columns)]
    return versions.select(*rest, *[F.when(F.col(f"{c}_mine").eqNullSafe(F.col(f"{c}_old")), F.col(f"{c}_theirs")).otherwise(F.col(f"{c}_mine")).alias(c) for c in columns])


def with_deletes(entries: DataFrame, ids: DataFrame, entry_id: Column) -> DataFrame:
    """A deleted entry for each id (record_id) whose audit isn't deleted."""
    gone = ids.join(deleted_state(entries), "record_id").where("not is_deleted")
    return gone.select("record_id", entry_id.alias("entry_id"), F.lit(DELETED).alias("type"))


def with_restores(state: DataFrame, wanted: DataFrame, entry_id: Column, columns: list[str]) -> DataFrame:
    """How each wanted record (record_id, columns) comes back, given the replayed state: created without a shadow, restored without a
    payload if it equals the shadow, else restored with it."""
    joined = wanted.alias("w").join(state.alias("s"), "record_id", "left")
    none, equal = F.col("s.live").isNull(), F.lit(True)
    for c in columns:
        equal = equal & F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}"))
    kind = F.when(none, CREATED).otherwise(RESTORED)
    return joined.select("record_id", entry_id.alias("entry_id"), kind.alias("type"), (none | ~equal).alias("has_payload"))


def server_audit(entries: DataFrame, user_id: str, live: DataFrame | None = None) -> DataFrame:
    """Entries (record_id, entry_id, type, record, ops, user_id) as a server keeps them: each with a user (its own, else ``user_id``), each
    delete with a record: its own, else for the last delete the live one (record_id, live) that was read, else the replay of what
    precedes it, else the id alone. Only audits with such a delete are folded, each streamed in order."""
    named = entries.withColumn("user_id", F.when(F.length("user_id") > 0, F.col("user_id")).otherwise(F.lit(user_id)))
    bare = named.where(when_type(DELETED) & F.col("record").isNull()).groupBy("record_id").agg(F.max("entry_id").alias("last_bare"))
    last = named.where(when_type(DELETED)).groupBy("record_id").agg(F.max("entry_id").alias("last"))

    def snapshots(batches):
        for record_id, rows in groupby(_rows(batches), itemgetter("record_id")):
            for e, before, _ in structure.histories(map(_read, rows)):
                if e is not None and e["type"] == DELETED:
                    yield {"record_id": record_id, "entry_id": e["entry_id"], "before": _text(before)}

    asked = named.join(bare, "record_id").where("entry_id <= last_bare and type is not null").select("record_id", "entry_id", "type", "record", "ops")
    schema = pa.schema(_strings("record_id", "entry_id", "before"))
    before = _ordered(asked, ["record_id"], F.col("entry_id")).mapInArrow(lambda batches: _batches(snapshots(batches), schema), "record_id string, entry_id string, before string")
    before = before.where("before is not null")
    joined = named.join(last, "record_id", "left").join(before, ["record_id", "entry_id"], "left")
    joined = joined.join(live.select("record_id", "live"), "record_id", "left") if live is not None else joined.withColumn("live", F.lit(None).cast("string"))
    snapshot = F.coalesce("record", F.when(F.col("entry_id") == F.col("last"), F.col("live")), "before", F.to_json(F.struct(F.col("record_id").alias("id"))))
    return joined.withColumn("record", F.when(when_type(DELETED), snapshot).otherwise(F.col("record"))).select(*entries.columns)


def updated_with(entries: DataFrame, current: DataFrame, entry_id: Column, base: DataFrame | None = None) -> DataFrame:
    """The entries (record_id, entry_id, type, record, ops) that bring audits to the current records (record_id, current as JSON; null:
    deleted): a delete unless the audit is deleted already; where nothing is live, a created entry if there is no shadow, a restored one
    without a record if it equals the shadow, else with it; for other differences an update; for none nothing."""
    state = replay_full(entries, base).join(deleted_state(entries), "record_id", "left")
    joined = current.join(state, "record_id", "left").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
    compared = differences(joined.withColumn("before", F.coalesce("live", "shadow")), "before", "current")
    none, gone, same = F.col("live").isNull(), F.col("current").isNull(), F.size("ops") == 0
    kind = F.when(gone & ~F.col("is_deleted"), DELETED).when(gone, None).when(none & F.col("shadow").isNull(), CREATED).when(none, RESTORED).when(~same, UPDATED)
    record = F.when((F.col("type") == CREATED) | (F.col("type") == RESTORED) & ~same, F.col("current"))
    return compared.withColumn("type", kind).where("type is not null").select("record_id", entry_id.alias("entry_id"), "type", record.alias("record"), F.when(F.col("type") == UPDATED, F.col("ops")).alias("ops"))


NEWS = "record_id string, entry_id string, type int, record string, ops " + "array<struct<op: string, path: string, value: string, position: string, hash: string>>, reset boolean"


def upsert_news(entries: DataFrame, live: DataFrame, records: DataFrame, entry_id: Column, correction_id: Column) -> DataFrame:
    """What the audits of upserted records (record_id, current: JSON) take in, given the live rows that these replace (record_id, live: JSON):
    (record_id, entry_id, type, record, ops, reset). A record without an audit gets a created entry. Where a live row and an audit are there, the audit is
    replayed from the live row: if that warns (an entry without id or type, a created one without a record, an update of nothing, an operation
    whose way leads nowhere), the audit gives way to one created entry of the live row (``reset``); if it gives another record, an update
    corrects it. Then comes the entry that leads to the new record; nothing at all where the live row equals it. The entries of the records
    are streamed in order, by record."""
    heads = records.select("record_id", "current", entry_id.alias("new_id"), correction_id.alias("fix_id")).join(live.select("record_id", "live"), "record_id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
    own = entries.join(records.select("record_id"), "record_id", "left_semi").select("record_id", "entry_id", "type", "record", "ops")
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ("entry_id", "type", "record", "ops")]
    rows = heads.select("record_id", F.lit(0).alias("part"), *blank, "current", "live", "new_id", "fix_id").unionByName(own.withColumn("part", F.lit(1)), allowMissingColumns=True)

    def news(batches):
        for record_id, group in groupby(_rows(batches), itemgetter("record_id")):
            head = next(group)
            if head["part"]:
                continue
            current, before = json.loads(head["current"]), None if head["live"] is None else json.loads(head["live"])
            made, warned, n = [], [], 0

            def valid():
                nonlocal n
                for e in group:
                    n += 1
                    if e["entry_id"] is None or e["type"] is None:
                        warned.append("an entry without id or type")
                    else:
                        yield _read(e)

            now, shadow = None, None
            for _, now, shadow in structure.histories(valid(), before, warned):  # noqa: B007
                pass
            now, shadow = copy.deepcopy(now), copy.deepcopy(shadow)
            reset = before is not None and n > 0 and bool(warned)
            if not n:
                made.append((head["new_id"], {"type": CREATED, "record": current, "ops": None}))
            elif before is not None and structure.same(before, current):
                continue
            else:
                if reset:
                    made.append((head["fix_id"], {"type": CREATED, "record": before, "ops": None}))
                elif before is not None and not structure.same(now, before):
                    made.append((head["fix_id"], structure.correction(now, shadow, before)))
                if before is not None:
                    now = shadow = before
                made.append((head["new_id"], structure.correction(now, shadow, current)))
            for name, e in made:
                if e is not None:
                    ops = None if e["ops"] is None else [o | {"value": json.dumps(o["value"], sort_keys=True, ensure_ascii=False) if o["op"] in ("add", "replace") else None} for o in e["ops"]]
                    yield {"record_id": record_id, "entry_id": name, "type": e["type"], "record": _text(e["record"]), "ops": ops, "reset": reset and name == head["fix_id"]}

    op = pa.struct(_strings("op", "path", "value", "position", "hash"))
    schema = pa.schema([*_strings("record_id", "entry_id"), ("type", pa.int32()), ("record", pa.string()), ("ops", pa.list_(op)), ("reset", pa.bool_())])
    return _ordered(rows, ["record_id"], F.col("part"), F.col("entry_id")).mapInArrow(lambda batches: _batches(news(batches), schema), NEWS)


def upserted(entries: DataFrame, live: DataFrame, records: DataFrame, entry_id: Column, correction_id: Column) -> DataFrame:
    """The log after an upsert of records, as ``upsert_news`` says; audits that are reset lose their other entries."""
    news = upsert_news(entries, live, records, entry_id, correction_id)
    kept = without_trail(entries, news.where("reset").select("record_id"))
    fields = {c: F.col(c) for c in ("record_id", "entry_id", "type", "record", "ops")}
    kinds = [(f.name, f.dataType.simpleString()) for f in entries.schema]  # everything may be null
    return kept.select(*[F.col(c).cast(k).alias(c) for c, k in kinds]).unionByName(news.select(*[fields.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds]))


def rebased_nested(versions: DataFrame, old: str, mine: str, theirs: str) -> DataFrame:
    """``versions`` with rebased: my changes of the JSON column ``old`` on top of ``theirs``."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if None in xs else _text(structure.rebase(*map(json.loads, xs))) for xs in zip(a, b, c)])

    return versions.withColumn("rebased", run(old, mine, theirs))


def edited(versions: DataFrame, old: str, mine: str, theirs: str) -> DataFrame:
    """What becomes of records being edited (JSON columns): ``restore?`` where theirs was deleted meanwhile, else ``current`` or ``rebased``."""
    found = rebased_nested(versions, old, mine, theirs)
    return found.withColumn("outcome", F.when(F.col(theirs).isNull(), "restore?").when(F.col(old) == F.col(theirs), "current").otherwise("rebased"))


def updates_for(state: DataFrame, current: DataFrame, entry_id: Column, columns: list[str]) -> DataFrame:
    """A corrective update (record_id, entry_id, type, paths) for each live record that differs from its replayed state."""
    joined = current.alias("c").join(state.where("live").alias("s"), "record_id")
    paths = F.array_compact(F.array(*[F.when(~F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")), F.lit(c)) for c in columns]))
    return joined.select("record_id", entry_id.alias("entry_id"), F.lit(UPDATED).alias("type"), F.array_join(paths, ",").alias("paths")).where("paths <> ''")
