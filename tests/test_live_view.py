"""Live records kept up from the log: any cut of it into batches gives the same, and only what is touched is read."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import structure
from quillon.operators import live_view
from quillon.operators.receiver import LOG
from quillon.sources.store import Store


def op(name, path, value=None, position=None):
    return (name, path, None if value is None else json.dumps(value), position, None)


def history(rng, record_id, size):
    """Entries of one record: creations, edits of fields and within them, deletes, restores with and without a record, branches."""
    rows = []
    for n in range(size):
        kind = rng.choice([0, 1, 1, 1, 1, 2, 3, 3, 4])
        record = json.dumps({"id": record_id, "n": n, "tags": [1, 2]}) if kind == 0 or kind == 3 and rng.random() < 0.5 else None
        ops = [rng.choice([op("replace", "n", n), op("add", "tags.1", n), op("remove", "tags.0"), op("replace", "in.x", n), op("add", "in", {"x": 0}), op("remove", "n")])] if kind == 1 else None
        rows.append((record_id, f"{n:04d}", kind, record, ops))
    return rows


def expected(rows):
    out = {}
    for record_id in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == record_id}
        entries = [{"entry_id": e, "type": k, "record": record and json.loads(record), "ops": [dict(zip(("op", "path", "value", "position", "hash"), o)) | {"value": o[2] and json.loads(o[2])} for o in ops or []]} for _, e, k, record, ops in mine.values()]
        live, _ = structure.replay(entries)
        if live is not None:
            out[record_id] = live
    return out


def kept(store):
    return {r.record_id: json.loads(r.live) for r in live_view.view(store).collect()}


def test_any_cut_and_order_of_batches_equals_a_replay_of_the_whole_log(spark, tmp_path):
    rng = random.Random(5)
    rows = [r for n in range(12) for r in history(rng, f"r{n}", 25)]
    cut = [[], [], []]
    for r in rows:  # half in order, half in batches at random, some of them twice
        home = int(r[1]) * 3 // 25 if int(r[0][1:]) < 6 else rng.randrange(3)
        cut[home].append(r)
        if rng.random() < 0.2:
            cut[rng.randrange(home, 3)].append(r)
    store, seen, before = Store(spark, (tmp_path / "v").as_uri(), 4), [], {}
    for n, part in enumerate(cut):
        assert live_view.applied(store, spark.createDataFrame(part, LOG), "s", n) and not live_view.applied(store, spark.createDataFrame(part, LOG), "s", n)
        seen += part
        now = expected(seen)
        assert kept(store) == now
        told = {r.record_id: (r.op, r.before and json.loads(r.before), r.after and json.loads(r.after)) for r in store.read("changes").collect()}
        differ = {i for i in before.keys() | now.keys() if before.get(i) != now.get(i)}
        assert told == {i: ("insert" if i not in before else "delete" if i not in now else "update", before.get(i), now.get(i)) for i in differ}
        before = now
    assert store.read("log").count() == len(set(r[:2] for r in rows))
    assert sorted(live_view.rebuilt(store).collect()) == sorted(store.read("heads").collect())


def test_a_batch_in_order_reads_no_log_and_a_late_one_its_records_buckets(spark, tmp_path, monkeypatch):
    store = Store(spark, (tmp_path / "v").as_uri(), 16)
    rows = [(f"r{i}", f"{n:04d}", 0 if n == 0 else 1, json.dumps({"id": i}) if n == 0 else None, [op("replace", "n", n)] if n else None) for i in range(100) for n in range(1, 200, 2) for n in ([0] if n == 1 else []) + [n]]
    live_view.applied(store, spark.createDataFrame(rows, LOG))
    read, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, buckets=None, manifest=None: read.append((name, list(buckets))) or real(self, name, buckets, manifest))
    live_view.applied(store, spark.createDataFrame([(f"r{i}", "0900", 1, None, [op("replace", "n", -1)]) for i in range(100)], LOG))
    assert [name for name, _ in read] == ["heads"]  # all records touched, a hundredth of the log new
    folders = {t: store.newest()[1]["tables"][t]["folders"] for t in ("log", "heads")}
    size = lambda t: sum(p.stat().st_size for fs in folders[t].values() for f in fs for p in (tmp_path / "v" / f).glob("*.parquet"))
    entries = lambda t: real(store, t).count()
    assert entries("heads") < 0.05 * entries("log") and size("heads") > 0
    read.clear()
    live_view.applied(store, spark.createDataFrame([("r7", "0002", 1, None, [op("replace", "late", True)])], LOG))
    home = store.touched(spark.createDataFrame([("r7",)], "id string"))
    assert read == [("heads", home), ("log", home)] and len(home) == 1
    monkeypatch.undo()
    ids = spark.createDataFrame([("r7",), ("r7",), ("none",), (None,)], "id string")
    assert [(r.record_id, json.loads(r.live)) for r in live_view.view(store, ids=ids).collect()] == [("r7", {"id": 7, "n": -1, "late": True})]


def test_entries_without_a_place_empty_batches_and_other_columns(spark, tmp_path):
    store = Store(spark, (tmp_path / "v").as_uri(), 4)
    assert live_view.view(store) is None
    live_view.applied(store, spark.createDataFrame([], LOG))
    assert kept(store) == {}
    rows = [("a", "1", 0, '{"id": "a", "x": 1}', None), (None, "1", 0, "{}", None), ("a", None, 2, None, None), ("a", "3", None, None, None), ("b", "1", 1, None, [op("replace", "x", 1)])]
    clashing = spark.createDataFrame(rows, LOG).withColumns({"shadow": F.lit("?"), "late": F.lit(True), "last_id": F.lit("9"), "_bucket": F.lit(1)})
    live_view.applied(store, clashing)
    live_view.applied(store, spark.createDataFrame([], LOG))
    assert kept(store) == {"a": {"id": "a", "x": 1}} and store.read("log").count() == 2
    assert [tuple(r) for r in live_view.view(store, "x int, id string").collect()] == [("a", 1, "a")]


class Stop(Exception):
    pass


def test_a_stream_starts_again_after_a_stop(spark, tmp_path, monkeypatch):
    folder, source = (tmp_path / "v").as_uri(), tmp_path / "in"
    rows = history(random.Random(3), "a", 30) + history(random.Random(4), "b", 30)
    for n in range(3):
        spark.createDataFrame(rows[n::3], LOG).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
        return stream.writeStream.foreachBatch(live_view.keeping(folder, 4, "in")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    real, calls = Store._publish, []

    def publish(self, number, manifest):
        calls.append(number)
        done = real(self, number, manifest)
        if len(calls) == 2:
            raise Stop  # published, but the stream doesn't know
        return done

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", publish)
        with pytest.raises(Exception):
            run()
    run()
    store = Store(spark, folder, 4)
    assert kept(store) == expected(rows) and store.read("log").count() == 60 and store.numbers() == [0, 1, 2]


def test_arrivals_are_ordered_once(spark, monkeypatch):
    """The batches are read from what was written once, not made of the whole log each."""
    read, own = [], live_view.applied
    monkeypatch.setattr(live_view, "applied", lambda store, entries, *rest: read.extend(entries.inputFiles()) or own(store, entries, *rest))
    assert entry.queries()["lv_live"](spark, "/root/testdata/sf0.001").count() > 0
    assert read and not [f for f in read if f.endswith("events.parquet")]
