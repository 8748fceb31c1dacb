import random

from pyspark.sql import functions as F

from quillon.operators.collection import Collection, Registry
from quillon.sources.changes import Versions, change_stream, seed_hash
from quillon.sources.store import Store
from quillon.streaming.live import Debouncer, LiveQuery, Subscriptions, batches, debounced, deliver, notices


def test_stream_equals_batch(spark, tmp_path):
    rows = [("c", "insert", 1, 0), ("c", "insert", 2, 5), ("c", "insert", 3, 90), ("c", "delete", 4, 7)]
    df = spark.createDataFrame(rows, "collection string, op string, seq long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = debounced(change_stream(spark, str(tmp_path / "in"), df.schema), "20 seconds", "1 second")
    stream.writeStream.format("memory").queryName("debounced").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = {tuple(r) for r in debounced(df, "20 seconds").collect()}
    assert {tuple(r) for r in spark.table("debounced").collect()} == batch and len(batch) == 3


def test_live_query_calls_only_on_change(spark, tmp_path):
    seen, data = [], [spark.createDataFrame([(0, 1), (1, 2)], "pos int, id int")]
    live = LiveQuery(lambda: data[0], lambda df: seen.append(df.count()))
    live.refresh()
    live.refresh()
    data[0] = spark.createDataFrame([(0, 2)], "pos int, id int")
    live.refresh()
    assert seen == [2, 1]


def test_windows_keep_the_last_record_of_each_id(spark, tmp_path):
    rows = [("c", "update", 1, 0, 1, "a"), ("c", "update", 1, 15, 2, "b"), ("c", "update", 2, 34, 3, "x"), ("c", "update", 1, 54, 4, "c"), ("c", "insert", 1, 16, 5, "n"), ("c", "delete", 7, 30, 6, None), ("d", "update", 1, 20, 7, "d")]
    df = spark.createDataFrame(rows, "collection string, op string, id int, s long, seq long, name string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    found = {(r.collection, r.op, r.id, r.n_changes, r.name, r.begin.timestamp(), r.end.timestamp()) for r in batches(df, 20).collect()}
    # a gap of exactly 20 seconds ends a window
    assert found == {("c", "update", 1, 2, "b", 0.0, 54.0), ("c", "update", 2, 1, "x", 0.0, 54.0), ("c", "update", 1, 1, "c", 54.0, 74.0), ("c", "insert", 1, 1, "n", 16.0, 36.0), ("c", "delete", 7, 1, None, 30.0, 50.0), ("d", "update", 1, 1, "d", 20.0, 40.0)}
    df.write.parquet(str(tmp_path / "in"))
    registry, told = Registry(), []
    registry.define(Collection("c", df))
    registry.extend("c", on_after_upsert=lambda new, old: told.append(("hook", new.count(), old.count())), on_after_delete=lambda ids: told.append(("gone", ids.count())))
    deliver(change_stream(spark, str(tmp_path / "in"), df.schema), 20, registry, [lambda name, b: told.append((name, b.count()))], str(tmp_path / "cp")).awaitTermination()
    assert told[-3:] == [("hook", 1, 3), ("gone", 1), ("c", 5)] or told == [("hook", 1, 3), ("gone", 1), ("c", 5), ("d", 1)]


def test_versions_replace_a_table_at_once(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and table.write(spark.range(3)) and table.write(spark.range(5))
    (tmp_path / "t/data/half").mkdir()  # a writer that stopped half-way
    assert table.read().count() == 5 and not table.write(spark.range(9), number=1) and table.write(spark.range(7), number=2) and table.read().count() == 7
    table.keep(1)
    assert table.numbers() == [2]
    table.drop()
    assert table.read() is None


def test_answers_are_told_once(spark):
    told, known = [], Subscriptions()
    assert known.tell("q", (3, "h"), told.append) and not known.tell("q", (3, "h"), told.append) and known.tell("q", (4, "h"), told.append)
    known.end("q")
    assert known.tell("q", (4, "h"), told.append) and told == [(3, "h"), (4, "h"), (4, "h")]
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert seed_hash(a) == seed_hash(a.orderBy(F.desc("id"))) != seed_hash(a.where("id = 1"))


def test_disabled_and_same_results(spark):
    seen, same = [], []
    live = LiveQuery(lambda: spark.createDataFrame([(0, 1)], "pos int, id int"), lambda df: seen.append(df.count()), on_same=lambda: same.append(1), default=spark.range(0))
    live.refresh()
    live.refresh()
    live.disabled = True
    live.refresh()
    assert seen == [1, 0] and same == [1]


def test_notices_of_own_changes(spark):
    events = spark.createDataFrame([("upsert", [1]), ("upsert", []), ("remove", [2]), ("clear", [3, 4]), ("clear", []), ("clear", None), ("reload", [5]), (None, [6])], "type string, ids array<int>")
    assert sorted((r.type, r.ids) for r in notices(events).collect()) == [("remove", [2]), ("remove", [3, 4]), ("upsert", []), ("upsert", [1])]


def test_windows_stay_open_across_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    steps = [0.0001, 0.2, 0.2499, 0.25, 0.2501, 0.6]
    at, rows = 1_700_000_000.0, []
    for i in range(160):
        at += rng.choice(steps)
        rows.append((rng.choice("ab"), rng.choice(["insert", "update"]), rng.randrange(5), round(at * 1e6), i, f"v{i}"))
    df = spark.createDataFrame(rows, "collection string, op string, id int, us long, seq long, name string").withColumn("ts", F.timestamp_micros("us")).drop("us").cache()
    want = sorted(map(tuple, batches(df, 0.25).collect()), key=str)
    for case, cuts in enumerate([[160], [1, 2, 3, 90, 160], [40, 80, 120, 160]]):
        table, found, start = Debouncer(Store(spark, str(tmp_path / f"s{case}"), 3), 0.25), [], 0
        for n, end in enumerate(cuts):
            part = df.where(f"seq >= {start} and seq < {end}")
            told = [tuple(r) for r in table.take(part, n).collect()]
            if n == 1:  # a repeated micro-batch tells the same and changes nothing
                assert sorted(told, key=str) == sorted((tuple(r) for r in table.take(part, n).collect()), key=str)
            found, start = found + told, end
        found += [tuple(r) for r in table.flush(len(cuts)).collect()]
        assert sorted(found, key=str) == want
    # out of order within the delay: odd changes come a micro-batch of 20 later
    table, found = Debouncer(Store(spark, str(tmp_path / "late"), 3), 0.25, delay=60), []
    for n in range(5):
        part = df.where(f"seq % 2 = 0 and seq div 40 = {n} or seq % 2 = 1 and seq div 40 = {n - 1}")
        found += [tuple(r) for r in table.take(part, n).collect()]
    assert sorted(found + [tuple(r) for r in table.flush(5).collect()], key=str) == want


def test_a_delivered_stream_keeps_windows_open(spark, tmp_path):
    rows = [("c", "update", i % 3, i * 5, i) for i in range(12)]
    df = spark.createDataFrame(rows, "collection string, op string, id int, s long, seq long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for k in range(4):
        df.where(f"seq div 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    registry, told = Registry(), []
    registry.define(Collection("c", df))
    windows = Debouncer(Store(spark, str(tmp_path / "s"), 3), 20)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deliver(stream, 20, registry, [lambda name, b: told.append(b.count())], str(tmp_path / "cp"), windows).awaitTermination()
    assert told == []
    assert {(r.id, r.n_changes, r.seq) for r in windows.flush(99).collect()} == {(0, 4, 9), (1, 4, 10), (2, 4, 11)}
