"""Tables that change together: races, writers that stop, receivers; and upserts that reset audits."""

import json
import math
import random
import struct
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from quillon.functions import hashing
from quillon.operators import audit, receiver
from quillon.operators.filters import apply_filter
from quillon.sources.changes import Versions
from quillon.sources.store import Store

OPS = "array<struct<op: string, path: string, value: string, position: string, hash: string>>"
ENTRIES = f"record_id string, entry_id string, type int, record string, ops {OPS}"


def at_once(*works):
    threads = [threading.Thread(target=w) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()


def test_racing_versions_are_each_whole(spark, tmp_path):
    done = []
    at_once(*[lambda n=n: done.append((n, Versions(spark, (tmp_path / "t").as_uri()).write(spark.range(n)))) for n in (10, 20, 30)])
    table = Versions(spark, (tmp_path / "t").as_uri())
    assert sorted(done) == [(10, True), (20, True), (30, True)] and table.numbers() == [0, 1, 2]
    assert sorted(table.read(n).count() for n in table.numbers()) == [10, 20, 30]
    done.clear()
    at_once(*[lambda n=n: done.append((Versions(spark, (tmp_path / "t").as_uri()).write(spark.range(n), 7), n)) for n in (1, 2)])
    assert sorted(d[0] for d in done) == [False, True] and table.read().count() == max(done)[1]


class Stop(Exception):
    pass


def log_and_live(store):
    now = store.newest()[1]
    log, live = ({r.record_id for r in store.read(t, manifest=now).collect()} if t in now["tables"] else set() for t in ("log", "live"))
    return log, live


def test_log_and_live_agree_wherever_a_writer_stops(spark, tmp_path, monkeypatch):
    folder = (tmp_path / "s").as_uri()
    store = Store(spark, folder, 4)
    request = lambda *ids: spark.createDataFrame([(i, None) for i in ids], "record_id string, client_hash string")
    sent = lambda *ids: spark.createDataFrame([(i, "1", 0, json.dumps({"id": i}), None) for i in ids], ENTRIES)
    assert receiver.receive(store, request("a", "b"), sent("a", "b"), "c1", 0) and not receiver.receive(store, request("a", "b"), sent("a", "b"), "c1", 0)
    for method, calls in (("_stage", 0), ("_stage", 1), ("_stage", 2), ("_publish", 0)):
        with monkeypatch.context() as m:
            real, seen = getattr(Store, method), []

            def broken(self, *a, real=real, seen=seen, calls=calls):
                if len(seen) == calls:
                    raise Stop
                seen.append(1)
                return real(self, *a)

            m.setattr(Store, method, broken)
            with pytest.raises(Stop):
                receiver.receive(store, request("c"), sent("c"), "c1", 1)
        assert log_and_live(store) == ({"a", "b"}, {"a", "b"})
    done = []
    at_once(*[lambda n=n: done.append(receiver.receive(Store(spark, folder, 4), request(n), sent(n), n, 0)) for n in ("x", "y")])
    assert done == [True, True] and log_and_live(store) == ({"a", "b", "x", "y"},) * 2
    assert receiver.receive(store, request("c"), sent("c"), "c1", 1) and log_and_live(store)[0] == log_and_live(store)[1] == {"a", "b", "c", "x", "y"}
    store.compact("log", "record_id")
    assert log_and_live(store)[0] == {"a", "b", "c", "x", "y"} and all(len(f) == 1 for f in store.newest()[1]["tables"]["log"]["folders"].values())


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    store = Store(spark, (tmp_path / "s").as_uri(), 16)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), F.lit("{}").alias("live"), F.lit("h").alias("hash"))
    store.commit(lambda now: {"live": ("replace", "record_id", rows, list(range(16)))})
    before = store.newest()[1]["tables"]["live"]["folders"]
    receiver.receive(store, spark.createDataFrame([("5", None)], "record_id string, client_hash string"), spark.createDataFrame([("5", "1", 0, '{"id": "5"}', None)], ENTRIES), "c", 0)
    after = store.newest()[1]["tables"]["live"]["folders"]
    assert [b for b in after if after[b] != before[b]] == [str(b) for b in store.touched(rows.where("record_id = '5'").select("record_id"))]
    assert store.read("live").count() == 1000


def test_entry_names(spark):
    assert "rc_log" in entry.queries() and "rc_log" in entry.oracle_sql()


def test_upserts_of_odd_audits(spark):
    op = lambda path, value: [("replace", path, value, None, None)]
    rows = [("a", "1", 0, '{"id": "a", "x": 1}', None), ("a", None, 1, None, op("x", "2")), ("b", "1", 4, None, None), ("b", "2", 1, None, op("x", "1")), ("c", "1", 1, None, op("x", "2")), ("d", "1", 0, None, None)]
    live = spark.createDataFrame([("a", '{"id": "a", "x": 1}'), ("b", '{"id": "b", "x": 1}'), ("d", '{"id": "d"}')], "record_id string, live string")
    records = spark.createDataFrame([(i, json.dumps({"id": i, "x": 5})) for i in "abcde"], "record_id string, current string")
    news = audit.upsert_news(spark.createDataFrame(rows, ENTRIES), live, records, F.lit("9"), F.lit("8")).collect()
    assert sorted((r.record_id, r.entry_id, r.type, r.reset) for r in news) == [("a", "8", 0, True), ("a", "9", 1, False), ("b", "9", 1, False), ("c", "9", 0, False), ("d", "8", 0, True), ("d", "9", 1, False), ("e", "9", 0, False)]
    assert audit.upsert_news(spark.createDataFrame(rows, ENTRIES), live, live.select("record_id", F.col("live").alias("current")), F.lit("9"), F.lit("8")).count() == 0


def test_unlike_types_match_nothing(spark):
    df = spark.createDataFrame([(1, [1, 2], True, ["a"], "t", {"k": 1})], "id long, nums array<long>, flag boolean, tags array<string>, name string, deep struct<k: long>")
    for odd in ({"nums": {"$all": ["a"]}}, {"id": {"$in": [True]}}, {"flag": {"$in": [1]}}, {"flag": 1}, {"tags": ["a"]}, {"tags": "a"}, {"nums": {"$size": "x"}}, {"gone": 1}, {"gone": {"$size": 1}}, {"gone": {"$elemMatch": {"x": 1}}},
                {"gone.deeper": {"$gt": 1}}, {"gone": {"$all": [1]}}, {"name": {"$gt": 5}}, {"deep": 1}, {"deep": {"k": "1"}}, {"deep.z": 1}, {"id": {"$elemMatch": {"x": 1}}}, {"name": {"$size": 1}}, {"id": {"$like": 5}}, {"tags": {"$like": "%a%"}}, {"gone": {"$exists": True}}, {"tags": {"$elemMatch": {"$gt": 1}}}):
        assert apply_filter(df, odd).count() == 0, odd
    for good in ({"gone": None}, {"gone": {"$exists": False}}, {"nums": {"$all": [1]}}, {"nums": {"$size": 2}}, {"flag": True}, {"deep": {"k": 1}}, {"id": {"$in": [True, 1]}}, {"tags": {"$elemMatch": {"$eq": "a"}}}):
        assert apply_filter(df, good).count() == 1, good


def test_variant_fields(spark):
    df = spark.createDataFrame([(1, '{"a": 5, "b": null, "it\'s": "x", "d": {"e": [1]}}'), (2, '{"a": "5", "b": 1.5}'), (3, None)], "id int, j string").select("id", F.parse_json("j").alias("rest"))
    ids = lambda f: [r.id for r in apply_filter(df, f, undeclared="rest").orderBy("id").collect()]
    assert ids({"a": 5}) == [1] and ids({"a": "5"}) == [2] and ids({"a": {"$in": [5, "5"]}}) == [1, 2] and ids({"b": None}) == [1, 3] and ids({"b": {"$gt": 1}}) == [2]
    assert ids({"it's": "x"}) == [1] and ids({"a": {"$regex": "^5"}}) == [2] and ids({"d.e": 1}) == [] and ids({"id": 3}) == [3]


def leaf():
    numbers = st.integers(-(10**15), 10**15).flatmap(lambda n: st.integers(-30, 30).map(lambda e: float(f"{n}e{e}")))
    return st.tuples(numbers | st.none(), st.text(max_size=6), st.lists(st.none() | st.booleans(), max_size=2))


@given(st.lists(leaf(), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_canonical_json_is_one_and_the_same(spark, rows):
    rows = [(n, t.encode("utf-8", "ignore").decode(), f, (n, None)) for n, t, f in rows] + [(-0.0, "\x0b\x1f\\u000B\"\n\U0001f642", [], (1e21, None)), (123456789.5, "\x7f", [True], (5e-7, 1))]
    kind = T._parse_datatype_string("n double, t string, f array<boolean>, s struct<z: double, a: int>")
    df = spark.createDataFrame(rows, kind)
    text = hashing.record_json(df, df.columns)
    for r in df.select("*", text.alias("j"), hashing.folded_hash(text).alias("h")).collect():
        value = {"n": r.n, "t": r.t, "f": r.f, "s": {"z": r.s.z, "a": r.s.a}}
        assert r.j == hashing.canonical(value) and r.h == hashing.content_hash(value)


def test_numbers_of_many_digits_have_their_shortest_ones(spark):
    draw = random.Random(5)
    some = [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(20_000)] + [draw.uniform(0, 1e4) for _ in range(20_000)]
    numbers = [x for x in some if math.isfinite(x)] + [2.0**-44, 2e23, 8.41e21, 5e-324, 1e-323, -1.6130484589462314e17, -0.0]
    df = spark.createDataFrame([(x, [x]) for x in numbers], "x double, a array<double>")
    for r in df.select("x", hashing.record_json(df, ["x", "a"]).alias("j")).collect():
        assert r.j == hashing.canonical({"x": r.x, "a": [r.x]})


def test_claims_of_a_request_are_hashed_without_python(spark, monkeypatch):
    """Only the receiver, which hashes any record, has a Python task for it: once a batch."""
    calls, own = [], hashing.json_hashes
    monkeypatch.setattr(hashing, "json_hashes", lambda column: calls.append(column) or own(column))
    assert entry.queries()["rc_live"](spark, "/root/testdata/sf0.001").count() > 0
    assert calls == ["live", "live"]
