import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import hashing, structure
from quillon.operators import audit

values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda x: st.dictionaries(st.text("xyz", min_size=1, max_size=1), x, max_size=3), max_leaves=6)
records = st.dictionaries(st.text("pqr", min_size=1, max_size=1), values, max_size=4)


@given(records, records)
@settings(max_examples=150, deadline=None)
def test_diff_of_objects_applies_back(old, new):
    out = json.loads(json.dumps(old))
    for op in structure.diff(old, new):
        structure.apply(out, op)
    assert structure.same(out, new)


def test_arrays():
    ops = structure.diff({"tags": ["a", "b"]}, {"tags": ["a", "c", "d"]})
    assert [(o["op"], o["path"]) for o in ops] == [("replace", "tags.1"), ("add", "tags.2")]
    assert ops[0]["hash"] == hashing.content_hash("b") and ops[1]["hash"] is None
    ops = structure.diff({"xs": [{"id": "1", "n": 1}, {"id": "2"}]}, {"xs": [{"id": "3"}, {"id": "1", "n": 2}]})
    assert [(o["op"], o["path"]) for o in ops] == [("remove", "xs.[id:2]"), ("add", "xs.[id:3]"), ("replace", "xs.[id:1].n")]
    # an anchor takes the first element with its hash
    twice = {"a": ["x", "x"]}
    for op in structure.diff(twice, {"a": ["x", "y"]}):
        structure.apply(twice, op)
    assert twice == {"a": ["y", "x"]}


def test_hash_vectors():
    assert hashing.content_hash(None) == "77074ba4360be094"
    assert hashing.canonical({"b": 1.0, "a": [None]}) == '{"a":[null],"b":1}'


SEQUENCES = [("CU", True), ("CDU", False), ("CDD", False), ("CUD", False), ("CDR", True), ("CDUU", False), ("UC", True), ("CDC", True)]


def test_replay_of_type_sequences(spark):
    rows = []
    for name, _ in SEQUENCES:
        for i, t in enumerate(name):
            kind = "CUDRB".index(t)
            ops = [{"op": "replace", "path": "v", "value": str(i), "position": None, "hash": None}] if t == "U" else None
            rows.append((name, f"{i:03d}", kind, json.dumps({"v": -1}) if t == "C" else None, ops))
    random.Random(1).shuffle(rows)
    log = spark.createDataFrame(rows, f"record_id string, entry_id string, type int, record string, ops {audit.OPS}")
    found = {r.record_id: r.live for r in audit.replay_full(log).collect()}
    assert {k: v is not None for k, v in found.items()} == dict(SEQUENCES)
    assert json.loads(found["CU"]) == {"v": 1}
    state = {r.record_id: r.is_deleted for r in audit.deleted_state(log).collect()}
    assert state["CDC"] and not state["CDR"]


def test_replay_from_a_base_and_from_the_last_snapshot(spark):
    op = lambda v: [{"op": "replace", "path": "v", "value": v, "position": None, "hash": None}]
    rows = [("a", "1", 1, None, op("1")), ("b", "1", 0, '{"v": 0}', None), ("b", "2", 1, None, op("5")), ("b", "3", 2, None, None), ("b", "4", 3, '{"w": 1}', None), ("b", "5", 1, None, op("7")), ("c", "1", 1, None, op("1"))]
    log = spark.createDataFrame(rows, f"record_id string, entry_id string, type int, record string, ops {audit.OPS}")
    base = spark.createDataFrame([("a", '{"u": 2}')], "record_id string, base string")
    found = {r.record_id: r.live and json.loads(r.live) for r in audit.replay_full(log, base).collect()}
    assert found == {"a": {"u": 2, "v": 1}, "b": {"w": 1, "v": 7}, "c": None}


def test_anchors_hold_at_the_last_two_steps():
    record = {"xs": [{"n": 1}, {"n": 2}]}
    op = structure.operation("replace", "xs.0.n", 9, hash=hashing.content_hash({"n": 2}))
    assert structure.apply(record, op) == {"xs": [{"n": 1}, {"n": 9}]}
    ops = structure.diff({"t": [1, 2, 3, 4]}, {"t": [1, 2]})
    assert [o["path"] for o in ops] == ["t.2", "t.3"]


def test_folded_hash_equals_the_plain_one(spark):
    texts = ['{"a":"x"}', "null", '"é"', "[1,2]"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.folded_hash(F.col("t")).alias("h"), F.lit("").alias("p")).collect()
    assert all(r.h == hashing.content_hash(json.loads(r.t)) for r in found)


def random_log(n: int, seed: int) -> list[tuple]:
    """Audits of all kinds of entries, with edits of whole fields, within fields and of paths that lead nowhere."""
    rng = random.Random(seed)
    value = lambda: rng.choice(["1", "null", '"x"', "[1, 2]", '{"y": 1}', '[{"id": "1", "n": 1}, {"id": "2.5"}]'])
    paths = ["a", "b", "7", "007", "a.0", "a.1", "a.y", "b.y.z", "b.[id:1]", "b.[id:1].n", "b.[id:2.5].m", "c.y", "a.", "", "b.0.n", "[id:1]", None]
    rows = []
    for record in range(n):
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice([0, 1, 1, 1, 1, 1, 1, 2, 3, 3, 4, None])
            held = json.dumps({k: json.loads(value()) for k in rng.sample(["a", "b", "7", "c"], rng.randrange(4))}) if kind == 0 and rng.random() < 0.9 or kind == 3 and rng.random() < 0.3 else None
            anchor = lambda: rng.choice([None, None, hashing.content_hash(1), hashing.content_hash(2), hashing.content_hash({"id": "1", "n": 1})])
            ops = [(rng.choice(["replace", "replace", "add", "add", "remove", "move"]), rng.choice(paths[:-1]), rng.choice([value(), None]), rng.choice([None, "FIRST"]), anchor()) for _ in range(rng.randrange(4))]
            rows.append((f"r{record}", None if rng.random() < 0.03 else f"{i:03d}", kind, held, ops if kind == 1 and rng.random() < 0.95 else None))
    rng.shuffle(rows)
    return rows


def test_replay_equals_the_plain_fold(spark):
    rows = random_log(600, 5)
    log = spark.createDataFrame([*rows, (None, "1", 0, "{}", None)], f"record_id string, entry_id string, type int, record string, ops {audit.OPS}")
    bases = {f"r{k}": {"a": [1, {"id": "1", "n": k}], "b": {"y": {}}} for k in range(0, 600, 3)}
    base = spark.createDataFrame([(k, json.dumps(v)) for k, v in bases.items()], "record_id string, base string")
    read = lambda text: None if text is None else json.loads(text)
    names = ("op", "path", "value", "position", "hash")
    entries: dict[str, list] = {}
    for record_id, entry_id, kind, record, ops in rows:
        ops = [dict(zip(names, o)) | {"value": read(o[2])} for o in ops or []]
        entries.setdefault(record_id, []).append({"entry_id": entry_id, "type": kind, "record": read(record), "ops": ops})
    for given_base, known in ((None, {}), (base, bases)):
        found = {r.record_id: (read(r.live), read(r.shadow)) for r in audit.replay_full(log, given_base).collect()}
        assert found == {k: structure.replay(es, known.get(k)) for k, es in entries.items()}
    assert sum(live is not None for live, _ in found.values()) > 100
    assert audit.replay_full(log.limit(0)).collect() == []


def test_merge_decisions(spark):
    schema = "record_id string, entry_id string, type int, ops array<int>"
    server = [("a", "1", 0, None), ("b", "1", 1, [1]), ("c", "1", 0, None), ("c", "2", 1, [1]), ("s", "1", 0, None)]
    client = [("a", "2", 1, [1]), ("b", "2", 2, None), ("c", "3", 1, [1]), ("c", "1", 0, None), ("c", "3", 1, [1]), ("n", "5", 1, []), ("n", "6", 3, None), (None, "7", 0, None)]
    server, client = (spark.createDataFrame(rows, schema) for rows in (server, client))
    # changes only: the server's audit has to be valid; a repeated entry counts once; records of the server alone have no decision
    assert {tuple(r) for r in audit.merge_decisions(server, client).collect()} == {("a", "merge"), ("b", "keep"), ("c", "merge"), ("n", "adopt")}
    news = audit.merged(server, client).select("record_id", "entry_id").exceptAll(server.select("record_id", "entry_id")).collect()
    assert sorted(map(tuple, news)) == [("a", "2"), ("c", "3"), ("n", "5"), ("n", "6")]
    assert audit.merged(server, client.limit(0)).count() == server.count() and audit.merge_decisions(server.limit(0), client).where("decision <> 'adopt'").isEmpty()
