import random

import pytest

from quillon.sources.store import Store
from quillon.streaming.subscriptions import SUBSCRIPTION, QuerySubscriptions, changed

RECORD = "id long, city string, kind string, x double, y double"


def answer(sub, records):
    """(total, page) by going through all records."""
    _, equal, ranges, sort, down, skip, most = sub
    place = {"id": 0, "city": 1, "kind": 2, "x": 3, "y": 4}
    found = [r for r in records.values() if all(r[place[f]] == v for f, v in (equal or {}).items()) and all(r[place[f]] is not None and (lo is None or r[place[f]] >= lo) and (hi is None or r[place[f]] <= hi) for f, lo, hi in ranges or [])]
    key = lambda r: (r[place[sort]] is None, (-r[place[sort]] if down else r[place[sort]]) if r[place[sort]] is not None else 0, r[0])
    page = [r[0] for r in sorted(found, key=key)][skip:]
    return len(found), page if most is None else page[:most]


@pytest.mark.parametrize("open_ended", [False, True])
def test_emissions_equal_running_each_query_again(spark, tmp_path, open_ended):
    rng = random.Random(3)
    number = lambda: rng.choice([None, -0.0, 0.5, *[round(rng.uniform(-50, 50), 2) for _ in range(9)]])
    record = lambda i: (i, rng.choice([None, "a", "b", "c"]), rng.choice("uvw"), number(), number())
    records = {i: record(i) for i in range(60)}
    subs = []
    for i in range(50):
        equal = rng.choice([None, {}, {"city": "a"}, {"city": "zz"}, {"kind": "u"}, {"city": "b", "kind": "v"}])
        low = rng.uniform(-50, 40)
        ranges = rng.choice([None, [], [("x", low, low + rng.choice([0.0, 0.01, 3.0, 40.0]))], [("x", None, low)], [("y", low, None), ("x", low - 20, low + 20)], [("x", low, low - 1)]])
        subs.append((i, equal, ranges, rng.choice("xy"), rng.random() < 0.5, rng.choice([0, 0, 2]), rng.choice([3, 7, None] if open_ended else [3, 7])))
    table = QuerySubscriptions(Store(spark, str(tmp_path / "s"), 4), "id", ["city", "kind"], ["x", "y"])
    frame = lambda rows: spark.createDataFrame(list(rows), RECORD)
    told = table.subscribe(spark.createDataFrame(subs, SUBSCRIPTION), frame(records.values()), 0)
    last = {s[0]: answer(s, records) for s in subs}
    assert {(r.sub_id, r.total, r.n) for r in told.collect()} == {(i, t, len(p)) for i, (t, p) in last.items()}
    for batch in range(1, 4):
        now = dict(records)
        for i in rng.sample(range(70), 8):
            if rng.random() < 0.3:
                now.pop(i, None)
            else:
                now[i] = record(i)
        before, after = changed(frame(records.values()), frame(now.values()), "id")
        told = {(r.sub_id, r.total, r.n) for r in table.take(before, after, batch).collect()}
        fresh = {s[0]: answer(s, now) for s in subs}
        assert told == {(i, t, len(p)) for i, (t, p) in fresh.items() if last[i] != (t, p)}
        assert told == {(r.sub_id, r.total, r.n) for r in table.take(before, after, batch).collect()}  # once more, the same
        pages = {}
        for r in table.page().orderBy("sub_id", "pos").collect():
            pages.setdefault(r.sub_id, []).append(r.id)
            assert r.pos == len(pages[r.sub_id])
        assert pages == {i: p for i, (_, p) in fresh.items() if p}
        records, last = now, fresh
    table.end(spark.createDataFrame([(s[0],) for s in subs[:25]], "sub_id long"), 4)
    assert {r.sub_id for r in table.store.read("subs").collect()} == {s[0] for s in subs[25:]} and table.page().where("sub_id < 25").isEmpty()


def test_records_are_compared_with_columns(spark, tmp_path):
    """What a record or a subscription asks is no map or array in the join; fields that aren't there, null values and null ends as before."""
    table = QuerySubscriptions(Store(spark, str(tmp_path / "s"), 2), "id", ["city", "kind"], ["x", "y"])
    nan = float("nan")
    records = spark.createDataFrame([(1, "a", "u", 1.0, 1.0), (2, "a", None, None, 2.0), (3, None, "v", nan, None), (4, "b", "v", -0.0, 4.0)], RECORD)
    asked = [
        ({"city": "a"}, None), ({"city": None}, None), ({"town": "a"}, None), ({"city": "a", "town": "a"}, None), (None, [("z", None, None)]), (None, [("x", None, None)]), (None, [(None, None, None)]),
        (None, [("x", 0.0, None)]), (None, [("x", None, nan)]), (None, [("x", -1.0, 5.0), ("x", None, 0.5), ("y", 3.0, None)]), ({"kind": "u", "city": "a"}, [("x", 1.0, 1.0)]), ({}, []), (None, [None]),
    ]
    found = [{1, 2}, set(), set(), set(), set(), {1, 3, 4}, set(), {1, 3, 4}, {1, 3, 4}, {4}, {1}, {1, 2, 3, 4}, set()]
    subs = spark.createDataFrame([(i, equal, ranges, sort, False, 0, 5) for i, (equal, ranges) in enumerate(asked) for sort in ["x"]], SUBSCRIPTION)
    matched = table.matches(table.indexed(subs), records)
    got = [set() for _ in asked]
    for r in matched.collect():
        assert r.id not in got[r.sub_id]
        got[r.sub_id].add(r.id)
    assert got == found
    plan = matched._jdf.queryExecution().optimizedPlan()
    joins = [x for x in str(plan).split("\n") if "Join" in x]
    assert joins and not any(word in x for x in joins for word in ("map(", "forall", "lambda"))
