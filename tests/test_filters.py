import datetime
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators.collection import Collection, Registry, Request, numbered
from quillon.operators.filters import MISSING, Compiler


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 3.0, ["a", "b"], {"n": 1}, datetime.datetime(2020, 1, 1)), (2, "bob", None, ["a", "a"], {"n": 2}, None), (3, None, -1.0, [], None, datetime.datetime(2021, 5, 5)), (4, "50%_x", 3.0, None, {"n": None}, datetime.datetime(2022, 1, 1))]
    return spark.createDataFrame(rows, "id int, name string, x double, tags array<string>, meta struct<n: int>, at timestamp_ntz")


CASES = [
    ({}, [1, 2, 3, 4]), ({"name": MISSING}, [1, 2, 3, 4]), ({"x": 3.0}, [1, 4]), ({"x": {"$ne": 3}}, [3]), ({"x": None}, [2]), ({"x": {"$exists": False}}, [2]),
    ({"x": {"$gt": -2, "$lt": 3}}, [3]), ({"x": "3"}, []), ({"name": {"$like": "B%"}}, [2]), ({"name": {"$beginsWith": "50%_"}}, [4]), ({"name": {"$endsWith": "N"}}, [1]),
    ({"id": [1, 9]}, [1]), ({"id": {"$in": []}}, []), ({"id": {"$nin": []}}, [1, 2, 3, 4]), ({"id": {"$ni": [1, 2]}}, [3, 4]), ({"name": {"$regex": "^[a-z]"}}, [2]), ({"name": {"$regex": re.compile("ANN", re.I)}}, [1]),
    ({"name": {"$regex": "["}}, []), ({"name": {"$regex": "(?<first>A)n"}}, [1]), ({"name": {"$regex": r"^\p{Lu}"}}, [1]), ({"name": {"$regex": "(?P<n>A)"}}, []), ({"name": {"$regex": re.compile("(?P<n>b)o")}}, [2]), ({"tags": {"$all": ["a", "b"]}}, [1]), ({"tags": {"$all": []}}, [1, 2, 3, 4]), ({"tags": {"$size": 2}}, [1, 2]), ({"tags": {"$elemMatch": {"$eq": "b"}}}, [1]),
    ({"meta": {"n": {"$gte": 2}}}, [2]), ({"meta.n": 1}, [1]), ({"$or": [{"id": 1}, {"id": 3}]}, [1, 3]), ({"$or": [{}, {"id": 1}]}, [1, 2, 3, 4]), ({"$or": []}, [1, 2, 3, 4]), ({"$and": [{"x": 3.0}, {"id": {"$gt": 1}}]}, [4]),
    ({"at": {"$gte": datetime.datetime(2021, 1, 1)}}, [3, 4]),
]


@pytest.mark.parametrize("filters,ids", CASES)
def test_filters_select_rows(people, filters, ids):
    assert sorted(r.id for r in Collection("people", people).matching(filters).collect()) == ids


def test_unknown_operator_raises_unless_compat(people):
    with pytest.raises(ValueError):
        Compiler(people.schema).compile({"x": {"$odd": 1}})
    assert Compiler(people.schema, compat=True).compile({"x": {"$odd": 1}}) is None


def test_pages_totals_and_ties(people):
    page, total = Collection("people", people).query(Request({"id": {"$lte": 4}}, [("x", "desc")], limit=2, offset=1))
    assert [r.id for r in page.collect()] == [4, 3]
    assert total.first().total == 4


def test_distinct_upsert_and_order(people):
    found = Collection("people", people)
    assert {r.value for r in found.distinct_values("x", sorts="id").collect()} == {3.0, -1.0, None}
    assert sorted(r.id for r in found.distinct_records("x").collect()) == [1, 2, 3]
    changed = people.where("id = 1").withColumn("name", F.lit("new"))
    assert {r.id: r.name for r in found.upsert(changed).collect()}[1] == "new"
    assert [r.id for r in found.get([3, 1, 99], ordered=True).collect()] == [3, 1]
    assert "TakeOrderedAndProject" in found.query(Request(sorts="x", limit=1))[0]._jdf.queryExecution().executedPlan().toString()


def test_news_and_synchronised_writes(people):
    found = Collection("people", people)
    changed = people.where("id in (1, 2)").withColumn("name", F.when(F.col("id") == 2, "Bob").otherwise(F.col("name"))).unionByName(people.where("id = 3").withColumn("id", F.lit(9)))
    assert sorted(r.id for r in found.news(changed).collect()) == [2, 9]
    batch = changed.unionByName(people.where("id = 4").withColumn("id", F.lit(None).cast("int")))
    now, results = found.synchronised(batch, people.where("id in (1, 3)").select("id"), F.col("id") != 9)
    assert sorted((r.id, r.name) for r in now.collect()) == [(2, "Bob"), (4, "50%_x")]
    assert {(r.id, r.error) for r in results.collect()} == {(1, None), (2, None), (3, None), (9, "not valid"), (None, "no id")}


def test_hooks_merge_and_run_in_order(people):
    registry, told = Registry(), []
    registry.define(Collection("people", people))
    registry.extend("people", on_query=lambda r: Request({"$and": [r.filters or {}, {"id": {"$gt": 1}}]}))
    registry.extend("people", on_after_upsert=lambda new, old: told.append(("upsert", new.count(), old.count())), on_after_delete=lambda ids: told.append(("delete", [r.id for r in ids.collect()])))
    registry.extend("people", on_seed=lambda: people.where("id = 1").withColumn("id", F.lit(50)))
    assert sorted(r.id for r in registry["people"].matching({"x": 3.0}).collect()) == [4] and registry.seeded("people").count() == 5
    registry.after("people", people.sparkSession.createDataFrame([("insert", 1), ("update", 2), ("update", 3), ("delete", 4)], "op string, id int"))
    assert told == [("upsert", 1, 2), ("delete", [4])]


def test_numbered_follows_the_whole_order(spark):
    rows = [(i * 7919 % 1000, i % 3, "x", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, at int, row string, `part.a` int").repartition(7)
    found = numbered(df, [("at", "desc"), "k"], "pos")
    assert found.columns == [*df.columns, "pos"]
    assert [r.k for r in sorted(found.collect(), key=lambda r: r.pos)] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.pos for r in found.collect()) == list(range(1, 1001))
    again = numbered(found, [("pos", "desc")], "pos")
    assert again.columns == found.columns and again.where("pos = 1").first().k == found.where("pos = 1000").first().k
    assert numbered(df.limit(0), "k", "pos").collect() == []
