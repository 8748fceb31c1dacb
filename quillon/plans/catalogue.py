"""The named queries of the library and the SQL that each must equal, on the shared test tables.

The audit log is made of ``events``: one entry per event, the user as record, the event id as entry id; sign-up creates, view and
click update ``value`` and ``k``, error deletes, purchase restores.
"""

from __future__ import annotations

from datetime import datetime


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.operators import audit, live_view, receiver, sync
from quillon.operators.collection import Collection, Request, numbered
from quillon.operators.filters import apply_filter
from quillon.sources import changes as sources
from quillon.sources.store import Store, new_folder
from quillon.streaming import dispatcher, live, subscriptions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    ids = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "documents": "doc_id"}
    return Collection(name, table(spark, sf_dir, name), ids[name])


def filtered(name: str, source: str, filters: dict, columns: list[str], where: str) -> None:
    """A filter query over a whole collection, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return collection(spark, sf_dir, source).matching(filters).select(*columns)

    QUERIES[name], ORACLES[name] = run, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}"


CUSTOMER = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
filtered("f_eq", "customer", {"c_mktsegment": "BUILDING", "c_nationkey": {"$eq": 5}}, CUSTOMER, "c_mktsegment = 'BUILDING' AND c_nationkey = 5")
filtered("f_ne", "customer", {"c_mktsegment": {"$ne": "BUILDING"}}, CUSTOMER, "c_mktsegment <> 'BUILDING'")
filtered("f_range", "orders", {"o_totalprice": {"$gt": 1000, "$lte": 200000}, "o_custkey": {"$gte": 10, "$lt": 900}}, ["o_orderkey", "o_totalprice"], "o_totalprice > 1000 AND o_totalprice <= 200000 AND o_custkey >= 10 AND o_custkey < 900")
filtered("f_in", "customer", {"c_nationkey": [1, 2, 3], "c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, CUSTOMER, "c_nationkey IN (1, 2, 3) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
filtered("f_nin", "customer", {"c_nationkey": {"$nin": [1, 2, 3]}, "c_mktsegment": {"$ni": []}}, CUSTOMER, "c_nationkey NOT IN (1, 2, 3)")
filtered("f_and", "customer", {"$and": [{"c_acctbal": {"$gt": 0}}, {"c_nationkey": {"$lt": 20}}], "c_mktsegment": "BUILDING"}, CUSTOMER, "c_acctbal > 0 AND c_nationkey < 20 AND c_mktsegment = 'BUILDING'")
filtered("f_or", "customer", {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_nationkey": 7, "c_mktsegment": "BUILDING"}]}, CUSTOMER, "c_acctbal < 0 OR (c_nationkey = 7 AND c_mktsegment = 'BUILDING')")
filtered("f_date", "orders", {"o_orderdate": {"$gte": datetime(1995, 1, 1), "$lt": datetime(1997, 1, 1)}}, ["o_orderkey", "o_orderdate"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
filtered("f_like", "part", {"p_name": {"$like": "%A%e%"}}, ["p_partkey", "p_name"], "p_name ILIKE '%A%e%'")
filtered("f_begins", "part", {"p_type": {"$beginsWith": "s"}}, ["p_partkey", "p_type"], "p_type ILIKE 's%'")
filtered("f_ends", "part", {"p_brand": {"$endsWith": "3"}}, ["p_partkey", "p_brand"], "p_brand ILIKE '%3'")



@query(r"SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_name, '(?P<odd>0[13579]+)$') OR regexp_matches(c_mktsegment, '^\p{Lu}U')")
def f_regex(spark, sf_dir):
    wanted = [{"c_name": {"$regex": "(?<odd>0[13579]+)$"}}, {"c_mktsegment": {"$regex": r"^\p{Lu}U"}}, {"c_name": {"$regex": "(?P<odd>0"}}, {"c_name": {"$regex": "["}}]
    return collection(spark, sf_dir, "customer").matching({"$or": wanted}).select("c_custkey", "c_name", "c_mktsegment")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls: the test tables have none of their own."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


SPARSE = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


@query(f"SELECT * FROM ({SPARSE}) WHERE segment IS NULL")
def f_null(spark, sf_dir):
    return Collection("sparse", sparse(spark, sf_dir), "c_custkey").matching({"segment": None})


@query(f"SELECT * FROM ({SPARSE}) WHERE segment IS NOT NULL")
def f_exists(spark, sf_dir):
    return Collection("sparse", sparse(spark, sf_dir), "c_custkey").matching({"segment": {"$exists": True}})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 3 AND event_type = 'click'")
def f_nested(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))
    return Collection("events", events, "event_id").matching({"props": {"k": {"$gt": 3}}, "event_type": "click"}).select("event_id", F.col("props.k").alias("k"))


MIXED = "CASE WHEN event_id % 5 = 0 THEN json_object('k', event_type) WHEN event_id % 7 = 0 THEN json_object('k', event_id % 2 = 0) WHEN event_id % 11 = 0 THEN json_object('in', json_object('k', value)) ELSE props::JSON END"


@query(f"""WITH e AS (SELECT event_id, {MIXED} AS x FROM events)
    SELECT event_id, json_extract(x, '$.k')::VARCHAR AS k FROM e WHERE json_extract_string(x, '$.k') = 'click' AND json_type(x, '$.k') = 'VARCHAR' OR json_type(x, '$.k') IN ('UBIGINT', 'BIGINT') AND (json_extract(x, '$.k')::BIGINT > 60 OR json_extract(x, '$.k')::BIGINT IN (3, 5))
        OR json_type(x, '$.k') = 'BOOLEAN' AND json_extract(x, '$.k')::BOOLEAN OR json_extract(x, '$.in.k')::DOUBLE > 50""")
def f_variant(spark, sf_dir):
    """Fields without a declared type, of mixed types; comparisons of unlike types and of missing fields match nothing."""
    e = F.col("event_id")
    mixed = F.when(e % 5 == 0, F.to_json(F.struct(F.col("event_type").alias("k")))).when(e % 7 == 0, F.to_json(F.struct((e % 2 == 0).alias("k")))).when(e % 11 == 0, F.to_json(F.struct(F.struct(F.col("value").alias("k")).alias("in")))).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json(mixed).alias("rest"))
    wanted = [{"k": "click"}, {"k": {"$gt": 60}}, {"k": [3, 5]}, {"k": True}, {"in.k": {"$gt": 50}}, {"in": {"k": "50"}}, {"other": {"$gte": 0}}, {"k": {"$size": 1}}, {"event_id": "1"}]
    return apply_filter(events, {"$or": wanted}, undeclared="rest").select("event_id", F.to_json(F.variant_get("rest", "$.k", "variant")).alias("k"))


def flagged(spark, sf_dir) -> Collection:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"), F.collect_list(F.struct("l_quantity", "l_linestatus")).alias("lines"))
    return Collection("flagged", lines, "l_orderkey")


@query("SELECT l_orderkey, len(list(l_returnflag)) AS n FROM lineitem GROUP BY l_orderkey HAVING list_has_all(list(l_returnflag), ['A', 'R'])")
def f_all(spark, sf_dir):
    return flagged(spark, sf_dir).matching({"flags": {"$all": ["A", "R"]}}).select("l_orderkey", F.size("flags").cast("long").alias("n"))


@query("SELECT l_orderkey, list_sort(list(l_returnflag))::VARCHAR[] AS flags FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3")
def f_size(spark, sf_dir):
    return flagged(spark, sf_dir).matching({"flags": {"$size": 3}}).select("l_orderkey", "flags")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_linestatus = 'F'")
def f_elem(spark, sf_dir):
    return flagged(spark, sf_dir).matching({"lines": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_linestatus": "F"}}}).select("l_orderkey")


# Queries

PAGE = Request({"o_orderstatus": "O", "o_totalprice": {"$gt": 5000}}, [("o_totalprice", "desc")], limit=50, offset=20)


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 5000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20")
def query_page(spark, sf_dir):
    return collection(spark, sf_dir, "orders").query(PAGE)[0]


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 5000")
def q_total(spark, sf_dir):
    return collection(spark, sf_dir, "orders").query(PAGE)[1]


@query("SELECT *, row_number() OVER (ORDER BY segment ASC NULLS FIRST, c_custkey DESC) AS pos FROM (SELECT * FROM (" + SPARSE + ") ORDER BY segment ASC NULLS FIRST, c_custkey DESC LIMIT 40)")
def sort_multi(spark, sf_dir):
    page, _ = Collection("sparse", sparse(spark, sf_dir), "c_custkey").query(Request(sorts=["segment", ("c_custkey", "desc")], limit=40))
    return page.withColumn("pos", F.row_number().over(Window.orderBy(F.col("segment").asc_nulls_first(), F.col("c_custkey").desc())).cast("long"))


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def page(spark, sf_dir):
    return collection(spark, sf_dir, "customer").query(Request(sorts="c_custkey", limit=25, offset=50))[0]


@query("SELECT * FROM customer ORDER BY c_custkey")
def table_request(spark, sf_dir):
    return collection(spark, sf_dir, "customer").table_request()[0]


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def find_first(spark, sf_dir):
    return collection(spark, sf_dir, "orders").find({"o_orderstatus": "F"})


@query("SELECT * FROM customer")
def get_all(spark, sf_dir):
    return collection(spark, sf_dir, "customer").get_all()


@query("SELECT count(*) AS total FROM customer")
def count_all(spark, sf_dir):
    return collection(spark, sf_dir, "customer").count()


@query("SELECT CAST(pos AS INT) AS pos, c_custkey, c_name FROM (VALUES (0, 9), (1, 3), (2, 7)) w(pos, want) JOIN customer ON c_custkey = want")
def get_ordered(spark, sf_dir):
    return collection(spark, sf_dir, "customer").get([9, 3, 7, -1], ordered=True).select("pos", "c_custkey", "c_name")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_by_ids(spark, sf_dir):
    return collection(spark, sf_dir, "customer").by_ids(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT * FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 ORDER BY c_custkey LIMIT 20")
def q_rls(spark, sf_dir):
    def own_nation(request: Request) -> Request:
        return Request({"$and": [request.filters or {}, {"c_nationkey": 3}]}, request.sorts, request.limit, request.offset)

    own = Collection("customer", table(spark, sf_dir, "customer"), "c_custkey", own_nation)
    return own.query(Request({"c_acctbal": {"$gt": 0}}, "c_custkey", limit=20))[0]


@query(f"SELECT DISTINCT segment AS value FROM ({SPARSE})")
def distinct_values(spark, sf_dir):
    return Collection("sparse", sparse(spark, sf_dir), "c_custkey").distinct_values("segment", sorts=[("c_custkey", "desc")])


@query("SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def distinct_records(spark, sf_dir):
    return collection(spark, sf_dir, "customer").distinct_records("c_nationkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    return Collection("lineitem", table(spark, sf_dir, "lineitem"), "l_orderkey").duplicates("l_orderkey", "l_linenumber")


# Sources and sinks


def changed_customers(df: DataFrame) -> DataFrame:
    return df.where("c_nationkey <> 4").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).where("c_mktsegment <> 'MACHINERY'")


CHANGED = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 4 AND c_mktsegment <> 'MACHINERY'"


@query(f"""WITH o AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS ({CHANGED}) SELECT coalesce(o.c_custkey, n.c_custkey) AS id, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""")
def cdc_snapshot(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return sources.snapshot_changes(df.where("c_mktsegment <> 'BUILDING'"), changed_customers(df), "c_custkey")


@query(f"WITH n AS ({CHANGED}) SELECT * FROM n UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_merge(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return found.upsert(changed_customers(found.df))


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def remove_ids(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return found.remove(found.df.where("c_nationkey = 4").select("c_custkey"))


@query("SELECT * FROM customer WHERE c_custkey % 3 <> 0 OR c_nationkey < 10")
def read_through(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    local = Collection("customer", df.where("c_custkey % 3 <> 0"), "c_custkey")
    return local.get_through(df.where("c_custkey % 3 <> 0 OR c_nationkey < 10").select("c_custkey"), df)


FIXED = "f AS (SELECT s_suppkey, 'fixed' AS s_name FROM supplier WHERE s_suppkey % 7 = 0), o AS (SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 18 AND s_suppkey % 7 <> 0), spare AS (SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey >= 18 AND s_suppkey % 7 <> 0)"


def seeds(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Existing suppliers, fixed ones, and new ones to draw on."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    kept = suppliers.where("s_nationkey < 18").drop("s_nationkey")
    return kept, suppliers.where("s_suppkey % 7 = 0").select("s_suppkey", F.lit("fixed").alias("s_name")), suppliers.where("s_nationkey >= 18").drop("s_nationkey")


@query(f"WITH {FIXED} SELECT * FROM f UNION ALL SELECT * FROM (SELECT * FROM o ORDER BY s_suppkey LIMIT (SELECT count(*) // 2 FROM supplier))")
def seed_with(spark, sf_dir):
    existing, fixed, create = seeds(spark, sf_dir)
    return sources.seeded(existing, fixed, create, table(spark, sf_dir, "supplier").count() // 2 + fixed.count(), "s_suppkey")


@query(f"""WITH {FIXED}, bad AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM o WHERE s_name LIKE '%3' AND s_suppkey % 2 = 0), s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM spare)
    SELECT * FROM f UNION ALL SELECT * FROM o WHERE s_name NOT LIKE '%3' UNION ALL SELECT s_suppkey, 'right' FROM o WHERE s_name LIKE '%3' AND s_suppkey % 2 = 1 UNION ALL SELECT bad.s_suppkey, s.s_name FROM bad JOIN s USING (n)""")
def seed_validated(spark, sf_dir):
    existing, fixed, create = seeds(spark, sf_dir)
    corrected = existing.where("s_suppkey % 2 = 1").withColumn("s_name", F.lit("right"))
    return sources.seeded(existing, fixed, create, None, "s_suppkey", valid=~F.col("s_name").like("%3"), corrected=corrected)


@query("SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL")
def migrate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return sources.deduplicated(lines.withColumn("first", F.col("l_shipdate")), ["l_orderkey", "l_linenumber"], "first").drop("first")


@query(f"WITH n AS ({CHANGED}) SELECT * FROM n WHERE c_nationkey = 2")
def upsert_news(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return found.news(changed_customers(found.df))


@query("SELECT count(*) AS here FROM (SELECT 1 FROM customer WHERE c_custkey = 7 LIMIT 1)")
def exists(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return spark.createDataFrame([(int(found.exists(7)) + int(found.exists(-7)),)], "here long")


@query(f"WITH n AS ({CHANGED}) SELECT * FROM n WHERE c_nationkey <> 5 AND c_acctbal > 0 UNION ALL SELECT * FROM customer c WHERE c_nationkey <> 5 AND c_custkey NOT IN (SELECT c_custkey FROM n WHERE c_acctbal > 0)")
def sync_write(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return found.synchronised(changed_customers(found.df), found.df.where("c_nationkey = 5").select("c_custkey"), F.col("c_acctbal") > 0)[0]


@query(f"WITH n AS ({CHANGED}) SELECT coalesce(n.c_custkey, d.c_custkey) AS id, CASE WHEN c_acctbal <= 0 THEN 'not valid' END AS error FROM n FULL JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) d ON n.c_custkey = d.c_custkey")
def sync_results(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return found.synchronised(changed_customers(found.df), found.df.where("c_nationkey = 5").select("c_custkey"), F.col("c_acctbal") > 0)[1]


@query("SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'update' WHEN event_type = 'signup' THEN 'insert' ELSE 'delete' END AS op FROM events WHERE event_type <> 'purchase' AND (event_type NOT IN ('view', 'click') OR event_id % 3 <> 0)")
def cdc_normalised(spark, sf_dir):
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN 'Replace' WHEN 'error' THEN 'delete' ELSE 'drop' END")
    before = F.when(F.col("event_type") != "signup", F.col("value"))
    after = F.when(F.col("event_type") == "error", None).when(F.col("event_type").isin("view", "click") & (F.col("event_id") % 3 == 0), F.col("value")).otherwise(F.col("value") + 1)
    return sources.normalised(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), before.alias("before"), after.alias("after"))).select("seq", "op")


@query("SELECT c_custkey AS _id, c_name FROM customer")
def id_codec(spark, sf_dir):
    plain = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return sources.to_stored(sources.from_stored(sources.to_stored(plain)))


# The audit log


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("record_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("entry_id"), kind.alias("type"), "event_type",
        F.when(F.col("event_type").isin("signup", "view"), F.col("value")).alias("value"), F.when(F.col("event_type").isin("signup", "click"), k).alias("k"), "event_id",
    )


LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS record_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS entry_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS type, event_type,
    CASE WHEN event_type IN ('signup', 'view') THEN value END AS value, CASE WHEN event_type IN ('signup', 'click') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id FROM events)"""


def state_of(entries: DataFrame) -> DataFrame:
    return audit.replay_scalar(entries, {"value": F.col("event_type") == "view", "k": F.col("event_type") == "click"})


def state_sql(source: str) -> str:
    return f"""SELECT record_id, max_by(type, entry_id) FILTER (type IN (0, 2) OR (type = 3 AND entry_id >= f)) <> 2 AS live,
        max_by(value, entry_id) FILTER (entry_id >= l AND event_type IN ('signup', 'view')) AS value, max_by(k, entry_id) FILTER (entry_id >= l AND event_type IN ('signup', 'click')) AS k
        FROM {source} JOIN (SELECT record_id, max(entry_id) AS l, min(entry_id) AS f FROM {source} WHERE type = 0 GROUP BY record_id) USING (record_id) GROUP BY record_id"""


@query(f"WITH {LOG} {state_sql('log')}")
def audit_replay_scalar(spark, sf_dir):
    return state_of(log(spark, sf_dir))


@query(f"WITH {LOG}, past AS (SELECT * FROM log WHERE event_id < (SELECT quantile_disc(event_id, 0.5) FROM events)) {state_sql('past')}")
def audit_asof(spark, sf_dir):
    entries = log(spark, sf_dir)
    middle = entries.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("long").cast("string")).first()[0]
    return state_of(audit.as_of(entries, middle.zfill(12)))


@query("SELECT CAST(c_custkey AS VARCHAR) AS record_id, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS entry_id, 0 AS type FROM customer")
def audit_create(spark, sf_dir):
    return audit.created(table(spark, sf_dir, "customer"), "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 12, "0")).select("record_id", "entry_id", "type")


@query(f"WITH {LOG} SELECT record_id, count(*) AS n, string_agg(CAST(type AS VARCHAR), ',' ORDER BY entry_id) AS types FROM log GROUP BY record_id")
def audit_group(spark, sf_dir):
    return audit.grouped(log(spark, sf_dir)).select("record_id", F.size("entries").cast("long").alias("n"), F.expr("array_join(transform(entries, e -> cast(e.type as string)), ',')").alias("types"))


def branched(entries: DataFrame) -> DataFrame:
    """The log with every 7th event as a branch."""
    return entries.withColumn("type", F.when(F.col("event_id") % 7 == 0, 4).otherwise(F.col("type")))


BRANCHED = f"{LOG}, b AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 4 ELSE type END AS type) FROM log)"


@query(f"WITH {BRANCHED} SELECT record_id, count(*) AS n_entries, max(entry_id) AS last_id, min(entry_id) FILTER (type = 4) AS branch_id FROM b GROUP BY record_id")
def audit_last(spark, sf_dir):
    return audit.last_entries(branched(log(spark, sf_dir)))


@query(f"WITH {LOG} SELECT record_id, coalesce(max_by(type, entry_id) FILTER (type IN (2, 3)) = 2, false) AS is_deleted FROM log GROUP BY record_id")
def audit_deleted(spark, sf_dir):
    return audit.deleted_state(log(spark, sf_dir))


@query(f"""WITH {BRANCHED}, s AS (SELECT record_id, min(entry_id) FILTER (type = 4) AS br, max(entry_id) FILTER (type NOT IN (0, 4)) AS c FROM b GROUP BY record_id)
    SELECT record_id, br IS NULL OR coalesce(c > br, false) AS has_pending, c IS NOT NULL AS has_history, c IS NULL AS is_branch_only FROM s""")
def audit_pending(spark, sf_dir):
    return audit.pending_state(branched(log(spark, sf_dir)))


@query(f"WITH {BRANCHED}, s AS (SELECT record_id, min(entry_id) FILTER (type = 4) AS br, max(entry_id) FILTER (type NOT IN (0, 4)) AS c FROM b GROUP BY record_id) SELECT count(*) FILTER (br IS NULL OR coalesce(c > br, false)) AS pending FROM s")
def pending_total(spark, sf_dir):
    return audit.pending_count(branched(log(spark, sf_dir)))


def short_log(spark, sf_dir) -> DataFrame:
    """The branched log as many short audits: a user's events by the remainder of their number, views with operations (none where even)."""
    entries = branched(log(spark, sf_dir)).withColumn("record_id", F.concat("record_id", F.lit("-"), (F.col("event_id") % 32).cast("string")))
    ops = F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    return entries.select("record_id", "entry_id", "type", ops.alias("ops"), "event_id")


SHORT = f"{BRANCHED}, sh AS (SELECT record_id || '-' || (event_id % 32) AS record_id, entry_id, type, CASE WHEN event_type = 'view' THEN event_id % 2 END AS n_ops, event_id FROM b)"


def valid_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT record_id, min_by(type, entry_id) AS first, max_by(type, entry_id) AS last, max_by({{'n': n_ops}}, entry_id).n AS n_ops, count(*) AS n, bool_and(type IN (1, 2, 3)) AS changes_only,
        CASE WHEN min_by(type, entry_id) NOT IN (0, 4) THEN 'does not start with an anchor' WHEN count(*) = 2 AND max_by(type, entry_id) = 1 AND max_by({{'n': n_ops}}, entry_id).n = 0 THEN 'anchor with an empty update' END AS reason FROM {source} GROUP BY record_id)"""


@query(f"WITH {SHORT}, {valid_sql('sh', 'v')} SELECT record_id, reason FROM v")
def audit_validate(spark, sf_dir):
    return audit.validated(short_log(spark, sf_dir))


@query(f"""WITH {SHORT}, {valid_sql('sh', 'v')} SELECT record_id, CASE WHEN n > 2 THEN 'more than two entries' WHEN first NOT IN (0, 4) THEN 'does not start with an anchor' WHEN n = 1 THEN NULL WHEN last = 1 AND n_ops IS NULL THEN 'update without operations'
    WHEN last = 1 AND n_ops > 0 THEN 'update with operations' WHEN last NOT IN (1, 2) THEN 'second entry is no update or delete' END AS reason FROM v""")
def audit_validate_sync(spark, sf_dir):
    return audit.validated(short_log(spark, sf_dir), full=False)


ANCHORS = "a AS (SELECT record_id, max(entry_id) FILTER (type = 0) || CASE WHEN record_id LIKE '%3' THEN 'x' ELSE '' END AS anchor FROM b GROUP BY record_id)"


@query(f"""WITH {BRANCHED}, {ANCHORS} SELECT record_id, entry_id, type FROM b JOIN a USING (record_id) WHERE anchor IS NULL OR entry_id > anchor AND (record_id NOT LIKE '%3' OR type <> 4) UNION ALL SELECT record_id, anchor, 4 FROM a WHERE anchor IS NOT NULL""")
def audit_collapse(spark, sf_dir):
    """At the last created entry; where the id ends in 3 at one that the audit doesn't have."""
    entries = branched(log(spark, sf_dir)).select("record_id", "entry_id", "type")
    last = entries.groupBy("record_id").agg(F.max(F.when(F.col("type") == 0, F.col("entry_id"))).alias("anchor"))
    return audit.collapsed(entries, last.withColumn("anchor", F.when(F.col("record_id").like("%3"), F.concat("anchor", F.lit("x"))).otherwise(F.col("anchor"))))


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two replicas of short audits: even thirds, odd ones, and every tenth event on both."""
    entries = short_log(spark, sf_dir)
    return entries.where("event_id div 32 % 2 = 0 AND record_id NOT LIKE '%7'"), entries.where("event_id div 32 % 2 = 1 OR event_id % 10 = 0")


SIDES = f"{SHORT}, s AS (SELECT * FROM sh WHERE event_id // 32 % 2 = 0 AND record_id NOT LIKE '%7'), c AS (SELECT * FROM sh WHERE event_id // 32 % 2 = 1 OR event_id % 10 = 0)"


def merged_sql(client: str) -> str:
    return f"""{valid_sql('s', 'vs')}, {valid_sql(client, 'vc')}, d AS (SELECT vc.record_id, CASE WHEN vs.record_id IS NULL THEN 'adopt' WHEN vc.changes_only AND vs.reason IS NULL OR NOT vc.changes_only AND vc.reason IS NULL THEN 'merge' ELSE 'keep' END AS decision FROM vc LEFT JOIN vs USING (record_id))
        SELECT record_id, entry_id, type FROM s UNION SELECT record_id, entry_id, type FROM {client} JOIN d USING (record_id) WHERE decision = 'adopt' OR decision = 'merge' AND type NOT IN (0, 4)"""


@query(f"WITH {SIDES}, {merged_sql('c')}")
def audit_merge(spark, sf_dir):
    return audit.merged(*sides(spark, sf_dir)).select("record_id", "entry_id", "type")


@query(f"WITH {LOG} SELECT record_id, entry_id, type FROM log WHERE record_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 6)")
def audit_read(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_nationkey < 6").select(F.col("c_custkey").cast("string").alias("record_id"))
    return audit.audits_of(log(spark, sf_dir), ids).select("record_id", "entry_id", "type")


@query(f"WITH {LOG} SELECT record_id, entry_id, type FROM log WHERE record_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 6)")
def audit_trail_removed(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_nationkey < 6").select(F.col("c_custkey").cast("string").alias("record_id"))
    return audit.without_trail(log(spark, sf_dir), ids).select("record_id", "entry_id", "type")


PENDING = "p AS (SELECT record_id, br IS NULL OR coalesce(c > br, false) AS pending FROM (SELECT record_id, min(entry_id) FILTER (type = 4) AS br, max(entry_id) FILTER (type NOT IN (0, 4)) AS c FROM sh GROUP BY record_id))"


def short_live(entries: DataFrame) -> DataFrame:
    return entries.select("record_id").distinct().where("record_id not like '%1'").unionByName(entries.sparkSession.createDataFrame([("unknown",)], "record_id string"))


LIVE = "lv AS (SELECT DISTINCT record_id FROM sh WHERE record_id NOT LIKE '%1' UNION ALL SELECT 'unknown')"


@query(f"WITH {SHORT}, {PENDING}, {LIVE} SELECT 'live' AS kept, count(*) AS n FROM lv WHERE record_id NOT IN (SELECT record_id FROM p WHERE NOT pending) UNION ALL SELECT 'log', count(*) FROM sh JOIN p USING (record_id) WHERE pending")
def clear_pending(spark, sf_dir):
    entries = short_log(spark, sf_dir)
    live_left, log_left = audit.cleared(short_live(entries), entries)
    return live_left.agg(F.lit("live").alias("kept"), F.count("*").alias("n")).unionByName(log_left.agg(F.lit("log").alias("kept"), F.count("*").alias("n")))


DELETES = "dl AS (SELECT DISTINCT record_id FROM sh WHERE record_id LIKE '%2' OR record_id LIKE '%1' UNION ALL SELECT 'unknown' UNION ALL SELECT 'nobody')"


def deleted_ids(entries: DataFrame) -> DataFrame:
    more = entries.sparkSession.createDataFrame([("unknown",), ("nobody",)], "record_id string")
    return entries.select("record_id").distinct().where("record_id like '%2' or record_id like '%1'").unionByName(more)


@query(f"WITH {SHORT}, {PENDING}, {LIVE}, {DELETES} SELECT record_id, CASE WHEN pending THEN 'markAsDeleted' ELSE 'remove' END AS action FROM dl LEFT JOIN p USING (record_id) WHERE pending IS NOT NULL OR record_id IN (SELECT record_id FROM lv)")
def server_deletes(spark, sf_dir):
    entries = short_log(spark, sf_dir)
    return sync.server_deletes(short_live(entries), entries, deleted_ids(entries))[2]


@query(f"WITH {SHORT}, {DELETES} SELECT record_id, entry_id, type FROM sh WHERE record_id NOT IN (SELECT record_id FROM dl) UNION ALL SELECT record_id, 'anchor', 4 FROM dl")
def server_writes(spark, sf_dir):
    entries = short_log(spark, sf_dir)
    ids = deleted_ids(entries)
    return sync.server_writes(short_live(entries), entries, ids, ids.withColumn("anchor", F.lit("anchor")))[1].select("record_id", "entry_id", "type")


@query(f"WITH {SHORT}, {DELETES} SELECT record_id, entry_id, type FROM sh WHERE record_id NOT IN (SELECT record_id FROM dl) UNION ALL SELECT record_id, 'new', 0 FROM dl")
def audit_write(spark, sf_dir):
    entries = short_log(spark, sf_dir).select("record_id", "entry_id", "type")
    return sources.replaced(entries, deleted_ids(entries).select("record_id", F.lit("new").alias("entry_id"), F.lit(0).alias("type")))


@query(f"WITH {SHORT}, {PENDING}, h AS (SELECT DISTINCT record_id FROM sh WHERE record_id NOT LIKE '%1') SELECT sh.record_id, CASE WHEN h.record_id IS NOT NULL THEN 'h' || sh.record_id END AS hash, entry_id, type FROM sh JOIN p ON p.record_id = sh.record_id AND pending LEFT JOIN h ON h.record_id = sh.record_id")
def sr_request(spark, sf_dir):
    entries = short_log(spark, sf_dir)
    return sync.requested(entries, short_live(entries).withColumn("hash", F.concat(F.lit("h"), "record_id")))


@query(f"""WITH {SHORT}, {LIVE}, k AS (SELECT record_id, min(entry_id) AS l FROM sh WHERE type <> 0 AND record_id NOT LIKE '%9' GROUP BY record_id), later AS (SELECT sh.record_id, entry_id, type FROM sh JOIN k ON k.record_id = sh.record_id AND entry_id > l)
    SELECT record_id, entry_id, type FROM sh WHERE record_id NOT IN (SELECT record_id FROM k) UNION ALL SELECT * FROM later UNION ALL SELECT record_id, l, 4 FROM k WHERE record_id IN (SELECT record_id FROM lv) OR record_id IN (SELECT record_id FROM later)""")
def ack_collapse(spark, sf_dir):
    entries = short_log(spark, sf_dir).select("record_id", "entry_id", "type")
    acks = entries.where("type <> 0 and record_id not like '%9'").groupBy("record_id").agg(F.min("entry_id").alias("last_entry_id"))
    return sync.acknowledged_audits(entries, short_live(entries), acks)


@query("SELECT 'orders' AS collection, o_custkey AS id FROM orders UNION SELECT 'orders', c_custkey FROM customer UNION SELECT 'customer', c_custkey FROM customer")
def answered_ids(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    as_answer = lambda df, name, column: df.select(F.lit(name).alias("collection"), F.col(column).alias("id"))
    return sync.answered(as_answer(orders, "orders", "o_custkey"), as_answer(customers, "orders", "c_custkey"), as_answer(customers, "customer", "c_custkey"))


@query(f"""WITH {LOG}, g AS (SELECT record_id, entry_id, type, CASE WHEN type = 0 AND event_id % 3 = 0 THEN NULL ELSE value END AS value, k, event_type, event_id FROM log),
    x AS (SELECT *, max(entry_id) FILTER (type = 2) OVER (PARTITION BY record_id) AS last, max_by(type, entry_id) FILTER (type IN (0, 2, 3)) OVER w <> 2 AND bool_or(type = 0) OVER w AS there,
        max_by({{'v': value}}, entry_id) FILTER (type = 0 OR event_type = 'view') OVER w AS v, max_by({{'v': k}}, entry_id) FILTER (type = 0 OR event_type = 'click') OVER w AS kk FROM g WINDOW w AS (PARTITION BY record_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT record_id, entry_id, type, CASE WHEN event_id % 11 = 0 THEN 'own' ELSE 'user' END AS user_id,
        CASE WHEN type <> 2 THEN NULL WHEN event_id % 13 = 0 THEN -1.0 WHEN entry_id = last AND record_id LIKE '%4' THEN -2.0 WHEN there THEN v.v END AS value, CASE WHEN type = 2 AND event_id % 13 <> 0 AND NOT (entry_id = last AND record_id LIKE '%4') AND there THEN kk.v END AS k,
        type = 2 AND event_id % 13 <> 0 AND NOT (entry_id = last AND record_id LIKE '%4') AND NOT coalesce(there, false) AS stub FROM x""")
def audit_server(spark, sf_dir):
    """Created values are null at times; some deletes have a record, some records a live row, some users are named already."""
    entries = document_log(log(spark, sf_dir).withColumn("value", F.when((F.col("type") == 0) & (F.col("event_id") % 3 == 0), None).otherwise(F.col("value"))))
    entries = entries.withColumn("record", F.when((F.col("type") == 2) & (F.col("event_id") % 13 == 0), F.lit('{"value": -1.0}')).otherwise(F.col("record")))
    entries = entries.withColumn("user_id", F.when(F.col("event_id") % 11 == 0, "own").when(F.col("event_id") % 2 == 0, "")).select("record_id", "entry_id", "type", "record", "ops", "user_id")
    snapshots = entries.where("record_id like '%4'").select("record_id").distinct().withColumn("live", F.lit('{"value": -2.0}'))
    found = audit.server_audit(entries, "user", snapshots)
    read = F.when(F.col("type") == 2, F.from_json("record", "value double, k long, id string"))
    return found.select("record_id", "entry_id", "type", "user_id", read["value"].alias("value"), read["k"].alias("k"), F.coalesce(read["id"].isNotNull(), F.lit(False)).alias("stub"))


def document_log(entries: DataFrame) -> DataFrame:
    """The log with whole records and operations, for the fold."""
    op = lambda name: F.array(F.struct(F.lit("replace").alias("op"), F.lit(name).alias("path"), F.col(name).cast("string").alias("value"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("hash")))
    ops = F.when(F.col("event_type") == "view", op("value")).when(F.col("event_type") == "click", op("k"))
    return entries.withColumn("record", F.when(F.col("type") == 0, F.to_json(F.struct("value", "k")))).withColumn("ops", ops)


@query(f"WITH {LOG}, t AS ({state_sql('log')}) SELECT l.record_id, coalesce(t.live, false) AS live, t.value, t.k FROM (SELECT DISTINCT record_id FROM log) l LEFT JOIN t USING (record_id)")
def audit_replay_full(spark, sf_dir):
    folded = audit.replay_full(document_log(log(spark, sf_dir)))
    shadow = F.from_json("shadow", "value double, k long")
    return folded.select("record_id", F.col("live").isNotNull().alias("live"), shadow["value"].alias("value"), shadow["k"].alias("k"))


def arrivals(spark, sf_dir) -> DataFrame:
    """The log in the order in which it comes: two thirds of the events, then the rest, and last the newest ones of some users and views that others
    sent late."""
    entries = log(spark, sf_dir)
    tile = F.ntile(30).over(Window.partitionBy("record_id").orderBy("event_id"))
    last = F.col("record_id").like("%7") & (F.col("event_type") == "view") | F.col("record_id").like("%3") & (F.col("tile") >= 29)
    part = F.when(last, 2).when(F.col("tile") <= 20, 0).otherwise(1)
    return document_log(entries.withColumn("tile", tile)).select("record_id", "entry_id", "type", "record", "ops", part.alias("part"))


ARRIVALS = "tiled AS (SELECT *, ntile(30) OVER (PARTITION BY record_id ORDER BY event_id) AS tile FROM log), part AS (SELECT *, CASE WHEN record_id LIKE '%7' AND event_type = 'view' OR record_id LIKE '%3' AND tile >= 29 THEN 2 WHEN tile <= 20 THEN 0 ELSE 1 END AS part FROM tiled)"


def kept_view(spark, sf_dir) -> Store:
    store, folder, came = Store(spark, new_folder(spark, "view"), 16), new_folder(spark, "arrivals"), arrivals(spark, sf_dir)
    came.write.partitionBy("part").parquet(folder)  # once: each batch would order the whole log again
    parts = spark.read.schema(came.schema).parquet(folder)
    for part in (0, 1, 2):
        live_view.applied(store, parts.where(F.col("part") == part).drop("part"), "events", part)
    return store


@query(f"WITH {LOG}, t AS ({state_sql('log')}) SELECT record_id, value, k FROM t WHERE live")
def lv_live(spark, sf_dir):
    """Live records kept up over three batches, of which the last one is late: as if the whole log were replayed."""
    return live_view.view(kept_view(spark, sf_dir), "value double, k long")


@query(f"""WITH {LOG}, {ARRIVALS}, past AS (SELECT * FROM part WHERE part < 2), b AS (SELECT * FROM ({state_sql('past')}) WHERE live), a AS (SELECT * FROM ({state_sql('log')}) WHERE live)
    SELECT coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN b.record_id IS NULL THEN 'insert' WHEN a.record_id IS NULL THEN 'delete' ELSE 'update' END AS op, b.value AS value_before, b.k AS k_before, a.value, a.k
    FROM a FULL JOIN b ON a.record_id = b.record_id WHERE a.record_id IS NULL OR b.record_id IS NULL OR a.value IS DISTINCT FROM b.value OR a.k IS DISTINCT FROM b.k""")
def lv_changes(spark, sf_dir):
    """What the late batch changed of the live records."""
    before, after = (F.from_json(c, "value double, k long") for c in ("before", "after"))
    told = kept_view(spark, sf_dir).read("changes")
    return told.select("record_id", "op", before["value"].alias("value_before"), before["k"].alias("k_before"), after["value"].alias("value"), after["k"].alias("k"))


@query(f"""WITH {LOG}, r AS (SELECT record_id, max(entry_id) AS l FROM log WHERE type = 0 GROUP BY record_id), o AS (SELECT log.*, l FROM log JOIN r ON log.record_id = r.record_id AND entry_id >= l)
    SELECT record_id, array_to_string(coalesce(list(k ORDER BY entry_id DESC) FILTER (event_type = 'click' AND k % 2 = 1), []) || [0, 0] || coalesce(list(k ORDER BY entry_id) FILTER (event_type = 'click' AND k % 2 = 0), []), ',') AS tags FROM o GROUP BY record_id""")
def audit_replay_arrays(spark, sf_dir):
    """Clicks add to an array, odd ones at its beginning."""
    op = F.array(F.struct(F.lit("add").alias("op"), F.lit("tags.2").alias("path"), F.col("k").cast("string").alias("value"), F.when(F.col("k") % 2 == 1, "FIRST").alias("position"), F.lit(None).cast("string").alias("hash")))
    entries = log(spark, sf_dir).select("record_id", "entry_id", "type", F.when(F.col("type") == 0, F.lit('{"tags": [0, 0]}')).alias("record"), F.when(F.col("event_type") == "click", op).alias("ops"))
    return audit.replay_full(entries).where("shadow is not null").select("record_id", F.array_join(F.from_json("shadow", "tags array<int>")["tags"], ",").alias("tags"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_acctbal AS value, c_nationkey + 1 AS k, true AS live FROM customer")
def audit_replay_base(spark, sf_dir):
    """Audits without an anchor of their own, from a base record: an update of k."""
    customers = table(spark, sf_dir, "customer").withColumn("record_id", F.col("c_custkey").cast("string"))
    op = F.array(F.struct(F.lit("replace").alias("op"), F.lit("k").alias("path"), (F.col("c_nationkey") + 1).cast("string").alias("value"), F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("hash")))
    entries = customers.select("record_id", F.lit("1").alias("entry_id"), F.lit(1).alias("type"), F.lit(None).cast("string").alias("record"), op.alias("ops"))
    base = customers.select("record_id", F.to_json(F.struct(F.col("c_acctbal").alias("value"), F.col("c_nationkey").alias("k"))).alias("base"))
    read = F.from_json("live", "value double, k int")
    return audit.replay_full(entries, base).select("record_id", read["value"].alias("value"), read["k"].alias("k"), F.col("live").isNotNull().alias("live"))


@query(f"""WITH {LOG}, t AS ({state_sql('log')}), d AS (SELECT record_id, coalesce(max_by(type, entry_id) FILTER (type IN (2, 3)) = 2, false) AS deleted FROM log GROUP BY record_id),
    x AS (SELECT d.record_id, CASE WHEN d.record_id LIKE '%5' THEN CASE WHEN NOT deleted THEN 2 END WHEN t.record_id IS NULL THEN 0 WHEN NOT live THEN 3 WHEN d.record_id LIKE '%2' THEN NULL ELSE 1 END AS type FROM d LEFT JOIN t USING (record_id))
    SELECT record_id, '999999999999' AS entry_id, type, type = 0 OR type = 3 AND record_id NOT LIKE '%2' AS has_record, CASE WHEN type = 1 THEN 1 ELSE 0 END AS n_ops FROM x WHERE type IS NOT NULL""")
def audit_update_with(spark, sf_dir):
    """Deleted where the id ends in 5, as replayed where in 2, else with another value."""
    entries = log(spark, sf_dir)
    joined = entries.select("record_id").distinct().join(state_of(entries), "record_id", "left")
    same, other = F.to_json(F.struct("value", "k")), F.to_json(F.struct(F.lit(-1.5).alias("value"), "k"))
    current = joined.select("record_id", F.when(F.col("record_id").like("%5"), None).when(F.col("record_id").like("%2"), same).otherwise(other).alias("current"))
    found = audit.updated_with(document_log(entries), current, F.lit("999999999999"))
    return found.select("record_id", "entry_id", "type", F.col("record").isNotNull().alias("has_record"), F.greatest(F.coalesce(F.size("ops"), F.lit(0)), F.lit(0)).alias("n_ops"))


#: Audits in ten states by the customer's key: none; branched; branched and changed; an operation without a way, changed or not; an entry without id;
#: another record; a created entry without a record; deleted; an index that isn't there.
STATES = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_custkey % 10 AS s FROM customer)"


@query(f"""WITH {STATES}, l AS (SELECT record_id, s, '1' AS entry_id, CASE WHEN s IN (1, 2) THEN 4 ELSE 0 END AS type FROM c WHERE s NOT IN (0) UNION ALL SELECT record_id, s, '2', 1 FROM c WHERE s IN (1, 2, 3, 4, 9) UNION ALL SELECT record_id, s, NULL, 1 FROM c WHERE s = 5 UNION ALL SELECT record_id, s, '2', 2 FROM c WHERE s = 8)
    SELECT record_id, entry_id, type FROM l WHERE s NOT IN (3, 5, 7, 9) UNION ALL SELECT record_id, '8', 0 FROM c WHERE s IN (3, 5, 7, 9) UNION ALL SELECT record_id, '8', 1 FROM c WHERE s = 6
    UNION ALL SELECT record_id, '9', CASE s WHEN 0 THEN 0 WHEN 8 THEN 3 ELSE 1 END FROM c WHERE s NOT IN (1, 4)""")
def audit_reset(spark, sf_dir):
    """The log after an upsert, with resets and corrections."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), (F.col("c_custkey") % 10).alias("s"), F.col("c_nationkey").alias("k"))
    doc = lambda k: F.to_json(F.struct(F.col("record_id").alias("id"), F.array(F.lit(1)).alias("tags"), k.alias("k")))
    null = F.lit(None).cast("string")
    op = lambda path: F.array(F.struct(F.lit("replace").alias("op"), path.alias("path"), F.col("k").cast("string").alias("value"), null.alias("position"), null.alias("hash")))
    none, s = op(F.lit("k")), F.col("s")
    path = F.when(s.isin(3, 4), "in.deep.k").when(s == 9, "tags.5.k").otherwise("k")
    first = c.where("s <> 0").select("record_id", F.lit("1").alias("entry_id"), F.when(s.isin(1, 2), 4).otherwise(0).alias("type"), F.when(~s.isin(1, 2, 7), doc(F.when(s == 6, -1).otherwise(F.col("k")))).alias("record"), F.when(F.lit(False), none).alias("ops"))
    second = c.where("s in (1, 2, 3, 4, 5, 8, 9)").select("record_id", F.when(s != 5, "2").alias("entry_id"), F.when(s == 8, 2).otherwise(1).alias("type"), null.alias("record"), F.when(s != 8, op(path)).alias("ops"))
    live = c.where("s <> 8").select("record_id", doc(F.col("k")).alias("live"))
    records = c.select("record_id", doc(F.when(s.isin(1, 4, 8), F.col("k")).otherwise(F.col("k") + 1)).alias("current"))
    return audit.upserted(first.unionByName(second), live, records, F.lit("9"), F.lit("8")).select("record_id", "entry_id", "type")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mine' ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 9 END AS a, 2 AS b, CASE WHEN c_custkey % 5 = 0 THEN 'restore?' ELSE 'rebased' END AS outcome FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'restore?' FROM customer WHERE c_custkey % 5 = 0")
def rebase_nested(spark, sf_dir):
    """My name or nested number where I changed it, on top of theirs; every fifth record was deleted meanwhile."""
    record = lambda name, a, b: F.to_json(F.struct(name.alias("name"), F.struct(a.alias("a"), b.alias("b")).alias("in")))
    name, even = F.col("c_name"), F.col("c_custkey") % 2 == 0
    mine = record(F.when(F.col("c_custkey") % 3 == 0, "mine").otherwise(name), F.when(even, 7).otherwise(1), F.lit(1))
    theirs = F.when(F.col("c_custkey") % 5 != 0, record(F.upper(name), F.lit(9), F.lit(2)))
    versions = table(spark, sf_dir, "customer").select("c_custkey", record(name, F.lit(1), F.lit(1)).alias("old"), mine.alias("mine"), theirs.alias("theirs"))
    read = F.from_json("rebased", "name string, in struct<a: int, b: int>")
    return audit.edited(versions, "old", "mine", "theirs").select("c_custkey", read["name"].alias("name"), read["in"]["a"].alias("a"), read["in"]["b"].alias("b"), "outcome")


@query(f"WITH n AS ({CHANGED}), m AS (SELECT * REPLACE (c_mktsegment || '!' AS c_mktsegment) FROM n WHERE c_nationkey < 12) SELECT CAST(o.c_custkey AS VARCHAR) AS record_id, 'c_acctbal' AS path FROM customer o JOIN m USING (c_custkey) WHERE o.c_acctbal <> m.c_acctbal UNION ALL SELECT CAST(o.c_custkey AS VARCHAR), 'c_mktsegment' FROM customer o JOIN m USING (c_custkey)")
def audit_diff(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = changed_customers(old).where("c_nationkey < 12").withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("!")))
    return audit.flat_differences(old, new, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).select("record_id", "path")


@query("SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'replace' AS op, 'tags.1' AS path FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'add', 'tags.2' FROM customer WHERE c_nationkey % 2 = 1")
def audit_diff_nested(spark, sf_dir):
    even = F.col("c_nationkey") % 2 == 0
    tags = lambda *xs: F.to_json(F.struct(F.array(*xs).alias("tags")))
    name, other = F.col("c_name"), F.lit("new")
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), tags(name, name).alias("old"), F.when(even, tags(name, other)).otherwise(tags(name, name, other)).alias("new"))
    return audit.differences(pairs, "old", "new").select("record_id", F.inline("ops")).select("record_id", "op", "path")


@query(f"WITH {LOG} SELECT record_id, '999999999999' AS entry_id, 2 AS type FROM (SELECT record_id, coalesce(max_by(type, entry_id) FILTER (type IN (2, 3)) = 2, false) AS d FROM log GROUP BY record_id) WHERE NOT d AND record_id LIKE '%5'")
def audit_delete(spark, sf_dir):
    entries = log(spark, sf_dir)
    return audit.with_deletes(entries, entries.where("record_id LIKE '%5'").select("record_id").distinct(), F.lit("999999999999"))


WANTED = "w AS (SELECT CAST(c_custkey AS VARCHAR) AS record_id, CASE WHEN c_custkey % 3 = 0 THEN t.value ELSE c_acctbal END AS value, t.k FROM customer LEFT JOIN t ON t.record_id = CAST(c_custkey AS VARCHAR))"


def wanted(spark, sf_dir, state: DataFrame) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), "c_custkey", "c_acctbal")
    joined = customers.join(state, "record_id", "left")
    return joined.select("record_id", F.when(F.col("c_custkey") % 3 == 0, F.col("value")).otherwise(F.col("c_acctbal")).alias("value"), "k")


@query(f"""WITH {LOG}, t AS ({state_sql('log')}), {WANTED} SELECT w.record_id, '999999999999' AS entry_id, CASE WHEN t.record_id IS NULL THEN 0 ELSE 3 END AS type,
    t.record_id IS NULL OR w.value IS DISTINCT FROM t.value OR w.k IS DISTINCT FROM t.k AS has_payload FROM w LEFT JOIN t USING (record_id)""")
def audit_restore(spark, sf_dir):
    state = state_of(log(spark, sf_dir))
    return audit.with_restores(state, wanted(spark, sf_dir, state), F.lit("999999999999"), ["value", "k"])


@query(f"WITH {LOG}, t AS ({state_sql('log')}), {WANTED} SELECT w.record_id, '999999999999' AS entry_id, 1 AS type, 'value' AS paths FROM w JOIN t USING (record_id) WHERE t.live AND w.value IS DISTINCT FROM t.value")
def audit_update(spark, sf_dir):
    state = state_of(log(spark, sf_dir))
    return audit.updates_for(state, wanted(spark, sf_dir, state), F.lit("999999999999"), ["value", "k"])


@query(f"WITH {LOG}, t AS ({state_sql('log')}), {WANTED} SELECT record_id, entry_id, type FROM log UNION ALL SELECT w.record_id, '999999999999', 1 FROM w JOIN t USING (record_id) WHERE t.live AND w.value IS DISTINCT FROM t.value")
def audit_reconcile(spark, sf_dir):
    entries = log(spark, sf_dir)
    state = state_of(entries)
    fix = audit.updates_for(state, wanted(spark, sf_dir, state), F.lit("999999999999"), ["value", "k"])
    return entries.select("record_id", "entry_id", "type").unionByName(fix.select("record_id", "entry_id", "type"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mine' ELSE upper(c_name) END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal + 2 END AS c_acctbal FROM customer")
def rebase(spark, sf_dir):
    mine = F.when(F.col("c_custkey") % 3 == 0, "mine").otherwise(F.col("c_name"))
    paid = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    versions = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("c_name_old"), mine.alias("c_name_mine"), F.upper("c_name").alias("c_name_theirs"), F.col("c_acctbal").alias("c_acctbal_old"), paid.alias("c_acctbal_mine"), (F.col("c_acctbal") + 2).alias("c_acctbal_theirs"))
    return audit.rebased(versions, ["c_name", "c_acctbal"])


#: The UTF-16 units of j, folded.
UNITS = "flatten(list_transform(string_split(j, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END))"
LANE = f"""printf('%08x', list_reduce([{{seed}}::BIGINT] || list_transform({UNITS}, lambda u: u::BIGINT), lambda h, u: xor(h, u) * 16777619 % 4294967296))"""


@query(f"""SELECT c_custkey, {LANE.format(seed=0x811C9DC5)} || {LANE.format(seed=0xC4CCD795)} AS content_hash FROM (SELECT c_custkey, '{{"c_name":"' || c_name || '\U0001F642\u00e9","c_nationkey":' || c_nationkey || '}}' AS j FROM customer)""")
def hash_content(spark, sf_dir):
    """Names end in a character beyond the basic plane."""
    named = table(spark, sf_dir, "customer").withColumn("c_name", F.concat("c_name", F.lit("\U0001F642\u00e9")))
    return named.select("c_custkey", hashing.folded_hash(hashing.record_json(named, ["c_name", "c_nationkey"])).alias("content_hash"))


@query(r"""SELECT c_custkey, substr(sha256('{"c_acctbal":' || regexp_replace(c_acctbal::VARCHAR, '\.0$', '') || ',"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","in":{"tiny":' || CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE c_custkey % 9 || 'e-9' END || ',"whole":' || c_custkey || '}}'), 1, 16) AS record_hash FROM customer""")
def hash_record(spark, sf_dir):
    """Whole, fractional and tiny doubles, within a nested record too."""
    tiny = F.when(F.col("c_custkey") % 9 > 0, F.concat((F.col("c_custkey") % 9).cast("string"), F.lit("e-9")).cast("double"))
    customers = table(spark, sf_dir, "customer").withColumn("in", F.struct(F.col("c_custkey").cast("double").alias("whole"), tiny.alias("tiny")))
    return customers.select("c_custkey", hashing.record_hash(customers, ["c_name", "c_custkey", "c_acctbal", "in"]).alias("record_hash"))


@query("SELECT c_custkey, 1469922850259 + c_custkey * 86400001 AS millis, 26 AS length FROM customer")
def ulid_time(spark, sf_dir):
    ulids = table(spark, sf_dir, "customer").select("c_custkey", hashing.ulid(1469922850259 + F.col("c_custkey") * 86400001, F.col("c_custkey")).alias("u"))
    return ulids.select("c_custkey", hashing.ulid_millis(F.col("u")).alias("millis"), F.length("u").alias("length"))


# Synchronisation


def events_as_cursors(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).select((F.lit("users")).alias("collection"), F.col("record_id").alias("id"), (F.col("type") == 2).alias("is_delete"), F.col("entry_id").alias("last_entry_id"), F.col("k").cast("string").alias("hash"), F.col("event_id").alias("seq"), (F.col("event_id") % 50 == 0).alias("authoritative"))


CURSORS = f"{LOG}, cur AS (SELECT 'users' AS collection, record_id AS id, type = 2 AS is_delete, entry_id AS last_entry_id, CAST(k AS VARCHAR) AS hash, event_id AS seq, event_id % 50 = 0 AS authoritative FROM log)"
SQUASH = f"{CURSORS}, a AS (SELECT id, bool_or(authoritative) AS authoritative FROM cur GROUP BY id), sq AS (SELECT cur.* EXCLUDE (authoritative), a.authoritative FROM cur JOIN a USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY is_delete DESC, CASE WHEN is_delete THEN '' ELSE last_entry_id END DESC, seq DESC) = 1)"


@query(f"WITH {SQUASH} SELECT * FROM sq")
def squash(spark, sf_dir):
    return sync.squashed(events_as_cursors(spark, sf_dir))


@query(f"WITH {CURSORS}, l AS (SELECT * FROM cur WHERE NOT is_delete), a AS (SELECT id, bool_or(authoritative) AS authoritative FROM l GROUP BY id) SELECT l.* EXCLUDE (authoritative), a.authoritative FROM l JOIN a USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_entry_id DESC, seq DESC) = 1")
def squash_active(spark, sf_dir):
    return sync.squashed(events_as_cursors(spark, sf_dir).where("not is_delete"))


def active_cursors(spark, sf_dir) -> DataFrame:
    return sync.squashed(events_as_cursors(spark, sf_dir).where("not is_delete or id like '%3'"))


def known_state(spark, sf_dir) -> DataFrame:
    """The filter state of users, without those that end in 1."""
    last = log(spark, sf_dir).where("event_id % 3 = 0 and type = 1 and record_id not like '%1'").groupBy(F.col("record_id").alias("id")).agg(F.max("entry_id").alias("known_last"))
    return last.select(F.lit("users").alias("collection"), "id", F.when(~F.col("id").like("%5"), F.col("known_last")).alias("known_hash"), "known_last", F.col("id").like("%9").alias("confirmed_deleted"))


KNOWN = "st AS (SELECT 'users' AS collection, record_id AS id, max(entry_id) AS known_last, CASE WHEN record_id NOT LIKE '%5' THEN max(entry_id) END AS known_hash, record_id LIKE '%9' AS confirmed_deleted FROM log WHERE event_id % 3 = 0 AND type = 1 AND record_id NOT LIKE '%1' GROUP BY record_id)"
ACTIVE = f"{CURSORS}, c0 AS (SELECT * FROM cur WHERE NOT is_delete OR id LIKE '%3'), a AS (SELECT id, bool_or(authoritative) AS authoritative FROM c0 GROUP BY id), sq AS (SELECT c0.* EXCLUDE (authoritative, hash), last_entry_id AS hash, a.authoritative FROM c0 JOIN a USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY is_delete DESC, CASE WHEN is_delete THEN '' ELSE last_entry_id END DESC, seq DESC) = 1)"


@query(f"""WITH {ACTIVE}, {KNOWN} SELECT sq.collection, sq.id, CASE WHEN coalesce(st.confirmed_deleted, false) THEN 'drop:deleted' WHEN st.id IS NULL AND NOT authoritative AND is_delete THEN 'tombstone' WHEN st.id IS NULL AND NOT authoritative THEN 'drop:unknown'
    WHEN st.id IS NULL THEN 'send' WHEN known_hash IS NULL THEN 'send:delete' WHEN is_delete THEN 'send:delete' WHEN known_hash = hash AND known_last = last_entry_id THEN 'drop:same' WHEN last_entry_id < known_last THEN 'drop:older' ELSE 'send' END AS decision
    FROM sq LEFT JOIN st ON sq.id = st.id""")
def sd_filter(spark, sf_dir):
    return sync.dispatched(active_cursors(spark, sf_dir).withColumn("hash", F.col("last_entry_id")), known_state(spark, sf_dir))


@query(f"""WITH {ACTIVE}, {KNOWN}, k AS (SELECT *, seq % 4 <> 0 AS ok FROM sq), j AS (SELECT coalesce(st.id, k.id) AS id, st.id IS NOT NULL AS known, st.known_hash, st.known_last, coalesce(st.confirmed_deleted, false) AS cd, k.ok, k.is_delete, k.hash, k.last_entry_id, k.authoritative,
    coalesce(k.ok AND k.is_delete, false) AS gone, coalesce(NOT k.ok AND k.is_delete, false) AS failed, coalesce(k.ok AND NOT k.is_delete, false) AS written FROM st FULL JOIN k ON st.id = k.id)
    SELECT 'users' AS collection, id, CASE WHEN gone OR failed THEN NULL WHEN written THEN hash ELSE known_hash END AS known_hash, CASE WHEN written OR failed THEN last_entry_id ELSE known_last END AS known_last, gone OR cd AS confirmed_deleted FROM j WHERE known OR (written AND authoritative) OR gone OR failed""")
def sd_ack(spark, sf_dir):
    acks = active_cursors(spark, sf_dir).select("collection", "id", (F.col("seq") % 4 != 0).alias("ok"), "is_delete", F.col("last_entry_id").alias("hash"), "last_entry_id", "authoritative")
    return sync.acknowledged(known_state(spark, sf_dir), acks)


TURNS = f"""{ACTIVE}, {KNOWN}, j AS (SELECT sq.*, st.id IS NOT NULL AS known, known_hash, known_last, coalesce(confirmed_deleted, false) AS cd FROM sq LEFT JOIN st ON sq.id = st.id),
    out AS (SELECT id, known, known AND known_hash IS NULL OR is_delete AS is_delete, CASE WHEN known AND known_hash IS NULL THEN CASE WHEN is_delete THEN greatest(last_entry_id, known_last) ELSE known_last END ELSE last_entry_id END AS last_entry_id,
        CASE WHEN NOT (known AND known_hash IS NULL) THEN hash END AS hash, authoritative, seq, seq % 4 <> 0 AS ok FROM j
        WHERE NOT cd AND CASE WHEN NOT known THEN authoritative ELSE known_hash IS NULL OR is_delete OR NOT (known_hash = hash AND known_last = last_entry_id) AND last_entry_id >= known_last END)"""


def dispatch_turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(what is sent, the filter at the end): all cursors, then answers to what was sent, of which a quarter fails and is sent again. Each turn
    is a run of the stream from the checkpoint of the one before."""
    own, folder = spark.newSession(), new_folder(spark, "dispatch")
    known_state(spark, sf_dir).select(F.lit("a").alias("client"), "*").write.parquet(f"{folder}/known")
    known, active = own.read.schema(dispatcher.FILTER).parquet(f"{folder}/known"), active_cursors(spark, sf_dir)
    dispatcher.keyed_state(own, known.count() + active.select("collection", "id").distinct().count())
    cursors = active.withColumn("hash", F.col("last_entry_id")).withColumns({"kind": F.lit("cursor"), "ok": F.lit(None).cast("boolean"), "client": F.lit("a")})
    sent = lambda: spark.read.schema(dispatcher.SENT).parquet(f"{folder}/sent")
    answers = lambda: sent().withColumns({"kind": F.lit("ack"), "ok": F.col("seq") % 4 != 0})
    for rows in (lambda: cursors, answers):
        rows().select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in dispatcher.EVENTS.split(", ")]).write.mode("append").parquet(f"{folder}/events")
        stream = dispatcher.dispatching(own.readStream.schema(dispatcher.EVENTS).parquet(f"{folder}/events"), known)
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/sent").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    return sent().drop("client"), dispatcher.filter_state(own, f"{folder}/checkpoint").drop("client")


@query(f"WITH {TURNS} SELECT 'users' AS collection, id, is_delete, last_entry_id, hash, authoritative, seq FROM out UNION ALL SELECT 'users', id, is_delete, last_entry_id, CASE WHEN NOT is_delete THEN hash END, authoritative, seq FROM out WHERE NOT ok")
def sd_stream_sends(spark, sf_dir):
    return dispatch_turns(spark, sf_dir)[0]


@query(f"""WITH {TURNS}, every AS (SELECT coalesce(st.id, j.id) AS id, st.id IS NOT NULL AS known, st.known_hash, st.known_last, coalesce(st.confirmed_deleted, false) OR st.id IS NULL AND j.is_delete AND NOT j.authoritative AS cd FROM st FULL JOIN j ON st.id = j.id)
    SELECT 'users' AS collection, e.id, CASE WHEN o.id IS NULL OR NOT o.is_delete AND NOT ok THEN known_hash WHEN NOT o.is_delete THEN o.hash END AS known_hash,
        CASE WHEN o.id IS NULL OR NOT o.is_delete AND NOT ok THEN known_last WHEN NOT o.is_delete OR NOT ok THEN o.last_entry_id END AS known_last, cd OR coalesce(o.is_delete AND ok, false) AS confirmed_deleted
    FROM every e LEFT JOIN out o ON e.id = o.id WHERE e.known OR cd OR o.id IS NOT NULL AND (ok OR o.is_delete)""")
def sd_stream_state(spark, sf_dir):
    return dispatch_turns(spark, sf_dir)[1]


@query(f"""WITH {ACTIVE}, l AS (SELECT record_id AS id, record_id NOT LIKE '%8' AS has_record, record_id NOT LIKE '%6' AS branch_only, max(entry_id) AS branch_id FROM log WHERE event_id % 4 = 0 AND record_id NOT LIKE '%2' GROUP BY record_id)
    SELECT sq.id, CASE WHEN l.id IS NULL AND NOT is_delete THEN 'apply' WHEN l.id IS NULL THEN 'done' WHEN NOT has_record AND NOT is_delete THEN 'refuse' WHEN NOT has_record THEN 'done' WHEN is_delete THEN 'apply delete' WHEN NOT branch_only THEN 'skip pending' WHEN last_entry_id < branch_id THEN 'skip stale' ELSE 'apply' END AS outcome FROM sq LEFT JOIN l USING (id)""")
def cr_apply(spark, sf_dir):
    local = log(spark, sf_dir).where("event_id % 4 = 0 and record_id not like '%2'").groupBy(F.col("record_id").alias("id")).agg(F.max("entry_id").alias("branch_id"))
    local = local.select("id", ~F.col("id").like("%8"), ~F.col("id").like("%6"), "branch_id").toDF("id", "has_record", "branch_only", "branch_id")
    return sync.client_applied(local, active_cursors(spark, sf_dir))


STATUS = "f AS (SELECT record_id, min_by(type, entry_id) FILTER (type <> 4) AS first, bool_or(type = 2) AS d, record_id IN (SELECT record_id FROM s) AS known FROM c GROUP BY record_id), st AS (SELECT record_id, CASE WHEN known OR coalesce(first = 0, false) THEN 'merged' WHEN d THEN 'orphan deleted' ELSE 'orphan' END AS status FROM f)"


@query(f"WITH {SIDES}, {STATUS} SELECT record_id, status FROM st")
def sr_merge(spark, sf_dir):
    return sync.received(*sides(spark, sf_dir))[1]


@query(f"WITH {SIDES}, {STATUS}, cm AS (SELECT * FROM c WHERE type <> 4 AND record_id IN (SELECT record_id FROM st WHERE status = 'merged')), {merged_sql('cm')}")
def sr_merged_log(spark, sf_dir):
    return sync.received(*sides(spark, sf_dir))[0].select("record_id", "entry_id", "type")


RECEIVED = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_custkey % 8 AS s, c_nationkey AS k FROM customer),
    lg AS (SELECT record_id, '1' AS entry_id, 0 AS type FROM c WHERE s BETWEEN 1 AND 5 UNION ALL SELECT record_id, '5', 1 FROM c WHERE s = 4 UNION ALL SELECT record_id, '3', 2 FROM c WHERE s = 5 UNION ALL SELECT record_id, '2', 0 FROM c WHERE s = 0 UNION ALL SELECT record_id, '4', 1 FROM c WHERE s IN (0, 1, 4, 5) UNION ALL SELECT record_id, '6', 2 FROM c WHERE s = 1),
    st AS (SELECT record_id, s, k + CASE s WHEN 0 THEN 1 WHEN 4 THEN 9 ELSE 0 END AS k FROM c WHERE s IN (0, 2, 3, 4)), lv AS (SELECT record_id, s, k, substr(sha256('{"id":"' || record_id || '","k":' || k || '}'), 1, 16) AS hash FROM st)"""


def received_store(spark, sf_dir) -> Store:
    """A server's log and live rows of customers, a client's request about all of them (adopted, merged, branched only with the same and with another
    hash, overtaken by the server, deleted there, and unknown ones changed or deleted), then another client's deletes; both batches come twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), (F.col("c_custkey") % 8).alias("s"), F.col("c_nationkey").alias("k"))
    null = F.lit(None).cast("string")
    doc = lambda k: F.to_json(F.struct(F.col("record_id").alias("id"), k.alias("k")))
    op = lambda k: F.array(F.struct(F.lit("replace").alias("op"), F.lit("k").alias("path"), k.cast("string").alias("value"), null.alias("position"), null.alias("hash")))
    no_ops = F.when(F.lit(False), op(F.col("k")))
    hashed = lambda text: F.substring(F.sha2(text, 256), 1, 16)  # noqa: E731  # what doc writes is canonical: a Python task has nothing to do

    def entry(where: str, name: str, kind: int, record=null, ops=no_ops) -> DataFrame:
        return c.where(where).select("record_id", F.lit(name).alias("entry_id"), F.lit(kind).alias("type"), record.alias("record"), ops.alias("ops"))

    log = entry("s between 1 and 5", "1", 0, doc(F.col("k"))).unionByName(entry("s = 4", "5", 1, ops=op(F.col("k") + 9))).unionByName(entry("s = 5", "3", 2))
    sent = entry("s = 0", "2", 0, doc(F.col("k"))).unionByName(entry("s in (1, 2, 3, 4, 5, 7)", "1", 4)).unionByName(entry("s in (0, 1, 4, 5, 6, 7)", "4", 1, ops=op(F.col("k") + 1))).unionByName(entry("s = 7", "6", 2))
    claimed = F.when(F.col("s") == 3, "old").when(F.col("s") == 2, hashed(doc(F.col("k")))).when(F.col("s") != 7, hashed(doc(F.col("k") + 1)))
    store = Store(spark, new_folder(spark, "receiver"), 8)
    rows = c.where("s between 1 and 4").select("record_id", doc(F.col("k") + F.when(F.col("s") == 4, 9).otherwise(0)).alias("live")).withColumn("hash", hashed(F.col("live")))
    every = list(range(8))
    store.commit(lambda now: {"log": ("append", "record_id", log, []), "live": ("replace", "record_id", rows, every)})
    for _ in range(2):
        receiver.receive(store, c.select("record_id", claimed.alias("client_hash")), sent, "a", 0)
        receiver.receive(store, c.where("s = 1").select("record_id", null.alias("client_hash")), entry("s = 1", "6", 2), "b", 0)
    return store


@query(f"WITH {RECEIVED} SELECT record_id, entry_id, type FROM lg")
def rc_log(spark, sf_dir):
    return received_store(spark, sf_dir).read("log").select("record_id", "entry_id", "type")


@query(f"WITH {RECEIVED} SELECT record_id, k, hash FROM lv")
def rc_live(spark, sf_dir):
    return received_store(spark, sf_dir).read("live").select("record_id", F.get_json_object("live", "$.k").cast("int").alias("k"), "hash")


@query(f"WITH {RECEIVED} SELECT record_id, CASE s WHEN 2 THEN 'branched' WHEN 3 THEN 'branched' WHEN 6 THEN 'orphan' WHEN 7 THEN 'deleted' ELSE 'merged' END AS status FROM c")
def rc_answers(spark, sf_dir):
    return received_store(spark, sf_dir).read("answers:a").select("record_id", "status")


@query(f"WITH {RECEIVED} SELECT record_id, 'active' AS cursor, CASE s WHEN 3 THEN '1' ELSE '5' END AS last_id, hash FROM lv WHERE s IN (3, 4) UNION ALL SELECT record_id, 'delete', '4', NULL FROM c WHERE s = 5")
def rc_cursors(spark, sf_dir):
    return received_store(spark, sf_dir).read("answers:a").where("cursor is not null").select("record_id", "cursor", "last_id", "hash")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey = 4 THEN 'delete' ELSE 'active' END AS cursor FROM customer WHERE c_nationkey IN (2, 4)")
def sr_disparity(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    server = customers.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    hashed = lambda df: hashing.record_hash(df, ["c_custkey", "c_name", "c_acctbal"])
    key = F.col("c_custkey").cast("string").alias("id")
    return sync.disparities(server.select(key, F.when(F.col("c_nationkey") != 4, hashed(server)).alias("server_hash")), customers.select(key, hashed(customers).alias("client_hash")))


@query(f"""WITH {ACTIVE}, {KNOWN}, cl AS (SELECT 'users' AS collection, id, CASE WHEN id NOT LIKE '%4' THEN hash END AS hash, last_entry_id FROM sq)
    SELECT 'users' AS collection, coalesce(st.id, cl.id) AS id, CASE WHEN cl.hash IS NOT NULL THEN cl.hash ELSE known_hash END AS known_hash, CASE WHEN cl.hash IS NOT NULL THEN cl.last_entry_id ELSE known_last END AS known_last,
        cl.hash IS NULL AND (cl.id IS NOT NULL OR confirmed_deleted) AS confirmed_deleted FROM st FULL JOIN cl ON st.id = cl.id""")
def sd_update_filter(spark, sf_dir):
    request = active_cursors(spark, sf_dir).select("collection", "id", F.when(~F.col("id").like("%4"), F.col("last_entry_id")).alias("hash"), "last_entry_id")
    return sync.filter_updated(known_state(spark, sf_dir), sync.mirrored(request))


@query(f"""WITH {CURSORS}, sent AS (SELECT * FROM cur WHERE seq % 3 = 0 AND id NOT LIKE '%1'), later AS (SELECT * FROM cur WHERE seq % 3 = 1), q AS (SELECT *, 0 AS turn FROM sent WHERE id LIKE '%2' OR id LIKE '%6' UNION ALL SELECT *, 1 FROM later), a AS (SELECT id, bool_or(authoritative) AS authoritative FROM q GROUP BY id)
    SELECT q.collection, q.id, is_delete, last_entry_id, hash, a.authoritative FROM q JOIN a USING (id) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY is_delete DESC, CASE WHEN is_delete THEN '' ELSE last_entry_id END DESC, turn DESC, seq DESC) = 1""")
def sd_requeue(spark, sf_dir):
    """Cursors whose id ends in 2 or 6 fail."""
    every = events_as_cursors(spark, sf_dir)
    sent = every.where("seq % 3 = 0 and id not like '%1'")
    acks = sent.select("collection", "id", ~(F.col("id").like("%2") | F.col("id").like("%6"))).distinct().toDF("collection", "id", "ok")
    return sync.requeued(sent, acks, every.where("seq % 3 = 1")).drop("seq")


@query(f"""WITH {LOG}, t AS ({state_sql('log')}) SELECT l.record_id, l.last_entry_id, CAST(t.k AS VARCHAR) AS hash, true AS authoritative FROM (SELECT record_id, max(entry_id) AS last_entry_id, coalesce(max_by(type, entry_id) FILTER (type IN (2, 3)) = 2, false) AS d FROM log GROUP BY record_id) l JOIN t USING (record_id) WHERE NOT d AND t.live UNION ALL SELECT 'unaudited', '', 'h', true""")
def cursors(spark, sf_dir):
    entries = log(spark, sf_dir)
    alive = state_of(entries).where("live").select("record_id", F.col("k").cast("string").alias("h"))
    unaudited = spark.createDataFrame([("unaudited", "h")], "record_id string, h string")
    return sync.cursors(entries, alive.unionByName(unaudited), "h", authoritative=True)


@query(f"WITH {LOG}, t AS ({state_sql('log')}) SELECT record_id, max(entry_id) AS last_id, record_id IN (SELECT record_id FROM t WHERE live) AS active FROM log GROUP BY record_id")
def j_state(spark, sf_dir):
    entries = log(spark, sf_dir)
    return sync.states(entries, state_of(entries).where("live"))


@query(f"WITH {SHORT}, {PENDING}, {LIVE} SELECT record_id, max(entry_id) AS last_id, record_id IN (SELECT record_id FROM lv) AS active FROM sh JOIN p USING (record_id) WHERE pending AND record_id LIKE '1%' GROUP BY record_id")
def j_state_pending(spark, sf_dir):
    entries = short_log(spark, sf_dir)
    return sync.states(entries, short_live(entries), only_pending=True, ids=entries.where("record_id like '1%'"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j_reconcile(spark, sf_dir):
    return sync.reconciled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).distinct())


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT (c_acctbal > 1000 AND c_nationkey < 15)")
def sub_removed(spark, sf_dir):
    found = collection(spark, sf_dir, "customer")
    return live.removed(found.matching({"c_acctbal": {"$gt": 0}}), found.matching({"c_acctbal": {"$gt": 1000}, "c_nationkey": {"$lt": 15}}), "c_custkey")


@query(f"WITH n AS ({CHANGED}), e AS (SELECT * FROM customer WHERE c_nationkey <> 9) SELECT coalesce(e.c_custkey, n.c_custkey) AS id, CASE WHEN n.c_custkey IS NULL THEN 'missing' WHEN e.c_custkey IS NULL THEN 'extra' ELSE 'mismatch' END AS issue FROM e FULL JOIN n ON e.c_custkey = n.c_custkey WHERE e.c_custkey IS NULL OR n.c_custkey IS NULL OR e.c_acctbal <> n.c_acctbal")
def integrity(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    hashed = lambda df: df.select(F.col("c_custkey").alias("id"), hashing.record_hash(df, ["c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment"]).alias("hash"))
    return sync.integrity(hashed(customers.where("c_nationkey <> 9")), hashed(changed_customers(customers)))


@query(f"WITH {LOG}, v AS (SELECT record_id AS id, event_id % 3 AS client, max(entry_id) AS l, max_by(value, entry_id) FILTER (value IS NOT NULL) AS value FROM log WHERE value IS NOT NULL GROUP BY ALL) SELECT id, client, value FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, client) = 1")
def lww_clients(spark, sf_dir):
    versions = log(spark, sf_dir).where("value is not null").groupBy(F.col("record_id").alias("id"), (F.col("event_id") % 3).alias("client")).agg(F.max("entry_id").alias("last_entry_id"), F.max_by("value", "entry_id").alias("value"))
    return sync.latest_of_clients(versions)


# Change batches and live queries


@query("""WITH g AS (SELECT event_type, ts, event_id, user_id, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 60 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    n AS (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g), sp AS (SELECT event_type, i, min(ts) AS begin, max(ts) + INTERVAL 60 MINUTE AS "end" FROM n GROUP BY ALL)
    SELECT 'events' AS collection, event_type AS op, begin, "end", user_id AS id, count(*) AS n_changes, max(event_id) AS seq, max_by(value, event_id) AS value FROM n JOIN sp USING (event_type, i) GROUP BY event_type, i, user_id, begin, "end\"""")
def debounce(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(F.lit("events").alias("collection"), F.col("event_type").alias("op"), F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), "value")
    return live.batches(changes, 3600).drop("ts")


@query(ORACLES["debounce"])
def debounce_cut(spark, sf_dir):
    """The same windows from three parts of the changes, whatever stays open between them."""
    changes = table(spark, sf_dir, "events").select(F.lit("events").alias("collection"), F.col("event_type").alias("op"), F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), "value")
    at = live.micros(F.col("ts"))
    first, second = changes.agg(F.percentile_approx(at, [0.3, 0.6])).first()[0]
    windows = live.Debouncer(Store(spark, new_folder(spark, "windows"), 8), 3600)
    told = [windows.take(changes.where(part), n) for n, part in enumerate([at <= first, (at > first) & (at <= second), at > second])]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(windows.flush(3)).drop("ts")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos, 'active' AS cursor FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, NULL, 'delete' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def sub_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    placed = lambda df: numbered(df.select(F.col("o_orderkey").alias("id")), "id", "pos")
    return live.all_emission(placed(orders.where("o_orderstatus = 'O' or o_orderstatus = 'F' and o_totalprice > 200000")), placed(orders.where("o_orderstatus = 'O'")))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'clear' WHEN 'error' THEN 'remove' ELSE 'reload' END AS type, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n_ids FROM events)
    SELECT event_id, CASE type WHEN 'clear' THEN 'remove' ELSE type END AS type, n_ids FROM e WHERE type IN ('upsert', 'remove') OR type = 'clear' AND n_ids > 0""")
def change_notices(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "upsert").when(F.col("event_type") == "click", "clear").when(F.col("event_type") == "error", "remove").otherwise("reload")
    ids = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("user_id").cast("bigint")))
    told = live.notices(table(spark, sf_dir, "events").select("event_id", kind.alias("type"), ids.alias("ids")))
    return told.select("event_id", "type", F.array_size("ids").alias("n_ids"))


@query("SELECT c_custkey AS id, n_name AS client FROM customer JOIN nation ON c_mktsegment = CASE n_regionkey WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END")
def fan_out(spark, sf_dir):
    changes = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("collection"), F.col("c_custkey").alias("id"))
    watched = F.when(F.col("n_regionkey") == 0, "BUILDING").when(F.col("n_regionkey") == 1, "MACHINERY").otherwise("AUTOMOBILE")
    return live.fanned_out(changes, table(spark, sf_dir, "nation").select(F.col("n_name").alias("client"), watched.alias("collection"))).select("id", "client")


@query("SELECT * FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def sub_query(spark, sf_dir):
    return collection(spark, sf_dir, "orders").query(Request({"o_orderpriority": {"$like": "1%"}, "o_totalprice": {"$gt": 100000}}, [("o_totalprice", "desc")], limit=30))[0]


@query("""WITH subs AS (SELECT c_custkey AS sub_id, c_custkey % 3 AS m FROM customer), o AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice AS p, o_orderdate AS d FROM orders),
    st AS (SELECT 'b' AS st, * FROM o WHERE id % 10 <> 1 UNION ALL SELECT 'a', id, o_custkey, o_orderstatus, CASE WHEN id % 10 = 3 THEN p + 1000 ELSE p END, d FROM o WHERE id % 10 <> 2),
    mem AS (SELECT st, sub_id, m, id, CASE m WHEN 0 THEN -p ELSE epoch(d) END AS rank FROM subs JOIN st ON o_custkey = sub_id WHERE m = 0 OR m = 1 AND o_orderstatus = 'O' AND p >= 50000
        UNION ALL SELECT st, sub_id, m, id, p FROM subs JOIN st ON id BETWEEN 10 * sub_id AND 10 * sub_id + 25 WHERE m = 2),
    pg AS (SELECT st, sub_id, m, id, row_number() OVER (PARTITION BY st, sub_id ORDER BY rank, id) AS n FROM mem),
    cut AS (SELECT st, sub_id, id, CASE m WHEN 2 THEN n - 2 ELSE n END AS pos FROM pg WHERE CASE m WHEN 0 THEN n <= 5 WHEN 1 THEN n <= 3 ELSE n > 2 AND n <= 12 END),
    t AS (SELECT st, sub_id, count(*) AS total FROM mem GROUP BY ALL), c AS (SELECT st, sub_id, count(*) AS n, CAST(sum(pos * id) AS BIGINT) AS order_sum, list(id ORDER BY pos) AS ids FROM cut GROUP BY ALL),
    ans AS (SELECT k.st, sub_id, coalesce(total, 0) AS total, coalesce(n, 0) AS n, coalesce(order_sum, 0) AS order_sum, ids FROM (SELECT DISTINCT st, sub_id FROM subs CROSS JOIN (VALUES ('a'), ('b')) v(st)) k LEFT JOIN t USING (st, sub_id) LEFT JOIN c USING (st, sub_id))
    SELECT x.sub_id, x.total, x.n, x.order_sum FROM ans x JOIN ans y ON x.sub_id = y.sub_id AND x.st = 'a' AND y.st = 'b' WHERE x.total <> y.total OR x.ids IS DISTINCT FROM y.ids""")
def sub_many(spark, sf_dir):
    """A subscription for each customer, and what is told after a tenth of the orders came, a tenth went and a tenth changed its price."""
    key, kind = F.col("c_custkey").cast("long"), F.col("c_custkey") % 3
    own, low = F.col("c_custkey").cast("string"), key.cast("double") * 10
    equal = F.when(kind == 0, F.create_map(F.lit("o_custkey"), own)).when(kind == 1, F.create_map(F.lit("o_custkey"), own, F.lit("o_orderstatus"), F.lit("O")))
    between = lambda field, low, high: F.array(F.struct(F.lit(field).alias("field"), low.alias("low"), high.alias("high")))
    ranges = F.when(kind == 1, between("o_totalprice", F.lit(50000.0), F.lit(None).cast("double"))).when(kind == 2, between("o_orderkey", low, low + 25))
    sort = F.when(kind == 1, "placed").otherwise("o_totalprice")
    subs = table(spark, sf_dir, "customer").select(key.alias("sub_id"), equal.alias("equal"), ranges.alias("ranges"), sort.alias("sort"), (kind == 0).alias("descending"), F.when(kind == 2, 2).otherwise(0).alias("skip"), F.when(kind == 0, 5).when(kind == 1, 3).otherwise(10).alias("most"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.unix_timestamp("o_orderdate").alias("placed"))
    digit = F.col("o_orderkey") % 10
    dearer = F.when(digit == 3, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice"))
    found = subscriptions.QuerySubscriptions(Store(spark, new_folder(spark, "subscriptions"), 16), "o_orderkey", ["o_custkey", "o_orderstatus"], ["o_orderkey", "o_totalprice", "placed"])
    found.subscribe(subs, orders.where(digit != 1), 0)
    told = found.take(orders.where(digit.isin(2, 3)), orders.where(digit.isin(1, 3)).withColumn("o_totalprice", dearer), 1)
    sums = found.page().groupBy("sub_id").agg(F.sum(F.col("pos") * F.col("id")).alias("order_sum"))
    return told.join(sums, "sub_id", "left").select("sub_id", "total", "n", F.coalesce("order_sum", F.lit(0)).alias("order_sum"))


@query("WITH d AS (SELECT c_custkey // 4096 AS run, sha256(string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey)) AS digest FROM customer GROUP BY run) SELECT sha256(string_agg(digest, '|' ORDER BY run)) AS result_hash FROM d")
def result_hash(spark, sf_dir):
    return live.hash_of(table(spark, sf_dir, "customer").withColumn("pos", F.col("c_custkey")), "c_custkey")
