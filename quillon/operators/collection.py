"""Collections: named DataFrames of records with an id, and the query API over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.filters import apply_filter, quoted


#: Ids of a request that are few enough to be sent to every task.
SMALL = 100_000


@dataclass(frozen=True)
class Request:
    filters: Mapping | None = None
    sorts: str | list | None = None
    limit: int | None = None
    offset: int = 0
    accurate_total: bool = True


def sort_columns(sorts: str | Iterable | None) -> list:
    """Nulls first ascending, last descending; any direction but 'desc' ascends; a bare name ascends."""
    pairs = [(sorts, "asc")] if isinstance(sorts, str) else [(s, "asc") if isinstance(s, str) else tuple(s) for s in sorts or []]
    return [F.col(quoted(p)).desc_nulls_last() if d == "desc" else F.col(quoted(p)).asc_nulls_first() for p, d in pairs]


def numbered(df: DataFrame, order: str | Iterable, name: str) -> DataFrame:
    """Rows with their place in the whole order (from 1) as column ``name``, without a window over all rows in one task: each range of the
    sorted rows is numbered by itself and starts after the sizes of those before it. The order must be total. The sorted rows stay on the
    executors' disks until the session drops its caches."""
    # kept, so that sizes and rows come from one and the same sort
    rows = df.orderBy(*sort_columns(order)).drop(name).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")).persist(StorageLevel.DISK_ONLY)
    part, within = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # of a row for each task
    starts = rows.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = rows.select("row", part, within.alias("within")).join(F.broadcast(starts), "part")
    return placed.select("row.*", (F.col("start") + F.col("within") + 1).alias(name))


@dataclass(frozen=True)
class Collection:
    """``on_query`` may rewrite a request before it is compiled (row-level security)."""

    name: str
    df: DataFrame
    id: str = "id"
    on_query: Callable[[Request], Request] | None = None
    unique: tuple[str, ...] = field(default=())

    def get_all(self) -> DataFrame:
        return self.df

    def get(self, ids, ordered: bool = False) -> DataFrame:
        """Records of one id or several; missing ones are left out. ``ordered`` adds ``pos`` and follows the request."""
        if not isinstance(ids, (list, tuple, set)):
            ids = [ids]
        if not ordered:
            return self.df.where(F.col(self.id).isin(list(ids)))
        spark = self.df.sparkSession
        wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "_want"))
        if len(ids) <= SMALL:
            wanted = F.broadcast(wanted)
        return self.df.join(wanted, F.col(self.id) == F.col("_want")).drop("_want").orderBy("pos")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """Records whose id is in a one-column DataFrame of any size; Spark chooses the join."""
        return self.df.join(ids.toDF(self.id), self.id, "left_semi")

    def get_through(self, ids: DataFrame, source: DataFrame) -> DataFrame:
        """Local records, and from ``source`` those of the ids that are missing here."""
        wanted = ids.toDF(self.id)
        here = self.by_ids(ids)
        return here.unionByName(source.join(wanted.join(self.df, self.id, "left_anti"), self.id, "left_semi"))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("total"))

    def exists(self, key) -> bool:
        return not self.get(key).limit(1).isEmpty()

    def matching(self, filters: Mapping | None) -> DataFrame:
        return apply_filter(self.df, self._request(Request(filters)).filters)

    def find(self, filters: Mapping) -> DataFrame:
        """The first match by id."""
        return self.matching(filters).orderBy(self.id).limit(1)

    def _request(self, request: Request) -> Request:
        return self.on_query(request) if self.on_query else request

    def query(self, request: Request) -> tuple[DataFrame, DataFrame]:
        """The page, and its total as a one-row DataFrame (of all matches, or of the page)."""
        request = self._request(request)
        found = apply_filter(self.df, request.filters)
        page = found.orderBy(*sort_columns(request.sorts), F.col(self.id).asc()) if request.sorts or request.limit is not None or request.offset else found
        if request.offset:
            page = page.offset(request.offset)
        if request.limit is not None:
            page = page.limit(request.limit)
        return page, (found if request.accurate_total else page).agg(F.count("*").alias("total"))

    def table_request(self, request: Request | None = None) -> tuple[DataFrame, DataFrame]:
        request = request or Request()
        return self.query(replace(request, filters=request.filters or {}, sorts=request.sorts or self.id))

    def distinct_values(self, path: str, filters: Mapping | None = None, sorts=None) -> DataFrame:
        """Distinct values of a path, null among them. Sorting by another path takes each value's least."""
        found = self.matching(filters)
        if not sorts:
            return found.select(F.col(quoted(path)).alias("value")).distinct()
        keys = [(sorts, "asc")] if isinstance(sorts, str) else [(s, "asc") if isinstance(s, str) else tuple(s) for s in sorts]
        least = found.groupBy(F.col(quoted(path)).alias("value")).agg(*[F.min(quoted(p)).alias(f"_{i}") for i, (p, _) in enumerate(keys)])
        return least.orderBy(*sort_columns([(f"_{i}", d) for i, (_, d) in enumerate(keys)])).select("value")

    def distinct_records(self, path: str, filters: Mapping | None = None) -> DataFrame:
        """One whole record per value: the one with the least id. Rows are reduced in each task before they are shuffled."""
        found = self.matching(filters)
        kept = found.groupBy(F.col(quoted(path)).alias("_value")).agg(F.min_by(F.struct("*"), self.id).alias("_record"))
        return kept.select("_record.*")

    def duplicates(self, *paths: str) -> DataFrame:
        """Keys that break a declared unique index."""
        return self.df.groupBy(*paths).count().where("count > 1")

    def upsert(self, records: DataFrame, order: str | None = None) -> DataFrame:
        """The collection after whole-record replacement; of several records of one id the last by ``order``, and records equal to
        the old ones change nothing."""
        fields = self.df.columns
        new = records
        if order:
            new = records.groupBy(self.id).agg(F.max_by(F.struct(*fields), order).alias("_r")).select("_r.*")
        both = self.df.select(self.id, F.struct(*fields).alias("_old")).join(new.select(self.id, F.struct(*fields).alias("_new")), self.id, "full_outer")
        return both.select(F.coalesce("_new", "_old").alias("_r")).select("_r.*")

    def news(self, records: DataFrame) -> DataFrame:
        """The records that this collection lacks or has otherwise: an equal one is no change and makes no entry."""
        fields = self.df.columns
        old = self.df.select(self.id, F.struct(*fields).alias("_old"))
        joined = records.join(old, self.id, "left").where(~F.struct(*fields).eqNullSafe(F.col("_old")))
        return joined.select(*records.columns)

    def synchronised(self, upserts: DataFrame, deletes: DataFrame, valid=None) -> tuple[DataFrame, DataFrame]:
        """The collection after a batch of whole records, then of ids that go, and each id's result (id, error; null: done). A record with a
        null id, or for which the column ``valid`` isn't true, is refused and its old state stays; who is in both batches goes."""
        error = F.when(F.col(self.id).isNull(), "no id")
        if valid is not None:
            error = error.when(~F.coalesce(valid, F.lit(False)), "not valid")
        judged = upserts.withColumn("_error", error)
        written = Collection(self.name, self.df, self.id).upsert(judged.where("_error is null").drop("_error"))
        gone = deletes.toDF(self.id).distinct()
        results = judged.select(F.col(self.id).alias("id"), F.col("_error").alias("error")).unionByName(gone.select(F.col(self.id).alias("id"), F.lit(None).cast("string").alias("error")))
        return written.join(gone, self.id, "left_anti"), results.groupBy("id").agg(F.max("error").alias("error"))

    def remove(self, ids: DataFrame) -> DataFrame:
        return self.df.join(ids.toDF(self.id), self.id, "left_anti")


@dataclass
class Hooks:
    """What runs around a collection's requests and changes."""

    on_query: Callable[[Request], Request] | None = None
    on_after_upsert: Callable[[DataFrame, DataFrame], None] | None = None  # inserted and updated records
    on_after_delete: Callable[[DataFrame], None] | None = None
    on_seed: Callable[[], DataFrame] | None = None


class Registry:
    """Named collections and their hooks. Extending a collection again replaces the hooks that are given and keeps the others."""

    def __init__(self):
        self._known: dict[str, Collection] = {}
        self._hooks: dict[str, Hooks] = {}

    def define(self, collection: Collection) -> Collection:
        self._known[collection.name] = collection
        return self[collection.name]

    def __getitem__(self, name: str) -> Collection:
        hooks = self._hooks.get(name)
        return replace(self._known[name], on_query=hooks.on_query) if hooks and hooks.on_query else self._known[name]

    def extend(self, name: str, **hooks) -> None:
        self._hooks[name] = replace(self._hooks.get(name, Hooks()), **hooks)

    def hooks(self, name: str) -> Hooks:
        return self._hooks.get(name, Hooks())

    def seeded(self, name: str) -> DataFrame:
        """The collection with what its seed hook adds or replaces."""
        hook = self.hooks(name).on_seed
        return self._known[name].upsert(hook()) if hook else self._known[name].df

    def after(self, name: str, batches: DataFrame) -> None:
        """Run the hooks on one batch of changes (op, id, record...); subscribers are told after this returns."""
        hooks = self.hooks(name)
        if hooks.on_after_upsert:
            hooks.on_after_upsert(batches.where("op = 'insert'"), batches.where("op = 'update'"))
        if hooks.on_after_delete:
            hooks.on_after_delete(batches.where("op = 'delete'").select("id"))
