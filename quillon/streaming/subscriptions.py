"""Many query subscriptions kept up at once: an index over what they ask finds those that a batch of changes concerns, and only these are counted,
ordered and compared with what they were told last.

A subscription (sub_id, equal map<string,string>, ranges array<struct<field, low, high>>, sort string, descending boolean, skip int, most int) asks for the
records whose fields equal all of ``equal`` and lie in all ranges (both ends belong to them, null is open), ordered by a number field and then by id,
nulls last, ``most`` of them (null: all) after the first ``skip``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.store import Store

SUBSCRIPTION = "sub_id long, equal map<string,string>, ranges array<struct<field: string, low: double, high: double>>, sort string, descending boolean, skip int, most int"
LEVELS = (-20, 60)


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("string")


class QuerySubscriptions:
    """Subscriptions on one collection, with their records, totals and pages in a store, cut by subscription; each batch is one commit.

    Each subscription stands in the index under one of its terms: an equality with the first of ``equal`` that it asks for (name the most
    selective field first), else its narrowest closed range, under the one or two cells of a grid as wide as the range, so that candidates are few whatever
    the number of subscriptions, else under the term that every record has. A batch reads the buckets of the subscriptions that it concerns. A subscription that is
    asked for with ``most`` sorts no more than its page in a task; one without orders all its records."""

    def __init__(self, store: Store, id_column: str, equal: list[str], numbers: list[str]):
        self.store, self.id, self.equal, self.numbers = store, id_column, equal, numbers

    def indexed(self, subs: DataFrame) -> DataFrame:
        """Subscriptions with what they ask of each field (``asks``), the kind of term under which they stand, and its values (kind, cell), a row each."""
        closed = F.filter("ranges", lambda r: r.low.isNotNull() & r.high.isNotNull() & (r.low <= r.high) & (F.abs(r.low) < 1e18) & (F.abs(r.high) < 1e18))
        sized = F.transform(closed, lambda r: F.struct(F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.ceil(F.log2(F.greatest(r.high - r.low, F.lit(1e-6)))).cast("int"))).alias("level"), r.field.alias("field"), r.low.alias("low"), r.high.alias("high")))
        subs = subs.withColumn("_range", F.array_min(sized))
        level = F.col("_range.level")
        grid = F.struct(F.concat(F.lit("@"), level.cast("string"), F.lit(" "), F.col("_range.field")).alias("kind"), F.array_distinct(F.array(_cell(F.col("_range.low"), level), _cell(F.col("_range.high"), level))).alias("cells"))
        where = F.when(F.col("_range").isNotNull(), grid).otherwise(F.struct(F.lit("").alias("kind"), F.array(F.lit("")).alias("cells")))
        for field in reversed(self.equal):
            where = F.when(F.col("equal")[field].isNotNull(), F.struct(F.lit(f"={field}").alias("kind"), F.array(F.col("equal")[field]).alias("cells"))).otherwise(where)
        return self._asking(subs).withColumn("_where", where).select("*", F.col("_where.kind").alias("kind"), F.explode("_where.cells").alias("cell")).drop("_where", "_range")

    def _asking(self, subs: DataFrame) -> DataFrame:
        """Subscriptions with their equalities and ranges by the place of their field (``asks``), so that a record is compared with columns; ``never`` if no
        record can fit."""
        of = lambda field: lambda r: r.field == field
        own = {f"_own{i}": F.filter("ranges", of(f)) for i, f in enumerate(self.numbers)}
        names = lambda fields: F.array(*map(F.lit, fields)).cast("array<string>")
        unknown = [F.size(F.array_except(F.map_keys("equal"), names(self.equal))) > 0, F.exists(F.map_values("equal"), F.isnull), F.size(F.array_except(F.col("ranges.field"), names(self.numbers))) > 0]
        asks = [reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in unknown]).alias("never")]
        asks += [F.col("equal")[f].alias(f"equal{i}") for i, f in enumerate(self.equal)]
        for i in range(len(self.numbers)):
            asks += [F.coalesce(F.size(f"_own{i}") > 0, F.lit(False)).alias(f"ranged{i}"), F.array_max(f"_own{i}.low").alias(f"low{i}"), F.array_min(f"_own{i}.high").alias(f"high{i}")]
        return subs.withColumns(own).withColumn("asks", F.struct(*asks)).drop(*own)

    def matches(self, index: DataFrame, records: DataFrame) -> DataFrame:
        """(sub_id, id, rank) of the records that subscriptions (as ``indexed``) ask for."""
        kinds = [r.kind for r in index.select("kind").distinct().collect()]  # fields and their 81 levels at most
        terms = []
        for kind in kinds:
            if kind.startswith("@"):
                level, _, field = kind[1:].partition(" ")
                value = _cell(F.col(field).cast("double"), F.lit(int(level)))
            else:
                value = F.col(kind[1:]).cast("string") if kind else F.lit("")
            terms.append(F.struct(F.lit(kind).alias("kind"), value.alias("cell")))
        if not terms:
            terms = [F.struct(F.lit("").alias("kind"), F.lit("").alias("cell"))]
        values = [F.col(f).cast("string").alias(f"_equal{i}") for i, f in enumerate(self.equal)] + [F.col(f).cast("double").alias(f"_number{i}") for i, f in enumerate(self.numbers)]
        asked = records.select(F.col(self.id).alias("id"), *values, F.explode(F.array(*terms)).alias("_t")).select("*", "_t.*").drop("_t").where("cell is not null")
        fits = F.lit(True)
        for i in range(len(self.equal)):
            fits &= F.col(f"asks.equal{i}").isNull() | F.coalesce(F.col(f"_equal{i}") == F.col(f"asks.equal{i}"), F.lit(False))
        key = F.lit(None).cast("double")
        for i, f in enumerate(self.numbers):
            x, low, high = F.col(f"_number{i}"), F.col(f"asks.low{i}"), F.col(f"asks.high{i}")
            fits &= ~F.col(f"asks.ranged{i}") | (x.isNotNull() & (low.isNull() | (x >= low)) & (high.isNull() | (x <= high)))
            key = F.when(F.col("sort") == f, x).otherwise(key)
        # the cell first: it parts the sorted rows, kinds are few
        found = asked.join(index.where("not asks.never").select("sub_id", "asks", "sort", "descending", "kind", "cell"), ["cell", "kind"]).where(fits)
        return found.select("sub_id", "id", F.struct(key.isNull().alias("none"), F.when(F.col("descending"), -key).otherwise(key).alias("key")).alias("rank"))

    @staticmethod
    def pages(members: DataFrame, subs: DataFrame) -> DataFrame:
        """(sub_id, pos, id), the page of each subscription in its order, from 1."""
        frame = subs.select("sub_id", F.coalesce("skip", F.lit(0)).alias("skip"), "most").distinct()
        bound = frame.agg(F.max(F.coalesce(F.col("skip") + F.col("most"), F.lit(-1))).alias("far"), F.bool_or(F.col("most").isNull()).alias("all")).first()
        placed = members.withColumn("_n", F.row_number().over(Window.partitionBy("sub_id").orderBy("rank", "id")))
        if bound.far is not None and not bound.all:
            placed = placed.where(F.col("_n") <= max(bound.far, 0))  # so each task keeps no more of a subscription before the shuffle
        inside = placed.join(frame, "sub_id").where("_n > skip and (most is null or _n <= skip + most)")
        return inside.select("sub_id", (F.col("_n") - F.col("skip")).cast("long").alias("pos"), "id")

    def _answers(self, members: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
        scratch = self.store.scratch
        counted = members.groupBy("sub_id").agg(F.count("*").alias("total"))
        totals = subs.select("sub_id").distinct().join(counted, "sub_id", "left").select("sub_id", F.coalesce("total", F.lit(0)).alias("total"))
        return scratch(totals), scratch(self.pages(members, subs))

    @staticmethod
    def _told(totals: DataFrame, pages: DataFrame) -> DataFrame:
        sizes = pages.groupBy("sub_id").agg(F.count("*").alias("n"))
        return totals.join(sizes, "sub_id", "left").select("sub_id", "total", F.coalesce("n", F.lit(0)).alias("n"))

    def _commit(self, build, batch: int) -> DataFrame:
        try:
            self.store.commit(build, "subscriptions", batch)
        finally:
            self.store.clear_scratch()
        return self.store.read("told")

    def subscribe(self, subs: DataFrame, records: DataFrame, batch: int) -> DataFrame:
        """New subscriptions (of ids that aren't there) over the records as they are; (sub_id, total, n) of each."""

        def build(now: dict):
            index = self.store.scratch(self.indexed(subs.repartition("sub_id")))
            members = self.store.scratch(self.matches(index, records))
            totals, pages = self._answers(members, subs)
            added = {"subs": index, "members": members, "totals": totals, "pages": pages}
            return {**{name: ("append", "sub_id", rows, []) for name, rows in added.items()}, "told": ("replace", "sub_id", self._told(totals, pages), list(range(self.store.buckets)))}

        return self._commit(build, batch)

    def take(self, before: DataFrame, after: DataFrame, batch: int) -> DataFrame:
        """A batch of changes, as the changed records were (none for new ones) and are (none for deleted ones), each record once; (sub_id, total, n) of the
        subscriptions whose total or page is another one now."""
        store = self.store

        def build(now: dict):
            index = store.read("subs", manifest=now)
            old, new = store.scratch(self.matches(index, before)), store.scratch(self.matches(index, after))
            concerned = store.scratch(old.select("sub_id").union(new.select("sub_id")).distinct())
            touched = store.touched(concerned)
            had = {name: store.read(name, touched, now) for name in ("members", "totals", "pages")}
            members = store.scratch(had["members"].join(old, ["sub_id", "id"], "left_anti").unionByName(new))
            asked = index.drop("kind", "cell").join(concerned, "sub_id", "left_semi")
            totals, pages = self._answers(members.join(concerned, "sub_id", "left_semi"), asked)
            differs = had["totals"].join(totals.withColumnRenamed("total", "now"), "sub_id").where("total <> now").select("sub_id")
            was = had["pages"].join(concerned, "sub_id", "left_semi").withColumnRenamed("id", "was")
            moved = was.join(pages, ["sub_id", "pos"], "full_outer").where("not was <=> id").select("sub_id")
            told = self._told(totals, pages).join(differs.union(moved).distinct(), "sub_id", "left_semi")
            kept = {name: had[name].join(concerned, "sub_id", "left_anti").unionByName(rows) for name, rows in (("totals", totals), ("pages", pages))}
            changed = {"members": members, **kept}
            return {**{name: ("replace", "sub_id", rows, touched) for name, rows in changed.items()}, "told": ("replace", "sub_id", told, list(range(store.buckets)))}

        return self._commit(build, batch)

    def end(self, ids: DataFrame, batch: int) -> None:
        """Forget subscriptions (sub_id)."""

        def build(now: dict):
            touched = self.store.touched(ids)
            rest = {name: self.store.read(name, touched, now).join(ids, "sub_id", "left_anti") for name in ("subs", "members", "totals", "pages")}
            return {name: ("replace", "sub_id", rows, touched) for name, rows in rest.items()}

        self._commit(build, batch)

    def page(self) -> DataFrame:
        """(sub_id, pos, id) of all subscriptions as they were told last."""
        return self.store.read("pages")


def changed(before: DataFrame, after: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Of two states of a collection the records that differ, as they were and are."""
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in before.columns])
    both = before.alias("b").join(after.alias("a"), same, "inner").select(F.col(f"b.{id_column}").alias(id_column))
    return before.join(both, id_column, "left_anti"), after.join(both, id_column, "left_anti")
