"""Sources and sinks: tables, snapshot differences, change rows, seeding, and versioned folders that batches and streams replace at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.collection import numbered
from quillon.sources.store import Manifests


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def snapshot_changes(before: DataFrame, after: DataFrame, id_column: str) -> DataFrame:
    """(id, op): insert, update or delete between two snapshots; records that are equal make no event."""
    fields = sorted(set(before.columns) - {id_column})
    old = before.select(F.col(id_column).alias("id"), F.struct(*fields).alias("old"))
    new = after.select(F.col(id_column).alias("id"), F.struct(*fields).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return old.join(new, "id", "full_outer").select("id", op.alias("op")).where("op is not null")


def change_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of change rows from files that are added to a folder."""
    return spark.readStream.schema(schema).parquet(path)


def normalised(changes: DataFrame) -> DataFrame:
    """Change rows (op, before, after, ...) as insert, update or delete; other kinds, and those that change nothing, are left out."""
    op = F.lower("op")
    named = F.when(op.isin("create", "insert"), "insert").when(op.isin("update", "replace"), "update").when(op == "delete", "delete")
    return changes.withColumn("op", named).where("op is not null").where(~F.col("before").eqNullSafe(F.col("after")) | (F.col("op") == "delete"))


def from_stored(df: DataFrame) -> DataFrame:
    """Stored documents carry their id as ``_id``."""
    return df.withColumnRenamed("_id", "id")


def to_stored(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "_id")


def seeded(existing: DataFrame, fixed: DataFrame, create: DataFrame, count: int | None = None, id_column: str = "id", valid: Column | None = None, corrected: DataFrame | None = None) -> DataFrame:
    """A collection seeded to ``count`` records (default: as many as there are): fixed ones added or replaced, others trimmed by id,
    missing ones taken from ``create``. Of those that stay, the ones for which ``valid`` isn't true are made anew under their id, from
    ``corrected`` where it has them, else from a spare record of ``create``."""
    others = existing.join(fixed.select(id_column), id_column, "left_anti")
    n_fixed, n_others = (df.count() for df in (fixed, others))
    room = n_others if count is None else max(0, count - n_fixed)
    kept = others if room >= n_others else others.orderBy(id_column).limit(room)
    spare = create.join(existing.select(id_column), id_column, "left_anti").join(fixed.select(id_column), id_column, "left_anti")
    missing = max(0, room - n_others)
    if valid is not None:
        bad = kept.where(~F.coalesce(valid, F.lit(False)))
        source = corrected if corrected is not None else spare.limit(0)
        given = source.join(bad.select(id_column), id_column, "left_semi")
        # who has no correction takes the values of the spare record of the same rank after the missing ones
        anew = numbered(bad.join(source.select(id_column), id_column, "left_anti").select(id_column), id_column, "_n")
        values = numbered(spare, id_column, "_n").where(F.col("_n") > missing).withColumn("_n", F.col("_n") - missing).drop(id_column)
        made = anew.join(values, "_n").drop("_n").select(*existing.columns)
        kept = kept.join(bad.select(id_column), id_column, "left_anti").unionByName(given).unionByName(made)
    return fixed.unionByName(kept).unionByName(spare.orderBy(id_column).limit(missing))


def seed_hash(fixed: DataFrame) -> str:
    """What tells whether fixed records are those of the last seeding, in any order; seeding may be left out while it stays the same."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(fixed.columns)))).cast("decimal(38,0)")
    return "-".join(map(str, fixed.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()))


def deduplicated(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with repeated keys the first by ``order`` stays (a migration copy)."""
    rest = [c for c in entries.columns if c not in keys]
    kept = entries.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in entries.columns])


def replaced(log: DataFrame, audits: DataFrame) -> DataFrame:
    """The log after whole audits were written over those of their records."""
    return log.join(audits.select("record_id").distinct(), "record_id", "left_anti").unionByName(audits.select(*log.columns))


class Versions(Manifests):
    """A table as numbered versions, each a manifest that names its folder: a reader sees a version whole or not at all, and of writers
    that race each gets a version of its own. A stream's batch is written under its own number, so a repeated batch changes nothing."""

    def read(self, number: int | None = None) -> DataFrame | None:
        """The newest version, or this one."""
        numbers = self.numbers()
        number = number if number is not None else numbers[-1] if numbers else None
        return None if number not in numbers else self.spark.read.parquet(f"{self.folder}/{self._content(number)['folder']}")

    def write(self, df: DataFrame, number: int | None = None) -> bool:
        """Write the next version, or this one; False if it or a later one is there."""
        if number is not None and number <= max(self.numbers(), default=-1):
            return False
        folder = self._stage(df)
        while True:
            last = max(self.numbers(), default=-1)
            if number is not None and number <= last:
                self._delete(folder)
                return False
            if self._publish(last + 1 if number is None else number, {"folder": folder}):
                return True

    def keep(self, most: int = 2) -> None:
        """Delete all versions but the last ``most``."""
        for n in self.numbers()[:-most]:
            folder = self._content(n)["folder"]
            self._delete(f"manifests/v{n}")
            self._delete(folder)
