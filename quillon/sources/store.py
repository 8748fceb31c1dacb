"""Tables that change together: numbered manifests, each published by one create-if-absent, name the folders that count.

A commit writes its data under names of its own and then publishes the next manifest; where another writer was first, it starts again from
what that one left. A reader takes one manifest and so sees all tables of one commit or none of it. Local folders publish by a hard link,
HDFS by a rename that is refused where the name exists; a store whose rename replaces (most object stores) isn't safe for several writers.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder beneath the one that driver and executors share (``spark.checkpoint.dir``); only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Manifests:
    """Numbered JSON files in a folder, of which each number is written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(str(x.getPath().getName()) for x in self.files.listStatus(path)) if self.files.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(f"{self.folder}/manifests") if n[:1] == "v" and n[1:].isdigit())

    def _content(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/v{number}", wholetext=True).first()[0])

    def _publish(self, number: int, manifest: dict) -> bool:
        """False if the number is taken."""
        here, there = f"{self.folder}/manifests/{uuid.uuid4().hex}.part", f"{self.folder}/manifests/v{number}"
        out = self.files.create(self._path(here))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self.files.getUri().getScheme() == "file":
                os.link(self._path(here).toUri().getPath(), self._path(there).toUri().getPath())  # a local rename would replace
                done = True
            else:
                return not self.files.exists(self._path(there)) and bool(self.files.rename(self._path(here), self._path(there)))
        except FileExistsError:
            done = False
        self.files.delete(self._path(here), False)
        return done

    def _stage(self, df: DataFrame, *by: str) -> str:
        """Write rows under a name of their own, which is returned."""
        name = f"data/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.folder}/{name}")
        return name

    def scratch(self, df: DataFrame) -> DataFrame:
        """Rows written once beside the tables, and read from there; ``clear_scratch`` deletes them."""
        name = f"scratch/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        self._scratch = [*getattr(self, "_scratch", []), name]
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def clear_scratch(self) -> None:
        for name in getattr(self, "_scratch", []):
            self._delete(name)
        self._scratch = []

    def _delete(self, name: str) -> None:
        self.files.delete(self._path(f"{self.folder}/{name}"), True)

    def drop(self) -> None:
        self.files.delete(self._path(self.folder), True)


class Store(Manifests):
    """Several tables, each cut into buckets by the hash of a key, so that a commit reads and writes only the buckets that it touches. Batches
    of a source are numbered and count once: a repeated one changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder)
        self.buckets = buckets

    def newest(self) -> tuple[int, dict]:
        numbers = self.numbers()
        return (numbers[-1], self._content(numbers[-1])) if numbers else (-1, {"tables": {}, "sources": {}})

    def bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of a one-column DataFrame's keys; there are ``buckets`` of them at most."""
        (key,) = keys.columns
        return [r[0] for r in keys.where(F.col(key).isNotNull()).select(self.bucket(key)).distinct().collect()]

    def read(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table, or some buckets of it, as a manifest has it (the newest one if none is given)."""
        table = (manifest or self.newest()[1])["tables"].get(name)
        if table is None:
            return None
        schema = T.StructType.fromJson(table["schema"])
        wanted = table["folders"].keys() if buckets is None else map(str, buckets)
        folders = [f"{self.folder}/{f}" for b in wanted for f in table["folders"].get(b, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, build: Callable[[dict], dict[str, tuple[str, str, DataFrame, list[int]]]], source: str | None = None, batch: int | None = None, tries: int = 20) -> bool:
        """``build`` gets a manifest and returns for each table that changes (mode, key, rows, buckets): with ``replace`` the rows take the place of
        these buckets' rows, with ``append`` they are added. It is called again where another writer was first. False for a batch of
        ``source`` that was there."""
        for _ in range(tries):
            number, now = self.newest()
            if source is not None and now["sources"].get(source, -1) >= batch:
                return False
            tables, staged = {**now["tables"]}, []
            for name, (mode, key, rows, buckets) in build(now).items():
                folder = self._stage(rows.withColumn(BUCKET, self.bucket(key)).hint("rebalance", BUCKET), BUCKET)  # a hot bucket is several files
                staged.append(folder)
                found = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.folder}/{folder}") if n.startswith(BUCKET)}
                old = tables.get(name, {"folders": {}})["folders"]
                kept = old if mode == "append" else {b: f for b, f in old.items() if int(b) not in set(buckets)}
                tables[name] = {"schema": rows.schema.jsonValue(), "folders": {**kept, **{b: [*kept.get(b, []), f] for b, f in found.items()}}}
            sources = now["sources"] if source is None else {**now["sources"], source: batch}
            if self._publish(number + 1, {"tables": tables, "sources": sources}):
                return True
            for folder in staged:
                self._delete(folder)
        raise RuntimeError(f"{tries} commits in a row were overtaken")

    def compact(self, name: str, key: str) -> None:
        """Give each bucket of a table one folder."""

        def build(now: dict):
            rows = self.read(name, manifest=now)
            return {name: ("replace", key, rows, list(range(self.buckets)))} if rows is not None else {}

        self.commit(build)
