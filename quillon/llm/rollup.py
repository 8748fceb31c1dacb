"""Token-count rollups kept up to date by signed deltas (operator 2).

A batch is summed to (source, lang, version, n_docs, n_tokens) before anything is written: an insert counts +1 and its
tokens, a delete -1 and minus its tokens, a revised count the difference. Totals are the sums over all batches, so batches
may come in any order.

A store is a folder of data folders, each written under a new name, and of numbered manifests. A manifest lists the data
folders that count and the identifiers of all batches in them. A commit or a compaction writes its data first, then the
next manifest, by one rename that fails where that number exists; who loses the race reads the newest manifest and tries
again. Readers take the newest manifest only, so they see a batch wholly or not at all, once, before, during and after
a compaction; stopped anywhere, both can be repeated. ``vacuum`` deletes folders that no manifest has named for long enough.

Nulls: a null source or language is a group of its own; a null count is 0. Rows of one id each count. Totals of zero
documents and tokens stay as rows, so that a reader sees the group emptied. An empty batch commits, and changes nothing.
"""

from __future__ import annotations

import json
import os
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, new_path, pieces, replace_column
from quillon.llm.tokens import count_tokens, words_in

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def inserted(rows: DataFrame) -> DataFrame:
    """Deltas of new (source, lang, version, n_tokens) rows."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    return inserted(rows).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Deltas of (source, lang, version, n_tokens, new_tokens) rows: documents counted anew."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.coalesce("new_tokens", F.lit(0)) - F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


class RollupStore:
    """The Hadoop file system that Spark itself uses holds the manifests, so any store that Spark can write will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.store = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(str(x.getPath().getName()) for x in self.store.listStatus(path)) if self.store.exists(path) else []

    def _newest(self) -> tuple[int, dict]:
        """The number and content of the newest manifest."""
        numbers = [int(n) for n in self._names(f"{self.folder}/manifests") if n.isdigit()]
        if not numbers:
            return 0, {"batches": [], "folders": []}
        text = self.spark.read.text(f"{self.folder}/manifests/{max(numbers):012d}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _publish(self, number: int, manifest: dict) -> bool:
        """Make ``manifest`` the one of this number; False if there is one already."""
        here, there = f"{self.folder}/manifests/{uuid.uuid4().hex}.part", f"{self.folder}/manifests/{number:012d}"
        out = self.store.create(self._path(here))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        local = self._path(here).toUri().getPath()
        try:
            if self.store.getUri().getScheme() == "file":
                os.link(local, self._path(there).toUri().getPath())  # a local rename would replace
                os.unlink(local)
                return True
            # refused where the name exists
            if not self.store.exists(self._path(there)) and self.store.rename(self._path(here), self._path(there)):
                return True
        except FileExistsError:
            pass
        self.store.delete(self._path(here), False)
        return False

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._newest()[1]["batches"]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if it was there, also where another driver adds it at the same time."""
        if self.committed(batch_id):
            return False
        name = f"data/{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.parquet(f"{self.folder}/{name}")
        while True:
            number, now = self._newest()
            if batch_id in now["batches"]:
                return False
            if self._publish(number + 1, {"batches": [*now["batches"], batch_id], "folders": [*now["folders"], name]}):
                return True

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{f}" for f in folders]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._read(self._newest()[1]["folders"])

    def compact(self, label: str = "folded") -> None:
        """Fold the data folders into one (``label`` only begins its name); batches keep their identifiers, so that a late repeat is still refused."""
        old = self._newest()[1]["folders"]
        if len(old) < 2:
            return
        name = f"data/{label}-{uuid.uuid4().hex}"
        self._read(old).write.parquet(f"{self.folder}/{name}")
        while True:
            number, now = self._newest()
            if not set(old) <= set(now["folders"]):
                return  # another compaction was first
            if self._publish(number + 1, {"batches": now["batches"], "folders": [name, *(f for f in now["folders"] if f not in old)]}):
                return

    def vacuum(self, older_than_s: float = 7 * 86_400) -> None:
        """Delete data folders and unfinished manifests that the newest manifest doesn't name and that are old enough for no reader or writer to need them."""
        number, now = self._newest()
        kept = {*now["folders"], f"manifests/{number:012d}"}
        for folder in ("data", "manifests"):
            for name in self._names(f"{self.folder}/{folder}"):
                path = self._path(f"{self.folder}/{folder}/{name}")
                if f"{folder}/{name}" not in kept and self.store.getFileStatus(path).getModificationTime() / 1000 <= time.time() - older_than_s:
                    self.store.delete(path, True)


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(source, lang, blank, words, tokens) of each document: white-space words and the tokenizer's ids of the whole text."""

    def run(batches):
        for piece in pieces(batches):
            text = replace_column(piece, "text")
            words = words_in(text)
            yield pa.record_batch([replace_column(piece, "source"), replace_column(piece, "lang"), pa.array(words == 0), pa.array(words, pa.int64()), pa.array(count_tokens(text, tokenizer), pa.int64())], names=["source", "lang", "blank", "words", "tokens"])

    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "source string, lang string, blank boolean, words long, tokens long")


def maintained_totals(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """The life of a rollup over all documents: loaded under one tokenizer, loaded under the next, revised (each document's
    end mark counts too), blank documents deleted, and the first batch sent twice."""
    rows = cut(counted(docs, tokenizer), "counts")
    store = RollupStore(spark, new_path(spark, "rollup"))
    first = inserted(rows.select("source", "lang", F.lit("words-1").alias("version"), F.col("words").alias("n_tokens")))
    bpe = rows.select("source", "lang", "blank", F.lit("bpe-1").alias("version"), F.col("tokens").alias("n_tokens"), (F.col("tokens") + 1).alias("new_tokens"))
    blank = bpe.where("blank").select(*KEYS, F.col("new_tokens").alias("n_tokens"))
    store.commit("0001-words", first)
    store.commit("0002-bpe", inserted(bpe))
    store.commit("0003-end-marks", revised(bpe))
    store.commit("0004-blank", deleted(blank).unionByName(deleted(rows.where("blank").select("source", "lang", F.lit("words-1").alias("version"), F.col("words").alias("n_tokens")))))
    store.commit("0001-words", first)
    return store.totals()
