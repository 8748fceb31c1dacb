"""Interpolated modified Kneser-Ney bigram model (operator 4).

Words are 64-bit hashes. A task counts the word pairs of its training texts and sends each bucket one packed blob of
them; a bucket's reducer adds them up and writes them as a sorted array of pair hashes with counts. Buckets follow the bytes
of text. A bucket holds a context's pairs, and a frequent context is spread over ``SPLITS`` buckets or more by the following
word, so none meets whole in one task. From the pairs come each word's count, continuation count, and its numbers of
followers seen once, twice and oftener, as rows that Spark sums by word; they are written as sorted hash arrays too. Workers
map the files into memory and score a text by binary search: nothing of the model passes through the driver but a few totals
and the files' names.

A text is its words and one end; the first word's context is the start. P(w|h) = max(c(hw) - D, 0) / c(h) + g(h) P(w),
P(w) likewise from continuation counts, and below it one share for each known word and one for all others.

Nulls, ties: a null text is empty, that is, one end token. A null doc_id is held out from nothing. Repeated rows count
each time. An empty table gives no rows; without training texts every known count is 0 and P is uniform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, crc_of, cut, map_file, new_path, pieces, replace_column, take_words, text_bytes, word_spans, write_file

SPLITS = 8
#: Bytes of text whose pairs a bucket holds on average, at most.
BUCKET_BYTES = 16 << 20
#: Words of a word file, on average, at most.
FILE_WORDS = 1 << 20
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PIECE = 8 << 20
STATS = ("count", "continuations", "followed", "once", "twice", "oftener")
COUNTS = ("ones", "twos", "threes", "fours")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants), so that close numbers get unrelated ones."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(3) + mix(word))


def splits_for(buckets: int) -> int:
    """Over how many buckets a context is spread: one with a sixteenth of all words adds an average bucket to each at most."""
    return max(SPLITS, -(-buckets // 16))


def pair_buckets(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(context + (word % np.uint64(splits_for(buckets))) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(buckets)).astype(np.int64)


def word_buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words % np.uint64(buckets)).astype(np.int64)


def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (the last two are end and start), the texts' tokens as numbers, each text led by its start, and their offsets."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    begin, end, before = word_spans(data, offsets)
    coded = take_words(data, begin, end).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    n = len(hashes)
    # before each text its start, after it its end
    tokens = np.insert(coded.indices.to_numpy().astype(np.int64), np.repeat(before, 2)[1:-1], np.tile([n + 1, n], len(before) - 1))
    return np.append(hashes, [END, START]), tokens, before + 2 * np.arange(len(before))


def _transitions(tokens: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """context * n + word of each token but the starts."""
    keep = np.ones(len(tokens), bool)
    keep[offsets[:-1]] = False
    at = np.flatnonzero(keep)
    return tokens[at - 1] * n + tokens[at]


def _small(x: np.ndarray) -> np.ndarray:
    """In as few bytes as all values allow."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs sorted by context: each context and each word once, then small numbers."""
    contexts, runs = np.unique(context, return_counts=True)
    words, at = np.unique(word, return_inverse=True)
    parts = [contexts, words, *map(_small, (runs, count, at))]
    head = np.array([x for part in parts for x in (len(part), part.itemsize)], np.uint32)
    return zstandard.compress(b"".join(x.tobytes() for x in (head, *parts)), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    head, p, out = np.frombuffer(raw, np.uint32, 10).tolist(), 40, []
    for n, size in zip(head[0::2], head[1::2]):
        out.append(np.frombuffer(raw, f"<u{size}", n, p))
        p += n * size
    contexts, words, runs, count, at = out
    return np.repeat(contexts, runs), words[at], count.astype(np.uint32)


def _by(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and each column's sum for them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], *(np.add.reduceat(c[order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64) for c in columns)


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


class HashArrays:
    """A file of ascending 64-bit hashes with columns of numbers; looked up by binary search in mapped memory."""

    def __init__(self, uri: str):
        self.data = map_file(uri)
        self.n, self.width = self.data[:16].view(np.uint64).tolist()
        self.keys = self.data[16 : 16 + 8 * self.n].view(np.uint64)

    @staticmethod
    def write(uri: str, keys: np.ndarray, *columns: np.ndarray) -> str:
        """The file's name. Columns are written in four bytes each where all numbers fit, else in eight."""
        wide = any(len(c) and int(c.max()) >= 1 << 32 for c in columns)
        kind = np.uint64 if wide else np.uint32
        return write_file(uri, iter([np.array([len(keys), kind().itemsize], np.uint64).tobytes(), keys.tobytes(), *(c.astype(kind).tobytes() for c in columns)]))

    def get(self, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """The columns for ``keys`` (best ascending); 0 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        there = self.keys[at] == keys
        kind, start, size = (np.uint64 if self.width == 8 else np.uint32), 16 + 8 * self.n, self.width * self.n
        return [np.where(there, self.data[start + k * size : start + (k + 1) * size].view(kind)[at].astype(np.int64), 0) for k in range(columns)]


@dataclass
class Model:
    folder: str
    buckets: int
    word_buckets: int
    pair_files: dict[int, str]  # by bucket, the names within the folder of the attempts that were committed
    word_files: dict[int, str]
    tokens: int
    words: int
    types: int
    discounts: list[float]
    word_discounts: list[float]
    rest: float  # what the words' discounts leave to all words alike

    def _lookup(self, files: dict[int, str], keys: np.ndarray, bucket: np.ndarray, columns: int) -> list[np.ndarray]:
        order = np.lexsort((keys, bucket))
        sorted_buckets = bucket[order]
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        heads = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]])) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]):
            if (name := files.get(int(sorted_buckets[a]))) is not None:
                own = order[a:b]
                for column, values in zip(out, _open(f"{self.folder}/{name}").get(keys[own], columns)):
                    column[own] = values
        return out

    def words_of(self, hashes: np.ndarray) -> list[np.ndarray]:
        return self._lookup(self.word_files, hashes, word_buckets_of(hashes, self.word_buckets), len(STATS))

    def pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._lookup(self.pair_files, pair_keys(context, word), pair_buckets(context, word, self.buckets), 1)[0]

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, the base's and the model's log10 probability."""
        hashes, tokens, offsets = pairs_of(column)
        n = len(hashes)
        count, continuations, followed, once, twice, oftener = self.words_of(hashes)
        d = np.array([0.0, *self.word_discounts])
        lower = (np.maximum(continuations - d[np.minimum(continuations, 3)], 0) / max(self.types, 1)) + self.rest / (self.words + 1)
        left = (self.discounts[0] * once + self.discounts[1] * twice + self.discounts[2] * oftener) / np.maximum(followed, 1)
        left = np.where(followed > 0, left, 1.0)
        pair, back = np.unique(_transitions(tokens, offsets, n), return_inverse=True)
        context, word = pair // n, pair % n
        both = self.pairs(hashes[context], hashes[word])
        d = np.array([0.0, *self.discounts])
        p = np.log10(np.maximum(both - d[np.minimum(both, 3)], 0) / np.maximum(followed[context], 1) + left[context] * lower[word])
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - 1)
        texts = len(offsets) - 1
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        sums = lambda values: np.bincount(owner, values, texts)
        return np.diff(offsets) - 1, sums((count[word] > 0)[back].astype(float)).astype(np.int64), sums(base[word][back]), sums(p[back])


_mapped: dict[str, HashArrays] = {}


def _open(uri: str) -> HashArrays:
    if uri not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[uri] = HashArrays(uri)
    return _mapped[uri]


def discounts(of_counts: list[int]) -> list[float]:
    """The three modified discounts; where the counts of counts don't allow them, a half of each count's step."""
    n1, n2, n3, n4 = of_counts
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(found, 1)]


def train(docs: DataFrame) -> Model:
    """Count all texts of ``docs`` (text) and write the model's files into a new shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    folder, buckets = new_path(spark, "kneser-ney"), max(2, -(-size // BUCKET_BYTES))

    def count(batches):
        for piece in pieces(batches, most=PIECE):
            hashes, tokens, offsets = pairs_of(replace_column(piece, "text"))
            pair, times = np.unique(_transitions(tokens, offsets, len(hashes)), return_counts=True)
            context, word = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
            bucket = pair_buckets(context, word, buckets)
            order = np.lexsort((context, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            blobs = [_pack(*(x[order[edges[b] : edges[b + 1]]] for x in (context, word, times))) for b in full]
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def write_pairs(rows: pa.Table) -> pa.Table:
        """Sums of a bucket's words, and one row more: its file, and how many pairs occur once to four times."""
        here = rows["bucket"][0].as_py()
        context, word, times = (np.concatenate(x) for x in zip(*(_unpack(b.as_py()) for b in rows["blob"])))
        keys = pair_keys(context, word)
        order = np.argsort(keys, kind="stable")
        keys, context, word, times = (x[order] for x in (keys, context, word, times))
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, context, word, times = keys[head], context[head], word[head], np.add.reduceat(times.astype(np.int64), head)
        name = HashArrays.write(f"{folder}/pairs-{here}", keys, times)
        counts_of_counts = _of_counts(times)
        del keys, order
        # each side is summed by itself first, to hold little at once
        contexts, followed, once, twice, oftener = _by(context, times, times == 1, times == 2, times > 2)
        words, count, continuations = _by(word, times, np.ones(len(times), bool))
        del context, word, times
        none, nought = np.zeros(len(contexts), np.int64), np.zeros(len(words), np.int64)
        found = _by(np.concatenate([contexts, words]), *(np.concatenate(x) for x in ((none, count), (none, continuations), (followed, nought), (once, nought), (twice, nought), (oftener, nought))))
        n, empty = len(found[0]), np.zeros(1, np.int64)
        columns = {"word": pa.array(np.append(found[0].view(np.int64), 0), mask=np.arange(n + 1) == n)}
        columns |= {s: pa.array(np.append(x, empty)) for s, x in zip(STATS, found[1:])}
        columns |= {c: pa.array(np.append(np.zeros(n, np.int64), x)) for c, x in zip(COUNTS, counts_of_counts)}
        pa.default_memory_pool().release_unused()
        return pa.table(columns | {"bucket": pa.array(np.full(n + 1, here, np.int32)), "file": pa.array([None] * n + [name.rpartition("/")[2]], pa.string())})

    blobs = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, blob binary")
    longs = lambda names: ", ".join(f"{n} long" for n in names)
    # as many tasks as buckets, so that a task's input stays near a bucket's
    sums = cut(blobs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(write_pairs, f"word long, {longs(STATS)}, {longs(COUNTS)}, bucket int, file string"), "sums")
    pair_rows = sums.where("file is not null").select("bucket", "file", *COUNTS).collect()  # one row per bucket
    words = cut(sums.where("file is null").groupBy("word").agg(*[F.sum(s).alias(s) for s in STATS]), "words")
    known, continued = F.col("count") > 0, F.col("continuations")
    exactly = [F.count_if(continued == k) for k in (1, 2, 3, 4)]
    n_words, tokens, n_known, types, more, *of_counts = words.agg(F.count("*"), F.sum("count"), F.count_if(known), F.sum("continuations"), F.count_if(continued > 2), *exactly).first()
    word_buckets = max(1, -(-n_words // FILE_WORDS))

    def write_words(batches):
        """Rows that come in the order of bucket and word: a file for each bucket."""
        held: list[pa.RecordBatch] = []

        def file() -> pa.RecordBatch:
            here, word, *stats = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2 + len(STATS)))
            order = np.argsort(word.view(np.uint64), kind="stable")
            name = HashArrays.write(f"{folder}/words-{here[0]}", word.view(np.uint64)[order], *(s[order] for s in stats))
            return pa.record_batch([pa.array(here[:1]), pa.array([name.rpartition("/")[2]])], names=["bucket", "file"])

        for batch in batches:
            here = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(here[1:] != here[:-1]) + 1).tolist(), len(here)] if len(here) else []
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column(0)[0].as_py() != here[a]:
                    yield file()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield file()

    # the unsigned remainder of a signed long
    half = (1 << 63) % word_buckets
    bucket = F.pmod(F.pmod(F.col("word"), F.lit(word_buckets)) + F.when(F.col("word") < 0, F.lit(2 * half % word_buckets)).otherwise(0), F.lit(word_buckets)).cast("int").alias("bucket")
    word_rows = words.select(bucket, "word", *STATS).repartition(word_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(write_words, "bucket int, file string").collect()  # one row per file
    total = np.sum([[r[c] for c in COUNTS] for r in pair_rows] or [[0] * 4], axis=0).tolist()
    word_discounts = discounts(of_counts)
    kinds = [of_counts[0], of_counts[1], more]
    rest = sum(d * k for d, k in zip(word_discounts, kinds)) / types if types else 1.0
    return Model(folder, buckets, word_buckets, {r.bucket: r.file for r in pair_rows}, {r.bucket: r.file for r in word_rows}, tokens or 0, n_known, types or 0, discounts(total), word_discounts, rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in pieces(batches, most=PIECE):
            m = sent.value
            n, known, base, own = m.score(replace_column(piece, "text"))
            yield pa.record_batch([replace_column(piece, "doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / n))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, fold: int = 7, remainder: int = 2) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id's text mod ``fold`` isn't ``remainder``."""
    held_out = F.coalesce(crc_of("doc_id") % fold == remainder, F.lit(False))
    return score(docs, train(docs.where(~held_out))).withColumn("held_out", held_out)
