"""Phrase collocation mining by pivot partitioning (operator 12), after MG-FSM.

The words of each language are counted first. They are ordered by their counts (equal ones by hash), and every phrase of two or
three words belongs to its rarest word, its pivot. Around each occurrence of a word a task keeps the neighbours that a phrase
with this pivot may reach: up to two words on each side, as far as they are frequent enough and not rarer than the pivot (to the
left not the pivot itself either, so that a phrase with its pivot twice is counted once, at the first one). Equal fragments are
counted, and those of one pivot leave the task as one row. Reducers mine the fragments of their pivots: a phrase's whole count lies
with its pivot's owner, and only phrases of the least count or more are emitted. A pivot with more than ``HOT`` occurrences is
split by its fragments' hash over several reducers, whose partial counts are added up. Scores, cuts and nested phrases are joins of
the frequent phrases alone.

The words' counts that order them are looked up in hash arrays in the shared folder, which workers map; they only route:
two words of one hash would share a place in the order, and counts would stay right.

Nulls, ties: a null text is empty, a null lang is ``und``. Equal scores go by higher count, then by the phrase's UTF-8 bytes.
Repeated rows count each time. A piece of text without words gives nothing; an empty table gives no rows. Long texts: a text longer than
a piece of 8 MiB is one piece. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, cut, new_path, pieces, replace_column, take_words, text_bytes, word_spans
from quillon.llm.kneser_ney import FILE_WORDS, HashArrays, mix

LEAST, NESTED, TOP = 10, 50, 2000
#: Characters that end a piece: [.,;:!?\x0A-\x0D]; words are parted by these and by space and tab.
STOP = np.zeros(256, bool)
STOP[[10, 11, 12, 13, *b".,;:!?"]] = True
WORD = ~STOP
WORD[[9, 32]] = False
INNER = np.ones(256, bool)
INNER[[10, 32]] = False
#: Bytes of text whose fragments a reducer's group holds on average, at most; occurrences of a pivot from which it is split.
GROUP_BYTES, HOT = 8 << 20, 1 << 18
#: Fragments that a task spells out at a time, about: it keeps numbers of the others.
SPELLED = 1 << 17
ROWS = "lang string, phrase string, whole boolean, a long"


class Words:
    """The words of some texts: their numbers (words of different languages differ), and which of them follow the one before directly."""

    def __init__(self, piece: pa.RecordBatch):
        data, offsets = text_bytes(replace_column(piece, "text"))
        data = LOWER[data]
        begin, end, before = word_spans(data, offsets, WORD)
        coded = take_words(data, begin, end).dictionary_encode()
        self.languages = replace_column(piece, "lang").dictionary_encode()
        lang = np.repeat(self.languages.indices.to_numpy().astype(np.int64), np.diff(before))
        n = max(len(self.languages.dictionary), 1)
        pairs = pa.array(coded.indices.to_numpy().astype(np.int64) * n + lang).dictionary_encode()
        pair, self.tokens = pairs.dictionary.to_numpy(), pairs.indices.to_numpy()
        self.lang, self.text = pair % n, coded.dictionary.take(pa.array(pair // n))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.languages.dictionary.to_pylist()), np.uint64, len(self.languages.dictionary))
        self.keys = mix(hashes[pair // n] + mix(seeds[pair % n])) if len(pair) else np.zeros(0, np.uint64)
        stops = np.searchsorted(np.flatnonzero(STOP[data]), begin)
        self.follows = np.zeros(len(begin) + 1, bool)  # one more, so that no word follows the last
        self.follows[1 : len(begin)] = stops[1:] == stops[:-1]
        self.follows[before[:-1][before[:-1] < len(begin)]] = False


def _strings(values: pa.Array) -> pa.Array:
    return values.cast(pa.large_binary()).view(pa.large_string())


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, key, n) of the words with ``least`` occurrences or more, and of each language's occurrences of all words, with a null word."""

    def counted(piece):
        w = Words(piece)
        times = np.bincount(w.tokens, minlength=len(w.text)).astype(np.int64)
        names = w.languages.dictionary
        every = np.bincount(w.lang, times, len(names)).astype(np.int64)
        return pa.record_batch(
            [pa.concat_arrays([names.take(pa.array(w.lang)), names]).cast(pa.string()), pa.concat_arrays([_strings(w.text), pa.nulls(len(names), pa.large_string())]), pa.array(np.concatenate([w.keys.view(np.int64), np.zeros(len(names), np.int64)])), pa.array(np.concatenate([times, every]))],
            names=["lang", "word", "key", "n"],
        )

    def run(batches):
        for piece in pieces(batches):
            yield counted(piece)

    rows = docs.mapInArrow(run, "lang string, word string, key long, n long")
    return cut(rows.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()), "word-counts")


class Counts:
    """Counts by hash, in files by the hash's upper bits."""

    def __init__(self, bits: int, files: dict[int, str]):
        self.bits, self.files = bits, files
        self.opened: dict[int, HashArrays] = {}

    def __getstate__(self):
        return {"bits": self.bits, "files": self.files, "opened": {}}

    @staticmethod
    def write(words: DataFrame) -> Counts:
        """Of words (key, n); a key that stands in several rows has their sum."""
        spark, count = words.sparkSession, words.count()
        folder, bits = new_path(spark, "word-order"), max(0, int(np.ceil(np.log2(max(count, 1) / FILE_WORDS))))

        def file(group: pa.Table) -> pa.Table:
            key, n = group["key"].to_numpy().view(np.uint64), group["n"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            part = group["part"][0].as_py()
            return pa.table({"part": pa.array([part], pa.int32()), "file": [HashArrays.write(f"{folder}/{part}", key[head], np.add.reduceat(n, head))]})

        part = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        rows = words.select(part.alias("part"), "key", "n").groupBy("part").applyInArrow(file, "part int, file string").collect()  # one row for 2^20 words
        return Counts(bits, {r.part: r.file for r in rows})

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        order = np.argsort(keys)
        part = (keys[order] >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for p in np.unique(part).tolist():
            if p in self.files:
                if p not in self.opened:
                    self.opened[p] = HashArrays(self.files[p])
                own = order[part == p]
                out[own] = self.opened[p].get(keys[own], 1)[0]
        return out


def fragments(w: Words, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fragments of some texts as rows of five word numbers (minus one: none; the pivot is in the middle), and their counts. ``n`` has
    the words' counts."""
    by = np.lexsort((w.keys, n))
    steps = np.concatenate([[0], np.cumsum((n[by][1:] != n[by][:-1]) | (w.keys[by][1:] != w.keys[by][:-1]))]) if len(by) else np.zeros(0, np.int64)
    place = np.empty(len(by), np.int32)
    place[by] = steps
    size = len(w.tokens)
    rank = np.full(size + 4, -1, np.int32)  # two places before and after, for the neighbours of the ends
    rank[2:-2] = np.where(n >= least, place, -1)[w.tokens]
    follows = np.zeros(size + 4, bool)
    follows[2 : size + 3] = w.follows
    own = rank[2:-2]
    left = follows[2:-2] & (rank[1:-3] > own)
    left2 = left & follows[1:-3] & (rank[:-4] > own)
    right = follows[3:-1] & (rank[3:-1] >= own)
    right2 = right & follows[4:] & (rank[4:] >= own)
    keep = np.flatnonzero((own >= 0) & (left | right))
    word = np.concatenate([[-1, -1], w.tokens, [-1, -1]]).astype(np.int32)
    rows = np.empty((len(keep), 5), np.int32)
    for c, there in enumerate((left2, left, None, right, right2)):
        rows[:, c] = word[keep + c] if there is None else np.where(there[keep], word[keep + c], -1)
    h = np.zeros(len(rows), np.uint64)
    for c in (2, 1, 3, 0, 4):
        h = mix(h + (rows[:, c] + 2).astype(np.uint64))
    order = np.argsort(h, kind="stable")
    rows = rows[order]
    head = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[head], np.diff(np.append(head, len(rows)))


def _mined(rows: pa.Table, least: int) -> pa.Table:
    """The phrases of a reducer's fragments; those of pivots that lie whole in it only from ``least`` occurrences on."""
    texts = _strings(pa.concat_arrays([c.cast(pa.large_binary()) for c in rows["fragments"].chunks]))
    data, offsets = text_bytes(texts)
    begin, end, before = word_spans(data, offsets, INNER)
    coded = take_words(data, begin, end).dictionary_encode()
    words = coded.indices.to_numpy()
    counts, lefts = (np.concatenate([np.frombuffer(x, kind) for x in rows[c].to_pylist()]) for c, kind in (("counts", np.uint32), ("lefts", np.uint8)))
    per_row = np.array([len(x) for x in rows["lefts"].to_pylist()], np.int64)
    names = rows["lang"].combine_chunks().dictionary_encode()
    # the language, and whether the pivot lies here as a whole, as one number
    kind = np.repeat(names.indices.to_numpy() * 2 + rows["whole"].to_numpy().astype(np.int32), per_row)
    first = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(data == 10), begin), prepend=-1)) if len(begin) else np.zeros(0, np.int64)
    # every row ends with a line feed, so a fragment is a line
    sizes, pivot = np.diff(np.append(first, len(begin))), first + lefts
    rights = sizes - 1 - lefts
    found = []
    for back, length in ((1, 2), (0, 2), (2, 3), (1, 3), (0, 3)):
        own = np.flatnonzero((lefts >= back) & (rights >= length - 1 - back))
        at = pivot[own] - back
        third = words[at + 2] + 1 if length == 3 else np.zeros(len(own), np.int32)
        found.append((kind[own], words[at], words[at + 1], third, counts[own]))
    kind, one, two, three, times = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.lexsort((three, two, one, kind))
    kind, one, two, three, times = (x[order] for x in (kind, one, two, three, times))
    new = (kind[1:] != kind[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1])
    head = np.flatnonzero(np.concatenate([[True], new])) if len(kind) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, head, dtype=np.int64) if len(head) else times.astype(np.int64)
    keep = (times >= least) | (kind[head] % 2 == 0)
    head, times = head[keep], times[keep]
    spelled = coded.dictionary
    parts = [spelled.take(pa.array(one[head])), spelled.take(pa.array(two[head])), spelled.take(pa.array(three[head] - 1, mask=three[head] == 0))]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    return pa.table({"lang": names.dictionary.take(pa.array(kind[head] // 2)), "phrase": _strings(phrase).cast(pa.string()), "whole": pa.array(kind[head] % 2 == 1), "a": pa.array(times)})


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """(lang, phrase, a) of the phrases of two and three words with ``least`` occurrences or more."""
    counts = Counts.write(words.where("word is not null"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(2, -(-size // group_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def packed(piece):
        w = Words(piece)
        n = sent.value.get(w.keys)
        rows, times = fragments(w, n, least)
        salts = -(-n // hot)  # over how many groups a pivot's fragments go
        h = np.zeros(len(rows), np.uint64)
        for c in (0, 1, 3, 4):
            h = mix(h + np.where(rows[:, c] >= 0, w.keys[rows[:, c]], np.uint64(1)))
        salt = (h % np.maximum(salts[rows[:, 2]], 1).astype(np.uint64)).astype(np.int32)
        order = np.lexsort((salt, rows[:, 2]))
        rows, times, salt = rows[order], times[order], salt[order]
        pivot = rows[:, 2]
        heads = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])])) if len(rows) else np.zeros(0, np.int64)
        every = np.append(heads, len(rows))
        # spelled out some pivots at a time
        parts = np.unique(np.append(np.searchsorted(every, np.arange(0, len(rows), SPELLED)), len(heads)))
        for a, b in zip(parts[:-1].tolist(), parts[1:].tolist()):
            edges = every[a : b + 1]
            own, head = rows[edges[0] : edges[-1]], edges[:-1]
            edges = edges - edges[0]
            spelled = [w.text.take(pa.array(own[:, c], mask=own[:, c] < 0)) for c in range(5)]
            texts = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
            texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            # whole lines end to end: a row's fragments are one run of bytes
            ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)[edges]
            blobs = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends.astype(np.int64)), texts.buffers()[2]])
            lefts, sizes = (own[:, :2] >= 0).sum(1).astype(np.uint8), times[head[0] : head[0] + len(own)].astype(np.uint32)
            group = (mix(w.keys[pivot[head]] + salt[head].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(groups)).astype(np.int32)
            columns = [pa.array(group), w.languages.dictionary.take(pa.array(w.lang[pivot[head]])).cast(pa.string()), pa.array(salts[pivot[head]] <= 1), blobs.cast(pa.binary()), *(pa.array([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])], pa.binary()) for x in (lefts, sizes))]
            yield pa.record_batch(columns, names=["group", "lang", "whole", "fragments", "lefts", "counts"])

    def run(batches):
        for piece in pieces(batches):
            yield from packed(piece)

    sent_out = docs.mapInArrow(run, "group int, lang string, whole boolean, fragments binary, lefts binary, counts binary")
    # as many tasks as groups, so that a task's input stays near a group's
    mined = sent_out.repartition(groups, "group").groupBy("group").applyInArrow(lambda rows: _mined(rows, least), ROWS)
    return cut(mined.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, nested: int = NESTED, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two and three words that occur ``least`` times, without those that lie in a longer one
    with ``nested`` per cent of their count or more, by falling score; the first ``top`` (None: all)."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = word_counts(read, least)
    phrases = frequent_phrases(read, words, least)
    word = words.where("word is not null")
    split = phrases.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    of_word = lambda name, count: word.select("lang", F.col("word").alias(name), F.col("n").alias(count))
    of_pair = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    ends = split.select("lang", "phrase", "a", F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"), (F.size("w") == 3).alias("long"), F.concat_ws(" ", F.slice("w", 1, 2)).alias("head"), F.concat_ws(" ", F.slice("w", -2, 2)).alias("tail"))
    ends = ends.join(of_word("first", "n_first"), ["lang", "first"]).join(of_word("last", "n_last"), ["lang", "last"])

    def cut_at(left: str, right: str):
        # whole numbers below 10^38: exact for counts below 10^15
        score = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    longer = ends.where("long").join(of_pair("head", "n_head"), ["lang", "head"]).join(of_pair("tail", "n_tail"), ["lang", "tail"])
    early, late = cut_at("n_first", "n_tail"), cut_at("n_head", "n_last")
    threes = longer.withColumn("early", early).withColumn("late", late).select("lang", "phrase", "a", F.when(F.col("late.score") < F.col("early.score"), F.col("late")).otherwise(F.col("early")).alias("cut"))
    within = ends.where("long").select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"), F.col("a").alias("more")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    twos = ends.where("not long").join(within, ["lang", "phrase"], "left").where(F.coalesce(F.col("more") * 100 < F.col("a") * nested, F.lit(True))).select("lang", "phrase", "a", cut_at("n_first", "n_last").alias("cut"))
    every = twos.unionByName(threes).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = every.withColumn("rank", rank.cast("long"))
    totals = words.where("word is null").select("lang", "n")
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
