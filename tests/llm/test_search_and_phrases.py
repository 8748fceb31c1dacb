"""Exact top-k, phrase mining and hard negatives against brute force, on odd rows too."""

import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives, phrases, top_k, vectors

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, part string, rank int"


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def rows_of(seed, n=400, size=6, wide=1.0):
    """Random vectors, a third of them one and the same, and odd ones: null, empty, other lengths, not finite, repeated and null ids."""
    r = random.Random(seed)
    hot = [r.uniform(-wide, wide) for _ in range(size)]
    rows = [(i, hot if i % 3 == 0 else [r.uniform(-wide, wide) for _ in range(size)], r.choice([0, 1, 2, 3, None])) for i in range(n)]
    rows += [(-20, [0.5] * size, 1), (10_000, [0.25] * (size + 2), 2), (10_020, [0.25] * (size - 3), 2), (10_040, [], 1), (10_060, None, 1), (10_080, [None] * size, 1), (10_100, [float("nan")] * size, 1), (10_120, [float("-inf")] * size, 0)]
    rows += [(20, rows[20][1], 2), (20, rows[7][1], 3), (21, hot, 1), (None, hot, 1), (10_140, [-0.0] * size, 3)]
    return [(*x, "c", "p", 1) for x in rows]


def top_k_brute(rows, every, k):
    kept = [(i, whole(v)) for i, v, *_ in rows if i is not None and whole(v) is not None]
    out = []
    for q, v in kept:
        if q % every == 0:
            scored = sorted((-dot(v, w), i) for i, w in kept if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("wide", [1.0, 5_000.0, 1e6])
def test_top_k_equals_brute_force(spark, wide):
    rows = rows_of(1, wide=wide)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    for k, block, shard, fan in ((5, 2048, 1 << 20, 16), (3, 7, 2000, 2)):
        got = top_k.search(df.where("vec_id % 20 = 0"), df, k, block, shard, fan)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == top_k_brute(rows, 20, k)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", 0), (1, [3.0, 1.0], 1, "", "", 0)], VECTORS)
    assert [tuple(r) for r in top_k.search(df.where("vec_id = 0"), df, 5).collect()] == [(0, 1, 1, 256 * 256 * 5)]
    assert top_k.search(df.limit(0), df).count() == 0 and top_k.search(df, df.limit(0)).count() == 0


def test_products_are_exact_at_every_width():
    r = np.random.default_rng(1)
    for top in (200, 1 << 20, 1 << 40):
        a, b = (r.integers(-top, top, (n, 9)).astype(float) for n in (4, 5))
        assert [[int(x) for x in line] for line in vectors.products(a, b)] == [[dot([int(x) for x in p], [int(x) for x in q]) for q in b] for p in a]
    huge = vectors.TopLists(1, 2)
    with pytest.raises(OverflowError):
        huge.add(np.array([0]), np.array([[1 << 70]], object), np.array([1]))


def negatives_brute(rows, every):
    kept = [(i, whole(v), c) for i, v, c, *_ in rows if i is not None and c is not None and whole(v) is not None]
    out = []
    for a, v, c in kept:
        if a % every == 0:
            scored = sorted((-dot(v, w), i, d) for i, w, d in kept)
            for p, i in [(-s, i) for s, i, d in scored if d == c and i != a][:5]:
                within = [(-s, j) for s, j, d in scored if d != c and 80 * p <= 100 * -s <= 100 * p][:5]
                out += [(a, i, n + 1, j, p, s) for n, (s, j) in enumerate(within)]
    return sorted(out)


@pytest.mark.parametrize(("wide", "shift", "sample", "segment", "block"), [(1.0, 0.0, 50_000, 16_384, 2048), (1.0, 0.6, 60, 9, 3), (3_000.0, 0.3, 100, 50, 1000), (1e6, 0.2, 100, 50, 1000)])
def test_hard_negatives_equal_brute_force(spark, wide, shift, sample, segment, block):
    rows = [(i, v and [x if x is None else x + shift * wide for x in v], *more) for i, v, *more in rows_of(2, wide=wide)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, sample=sample, segment=segment, block=block)
    want = negatives_brute(rows, 20)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", 0), (1, [3.0, 1.0], 1, "", "", 0), (2, [3.0, 0.5], 2, "", "", 0)], VECTORS)
    assert [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 5 * 65536, 4 * 65536)]
    assert hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0


def test_bounds_save_work(monkeypatch):
    """Searches near their own cluster read few of many clusters far from each other."""
    r = np.random.default_rng(3)
    centres = np.eye(32) * 1000
    lists = hard_negatives.Lists.__new__(hard_negatives.Lists)
    members = {c: centres[c] + r.integers(-3, 4, (50, 32)) for c in range(32)}
    lists.clusters, lists.centres = np.arange(32), centres
    lists.segments = {c: [{"radius": float(np.sqrt(np.square(members[c] - centres[c]).sum(1).max())), "n": 50, "size": 32, "cluster": c}] for c in range(32)}
    lists.radius = np.array([lists.segments[c][0]["radius"] for c in range(32)])
    read = []
    monkeypatch.setattr(hard_negatives.Lists, "load", staticmethod(lambda s: read.append(s["cluster"]) or (np.arange(50) + 50 * s["cluster"], np.arange(50) % 2, members[s["cluster"]])))
    free = np.full(3, np.inf)
    found = hard_negatives.visit(lists, members[4][:3], np.array([200, 201, 202]), np.array([0, 1, 0]), np.arange(3), -free, free, True, 5)
    assert read == [4] and (found.ids // 50 == 4).all()
    # a window under what the own cluster reaches skips it
    read.clear()
    hard_negatives.visit(lists, members[4][:3], np.array([200, 201, 202]), np.array([0, 1, 0]), np.arange(3), np.full(3, -30_000), np.full(3, 30_000), False, 5)
    assert read and 4 not in read


def phrases_brute(docs, least, nested, top):
    f = collections.defaultdict(collections.Counter)
    for lang, text, *_ in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if " " not in p)
        cand = {p: v for p, v in c.items() if " " in p and v >= least}
        kept = []
        for p, a in cand.items():
            w = p.split(" ")
            if any(100 * b >= nested * a for q, b in cand.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "):
                continue
            cuts = [(1_000_000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), (p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n, score)))
        out += [(lang, i + 1, *x[3]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


def odd_texts(seed):
    r = random.Random(seed)
    words = ["the", "The", "a", "of", "New", "york", "city", "x-ray", "é", "É", "日本", "\x0b", "it's", "q", "zz\x00z", " ", "the"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "? "]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    langs = ["en", "en", "de", None, "", "und"]
    return [(r.choice(langs), t, 1, "k") for t in texts] + [("en", None, 1, "k"), ("en", "", 1, "k"), (None, " . ", 1, "k"), ("en", "the the the the the", 1, "k"), ("fr", "a b c " * 30, 1, "k"), ("lone", "x" * 100_000, 1, "k")] + [("en", texts[0], 1, "k")] * 12


@pytest.mark.parametrize(("least", "nested", "top"), [(10, 50, 2000), (2, 90, 7)])
def test_phrases_equal_brute_force(spark, least, nested, top):
    docs = odd_texts(least)
    df = spark.createDataFrame(docs, "lang string, text string, n long, phrase string").repartition(3)
    got = phrases.collocations(df, least, nested, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_brute(docs, least, nested, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_split_pivots_and_small_groups_change_nothing(spark):
    docs = odd_texts(5)
    df = spark.createDataFrame([d[:2] for d in docs], "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(4)
    words = phrases.word_counts(df, 5)
    plain, split = (sorted(map(tuple, phrases.frequent_phrases(df, words, 5, group, hot).collect())) for group, hot in ((1 << 20, 1 << 18), (500, 20)))
    assert plain == split and len(plain) > 50


def test_fragments_take_little_memory_and_may_be_spelled_in_parts(spark, monkeypatch):
    r = random.Random(1)
    text = " ".join(f"w{int(1.002 ** r.randint(0, 4000))}" for _ in range(200_000))
    tracemalloc.start()
    try:
        w = phrases.Words(pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"]))
        rows, _ = phrases.fragments(w, np.bincount(w.tokens), 10)
        assert len(rows) > 100_000 and tracemalloc.get_traced_memory()[1] < 20 * len(text)
    finally:
        tracemalloc.stop()
    df = spark.createDataFrame([d[:2] for d in odd_texts(6)], "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(2)
    words = phrases.word_counts(df, 5)
    found = []
    for size in (1 << 17, 3):
        monkeypatch.setattr(phrases, "SPELLED", size)
        found.append(sorted(map(tuple, phrases.frequent_phrases(df, words, 5).collect())))
    assert found[0] == found[1] and len(found[0]) > 50


def test_counts_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILE_WORDS", 100)
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 1000)
    counts = phrases.Counts.write(spark.createDataFrame([(int(k), i + 1) for i, k in enumerate(keys)], "key long, n long"))
    assert counts.bits == 4 and counts.get(keys.view(np.uint64)).tolist() == list(range(1, 1001)) and counts.get(np.array([1, 2], np.uint64)).tolist() == [0, 0]


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the score of a phrase with 3e12 occurrences."""
    a, l, r = 3_000_000_000_007, 3_000_000_000_011, 3_000_000_000_013
    got = spark.sql(f"select (cast({a}L as decimal(15,0)) * cast({a}L as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({l}L as decimal(19,0)) * cast({r}L as decimal(19,0))) as s").first().s
    assert got == 1_000_000 * a * a // (l * r)
