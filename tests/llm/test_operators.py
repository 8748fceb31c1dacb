"""Each operator against brute force or a round trip, on small rows with nulls, ties, empties, long texts and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, decontaminate, exact_dedup, kneser_ney, packing, pii, quality_gam, rollup, simhash, sstable
from quillon.llm.catalogue import WORD_BPE
from quillon.llm.common import new_path
from quillon.llm.components import components
from quillon.llm.tokens import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, score double, segment int"
R = random.Random(5)
WORDS = ["alpha", "beta", "Gamma", "été", "x1", "don't", "日本", "n.", "the", "of"]
LONG = " ".join(R.choice(WORDS) + str(R.randrange(50)) for _ in range(9000))
TEXTS = [None, "", " ", "\t\n", "a", "a  b", "a b", "A b", LONG, LONG + " end", LONG.replace(" ", "\n"), "the quick brown fox jumps over the lazy dog again and again", "The  quick brown fox jumps over the lazy dog again and again", "été. É ÉÀ <|endoftext|> x́."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", 0.5, 1) for i, t in enumerate(TEXTS)] + [(4, "a", None, None, None, None), (None, "a b", "en", "s0", 1.0, 2), (90, "beta beta gamma delta " * 5, "en", "s0", 1.0, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(docs, bits):
    rows = exact_dedup.groups(docs, bits).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(normal(r.text), []).append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
    assert sum(r.kept for r in rows) == len(texts) and len(rows) == docs.count()
    if bits == 64:
        stay = exact_dedup.keep_one(docs)
        assert stay.columns == docs.columns and stay.count() == len(texts)


def test_chunks_are_cut_alike_anywhere():
    data = np.frombuffer(LONG.encode(), np.uint8)
    alone = exact_dedup.cut_points(data, np.array([0, len(data)]))[0]
    both = np.concatenate([data[:700], data])
    placed = exact_dedup.cut_points(both, np.array([0, 700, len(both)]))[1]
    assert [p - 700 for p in placed] == alone and len(alone) > 5


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    found = simhash.near_duplicate_report(docs).collect()
    want = sorted(format(fingerprint(r.text), "016x") for r in docs.collect())
    assert sorted(r.fingerprint for r in found) == want


@pytest.mark.parametrize("entries", [10, 10**6, 10**11])
def test_links_lose_none(spark, entries):
    rng = np.random.default_rng(entries % 97)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) for _ in range(6))]))
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4):
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    want = {}
    for i in range(len(codes)):
        want.setdefault(root(i), set()).add(int(codes.view(np.int64)[i]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {}
    for r in components(simhash.links(df, simhash.masks_for(entries))).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def five_word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


@pytest.mark.parametrize("rows", [512, 4])
def test_similar_texts_are_joined(spark, monkeypatch, rows):
    """Every pair of similarity 0.8 and no other, also where a group is too large for one task (rows)."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    rng = random.Random(3)
    texts = ["a b c", "A  b c", "a b d", ""]
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 300))]
        for edits in (0, 1, 2, 3, 5, 8, 1, 2):
            own = list(words)
            for k in rng.sample(range(len(own)), min(edits, len(own))):
                own[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets, root = [five_word_sets(t) for t in texts], list(range(len(texts)))
    close = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 5 >= (len(sets[i] | sets[j])) * 4:
                close += both * 10 < len(sets[i] | sets[j]) * 9
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert close > 20 and len(set(root)) > 14
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_decontamination(docs, spark, empty):
    item = "brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, "a b", 0), (4, None, 0), (5, "", 0), (None, "gamma", 0), (1, item, 1)], "item_id long, text string, doc_id int")
    for most in (50_000, 1):
        found = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_windows=most).collect()}
        assert (found[11].n_hit, found[11].n_items) == (10, 2) and found[11].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
        assert (found[6].n_hit, found[6].n_items, found[7].n_hit) == (2, 1, 2) and found[0].n_words == 0 and not found[4].contaminated
        assert found[90].contaminated and found[90].n_items == 0 and found[90].n_hit == 5
    near = {r.doc_id: r.n_items for r in decontaminate.contamination(docs, spark.createDataFrame([(7, "quick fox over")], "item_id long, text string"), slack=3).collect()}
    assert near[11] == 1 and near[8] == 0
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns


def test_stages_decide_by_row(spark):
    """Null ids and two texts of one id: each row stays or goes by itself."""
    near = " ".join(f"n{i}" for i in range(200))
    texts = [near, near + " end", *(" ".join(f"t{k}x{i}" for i in range(60)) for k in range(6)), "", None]
    leak = texts[2]
    rows = [(1, texts[0]), (None, texts[1]), (None, leak), (None, texts[3]), (7, texts[1] + " more"), (7, texts[4]), (7, texts[5]), (9, texts[6]), (9, texts[6]), (None, texts[7]), (None, texts[7]), (5, ""), (5, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, other int")
    stay = simhash.keep_one(docs)
    assert stay.columns == docs.columns
    ids = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    assert ids(stay) == sorted([(1, texts[0]), (None, leak), (None, texts[3]), (7, texts[4]), (7, texts[5]), (9, texts[6]), (None, texts[7]), (5, "")], key=str)
    bench = spark.createDataFrame([(1, leak), (2, texts[4])], "item_id long, text string")
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and ids(clean) == sorted([(i, t or "") for i, t in rows if t not in (leak, texts[4])], key=str)


def test_language_model(docs, empty):
    model = kneser_ney.train(docs)
    rows = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    assert rows[0].n_tokens == 1 and rows[5].n_tokens == 3 and rows[8].score > rows[8].base_score
    assert kneser_ney.held_out_scores(empty).count() == 0
    assert kneser_ney.score(docs, kneser_ney.train(empty)).count() == docs.count()


def test_language_model_buckets_follow_the_input(docs, monkeypatch):
    before = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.train(docs)).collect() if r.doc_id != 4}
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 1000)
    model = kneser_ney.train(docs)
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    assert model.buckets >= size / 1000 > 100
    after = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect() if r.doc_id != 4}
    assert before.keys() == after.keys() and all(after[i] == pytest.approx(before[i]) for i in before)
    # a frequent context's pairs are spread over more buckets where there are more
    words = np.random.default_rng(1).integers(0, 1 << 63, 100_000, np.uint64)
    most = np.bincount(kneser_ney.pair_buckets(np.full(len(words), 7, np.uint64), words, 6000)).max()
    assert most < len(words) / 50


def test_tokens_equal_the_tokenizer():
    encoder = WordEncoder.of(WORD_BPE)
    texts = [t or "" for t in TEXTS] + ["It's ,,, ..'s x.'s", "A.B.C. a.,b;'ll ×. ñ.,", "ΣΑΣ İ ﬁ Ǆ x"]
    ids, offsets = encoder.encode(pa.array(texts))
    for i, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids


def test_shards(spark, docs, empty):
    rows = sorted(sstable.token_id_output(spark, docs, WORD_BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and rows[0].start == 0
    blank = next(r for r in rows if r.doc_id == 0)
    assert (blank.n_tokens, blank.ids_crc32) == (1, zlib.crc32(b"\1\0\0\0"))
    manifest = sstable.write_shards(sstable.encoded(docs, WORD_BPE, 1, 49_408), new_path(spark, "t"), 2, 49_408, block_size=64).collect()
    found = [x for m in manifest for x in sstable.Shard(m.path).get(4)]
    assert len(found) == 2 and not any(sstable.Shard(m.path).get(12345) for m in manifest)
    assert sstable.token_id_output(spark, empty, WORD_BPE).count() == 0


def test_packing(docs, empty):
    rows = packing.packed_documents(docs, WORD_BPE).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
    for (_, length), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and length == min(c for c in packing.LENGTHS if c >= at)
    assert sum(r.n_tokens for r in rows) == packing.token_lengths(docs, WORD_BPE).agg(F.sum("n_tokens")).first()[0]
    assert packing.packed_documents(empty, WORD_BPE).count() == 0


def test_packing_takes_the_fullest_fit():
    rng = random.Random(11)
    sizes = sorted((rng.choice([rng.randrange(1, 60), rng.randrange(1, 4097)]) for _ in range(700)), reverse=True)
    bins, places, final = packing.pack(sizes)
    opened, want, left = [], [], sum(sizes)  # every open bin looked at, for every item
    for size in sizes:
        fits = [(cap - used - size, k) for k, (cap, used) in enumerate(opened) if cap - used >= size]
        if fits:
            k = next(k for room, k in fits if k == bins[len(want)] and room == min(fits)[0])
        else:
            k = len(opened)
            opened.append((min((c for c in packing.LENGTHS if c >= size), key=lambda c: (packing.cost(c) / min(c, left), c)), 0))
        want.append(k)
        opened[k] = (opened[k][0], opened[k][1] + size)
        left -= size
    assert bins == want and final == [min(c for c in packing.LENGTHS if c >= opened[b][1]) for b in bins]
    # the lengths used jointly cost no more than the largest alone
    def paid(lengths):
        return sum(packing.cost(c) for c in dict(zip(*packing.pack(sizes, lengths)[::2])).values())

    assert paid(packing.LENGTHS) <= paid((4096,))


def test_packing_spreads_repeated_ids(spark):
    lengths = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(40).cast("long").alias("n_tokens"))
    rows = packing.best_fit_pack(lengths, group_tokens=16_000).groupBy(F.expr("bin_id >> 32").alias("pack")).agg(F.sum("n_tokens").alias("n"), F.sum((F.col("doc_id") == 7).cast("int")).alias("hot")).collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 160_000 and max(r.n for r in rows) < 24_000 and max(r.hot for r in rows) < 250
    assert packing.best_fit_pack(lengths, group_items=400).select(F.expr("bin_id >> 32")).distinct().count() == 10


def test_rollup(spark, docs):
    store = rollup.RollupStore(spark, new_path(spark, "r"))
    rows = spark.createDataFrame([("s", "en", "1", 5), ("s", "en", "1", 7), (None, "en", "1", None)], "source string, lang string, version string, n_tokens long")
    assert store.commit("a", rollup.inserted(rows)) and not store.commit("a", rollup.inserted(rows))
    store.commit("b", rollup.revised(rows.withColumn("new_tokens", F.col("n_tokens") + 1)))
    store.commit("c", rollup.deleted(rows.where("n_tokens = 7")))
    want = {("s", 1, 7), (None, 1, 0)}
    # revised by one each, and the deleted one had 7 of its 8
    assert {(r.source, r.n_docs, r.n_tokens) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("b", rollup.inserted(rows)) and {(r.source, r.n_docs, r.n_tokens) for r in store.totals().collect()} == want
    assert sum(r.n_docs for r in rollup.maintained_totals(spark, docs, WORD_BPE).where("version = 'bpe-1'").collect()) == docs.where("trim(translate(text, '\t\n', '  ')) <> ''").count()


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(60)), "en", "s", 0.0, 0) for i in range(300)]
    bad = [(i, "BUY!! NOW!! " * rng.randrange(5, 30), "en", "s", 0.0, 0) for i in range(300, 400)]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_gam.quality(spark.createDataFrame(good + bad, SCHEMA), labels).collect()
    assert all(r.predicted == int(r.doc_id < 300) for r in rows if r.held_out) and {r.held_out for r in rows} == {True, False}
    kept = quality_gam.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.score for r in quality_gam.quality(docs, labels.limit(0)).collect()} == {0.5} and quality_gam.quality(empty, labels).count() == 0


def test_reply_trees(spark):
    said = "</s>[INST] ok [/INST] <\\s> <<SYS>>\n"
    rows = [("c", 1, None, "user", said, 0.0), ("c", 2, 1, "assistant", said, 0.2), ("c", 3, 1, "assistant", "better", 0.9), ("c", 4, 3, "we\nird\\n", None, 0.5), ("c", 5, 77, "user", "orphan", 0.1), ("d", 1, 2, "user", "circle", 1.0), ("d", 2, 1, "user", "circle", 1.0), ("d", 3, 2, "user", "below", 1.0)]
    messages = spark.createDataFrame(rows, "conv_id string, msg_id long, parent_id long, role string, text string, score double")
    paths = {r.leaf_id: r.path for r in chat.branches(messages).collect()}
    assert paths == {2: [1, 2], 4: [1, 3, 4], 5: [5]}
    back = chat.read_back(chat.formatted(messages, top=3)).orderBy("rank").collect()
    assert [r.leaf_id for r in back] == [4, 2, 5]
    assert [(t.role, t.text) for t in back[0].turns] == [("user", said), ("assistant", "better"), ("we\nird\\n", "")]
    assert back[1].loss == said and back[0].loss == "better"
    assert chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PRIVATE = 'Mail Ann.Lee7@Mail3.example.com, +1 (017) 555-7713, 97.51.17.173, 4845168114407329 or 4845 1681 1440 7329; token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B". Herr Braun, Mrs Jane Doe, Госпожа Иванова.'


def test_surrogates(spark, empty):
    rows = [(1, PRIVATE), (2, PRIVATE.lower().replace("herr", "Herr")), (3, "no 9807915762804490 here, version 2.0."), (4, None), (5, "")]
    found = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    out = found[1].text
    assert found[1].pii == "email,phone,ip,card,card,secret,name,name,name"
    for secret in ("Ann.Lee7", "555-7713", "97.51.17.173", "4845168114407329", "1440 7329", "9233A8EC", "Braun", "Doe", "Иванова"):
        assert secret not in out
    email = re.search(r"\S+@\S+(?=,)", out).group()
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", email) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)
    cards = re.findall(r"4\d{3} ?\d{4} ?\d{4} ?\d{4}", out)
    assert len(cards) == 2 and cards[0] == cards[1].replace(" ", "") and re.search(r'"[0-9A-F]{40}"', out) and re.search(r"Herr \w+, Mrs \w+ \w+, Госпожа [А-Яа-яё]+\.", out)
    assert email.lower() in found[2].text
    assert found[3].text == rows[2][1] and found[4].text is None and found[5].text == "" and pii.report(empty).count() == 0


@pytest.mark.parametrize("phone", ["+44 20 7946 0958", "+442079460958", "+33 1 23 45 67 89", "+49 30 12345678", "+49 (30) 12345678", "+7 495 123-45-67", "(555) 123 4567", "(555)123-4567", "1-800-555-1234", "020 7946 0958", "01 23 45 67 89"])
def test_phones_of_all_groupings(spark, phone):
    texts = [f"call {phone}, or {phone}.", "on 01-02-2024 or 2024-01-02 10:20, 012-34-5678"]
    found = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    shape = re.escape(re.sub(r"\d", "9", phone)).replace("9", r"\d")
    a, b = re.fullmatch(rf"call ({shape}), or ({shape})\.", found[0].text).groups()
    assert found[0].pii == "phone,phone" and a == b != phone and found[1].pii == "ssn"


def test_names_in_full_and_without_a_title(spark):
    texts = ["Mr John Paul Smith came. Smith left; John Paul Smith stayed.", "Mrs Mary-Jane Watson, Mr McDonald, Mrs O'Neil and Dr Jane Doe.", "Herr Braun schrieb. Dann ging Braun, und Brauner blieb.", "Prof. Dr. J. R. Hartley's book. The Hartley book.", "Mr Smith The end. The end.", "Braun alone."]
    out = [r.text for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    first, last, after, whole = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) left; (\w+ \w+) stayed\.", out[0]).groups()
    assert after == last and whole == f"{first} {last}" and not {"John", "Paul", "Smith"} & set(re.findall(r"\w+", out[0]))
    assert re.fullmatch(r"Mrs \w+ \w+, Mr \w+, Mrs \w+ and Dr \w+ \w+\.", out[1]) and not re.search("Mary|Jane|Watson|McDonald|Neil|Doe", out[1])
    a, b = re.fullmatch(r"Herr (\w+) schrieb\. Dann ging (\w+), und Brauner blieb\.", out[2]).groups()
    assert a == b != "Braun"
    a, b = re.fullmatch(r"Prof\. Dr\. \w+ (\w+)'s book\. The (\w+) book\.", out[3]).groups()
    assert a == b != "Hartley" and re.fullmatch(r"Mr (?!Smith)\w+ The end\. The end\.", out[4]) and out[5] == texts[5]


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"from 10.0.{i}.7 to 10.0.{i}.7") for i in range(60)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k", chars=2).collect()
    names = [re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in out]
    assert all(a == b for a, b in names) and len({a for a, _ in names}) == 60 and not {a for a, _ in names} & {f"10.0.{i}.7" for i in range(60)}


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.count()
