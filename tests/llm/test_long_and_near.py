"""Long texts in the surrogates' patterns, proximity across neighbouring documents, labels of other tables."""

import random
import time
import warnings

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, pii, quality_gam

SF = "/root/testdata/sf0.001"


def rewritten(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]


def test_long_texts_end_soon(spark):
    """Title case, domain labels, titles, initials and names without end: each ends within seconds."""
    names = [f"{a}{b}{c}{d}" for a in ("Bal", "Cor", "Dan", "Fel", "Gar", "Hol", "Jan", "Kel", "Lor", "Mar") for b in "aeiouy" for c in ("n", "r", "l", "s", "t", "v", "d", "m", "b", "k") for d in ("us", "er", "an", "os", "ic", "el", "im", "ax", "on", "ur", "ath", "eth", "oth", "ard", "old", "and", "ert")]
    assert len(set(names)) > 10_000
    several = " ".join(f"Mr {n} came." for n in names[:10_000]) + " " + " ".join(names[:1000])
    texts = ["Mr " + "Aa " * 100_000, "write to x@" + "a." * 100_000 + "com now", "Mr " * 100_000 + "Smith", "Mr " + "A." * 100_000 + " Smith", several, "Mr " + "Aa-" * 100_000, "+1 " * 100_000]
    start = time.time()
    out = rewritten(spark, *texts)
    assert time.time() - start < 150
    assert not set(names[:10_000]) & set(out[4].replace(".", "").split()) and "Smith" not in out[2]
    assert "Smith" not in rewritten(spark, "Mr " * 1000 + "Smith")[0]


def test_suffixes_belong_to_no_name(spark):
    full, short, other, same = rewritten(spark, "Dr. Martin Luther King Jr. spoke.", "Dr. King spoke.", "Dr. Smith Jr. spoke.", "Prof. Martin Luther King III spoke")
    king, smith = short.split()[1], other.split()[1]
    assert king != smith and "King" not in full + short and full.split()[-3:] == [king, "Jr.", "spoke."] and other.split()[2] == "Jr."
    assert same.split()[-3:] == [king, "III", "spoke"] and full.split()[1] == same.split()[1]


def test_common_words_stay_without_a_title(spark):
    may, will, brown = rewritten(spark, "Mr May came in May. May he? Mr May left.", "Mr Will Brown came. Will he? Will Brown did. So did Will.", "Mr Brown came. Brown left.")
    first = may.split()[1]
    assert may == f"Mr {first} came in May. May he? Mr {first} left." and first != "May"
    assert " Will he? " in will and "Will Brown" not in will and will.endswith("So did Will.") and "Brown" not in will + brown


def words_of(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def near_brute(docs, items, window, slack):
    """For each document: hit words, and the items with windows in it."""
    out = []
    for d, text in docs:
        w, hit, own = words_of(text), set(), set()
        for i, item in items:
            v = words_of(item)
            for run in {tuple(v[k : k + window]) for k in range(max(len(v) - window, 0) + 1)} if v else ():
                for p in range(-slack, len(w) + slack):
                    if all(any(0 <= q < len(w) and w[q] == t for q in range(p + n - slack, p + n + slack + 1)) for n, t in enumerate(run)):
                        hit.update(q for q in range(p, p + len(run)) if 0 <= q < len(w))
                        own.add(i)
        out.append((d, len(w), len(hit), sorted(own)))
    return sorted(out)


@pytest.mark.parametrize("slack", [0, 1, 2, 3])
def test_proximity_stays_within_documents(spark, slack):
    r = random.Random(slack)
    vocabulary = ["quick", "fox", "over", "dog", "zzz", "yyy", "xxx"]
    docs = [(0, "zzz yyy quick"), (1, "fox over zzz xxx"), (2, ""), (3, None), (4, "quick"), (5, "fox"), (6, "over"), (7, "over fox quick")]
    docs += [(10 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9)))) for i in range(60)]
    items = [(1, "quick fox over"), (2, "dog"), (3, "over over dog quick zzz"), (4, ""), (5, "quick fox"), (6, "yyy yyy")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 3):
        found = decontaminate.contamination(d.repartition(parts), b, 4, slack).select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"))
        assert sorted(map(tuple, found.collect())) == near_brute(docs, items, 4, slack)


def test_labels_of_other_documents_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = labels.unionByName(spark.range(10**9, 10**9 + 30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")), allowMissingColumns=True)
    own, all_ = ({r.doc_id: r.score for r in quality_gam.quality(docs, x).collect()} for x in (labels, more))
    assert own == all_ and len(set(own.values())) > 20
    with pytest.warns(UserWarning, match="labelled documents"):
        quality_gam.quality(docs, labels.limit(0))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        quality_gam.train(docs, labels)


def test_index_of_one_task_is_many_row_groups(spark):
    """A reader takes a row group at once, so one task's segments must not be a single one."""
    docs = spark.range(12, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("rare word "), F.repeat(F.lit("abcd efgh "), 840_000)).alias("text"))
    index = decontaminate.build_index(docs)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert index.count() == 12 and len(sizes) > 1 and max(sizes) < 64 << 20
    bench = spark.createDataFrame([(1, "rare word"), (2, "word rare")], "item_id long, text string")
    found = decontaminate.search(index, decontaminate.windows_of(bench, 2), 2)
    assert {(r.n_words, r.runs[0].end, tuple(r["items"])) for r in found.collect()} == {(1_680_002, 2, (1,))}
