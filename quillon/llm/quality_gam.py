"""Text quality by a generalised additive model with pairwise interactions (operator 1).

Every document gets numeric features of its whole text. Boosting cycles over the features, each round adding a shallow
tree of one feature (at most four leaves) to that feature's lookup table over quantile bins, so the model is a sum of
tables; then the pairs of features whose joint trees still lower the loss most get two-way tables in the same manner. A
score is the logistic of the sum of the tables' entries at a document's bins: one search and one addition per table.

The tables are fitted on the driver from the features of at most ``sample`` labelled documents, taken in the order of a
hash of their ids; only those features travel there. Scoring reads all rows.

Nulls, ties: a null text is empty and gets a score like others. Labels that are null, or of a null id, are not used; several
labels of one document count as their mean. Without labels of both kinds every score is 0.5. Repeated rows get a row each; an
empty table gives none. Labels, language, source and id never enter a score. ``keep_good`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import LOWER, crc_of, free_names, pieces, replace_column, take_words, text_bytes, word_spans

#: Labelled documents under which a fit means little.
FEW = 50
#: Labelled documents that are fitted on, at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 300, 100, 6, 0.08
THRESHOLD = 0.3

#: Shares of a text's bytes.
CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)], "capitals": range(65, 91), "digits": range(48, 58), "white": [9, 10, 11, 12, 13, 32],
    "lines": [10], "stops": list(b".,;:"), "calls": list(b"!?"), "bars": list(b"|"), "signs": list(b"#$%&*@^~<>{}[]\\_=+/"), "other": [*range(0, 9), *range(14, 32), 127],
}
FEATURES = ["log_bytes", *CLASSES, "word_bytes", "words_per_line", "distinct_words", "repeats_before", "repeats_second", "top_word", "distinct_lines", "long_words"]


def features_of(column: pa.Array) -> np.ndarray:
    """A row of features per text."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    n, safe = len(size), np.maximum(size, 1)

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])

    out = {"log_bytes": np.log1p(size)}
    for name, members in CLASSES.items():
        member = np.zeros(256, bool)
        member[list(members)] = True
        out[name] = sums(member[data], offsets) / safe
    begin, end, before = word_spans(data, offsets)
    words = np.diff(before)
    many, owner = np.maximum(words, 1), np.repeat(np.arange(n), words)
    out["word_bytes"] = sums(end - begin, before) / many
    out["words_per_line"] = words / (1 + out["lines"] * size)
    out["long_words"] = sums(end - begin > 24, before) / many
    coded = take_words(LOWER[data], begin, end).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)

    def again(step: int) -> np.ndarray:
        same = np.zeros(len(codes), bool)
        same[step:] = (codes[step:] == codes[:-step]) & (owner[step:] == owner[:-step])
        return sums(same, before) / many

    out["repeats_before"], out["repeats_second"] = again(1), again(2)
    keys = np.sort(owner * (len(coded.dictionary) + 1) + codes)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    of = keys[head] // (len(coded.dictionary) + 1)
    out["distinct_words"] = np.where(words > 0, np.bincount(of, minlength=n) / many, 1.0)
    top = np.zeros(n)
    np.maximum.at(top, of, np.diff(np.append(head, len(keys))))
    out["top_word"] = top / many
    line_begin, line_end, lines_before = word_spans(data, offsets, np.arange(256) != 10)
    lines = np.diff(lines_before)
    line_codes = take_words(data, line_begin, line_end).dictionary_encode().indices.to_numpy().astype(np.int64)
    line_owner = np.repeat(np.arange(n), lines)
    distinct = np.unique(line_owner * (len(line_codes) + 1) + line_codes) // (len(line_codes) + 1)
    out["distinct_lines"] = np.where(lines > 0, np.bincount(distinct, minlength=n) / np.maximum(lines, 1), 1.0)
    return np.stack([out[f] for f in FEATURES], 1)


def _tree(gradient: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The value of each bin in a tree of two levels over ordered bins."""

    def best(lo: int, hi: int) -> int:
        g, w = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
        left, right = w[:-1], w[-1] - w[:-1]
        gain = g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (w[-1] + 1)
        gain[(left < least) | (right < least)] = 0
        return lo + 1 + int(np.argmax(gain)) if hi - lo > 1 and gain.max(initial=0) > 1e-12 else -1

    cuts = {0, len(gradient)}
    if (middle := best(0, len(gradient))) > 0:
        cuts |= {c for c in (middle, best(0, middle), best(middle, len(gradient))) if c > 0}
    edges, out = sorted(cuts), np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The values of a tree with one cut in each of two features (four quadrants), and its gain."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    total_g, total_w = g[-1, -1], w[-1, -1]
    a_g, a_w = g[:-1, :-1], w[:-1, :-1]
    b_g, b_w = g[:-1, -1:] - a_g, w[:-1, -1:] - a_w
    c_g, c_w = g[-1:, :-1] - a_g, w[-1:, :-1] - a_w
    d_g, d_w = total_g - a_g - b_g - c_g, total_w - a_w - b_w - c_w
    gain = sum(x**2 / (y + 1) for x, y in ((a_g, a_w), (b_g, b_w), (c_g, c_w), (d_g, d_w))) - total_g**2 / (total_w + 1)
    gain[np.minimum(np.minimum(a_w, b_w), np.minimum(c_w, d_w)) < least] = 0
    out = np.zeros(gradient.shape)
    if not gain.size or gain.max() <= 1e-12:
        return out, 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for x, y, at in ((a_g, a_w, np.s_[: i + 1, : j + 1]), (b_g, b_w, np.s_[: i + 1, j + 1 :]), (c_g, c_w, np.s_[i + 1 :, : j + 1]), (d_g, d_w, np.s_[i + 1 :, j + 1 :])):
        out[at] = x[i, j] / (y[i, j] + 1)
    return out, float(gain[i, j])


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    bias: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.single):
            total += table[b[:, k]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """y between 0 and 1."""
    if len(y) < 20 or not 0.0 < y.mean() < 1.0:
        return AdditiveModel([np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = AdditiveModel(edges, float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(len(e) + 1) for e in edges])
    b, total = model.bins(x), np.full(len(y), model.bias)
    least = 2.0

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.single):
            g, w = residual()
            step = RATE * np.clip(_tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], w, len(table)), least / 10), -4, 4)
            table += step
            total += step[b[:, k]]
    g, w = residual()

    def joint(i: int, j: int, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        shape = len(model.single[i]), len(model.single[j])
        cell = b[:, i] * shape[1] + b[:, j]
        return _pair_tree(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, w, shape[0] * shape[1]).reshape(shape), least / 10)

    gains = sorted(((joint(i, j, g, w)[1], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(model.single[i]), len(model.single[j])))) for gain, i, j in gains if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, w = residual()
            step = RATE * np.clip(joint(i, j, g, w)[0], -4, 4)
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled documents of ``docs`` whose crc32 of the id's text mod ``fold`` isn't 0. Labels of other ids don't count;
    with fewer than ``FEW`` labelled documents, or with one class of them only, a warning says that the scores mean little."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("quality is not null").where(crc_of("doc_id") % fold != 0)
    usable = usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = usable.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for piece in pieces(batches):
            values = features_of(replace_column(piece, "text"))
            yield pa.record_batch([replace_column(piece, "doc_id"), replace_column(piece, "quality"), pa.array(list(values), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # the sample's bound is the broadcast's
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # a document that stands in several rows counts once
    rows = labelled.mapInArrow(run, "doc_id long, quality double, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(rows.x.tolist(), float).reshape(len(rows), len(FEATURES))
    if len(rows) < FEW or rows.quality.nunique() < 2:
        warnings.warn(f"{len(rows)} labelled documents with {rows.quality.nunique()} distinct labels to learn quality from", stacklevel=2)
    return fit(x, rows.quality.to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score and the prediction after its own columns, under ``names`` (which it must not have)."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    # columns are numbered on the way through Python, so that any name will do
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text, added = f"c{docs.columns.index('text')}", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches):
        for piece in pieces(batches, text):
            p = broadcast.value.score(features_of(replace_column(piece, text)))
            yield pa.record_batch([*piece.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*piece.schema.names, "score", "predicted"])

    return numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, *added])).toDF(*docs.columns, *names)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels)
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    return score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    names = free_names(docs, "score", "predicted")
    return score(docs, train(docs, labels), tuple(names)).where(F.col(names[1]) == 1).drop(*names)
