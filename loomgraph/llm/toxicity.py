"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and skip-grams (two words with one between) of a whole text. The model
is fitted on at most PER_CLASS labelled rows of each class, those of the least hashed id, and of these on the first ones whose
features number at most FEATURES a class, so that the fit's memory is bounded whatever the length of texts; every other row is only
scored, whole. Rows are turned into features on the executors; one task then runs the online updates, each coordinate with its own
rate, and L1 keeps the weights few, so that they are broadcast as a short list (2^BITS at most).

Defined cases: null and empty texts have no features and get the score of the bias; ids labelled twice count as toxic if
one label says so; null labels and labels of unknown ids are left out; without labels of both classes nothing is
learned and every score is 0.5 (nothing rejected); repeated rows are scored one by one; an empty table gives an empty result;
other columns, of whatever name, keep their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed
from .shingles import WordHashes, hashed, lists, sliced, stir, words_of

BITS = 20
#: Most rows of each class that the model is fitted on.
PER_CLASS = 6_000
#: Most features (4 bytes each) of the rows of each class that are held while the model is fitted.
FEATURES = 24_000_000
THRESHOLD = 0.7


def features(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Hashed unigrams, bigrams and skip-grams of a text, repeats included."""
    h = hashed(words_of(text), known)
    mask, keep = np.uint64((1 << BITS) - 1), []
    for tag, (a, b) in enumerate(((h, None), (h[:-1], h[1:]), (h[:-2], h[2:]))):
        mixed = a if b is None else a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(tag)
        keep.append(stir(mixed) & mask)
    return np.concatenate(keep).astype(np.int32)


class Ftrl:
    """The per-coordinate state of FTRL-proximal; coordinate 2^BITS is the bias, which L1 spares."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 30.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int, times: float = 1.0) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * times
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _fit(epochs: int, most: int = FEATURES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, room = [], [], [most, most]
        for batch in batches:
            for x, y in zip(batch.column(1), map(int, batch.column(2).to_pylist()), strict=True):
                if len(x.values) > room[y]:
                    room[y] = 0  # the sample of this class ends here
                    continue
                room[y] -= len(x.values)
                rows.append(np.append(x.values.to_numpy(zero_copy_only=False), np.int32(1 << BITS)))
                labels.append(y)
        at, w = np.empty(0, dtype=np.int64), np.empty(0)
        if len(set(labels)) == 2:
            model, order = Ftrl(), np.random.default_rng(11)
            rare = min(8.0, max(1.0, labels.count(0) / labels.count(1)))  # a toxic row counts so many times
            for _ in range(epochs):
                for i in order.permutation(len(rows)).tolist():
                    model.learn(rows[i], labels[i], rare if labels[i] else 1.0)
            all_of_it = np.arange((1 << BITS) + 1)
            w = model.weights(all_of_it)
            at = np.flatnonzero(w)
            w = w[at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 8, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, float]]:
    """The non-zero (coordinate, weight)s learned from labels(id_col, toxic) of the docs."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches):
            found = [np.unique(features(t.as_py(), known)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(found, pa.int32()), batch.column(1)], ["h", "x", "y"])

    known = labels.where("toxic is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y")).where("id is not null")
    known = known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    some = [known.where(F.col("y") == y).orderBy("h").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(sample, "id").select("h", "y", "text")
    rows = rows.mapInArrow(featurise, "h long, x array<int>, y int").repartition(1).sortWithinPartitions("h")
    return [(r["at"], r["w"]) for r in rows.mapInArrow(_fit(epochs), "at long, w double").collect()]


def score(docs: DataFrame, weights: list[tuple[int, float]], text_col: str = "text") -> Column:
    """The score (0 to 1) of a whole text, as a column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array([a for a, _ in weights], dtype=np.int64), np.array([w for _, w in weights])))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        at, w = shared.value
        if not len(at):
            return pa.array(np.zeros(len(texts)))
        dense, known = np.zeros((1 << BITS) + 1), WordHashes()
        dense[at] = w
        used = dense != 0
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = features(t.as_py(), known)
            out[i] = dense[np.unique(x[used[x]])].sum() + dense[1 << BITS]
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return scored(F.col(text_col).cast("binary"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted (1 if score >= THRESHOLD)."""
    weights = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), score(docs, weights, text_col).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are predicted to be toxic."""
    weights = fit(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    return docs.select(packed(docs), score(docs, weights, text_col).alias("score")).where(F.col("score") < THRESHOLD).select("own.*")
