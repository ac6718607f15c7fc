"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams, hashed into a fixed number of buckets: words, pairs of words, the last three
bytes of words, and whether two, three or four words on end are equal. They are scaled by the log
ratio of their smoothed shares in the two classes; a linear model with hinge loss is fitted to the
scaled, length-normalised vectors by dual coordinate descent.

The fit takes at most ``max_train`` labelled rows, those with the smallest hash of their id: the
documented bound of the classifier. Their ids are chosen from the labels alone and broadcast, so no text
is shuffled; their buckets go to the driver. Scores are a map over all documents.

Defined results: null and empty texts have no n-gram and get the score of the intercept alone; label
rows with a null id or label are left out; an id with several labels counts once, as 1 if the mean is
at least 0.5; of rows that repeat a labelled id the one with the least text is learnt from; without rows of both classes every score is the share of label 1 (0.5 without rows).
Every row of the input, repeated ones too, gives one row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.arrays import Words, mix, windows, word_blocks
from peerbench.llm.tables import one_row_per_id


@dataclass(frozen=True)
class NbSvm:
    bits: int = 18
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    max_train: int = 10_000
    slope: float = 4.0
    seed: int = 7

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@dataclass
class Model:
    weight: np.ndarray
    intercept: float
    ratio: np.ndarray
    slope: float


def indicators(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with (row, bucket) of each distinct bucket of a document's n-grams, in order."""
    for lo, hi, words in word_blocks(column):
        h = words.checks()
        pair, doc, _ = windows(words, h, 2)
        found = [(words.doc, h), (doc, pair), (words.doc, tails(words))]
        found += [(of, mix(np.full(len(of), n, np.uint64))) for n, of in equal_runs(words, h)]
        key = np.unique(np.concatenate([(of.astype(np.uint64) << np.uint64(bits)) | (x >> np.uint64(64 - bits)) for of, x in found]))
        yield lo, hi, (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def tails(words: Words) -> np.ndarray:
    """A hash of the last three bytes of each word."""
    out = np.zeros(len(words.start), np.uint64)
    for back in (1, 2, 3):
        at = words.end - back
        out = out * np.uint64(257) + np.where(at >= words.start, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return mix(out + np.uint64(1 << 40))


def equal_runs(words: Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 2, 3, 4 the documents of each place from which n words are equal."""
    doc = words.doc
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    for n in (2, 3, 4):
        yield n, doc[: len(same)][same]
        same = same[1:] & same[:-1]


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, params: NbSvm) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2 / 2 + cost * sum of hinge losses: coordinate by
    coordinate of the dual, each in [0, cost]. The intercept is the weight of a constant 1."""
    values = []
    for x in rows:
        v = ratio[x]
        norm = float(np.sqrt(v @ v))
        values.append(v / norm if norm else v)
    diagonal = np.array([v @ v + 1.0 for v in values])
    w, b, a = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(params.seed)
    for _ in range(params.epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1.0
            new = min(max(a[i] - gradient / diagonal[i], 0.0), params.cost)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3 * params.cost:
            break
    return w, b


def fit(train: DataFrame, params: NbSvm = NbSvm()) -> Model:
    """``train`` has ``doc_id``, ``text`` and ``label`` (0 or 1), ``max_train`` rows at most."""
    bits = params.bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, bucket in indicators(batch.column(1), bits):
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["doc_id", "label", "buckets"])

    sample = train.select("doc_id", "text", "label").mapInArrow(rows, "doc_id bigint, label int, buckets array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = [np.asarray(x.values) for x in sample["buckets"]]
    one = sample["label"].to_numpy() == 1
    if not one.any() or one.all():
        rate = min(max(one.mean() if len(one) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(params.buckets), float(np.log(rate / (1 - rate))) / params.slope, np.zeros(params.buckets), params.slope)
    n = np.full((2, params.buckets), params.alpha)
    for x, y in zip(lists, one, strict=True):
        n[int(y), x] += 1
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    w, b = dual_descent(lists, np.where(one, 1.0, -1.0), ratio, params)
    return Model(w, b, ratio, params.slope)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` for every row. The model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits = int(len(m.weight)).bit_length() - 1
        scaled = m.weight * m.ratio
        square = m.ratio * m.ratio
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, row, bucket in indicators(batch.column(1), bits):
                norm = np.sqrt(np.bincount(row, square[bucket], minlength=hi - lo))
                margin = np.bincount(row, scaled[bucket], minlength=hi - lo) / np.where(norm > 0, norm, 1.0) + m.intercept
                out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(m.slope * margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, params: NbSvm = NbSvm()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document, learnt from labels that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id")
    train = one_row_per_id(texts, "doc_id", "text").join(F.broadcast(known), "doc_id")
    out = score(docs, fit(train, params))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
