"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of lexicon words by strength, how near they stand to each other and to words of the
second person, capitals, exclamation and question marks, other symbols, and words written in disguise
(digits and symbols for letters, letters drawn out or spaced).

The lexicon is learnt: stems (whole words, and their first 3 to 6 letters) whose share of toxic documents is
above that of others by a lower bound of the log ratio. Stems are counted in Spark. Features of a training
row come from the lexicon of the other folds, so that the trees do not trust stems for rows they were found
in; the margins that are calibrated come from trees of the other folds likewise. Scoring is a map over all
documents with a model of fixed size: at most ``max_lexicon`` stems, the trees and the steps.

The fit takes at most ``max_train`` labelled documents, those with the smallest hash of their id: the
documented bound of the classifier. Only their features, one short row each, go to the driver.

Defined results: null and empty texts have all features zero; label rows with a null id or label are left
out; an id with several labels counts once, as 1 if the mean is at least 0.5; of repeated labelled ids the least
text is learnt from; without training rows of both classes every score is the share of label 1 (0.5 without
rows). Every row, repeated ones and null ids too, gives one row. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.boosting import Boosting, Trees, boost, isotonic
from peerbench.llm.tables import one_row_per_id

# Words of the second person in English, German, French and Spanish, and letters that
# digits and symbols stand for.
SECOND = frozenset(
    "you your yours yourself yourselves ur u du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes "
    "vous votre vos tú usted ustedes vosotros ti tus".split()
)
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})

FEATURES = (
    "length", "strong", "weak", "hits", "kinds", "strongest", "strength", "crowd", "second", "near_second",
    "capitals", "shouted", "exclaimed", "asked", "symbols", "disguised", "disguised_hits",
)

SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
DRAWN = re.compile(r"(.)\1{2,}")


@dataclass(frozen=True)
class Toxicity:
    max_train: int = 10_000
    max_lexicon: int = 8192
    folds: int = 4
    least: int = 4
    sure: float = 2.5
    weak: float = 0.5
    strong: float = 1.5
    window: int = 20
    reach: int = 5
    threshold: float = 0.3
    boosting: Boosting = field(default_factory=Boosting)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]


def letters_of(word: str) -> tuple[str, str]:
    """The letters of a word, and those that it has when disguises are undone."""
    low = word.lower()
    plain = "".join(filter(str.isalpha, low))
    core = low.strip(".,;:!?\"'()[]{}*#-_~…«»“”„")
    undone = DRAWN.sub(r"\1", "".join(filter(str.isalpha, core.translate(DISGUISES))))
    return plain, undone


def stems(letters: str) -> Iterator[str]:
    """The whole word, marked by a full stop, and its beginnings of 3 to 6 letters."""
    if letters:
        yield letters + "."
    for n in range(3, min(6, len(letters) - 1) + 1):
        yield letters[:n]


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for; ``new`` are those since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Reader:
    """Features of texts with one lexicon; what is known of a word is kept, up to ``MOST`` words."""

    MOST = 300_000

    def __init__(self, lexicon: dict[str, float], params: Toxicity):
        self.lexicon, self.params = lexicon, params
        self._clear()

    def _clear(self) -> None:
        self.number = Numbers()
        self.table = np.zeros((0, 9))

    def _strength(self, letters: str) -> float:
        get = self.lexicon.get
        return max(map(get, stems(letters), repeat(0.0)), default=0.0)

    def _look(self, word: str) -> tuple:
        core = word.rstrip(".,")
        if core.islower() and core.isalpha() and not DRAWN.search(core):
            return self._strength(core), core in SECOND, len(core), 0, False, 0, 0, 0, 0
        plain, undone = letters_of(word)
        strength = self._strength(plain)
        hidden = self._strength(undone) if undone != plain else 0.0
        upper = sum(map(str.isupper, word))
        core = word.strip(".,;:!?\"'()[]{}")
        mixed = bool(plain) and (not core.replace("-", "").replace("'", "").replace("’", "").isalpha() or bool(DRAWN.search(core)))
        marks = word.count("!"), word.count("?")
        symbols = sum(not c.isalnum() for c in word) - sum(marks) - sum(map(word.count, ".,;:'\"-"))
        return max(strength, hidden), plain in SECOND, len(plain), upper, len(plain) > 1 and upper == len(plain), *marks, max(symbols, 0), mixed + 2 * (hidden > strength)

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        words = SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text).split()
        n = len(words)
        if not n:
            return out
        if len(self.number) > self.MOST:
            self._clear()
        known, number = len(self.number), self.number
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        if number.new:
            if len(number) > len(self.table):
                table = np.zeros((2 * len(number), 9))
                table[:known] = self.table[:known]
                self.table = table
            self.table[known : len(number)] = [self._look(w) for w in number.new]
            number.new.clear()
        at = self.table[ids]
        strength, second = at[:, 0], at[:, 1] > 0
        p = self.params
        hit = np.flatnonzero(strength > p.weak)
        strong = strength > p.strong
        totals = at.sum(axis=0)
        out[0] = np.log1p(n)
        out[1] = strong.sum() / n
        out[2] = (len(hit) - strong.sum()) / n
        out[3] = np.log1p(len(hit))
        if len(hit):
            out[4] = np.log1p(len(np.unique(ids[hit])))
            out[5] = strength.max()
            out[6] = strength[hit].sum() / n
            out[7] = (np.searchsorted(hit, hit + p.window) - np.arange(len(hit))).max()
        out[8] = second.sum() / n
        if len(hit) and second.any():
            places = np.flatnonzero(second)
            low = np.searchsorted(places, hit - p.reach, "left")
            high = np.searchsorted(places, hit + p.reach, "right")
            out[9] = (high > low).sum() / n
        out[10] = totals[3] / max(totals[2], 1)
        out[11] = totals[4] / n
        out[12:15] = totals[5:8] / n
        disguise = at[:, 8]
        out[15] = (disguise % 2 > 0).sum() / n
        out[16] = (disguise >= 2).sum() / n
        return out


def count_stems(train: DataFrame, params: Toxicity) -> DataFrame:
    """(stem, n), n being the documents that have it by fold and label: place 2 * fold + label."""
    wide = 2 * params.folds

    def flush(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        stem, cell, n = [], [], []
        for s, counts in held.items():
            for c in np.flatnonzero(counts):
                stem.append(s)
                cell.append(int(c))
                n.append(int(counts[c]))
        return pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["stem", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
                met = {s for w in set((text or "").split()) for s in stems(letters_of(w)[0])}
                for s in met:
                    if s not in held:
                        held[s] = np.zeros(wide, np.int32)
                    held[s][2 * fold + label] += 1
                if len(held) > 200_000:
                    yield flush(held)
                    held = {}
        yield flush(held)

    cells = train.select("text", "label", "fold").mapInArrow(run, "stem string, cell int, n bigint")
    return cells.groupBy("stem").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in range(wide)])


def lower_bound(toxic, other, n_toxic: float, n_other: float, sure: float):
    """Lower bound of the log ratio of a stem's shares in the two classes; columns or arrays."""
    log, root = (F.log, F.sqrt) if hasattr(toxic, "alias") else (np.log, np.sqrt)
    ratio = log((toxic + 0.5) / (n_toxic + 1.0)) - log((other + 0.5) / (n_other + 1.0))
    return ratio - sure * root(1 / (toxic + 0.5) + 1 / (other + 0.5))


def fit(train: DataFrame, params: Toxicity = Toxicity()) -> Model:
    """``train`` has ``doc_id``, ``text`` and ``label`` (0 or 1), ``max_train`` rows at most."""
    spark = train.sparkSession
    folds = params.folds
    train = train.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int"))
    size = {(r["fold"], r["label"]): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    n = np.array([[size.get((f, y), 0) for y in (0, 1)] for f in range(folds)], float)
    if not n.sum(axis=0).all():
        rate = float(n[:, 1].sum() / n.sum()) if n.sum() else 0.5
        return Model({}, None, (np.zeros(1), np.array([rate])))

    total = lambda y: sum((F.col(f"n{2 * f + y}") for f in range(folds)), F.lit(0))
    bound = lower_bound(total(1), total(0), n[:, 1].sum(), n[:, 0].sum(), params.sure)
    chosen = count_stems(train, params).where(total(1) >= params.least).withColumn("bound", bound).where(F.col("bound") > params.weak / 2)
    found = chosen.orderBy(F.desc("bound"), "stem").limit(params.max_lexicon).toArrow()
    names = found["stem"].to_pylist()
    counts = np.stack([np.asarray(found[f"n{c}"], float) for c in range(2 * folds)], axis=1) if names else np.zeros((0, 2 * folds))

    def lexicon(without: int | None) -> dict[str, float]:
        use = [f for f in range(folds) if f != without]
        values = lower_bound(counts[:, [2 * f + 1 for f in use]].sum(axis=1), counts[:, [2 * f for f in use]].sum(axis=1), n[use, 1].sum(), n[use, 0].sum(), params.sure)
        return {s: float(v) for s, v in zip(names, values) if v > params.weak}

    shared = spark.sparkContext.broadcast([lexicon(f) for f in range(folds)])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x, params) for x in shared.value]
        for batch in batches:
            rows = [readers[f].features(t) for t, f in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["doc_id", "label", "fold", "x"])

    sample = train.select("doc_id", "text", "label", "fold").mapInArrow(describe, "doc_id bigint, label int, fold int, x array<double>").toArrow().sort_by("doc_id")
    x = np.asarray(sample["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y, fold = sample["label"].to_numpy().astype(float), sample["fold"].to_numpy()
    margin, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(folds):
        rest, own = fold != f, fold == f
        if own.any() and 0 < y[rest].sum() < rest.sum():
            margin[own], known[own] = boost(x[rest], y[rest], params.boosting).margins(x[own]), True
    trees = boost(x, y, params.boosting)
    if not known.any():
        margin, known = trees.margins(x), ~known
    return Model(lexicon(None), trees, isotonic(margin[known], y[known]))


def score(docs: DataFrame, model: Model, params: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` for every row, as a map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.lexicon, params)
        for batch in batches:
            if m.trees is None:
                out = np.full(batch.num_rows, m.knots[1][0])
            else:
                x = np.stack([reader.features(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(FEATURES)))
                out = np.interp(m.trees.margins(x), *m.knots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: Toxicity = Toxicity()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document, learnt from labels that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id")
    train = one_row_per_id(texts, "doc_id", "text").join(F.broadcast(known), "doc_id")
    out = score(docs, fit(train, params), params)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))
