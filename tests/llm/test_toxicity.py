import random
import re
import zlib

import numpy as np
import pytest

from peerbench.llm import queries
from peerbench.llm.boosting import Boosting, boost, isotonic
from peerbench.llm.toxicity import FEATURES, SECOND, Reader, Toxicity, letters_of, stems, toxicity_scores
from brute import SF

LEXICON = {"idiot.": 3.0, "scum.": 1.0, "réeux": 2.0, "tra": 0.8}
ODD = ["", None, " ", "\n\n", "a", "!!!", "é b c\x0b\x0cd\x1ce", "x " * 4000, "x" * 5000, "ß ü 漢字 😀 ok", "İ ǅ ﬀ"]


def plain(text, p=Toxicity()):
    """The features that count words, one word at a time."""
    text = re.sub(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)", lambda m: re.sub(r"[ .*_-]", "", m[0]), text or "")
    words = text.split()
    if not words:
        return [0.0] * 10
    strength = [max([LEXICON.get(s, 0.0) for form in letters_of(w) for s in stems(form)] or [0.0]) for w in words]
    second = [letters_of(w)[0] in SECOND for w in words]
    hits = [i for i, s in enumerate(strength) if s > p.weak]
    n = len(words)
    strong = sum(s > p.strong for s in strength)
    near = sum(any(second[max(i - p.reach, 0) : i + p.reach + 1]) for i in hits)
    crowd = max((sum(i <= j < i + p.window for j in hits) for i in hits), default=0)
    return [
        np.log1p(n), strong / n, (len(hits) - strong) / n, np.log1p(len(hits)), np.log1p(len({words[i] for i in hits})),
        max((strength[i] for i in hits), default=0.0), sum(strength[i] for i in hits) / n, crowd, sum(second) / n, near / n,
    ]


def test_features_equal_the_plain_ones():
    rng = random.Random(2)
    words = ["you", "Idiot!", "id1ot", "I.d.i.o.t", "i d i o t", "scum###", "the", "réeuxment", "trala", "tr@sh", "TU", "don't", "a", "sooo", "\x1c"]
    reader = Reader(LEXICON, Toxicity())
    for text in ODD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]:
        got = reader.features(text)
        assert len(got) == len(FEATURES) and np.isfinite(got).all()
        assert np.allclose(got[:10], plain(text)), text


def test_features_of_style():
    got = dict(zip(FEATURES, Reader(LEXICON, Toxicity()).features("YOU id1ot!! Why?? @home ok")))
    assert got["shouted"] == 1 / 5 and got["capitals"] == 4 / 16 and got["exclaimed"] == 2 / 5 and got["asked"] == 2 / 5
    assert got["disguised"] == 2 / 5 and got["disguised_hits"] == 1 / 5 and got["near_second"] == 1 / 5


def test_known_words_are_dropped_and_found_again(monkeypatch):
    monkeypatch.setattr(Reader, "MOST", 5)
    reader = Reader(LEXICON, Toxicity())
    text = " ".join(f"w{i} idiot" for i in range(40))
    assert [reader.features(text).tolist() for _ in range(3)] == [Reader(LEXICON, Toxicity()).features(text).tolist()] * 3


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    trees = boost(x[:2000], y[:2000], Boosting())
    assert ((trees.margins(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.97
    flat = boost(np.zeros((10, 2)), np.r_[np.ones(4), np.zeros(6)], Boosting())
    assert np.allclose(1 / (1 + np.exp(-flat.margins(np.zeros((1, 2))))), 0.4, atol=0.01)
    assert flat.margins(np.zeros((0, 2))).shape == (0,)


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_is_the_best_step_function(seed):
    """Against the max-min formula of isotonic regression."""
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 12, 40).astype(float)
    y = (rng.random(40) < m / 12).astype(float)
    at, value = isotonic(m, y)
    kinds = np.unique(m)
    mean = lambda lo, hi: y[(m >= lo) & (m <= hi)].mean()
    want = [max(min(mean(lo, hi) for hi in kinds if hi >= k) for lo in kinds if lo <= k) for k in kinds]
    assert np.allclose(np.interp(kinds, at, value), want) and (np.diff(value) >= 0).all()


def test_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    out = queries.op12_toxicity(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.9
    assert np.mean([r.predicted for r in held if r.toxic == 0]) < 0.02


def test_odd_rows(frame, spark):
    docs = frame([(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (1, "again")], extra=("label", "fold", "stem", "n", "cell", "count", "score"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (6, 1), (6, 1), (7, 0), (8, 0), (9, 1)], "doc_id bigint, toxic int")
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    one = toxicity_scores(docs, labels.where("toxic = 1")).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    assert {r.score for r in toxicity_scores(docs, labels.where("doc_id > 99")).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), labels).collect() == []
