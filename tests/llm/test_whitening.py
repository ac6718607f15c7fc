import math

import numpy as np
import pytest

from peerbench.llm import queries
from peerbench.llm.spectrum import eigenvalues_below, leading
from peerbench.llm.whitening import whiten
from brute import SF


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = symmetric(rng.normal(size=40) * 10 ** rng.uniform(-3, 3, 40), seed)
    if seed == 3:
        a[np.arange(40), np.arange(40)] = 0.0
    known = np.linalg.eigvalsh(a)
    for s in [*rng.choice(known, 10) + rng.normal(size=10) * 1e-3, 0.1, -1e5, 1e5]:
        assert eigenvalues_below(a, s) == (known < s).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [7, 7, 7, 1, 1, 0], [3, 3 - 1e-9, 2, 2 - 1e-13, 1, 0], [1e8, 1, 1e-4, 0, 0, 0], [0] * 6, [4, 0, 0, 0, 0, 0]])
def test_leading_pairs(values):
    a = symmetric(values, 5)
    e, v = leading(a, 4)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 0]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-12, atol=1e-14 * max(values[0], 1))
    assert np.allclose(v @ v.T, np.eye(len(e)), atol=1e-13)
    assert np.abs(v @ a - e[:, None] * v).max(initial=0) <= 1e-14 * max(abs(x) for x in values) * 6 + 1e-300


def plain(rows, k=4):
    points = {}
    for i, (key, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            points[i] = (key, tuple(math.floor(256 * c) for c in v))
    x = np.array(sorted({p for _, p in points.values()}), float)
    n, s = len(x), [sum(c) for c in zip(*sorted({p for _, p in points.values()}))]
    c = x - np.array(s) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    out = []
    for key, p in points.values():
        dev = sum((n * a - b) ** 2 for a, b in zip(p, s))
        w = (np.array(p) - np.array(s) / n) @ v / np.sqrt(e)
        out += [(key, j + 1, n, dev, w[j], e[j] / cov.trace()) for j in range(k)]
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[3])) for x in (got, want))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in range(1, 5):
        a, b = (np.array([r[4] for r in x if r[1] == j]) for x in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)


def test_query_against_eigenvectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, SF).collect()
    same([tuple(r) for r in got], plain(rows))
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1


def test_odd_rows(frame):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.normal(size=6) * [5, 3, 2, 1.5, 1, 1] + 100]) for i in range(60)]
    rows = [*good, *good[:5], (7, good[3][1]), (None, good[4][1])]
    odd = [(90, None), (91, []), (92, [1.0] * 5 + [None]), (93, [1.0] * 5 + [math.nan]), (94, [math.inf] * 6), (95, [1.0] * 3)]
    got = whiten(frame([*rows, *odd], "vec_id bigint, embedding array<double>", extra=("x", "id", "component", "n", "d"))).collect()
    same([tuple(r) for r in got], plain(rows))


def test_large_numbers_stay_exact(frame):
    rows = [(i, [float(2**40 * (i * 7 % 11)), float(i)]) for i in range(50)]
    got = {(r.vec_id, r.component): r.deviation for r in whiten(frame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = {(key, j): dev for key, j, _, dev, *_ in plain(rows, 1)}
    assert {k: int(v) for k, v in got.items()} == want and max(want.values()) > 2**63


def test_no_spread(frame):
    schema = "vec_id bigint, embedding array<float>"
    assert whiten(frame([], schema)).collect() == []
    assert whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whiten(frame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
