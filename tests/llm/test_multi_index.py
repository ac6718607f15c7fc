import random

import numpy as np
import pyarrow.parquet as pq

from peerbench.llm import queries
from peerbench.llm.multi_index import nearest, traverse
from peerbench.llm.tables import components, joined_components

NAN, INF = float("nan"), float("inf")


def exact(rows, asked, k=5):
    """rows: (id, vector), valid ones."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero([asked(i) for i in ids]):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[q]][:k]
        out[ids[q]] = [(ids[j], score[j]) for j in order]
    return out


def test_heap_goes_by_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(50):
        d1, d2 = rng.random(6), rng.random(9)
        sizes = rng.integers(0, 4, (6, 9))
        order = [c for c in sorted(np.ndindex(6, 9), key=lambda c: d1[c[0]] + d2[c[1]]) if sizes[c]]
        enough = int(rng.integers(1, sizes.sum() + 1))
        got = list(traverse(d1, d2, sizes, enough))
        assert got == order[: len(got)]
        assert sum(sizes[c] for c in got) >= enough > sum(sizes[c] for c in got[:-1])
        assert list(traverse(d1, d2, sizes, 10**9)) == order


def test_recall_and_scores_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    want = exact(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), lambda i: i % 50 == 0)
    got = {}
    for r in sorted(queries.op4_multi_index(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    true = {(q, i): s for q, x in exact(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), lambda i: i % 50 == 0, 10**6).items() for i, s in x}
    for q, x in got.items():
        assert all(abs(s - true[q, i]) < 1e-12 for i, s in x)
        assert x == sorted(x, key=lambda y: (-y[1], y[0]))


def test_odd_vectors_copies_and_ties(spark):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    copied, other = vector(), vector()
    rows = [(i, copied) for i in range(300)] + [(300 + i, other) for i in range(9)] + [(400 + i, vector()) for i in range(200)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [NAN] + [1.0] * 5), (1004, [INF] + [1.0] * 5), (1005, [None] + [1.0] * 5), (1006, [1.0] * 4), (None, vector()), (50, copied)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as i", "'y' as id", "'z' as entry").repartition(3)
    got = {}
    for r in sorted(nearest(df, "id % 50 = 0").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[300] == [301, 302, 303, 304, 305]
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def test_few_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), "id % 50 = 0").collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), "id % 50 = 0").collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0, 2.0])], schema), "id % 50 = 0").collect() == []
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame([(0, [1.0]), (3, [-2.0])], schema), "id % 50 = 0").collect()] == [(0, 1, 3)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for e in links for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    half = len(links) // 2
    parts = components(spark.createDataFrame(links[:half], "a bigint, b bigint"))
    parts = joined_components(parts, spark.createDataFrame(links[half:], "a bigint, b bigint"))
    assert {r.node: r.root for r in parts.collect() if r.node in parent} == got
