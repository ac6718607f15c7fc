import random

import brute
import numpy as np
import pytest
from brute import SF

from peerbench.llm import queries
from peerbench.llm.order_minhash import aligned, near_duplicates, similarity_bound, sketch


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(5)
    for case in range(500):
        n = rng.randint(1, 60)
        a = [rng.randint(0, 4 if case % 3 == 0 else 10**6) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            b = b[:i] + rng.choice([[], [7], [1, 2]]) + b[i + rng.randint(0, 3) :]
        if case % 5 == 0:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        want, least = brute.common_subsequence(a, b), similarity_bound(len(a), len(b))
        got = aligned(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert got <= want and (got == want if want >= least else got < least), (a, b)


def test_sketch_follows_order():
    h = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = lambda x, y: len(set(x.tolist()) & set(y.tolist()))
    full = len(sketch(h))
    assert same(sketch(h), sketch(h.copy())) == full
    assert same(sketch(h), sketch(h[::-1].copy())) < full / 4
    edited = h.copy()
    edited[[50, 150, 250]] += np.uint64(12345)
    assert same(sketch(h), sketch(edited)) > full * 0.8


def test_classes_of_the_table(spark, documents):
    got = {r.doc_id: r.class_id for r in queries.op5_order_minhash(spark, SF).collect()}
    assert got == brute.near_classes(documents)


@pytest.mark.parametrize("small, rounds", [(8, 2), (2, 0)])
def test_large_groups_lose_no_link(frame, small, rounds):
    """A group of edited copies, some similar only to some others, texts that share a long passage, and
    odd texts; with small limits the leaders' rounds and the exact rest do the work."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 3000)}"
    origin = [word() for _ in range(120)]
    rows = []
    chain = list(origin)
    for d in range(60):
        text = list(origin) if d % 3 else chain
        for _ in range(rng.randint(0, 2)):
            text[rng.randint(0, len(text) - 1)] = word()
        if d % 3 == 0:
            chain = list(text)
        rows.append((d, " ".join(text)))
    passage = [word() for _ in range(100)]
    rows += [(100 + d, " ".join(passage + [word() for _ in range(rng.randint(5, 60))])) for d in range(50)]
    rows += [(200 + d, " ".join(origin[: 3 + d % 20])) for d in range(60)]
    rows += [(300, ""), (301, None), (302, " "), (303, "a b"), (304, "a  b"), (305, "b a"), (306, "a " * 900), (307, "a " * 880), (308, "a " * 500)]
    out = near_duplicates(frame([*rows, (None, "a b"), rows[3]]), small=small, rounds=rounds).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out} == brute.near_classes(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
