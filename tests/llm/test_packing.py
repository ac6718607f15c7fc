import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from brute import SF
from tokenizers import Tokenizer

from peerbench.llm import queries
from peerbench.llm.packing import CAPACITY, best_fit, least_sequences, pack, plan, reduce_by_dominance, token_pieces

ODD = ["", None, "  \n", "a", "İstanbul ΣΑΣ ẞ", "é 가", "x.. y., z... 3.5 it's <|endoftext|> <|ENDOFTEXT|>. ok", "#. a #, b\tc\x0bd", "日本語 テキスト 😀. ", "no break wide\x1cbar", "long " * 7000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def expected(rows, tokenizer):
    out = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return sorted(out, key=str)


def assert_packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= CAPACITY
    return len(by)


def test_pieces_and_packing_of_the_table(spark, documents, tokenizer):
    rows = queries.op7_best_fit(spark, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == expected(documents, tokenizer)
    used = assert_packed(rows)
    assert used <= least_sequences({i: r.length for i, r in enumerate(rows)} and {1: sum(r.length for r in rows)}) * 1.01 + 1


def test_odd_texts(frame, tokenizer):
    rows = [*enumerate(ODD), (None, "a"), (3, "a"), (3, "a")]
    got = pack(token_pieces(frame(rows), queries.tokenizer_path(), keep_ids=True)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected(rows, tokenizer)
    assert all(len(r.ids) == r.length for r in got)
    assert_packed(got)


def test_empty(spark):
    assert pack(token_pieces(spark.createDataFrame([], "doc_id bigint, text string"), queries.tokenizer_path())).collect() == []


def counted(patterns):
    out = defaultdict(int)
    for pattern, times in patterns:
        for w, q in pattern:
            out[w] += q * times
    return dict(out)


def fewest(items, capacity):
    """Fewest sequences by trying all sets with the largest piece."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(len(rest) + 1):
        for some in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in some) <= capacity:
                best = min(best, 1 + fewest([w for i, w in enumerate(rest) if i not in some], capacity))
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(2)
    reduced = 0
    for _ in range(120):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        counts = {w: items.count(w) for w in set(items)}
        fixed = reduce_by_dominance(counts, 20)
        left = sorted((w for w, n in counts.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(items, 20)
        reduced += len(items) - len(left)
    assert reduced > 100


def one_by_one(items, capacity):
    rooms = []
    for w in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= w]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= w
        else:
            rooms.append(capacity - w)
    return sorted(rooms)


def test_best_fit_in_groups_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        counts = {w: items.count(w) for w in set(items)}
        patterns = best_fit(counts, 40)
        assert counted(patterns) == counts
        assert sorted(40 - sum(w * q for w, q in p) for p, n in patterns for _ in range(n)) == one_by_one(items, 40)


def test_plan_takes_every_piece():
    rng = random.Random(6)
    for _ in range(50):
        counts = {rng.randint(1, CAPACITY): rng.randint(1, 10**6) for _ in range(rng.randint(1, 400))}
        patterns = plan(counts)
        assert counted(patterns) == counts
        assert all(sum(w * q for w, q in p) <= CAPACITY for p, _ in patterns)
        assert len(patterns) < 40_000
