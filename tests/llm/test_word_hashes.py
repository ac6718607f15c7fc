"""Words that share a polynomial hash modulo 2^64 in every base are different words."""

import numpy as np
import pyarrow as pa

from peerbench.llm.arrays import find_words, text_buffers, word_blocks
from peerbench.llm.compression_bands import compression_bands
from peerbench.llm.order_minhash import near_duplicates
from peerbench.llm.substring_dedup import substring_dedup
import brute


def patterned():
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_of_patterned_words():
    one, other = patterned()
    words = find_words(*text_buffers(pa.array([f"{one} {other} {one}"])))
    assert len(set(words.checks().tolist())) == 1  # the kind that they share
    h = words.hashes()
    assert h[0] == h[2] != h[1]


def test_hashes_tell_places_and_lengths():
    texts = ["a" * n for n in (1, 63, 64, 65, 128, 129)] + ["b" + "a" * 63, "a" * 63 + "b", "a" * 100 + "b", "a" * 99 + "ba"]
    (_, _, words), = word_blocks(pa.array([" ".join(texts)]))
    assert len(set(words.hashes().tolist())) == len(texts) == len(np.unique(words.hashes()))


def test_operators_tell_patterned_words_apart(spark):
    one, other = patterned()
    text = lambda w: " ".join([f"w{i}" for i in range(13)] + [w] + [f"v{i}" for i in range(12)])
    rows = [(1, text(one)), (2, text(other)), (3, text(one))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 26} == {d: x[1] for d, x in brute.substring_dedup(rows).items()}
    found = {r.doc_id: (r.class_id, r.copy_of) for r in near_duplicates(df).collect()}
    assert found == {1: (1, 1), 2: (2, 2), 3: (1, 1)}
    twice = spark.createDataFrame([(1, f"{one} x y {other} x y")], "doc_id bigint, text string")
    assert compression_bands(twice).first().n_repeat_words == 0
