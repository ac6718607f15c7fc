import random
import zlib

import brute
import numpy as np
import pytest
import zstandard
from brute import SF
from test_packing import assert_packed
from test_pii import base
from tokenizers import Tokenizer

import corpus_pipeline
from peerbench.llm import queries
from peerbench.llm.compression_bands import Bands
from peerbench.llm.pii import masked


def plain_stages(rows):
    """The stages one document at a time; rows: (doc_id, text)."""
    bands, pack = Bands(), zstandard.ZstdCompressor(level=Bands().level)

    def keeps(text):
        raw = (text or "").encode()
        if brute.base_counts(text)[-1]:
            return False
        low, high = next((lo, hi) for most, lo, hi in bands.whole if len(raw) <= most)
        return low <= len(raw) / len(pack.compress(raw)) <= high and brute.chunk_verdict(raw, bands, pack)[2]

    rows = [(d, t) for d, t in rows if keeps(t)]
    classes = brute.near_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    removed = brute.removed_words(rows)
    texts = {}
    for d, t in rows:
        words = brute.words_of(t)
        if removed[d]:
            t = " ".join(w for i, w in enumerate(words) if i not in removed[d])
        if len(removed[d]) < len(words):
            texts[d] = masked(t, [(*x, True) for x in base(t)])
    return texts


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_pipeline_equals_its_plain_version(result, documents):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for d, t in plain_stages(documents).items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k // 2048, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in result} == want
    assert len(result) == len(want)
    assert_packed(result)


def test_stages_take_odd_rows_and_extra_columns(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    good, other = prose(120), prose(120)
    rows = [(1, good, None, None, None), (1, good, "en", "s", 3), (2, None, "en", "s", 0), (None, good, "en", "s", 1), (3, good + " end", "en", "s", 5), (4, "", None, "s", None), (5, "mail a@b.co " + other, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' as kept", "1 as class_id", "2 as spans", "3 as new_text")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen == [[1, 1, 3, 5], [1, 5], [1, 5], [1, 5]]
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert texts[1][0] == good and texts[5][0].startswith("mail <EMAIL> " + other[:20]) and texts[5][1] == len(texts[5][0])
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {1, 5}
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
