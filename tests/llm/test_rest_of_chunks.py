import base64
import random

from brute import SF

from peerbench.llm.compression_bands import Bands, compression_bands


def _texts(documents, n):
    """Prose of ``n`` bytes each, from texts that the rules keep."""
    return [t[:n] for _, t in documents if t and t.isascii() and len(t) >= n]


def _kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.kept for r in sorted(compression_bands(rows).collect())]


def test_the_rest_after_full_chunks_is_judged(spark, documents):
    rng = random.Random(5)
    prose = _texts(documents, 7000)[:40]
    junk = [base64.b64encode(rng.randbytes(2175)).decode() for _ in prose]
    assert sum(_kept(spark, prose)) >= 0.9 * len(prose)
    # 4096 bytes in the full chunk, 2894 bytes of junk after it
    assert sum(_kept(spark, [p[:4090] + j for p, j in zip(prose, junk, strict=True)])) == 0
    # of a text that repeats itself after its full chunk too
    assert sum(_kept(spark, [p[:4096] + " " + "again and again " * 150 for p in prose])) == 0


def test_a_short_rest_is_judged_with_the_bytes_before_it():
    import zstandard
    from peerbench.llm.compression_bands import ratios

    bands, pack, rng = Bands(), zstandard.ZstdCompressor(level=3), random.Random(6)
    junk = base64.b64encode(rng.randbytes(3300))
    assert len(junk) == 4400
    assert ratios(memoryview(junk[: 4096 + 150]), bands, pack)[1:] == (1, 1, 150)
    assert ratios(memoryview(junk[:4096]), bands, pack)[1:] == (1, 1, 0)


def test_a_rest_that_fits_changes_no_verdict(spark, documents):
    """Natural texts keep the verdict of their full chunks: the rest only adds bytes if it is outside."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    bands, n = Bands(), 0
    for r in compression_bands(rows, carry=["text"]).where("n_chunks > 0 and not base_failed").collect():
        size = len(r.text.encode())
        low, high = next((lo, hi) for most, lo, hi in bands.whole if size <= most)
        assert r.kept == (low <= r.whole_ratio <= high and r.n_bad_chunks <= bands.bad_share * r.n_chunks)
        n += 1
    assert n > 100
