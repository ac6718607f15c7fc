"""Quality rules: compression bands.

Text that repeats itself compresses too well, text without structure not well enough. The ratio of
plain to zstandard bytes is taken over the whole document and over fixed chunks of it with what is left
after them; all have to lie in a band that depends on length, as short texts compress less whatever they say.

What is left after the full chunks is judged as a document of its length would be. Up to the first of the
lengths of ``Bands.whole`` it says too little alone and is judged by the last ``chunk`` bytes of the text. A
text shorter than a chunk is one such rest, so its whole ratio judges it. ``n_chunks`` and ``n_bad_chunks``
count full chunks; the rest counts in ``kept``, by its bytes.

Defined results: a null text has no words; a document without words has all counts 0, fails the base
rules and is not kept. Every row, repeated ones too, gives one row; null ids stay. Long texts are
handled whole. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.arrays import covered, find_words, mix, text_buffers, blocks, windows
from peerbench.llm.tables import carried, uncarried

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


@dataclass(frozen=True)
class Bands:
    """Lowest and highest ratio of plain to compressed bytes, by length: each band holds up to that
    many bytes. ``chunks`` is the band of every full chunk; a document goes if more than ``bad_share`` of
    its bytes are in full chunks, or in a rest after them, that are outside."""

    level: int = 3
    chunk: int = 4096
    whole: tuple[tuple[float, float, float], ...] = (
        (200, 0.7, 4.0),
        (500, 1.15, 3.0),
        (1000, 1.25, 3.2),
        (4000, 1.4, 3.6),
        (20_000, 1.55, 4.2),
        (float("inf"), 1.65, 5.0),
    )
    chunks: tuple[float, float] = (1.4, 4.0)
    bad_share: float = 0.25


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, whole_ratio double, n_chunks bigint, n_bad_chunks bigint"
)


def repeated_words(words, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Per document, the words in runs of ``width`` that its text has twice or more."""
    h, doc, pos = windows(words, hashes, width)
    key = mix(h ^ mix(doc.astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    hit = covered(words.ptr[doc[again]] + pos[again], width, len(words.start))
    return np.bincount(words.doc[hit], minlength=len(words.ptr) - 1)


def duplicate_lines(data: np.ndarray, bounds: np.ndarray, words) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line of it."""
    out = np.zeros(len(bounds) - 1, np.int64)
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, bounds)
    for i in np.flatnonzero(np.diff(per)):
        seen: set[bytes] = set()
        for line in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n"):
            if line in seen:
                out[i] += bool(line.strip(b" \t\n\r\x0b\x0c"))
            else:
                seen.add(line)
    return out


def band(n: int, bands: Bands) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands.whole if n <= most)


def ratios(text: memoryview, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Whole ratio, full chunks, those outside their band, and the bytes of the rest after them if it is
    outside its own, else 0; an empty text has ratio 1."""
    n = len(text)
    whole = n / len(pack.compress(text)) if n else 1.0
    low, high = bands.chunks
    full, rest = divmod(n, bands.chunk)
    bad = 0
    for k in range(full):
        r = bands.chunk / len(pack.compress(text[k * bands.chunk : (k + 1) * bands.chunk]))
        bad += not low <= r <= high
    if not full or not rest:
        return whole, full, bad, 0
    last = text[n - rest :]
    if rest > bands.whole[0][0]:
        low, high = band(rest, bands)
    else:
        last = text[n - bands.chunk :]
    fits = low <= len(last) / len(pack.compress(last)) <= high
    return whole, full, bad, 0 if fits else rest


def verdict(n: int, whole: float, bad: int, bad_rest: int, bands: Bands) -> bool:
    low, high = band(n, bands)
    return low <= whole <= high and bad * bands.chunk + bad_rest <= bands.bad_share * n


def measure(batch: pa.RecordBatch, bands: Bands) -> pa.RecordBatch:
    data, bounds = text_buffers(batch.column(1))
    pack = zstandard.ZstdCompressor(level=bands.level)
    n = len(bounds) - 1
    cols = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chunks", "n_bad_chunks")}
    fits, whole = np.zeros(n, bool), np.zeros(n)
    for lo, hi in blocks(bounds):
        part = bounds[lo : hi + 1] - bounds[lo]
        own = data[bounds[lo] : bounds[hi]]
        words = find_words(own, part)
        # a code point has one byte that is not 10xxxxxx
        chars = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
        symbols = np.r_[0, np.cumsum(SYMBOLS[own])]
        cols["n_words"][lo:hi] = words.count
        per_word = np.r_[0, np.cumsum(chars[words.end] - chars[words.start])]
        cols["word_chars"][lo:hi] = np.diff(per_word[words.ptr])
        cols["n_symbols"][lo:hi] = np.diff(symbols[part])
        cols["n_dup_lines"][lo:hi] = duplicate_lines(own, part, words)
        cols["n_repeat_words"][lo:hi] = repeated_words(words, words.hashes())
        for i in range(lo, hi):
            text = memoryview(data[bounds[i] : bounds[i + 1]])
            whole[i], cols["n_chunks"][i], cols["n_bad_chunks"][i], bad_rest = ratios(text, bands, pack)
            fits[i] = verdict(len(text), whole[i], cols["n_bad_chunks"][i], bad_rest, bands)
    failed = (cols["n_words"] < 50) | (100 * cols["n_repeat_words"] > 50 * cols["n_words"])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(cols[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
         pa.array(failed), pa.array(fits & ~failed), pa.array(whole), pa.array(cols["n_chunks"]), pa.array(cols["n_bad_chunks"])],
        names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "n_chunks", "n_bad_chunks"],
    )


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), carry: list[str] | None = None) -> DataFrame:
    """One row per document with base counts, ratios and the verdict ``kept``, and the columns ``carry`` of
    the input. A map over the scan: nothing is shuffled."""
    more, schema = carried(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = measure(batch, bands)
            yield pa.RecordBatch.from_arrays([*out.columns, *batch.columns[2:]], names=[*out.schema.names, *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return uncarried(rows.mapInArrow(run, SCHEMA + schema), carry)
