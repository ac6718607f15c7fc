"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. It is a repeat if its word sequence also
starts earlier: in a document with a smaller id, or before it in the same one. All words of repeats
are removed; windows are judged on the input, not on what is left.

The residues {0, 1, 3, 9} cover all differences modulo 13: for any two places i and j there is a
shift d < 13 with i + d and j + d both at covered residues. So two equal windows of 20 words share an
anchor, the 8 words at such a shift, hashed at covered places only (4 of 13). The steps:

1. each document sends its anchors' hashes; those met once are dropped (one shuffle, sorted stream);
2. around anchors met again, the match is extended: every window that holds one is hashed whole, in
   64 bits and in 30 of another kind of hash; of equal ones all but the earliest are repeats (one shuffle, sorted stream);
3. repeats go back to their documents.

No step gathers the rows of a hash: the sorted streams look at neighbouring rows only, and repeats
within a block of documents are settled before the shuffle, so that a passage that every document
has sends one row per block.

Defined results: a null text has no words; texts under 20 words have no window and stay whole; rows
with a null id take no part and are not returned; rows that repeat an id count as one document, the
one with the least text. Long texts are handled whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.arrays import Words, covered, mix, window_hashes, word_blocks
from peerbench.llm.tables import one_row_per_id, settle

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SECOND = 0xBF58476D1CE4E5B9


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _own_key(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key of its own for each row, for rows that are settled and only need to be dealt out."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) ^ pos.astype(np.uint64))


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows. The place of anchors already met twice in this block of documents is stored as
    -1 - place; one of them keeps its hash as key, to tell other blocks, and the others go under keys of
    their own."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, words in word_blocks(batch.column(1)):
            h, doc, pos = _anchors_of(words)
            doc = ids[lo:hi][doc]
            _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            hit = count[inverse] > 1
            moved = hit.copy()
            moved[first] = False
            h[moved] = _own_key(doc[moved], pos[moved])
            pos = np.where(hit, -1 - pos, pos).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(doc), pa.array(pos)], names=["h", "doc", "pos"])


def _anchors_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.where(words.count >= WINDOW, words.count - ANCHOR + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = _IN_COVER[pos % PERIOD]
    doc, pos = doc[at], pos[at]
    return window_hashes(words.hashes(), words.ptr[doc] + pos, ANCHOR), doc, pos


def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by hash, those that are marked or have a neighbour with the same hash. The
    last row of a batch waits for the first of the next."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
        h, doc, pos = cols
        same = h[1:] == h[:-1]
        keep = (pos < 0) | np.r_[False, same] | np.r_[same, False]
        # what is held stays marked if it has met an equal hash already
        pos = np.where(pos < 0, -1 - pos, pos)
        held = h[-1:], doc[-1:], np.where(keep[-1:], -1 - pos[-1:], pos[-1:])
        yield _places(doc[:-1][keep[:-1]], pos[:-1][keep[:-1]])
    if held is not None and len(held[0]) and held[2][0] < 0:
        yield _places(held[1], -1 - held[2])


def _places(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int32))], names=["doc", "pos"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and each value's row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.repeat(np.arange(len(column)), n)


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-window rows around anchors met again. Of equal windows in this block all but the earliest
    are repeats for sure: they are marked and go under keys of their own."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        place, row = _flat(batch.column(2))
        order = np.argsort(row, kind="stable")
        place, row = place[order], row[order]
        for lo, hi, words in word_blocks(batch.column(1)):
            of = slice(*np.searchsorted(row, [lo, hi]))
            at = words.ptr[row[of] - lo] + place[of]
            # a window holds an anchor if it begins up to PERIOD - 1 words before it
            begins = np.maximum(at - PERIOD + 1, words.ptr[row[of] - lo])
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, begins, 1)
            np.add.at(change, at + 1, -1)
            doc = words.doc
            fits = np.arange(len(words.start)) + WINDOW <= words.ptr[doc + 1]
            at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & fits)
            hashes = words.hashes()
            h = window_hashes(hashes, at, WINDOW)
            g = (window_hashes(words.checks(), at, WINDOW, _SECOND) >> np.uint64(34)).astype(np.int64)
            doc_id, pos = ids[lo:hi][doc[at]], at - words.ptr[doc[at]]
            order = np.lexsort((pos, doc_id, g, h))
            h, g, doc_id, pos = h[order], g[order], doc_id[order], pos[order]
            repeat = np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])] if len(h) else np.zeros(0, bool)
            h[repeat] = _own_key(doc_id[repeat], pos[repeat])
            # 30 bits of hash, one for settled rows, 32 of place
            gp = (g << 33) | (repeat.astype(np.int64) << 32) | pos
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(doc_id), pa.array(gp)], names=["h", "doc", "gp"])


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by hash and place, all but the first of each run, and those marked."""
    last = None
    for batch in batches:
        h, doc, gp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(h):
            continue
        settled, g = (gp >> 32 & 1) == 1, gp >> 33
        same = np.r_[last == (h[0], g[0]), (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
        last = h[-1], g[-1]
        out = same | settled
        yield _places(doc[out], gp[out] & 0xFFFFFFFF)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, row = _flat(batch.column(2))
        order = np.argsort(row, kind="stable")
        place, row = place[order], row[order]
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        total, removed, kept = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = text.encode().split()
            total.append(len(words))
            if first[i] < first[i + 1]:
                gone = covered(place[first[i] : first[i + 1]], WINDOW, len(words))
                words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per document; ``kept`` joins the words left by one space."""
    docs = one_row_per_id(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), "doc_id", "text")
    by_doc = lambda places, name: settle(places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("pos").alias("places")), name)
    met = docs.mapInArrow(anchors, "h bigint, doc bigint, pos int").repartition("h").sortWithinPartitions("h")
    met = by_doc(met.mapInArrow(met_again, "doc bigint, pos int"), "anchors_met")
    near = docs.join(met, "doc_id").select("doc_id", "text", "places")
    whole = near.mapInArrow(extended, "h bigint, doc bigint, gp bigint").repartition("h").sortWithinPartitions("h", F.shiftright("gp", 32), "doc", "gp")
    found = by_doc(whole.mapInArrow(repeats, "doc bigint, pos int"), "repeats")
    out = docs.join(found, "doc_id", "left").select("doc_id", "text", "places")
    return out.mapInArrow(_without, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
