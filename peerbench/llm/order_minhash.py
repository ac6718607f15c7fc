"""Near-duplicate documents by Order MinHash.

The sketch of a text keeps, for each of ``SLOTS`` random orders, the ``SAMPLED`` least of its five-word
shingles (each labelled with how often it occurred before), in the order in which the text has them.
Two texts agree in a slot only if they share those shingles and their order, so agreement follows edit
similarity, not only the sets. Texts that agree in a slot, and in length to a factor of 0.8, are
candidates; they are verified by a banded alignment of their shingle sequences. With m shingles aligned
out of n1 and n2, the similarity is m / (n1 + n2 - m); pairs of 0.8 or more are linked, and classes are
the connected components. At a similarity of 0.8 a slot agrees with probability 0.8 ** 4 = 0.41, so
a link is missed with probability 0.59 ** 24 = 3e-6. Texts of up to 16 shingles use one shingle a slot.

Work within a slot's bucket stays linear. Equal texts are one node from the start. Buckets of up to
``SMALL`` texts compare all; in larger ones all compare with a leader, the text that meets most
others, then, ``ROUNDS`` times, those outside the largest class with another text of it. What a large
bucket has left to tell apart is finished exactly: its texts meet on their rarest shingles, as any two
that are similar enough share one of the rarest ninth or fifth, texts of one class left out.

Defined results: texts without words are alone in their class; of texts under five words only equal
word sequences share a class; rows with a null id are not returned; rows that repeat an id count as one
document, the one with the least text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.arrays import Words, mix, occurrence, window_hashes, windows, word_blocks
from peerbench.operators.joins import SHARE, left_join
from peerbench.llm.tables import components, joined_components, one_row_per_id, settle

SHINGLE = 5
SIMILARITY = 0.8
SLOTS = 24
SAMPLED = 4
#: Texts of up to FEW shingles use one shingle a slot; those from MANY on use SAMPLED. Any two texts
#: that are similar enough share one way, as 12 < 0.8 * 17.
FEW, MANY = 16, 12
SMALL = 8
ROUNDS = 2

_MULTIPLY, _ADD = (mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(s)) | np.uint64(1) for s in (1000, 2000))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of a block, and each document's bounds in them."""
    h, doc, _ = windows(words, words.hashes(), SHINGLE)
    return h, np.searchsorted(doc, np.arange(len(words.ptr)))


def sketch(h: np.ndarray) -> np.ndarray:
    """The bucket keys of a text with the shingle hashes ``h``."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    label = mix(h + mix(occurrence(h).astype(np.uint64)))
    ways = [k for k, used in ((1, n <= FEW), (SAMPLED, n >= MANY)) if used]
    keys = []
    rank = int(np.floor(np.log(n) / np.log(1 / SIMILARITY)))
    step = SLOTS if n < 100_000 else 1
    for s in range(0, SLOTS, step):
        order = label[None, :] * _MULTIPLY[s : s + step, None] + _ADD[s : s + step, None]
        for k in ways:
            least = np.argpartition(order, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), (len(order), n))
            least = np.sort(least, axis=1)
            key = mix(np.arange(s, s + len(order), dtype=np.uint64) * np.uint64(64) + np.uint64(k))
            for j in range(least.shape[1]):
                key = mix(key ^ label[least[:, j]])
            # texts whose lengths differ by a factor of 0.8 at most share one of the two
            keys += [mix(key + np.uint64(rank)), mix(key + np.uint64(rank + 1))]
    return np.concatenate(keys)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in word_blocks(batch.column(1)):
            hashes = words.hashes()
            h, ptr = shingles(words)
            keys = [sketch(h[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            checks = words.checks()
            whole = [_content(hashes[a:b], checks[a:b]) for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x[0] for x in whole], pa.int64()), pa.array([x[1] for x in whole], pa.int64()), lists], names=["doc_id", "c1", "c2", "keys"])


def _content(h: np.ndarray, g: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a word sequence, each half from another kind of hash of its words; null without words."""
    if not len(h):
        return None, None
    at = np.arange(len(h), dtype=np.uint64)
    return tuple(int((mix(x ^ mix(at + np.uint64(s))).sum(dtype=np.uint64) + np.uint64(len(x))).view(np.int64)) for x, s in ((h, 0), (g, 1 << 40)))


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``b`` if it is ``least`` or more; else some
    number below. Only the band of cells that such an alignment can reach is computed, a row at a time,
    as bits of one integer: a 0 marks the cells where the length grows."""
    n = min(len(a), len(b))
    unequal = np.flatnonzero(a[:n] != b[:n])
    head = int(unequal[0]) if len(unequal) else n
    a, b, n = a[head:], b[head:], n - head
    unequal = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(unequal[0]) if len(unequal) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    least -= head + tail
    found = head + tail
    if min(len(a), len(b)) < max(least, 1):
        return found
    below, above = len(a) - max(least, 0), len(b) - max(least, 0)
    width = below + above + 1
    full = (1 << width) - 1
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    many = {x: int.from_bytes(np.packbits(b == np.uint64(x), bitorder="little").tobytes(), "little") for x, at in places.items() if len(at) > 16}
    row, top = full, 1 << (width - 1)
    lo = -below
    for x in a.tolist():
        match = 0
        if x in many:
            match = (many[x] >> lo if lo >= 0 else many[x] << -lo) & full
        else:
            for j in places.get(x, ()):
                if lo <= j < lo + width:
                    match |= 1 << (j - lo)
        if match:
            both = row & match
            row = ((row + both) | (row - both)) & full
        found += not row & 1
        row = row >> 1 | top
        lo += 1
    return found + width - row.bit_count()


def similarity_bound(n1: int, n2: int) -> int:
    """The least number of aligned shingles with m / (n1 + n2 - m) >= SIMILARITY."""
    return -(-4 * (n1 + n2) // 9)


def _lists(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, words in word_blocks(column):
        h, ptr = shingles(words)
        out += [h[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            keep = []
            for x, y in zip(_lists(part.column(2)), _lists(part.column(3)), strict=True):
                least = similarity_bound(len(x), len(y))
                keep.append(min(len(x), len(y)) >= max(least, 1) and aligned(x, y, least) >= least)
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verified, "a bigint, b bigint")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        ids = batch.column(0).to_numpy()
        for h in _lists(batch.column(1)):
            label = mix(h + mix(occurrence(h).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), ids[at])), pa.array(np.full(len(h), len(h))), pa.array(label.view(np.int64))], names=["doc_id", "n", "label"])
            at += 1


def rare_pairs(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of texts of different classes that can be similar enough by where the rarest shingle that
    both have stands: with the shingles of each in order of rarity, m shared ones leave no more than
    n - m before the first."""
    rows = texts.mapInArrow(_shingle_rows, "doc_id bigint, n bigint, label bigint")
    often = rows.groupBy("label").agg(F.count("*").alias("often"))
    per_doc = rows.join(often, "label").selectExpr("*", "row_number() over (partition by doc_id order by often, label) as place")
    rare = settle(per_doc.where("often > 1 and place <= n - (4 * n + 4) div 5 + 1").join(roots, "doc_id").select("label", "doc_id", "n", "root", "place"), "rare")
    # x is the shorter text; in order of rarity the first label that both have stands this early in each
    x, y = rare.where("place <= n - (8 * n + 8) div 9 + 1").alias("x"), rare.alias("y")
    shared = "(4 * (x.n + y.n) + 8) div 9"
    near = f"x.label = y.label and x.root <> y.root and (x.n < y.n or x.n = y.n and x.doc_id < y.doc_id) and x.place <= x.n - {shared} + 1 and y.place <= y.n - {shared} + 1"
    return x.join(y, F.expr(near)).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id of its class), ``copy_of`` (the least id with the same words)
    and ``n_links`` (links of that text with different ones that were verified)."""
    docs = one_row_per_id(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), "doc_id", "text")
    sketched = settle(docs.mapInArrow(_sketches, "doc_id bigint, c1 bigint, c2 bigint, keys array<bigint>"), "sketches")
    # texts without words have no content and stay their own
    same = sketched.where("c1 is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    same = settle(same.where("n > 1"), "same")
    often = F.col("n") > sketched.count() * SHARE
    copies = left_join(sketched.select("doc_id", "c1", "c2"), same.drop("n"), ["c1", "c2"], frequent=same.where(often).select("c1", "c2"))
    copies = settle(copies.where("copy_of is not null").select("doc_id", "copy_of"), "copies")
    nodes = sketched.select("doc_id", "keys").join(copies.where("doc_id <> copy_of"), "doc_id", "left_anti")

    rows = nodes.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    heads = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = settle(rows.join(heads, "key").select("key", "doc_id", "size"), "buckets")
    few, large = rows.where(F.col("size") <= small), rows.where(F.col("size") > small)
    # the text that most others agree with leads: of edited copies, the one nearest to their origin
    central = large.groupBy("doc_id").agg(F.sum("size").alias("met"))
    leads = large.join(central, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("met", "doc_id")).alias("lead"))
    starred = large.join(leads, "key").where("doc_id <> lead")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, F.expr("x.key = y.key and x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    pairs = pairs.union(starred.select(_ordered("doc_id", "lead"))).distinct()
    texts = settle(docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")

    done = settle(pairs, "pairs")
    links = settle(verify(done, texts), "links")
    roots = components(links)
    for k in range(rounds + 1):
        # buckets whose texts are in more than one class, with the largest class and a leader of it
        classed = large.select("key", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        classed = classed.withColumn("root", F.coalesce("root", "doc_id"))
        per_class = classed.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))).alias("pick"))
        leaders = per_class.groupBy("key").agg(F.count("*").alias("classes"), F.max_by(F.struct("pick", "root"), F.struct("n", F.xxhash64("root", F.lit(k)))).alias("lead"))
        open_rows = settle(classed.join(leaders.where("classes > 1").select("key", "lead.*").withColumnRenamed("root", "lead_root"), "key"), "open")
        if open_rows.isEmpty():
            break
        if k < rounds:
            pairs = open_rows.where("root <> lead_root").select(_ordered("doc_id", "pick")).distinct()
        else:
            rest = open_rows.select("doc_id", "root").distinct()
            pairs = rare_pairs(texts.join(rest, "doc_id", "left_semi"), rest)
        new = settle(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.union(new)
        more = settle(verify(new, texts), "links")
        if not more.isEmpty():
            links = links.union(more)
            roots = joined_components(roots, more)

    degree = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    out = sketched.select("doc_id").join(copies, "doc_id", "left").withColumn("copy_of", F.coalesce("copy_of", "doc_id"))
    out = out.join(roots.withColumnRenamed("node", "copy_of"), "copy_of", "left").join(degree, "copy_of", "left")
    return out.select("doc_id", F.coalesce("root", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).alias("n_links"))
