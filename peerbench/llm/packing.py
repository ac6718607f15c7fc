"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids with a separator at the end; those longer than a sequence are cut. What has
to be packed is then only a count for each length, ``capacity`` numbers at most however many
documents there are, so the plan is made on those counts: a pattern (so many pieces of these lengths)
and how many sequences follow it. The reduction goes through the lengths from the longest down and
fixes a pattern for good where a set with that piece provably dominates all others:

* nothing else fits beside it: alone;
* a piece fills the rest exactly: the pair (whatever else fits could stand where that piece stands);
* no two others fit beside it: with the largest that fits;
* no three others fit, and the largest that fits is at least as long as any two that fit together:
  with that one.

It is repeated until nothing more is fixed; the remainder is packed best-fit, longest first. Pieces get
their ranks among those of the same length on Spark and look their places up in the plan.

Defined results: null and empty texts are the separator alone; every row, repeated ones and those with a
null id too, is a document. Long texts are handled whole. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.tokens import word_tokens
from peerbench.staging import stage

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length are numbered in groups of about this many.
GROUP = 50_000

Pattern = tuple[tuple[int, int], ...]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(tokens.ids(batch.column(1).to_pylist())):
                data += end
                n = len(data) // 4
                for k in range(-(-n // capacity)):
                    part = data[4 * k * capacity : 4 * (k + 1) * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(k * capacity)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns fixed for good, with how many sequences follow each. ``counts`` loses what they take."""
    fixed: list[tuple[Pattern, int]] = []

    def others(j: int) -> list[int]:
        """Lengths left beside one piece of length j, ascending; each three times at most."""
        out = []
        for w in sorted(counts):
            out += [w] * min(3, counts[w] - (w == j))
        return out

    def take(pattern: Pattern, times: int) -> None:
        fixed.append((pattern, times))
        for w, q in pattern:
            counts[w] -= q * times
            if not counts[w]:
                del counts[w]

    def best_pair(beside: list[int], rest: int) -> int:
        """The largest sum of two that fit together."""
        best, lo, hi = 0, 0, len(beside) - 1
        while lo < hi:
            total = beside[lo] + beside[hi]
            if total <= rest:
                best = max(best, total)
                lo += 1
            else:
                hi -= 1
        return best

    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                rest, beside = capacity - j, others(j)
                fits = [w for w in beside if w <= rest]
                if not fits:
                    take(((j, 1),), counts[j])
                    changed = True
                    continue
                k = fits[-1]
                if k < rest and sum(fits[:2]) <= rest and len(fits) > 1 and (len(fits) > 2 and sum(fits[:3]) <= rest or best_pair(fits, rest) > k):
                    break
                take(((j, 2),) if j == k else ((j, 1), (k, 1)), counts[j] // 2 if j == k else min(counts[j], counts[k]))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing: pieces of equal length and sequences of equal make-up are moved together."""
    # room left -> sequences with that room, by pattern
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for w in sorted(counts, reverse=True):
        left = counts[w]
        for room in range(w, capacity):
            while left and open_[room]:
                pattern, times = open_[room].pop()
                each = room // w
                full = min(times, left // each)
                if full:
                    open_[room - each * w].append(((*pattern, (w, each)), full))
                    left -= full * each
                if full < times and left and left < each:
                    open_[room - left * w].append(((*pattern, (w, left)), 1))
                    full, left = full + 1, 0
                if full < times:
                    open_[room].append((pattern, times - full))
            if not left:
                break
        each = capacity // w
        if left // each:
            open_[capacity - each * w].append((((w, each),), left // each))
        if left % each:
            open_[capacity - left % each * w].append((((w, left % each),), 1))
    return [x for row in open_ for x in row]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    left = dict(counts)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """The plan as rows, ordered by length and rank: pieces of a length with ranks from ``rank`` on go
    to sequences from ``sequence`` on, ``each`` of them in a sequence, from ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for w, each in pattern:
            rows.append((w, used.get(w, 0), sequence, each, offset))
            used[w] = used.get(w, 0) + each * times
            offset += w * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32 and any others) with ``sequence_id`` and ``offset``."""
    pieces = stage(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    table = places(plan(counts, capacity))
    groups = sum(counts.values()) // GROUP + 1
    dealt = pieces.withColumn("group_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = dealt.groupBy("length", "group_").agg(F.count("*").alias("size_"))
    starts = sizes.selectExpr("length", "group_", "sum(size_) over (partition by length order by group_) - size_ as before_")
    ranked = dealt.selectExpr("*", "row_number() over (partition by length, group_ order by doc_id, piece, ids_crc32) - 1 as within_")
    ranked = ranked.join(starts, ["length", "group_"]).withColumn("rank_", F.col("before_") + F.col("within_"))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table["length"] << 44 | table["rank"]
        for batch in batches:
            rank = batch.column("rank_").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) | rank, "right") - 1
            rank = rank - table["rank"][at]
            sequence = table["sequence"][at] + rank // table["each"][at]
            offset = table["offset"][at] + rank % table["each"][at] * batch.column("length").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank_").mapInArrow(run, schema)


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences than this."""
    return -(-sum(w * n for w, n in counts.items()) // capacity)


