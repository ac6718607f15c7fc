"""Phrase collocation mining by vertical partitioning of a suffix tree.

The suffixes of all pieces of text, cut to ``max_words`` words, make a tree whose node of a phrase counts
its occurrences. The tree is built in parts: suffixes go to groups by their first word, or by more of their
first words where one prefix alone would outgrow its share of the memory ``budget``, and each group's
subtrees are built apart from all others, depth by depth, the count of a node being the total of the leaves
below it. Nodes above a prefix of several words get their leaves from several groups and are added up last.

Passes over the text: (1) words are counted; (2) while prefixes of some length are too heavy, the suffixes
below the next longer ones are counted; (3) suffixes are sent to their groups. A chunk of text sends each
distinct suffix once with its count, as sorted columns of word numbers. What tasks have to know of the whole
corpus has a fixed size: the ``named`` most frequent words, which have one number everywhere (others go along
with their suffixes as text); a bitmap of words met ``min_count`` times, as rarer words are in no phrase and end
suffixes; and a bitmap of heavy prefixes for each length. A collision in a bitmap costs a suffix or a split too
many. No count depends on a hash: groups compare words.

Definitions: A-Z become lower case; ``[.,;:!?]`` and line ends part a text into pieces; words are runs of
characters other than space and tab. ``score`` of a cut after k words is floor(1000 a n / (l r)), exact in
DECIMAL(38, 0); the lowest cut counts, ties to the smallest k. A candidate goes if a longer one that holds it
is met as often.

Defined results: a null text has no words; a null language is ``und``; null and repeated ids do not matter,
as every row is text of its own; ties in rank go by the bytes of the phrase, so ranks are unique; a text of any
length is handled in chunks that end between pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerbench.llm.arrays import mix, text_buffers
from peerbench.llm.tables import settle

BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Phrases:
    """``budget``: suffixes that a group of prefixes may hold; a prefix with more than an eighth of it is split,
    or, in a corpus so large that many slots of the bitmap would be that heavy, one with twice the mean slot's."""

    max_words: int = 5
    min_count: int = 100
    top: int = 2000
    budget: int = 1 << 21
    slots: int = 1 << 16
    bits: int = 24
    named: int = 1 << 17
    chunk: int = 4 << 20


@dataclass
class Tokens:
    """A chunk as numbers: ``ids`` of its words in order, ``same`` where the next word is of the same piece;
    each number stands for a ``word`` of a ``lang``."""

    ids: np.ndarray
    same: np.ndarray
    lang: np.ndarray
    word: pa.Array

    def checks(self, names: list[str]) -> np.ndarray:
        """CRC-32 of language, space and word."""
        seed = [zlib.crc32(f"{n} ".encode()) for n in names]
        return np.array([zlib.crc32(w.encode(), seed[k]) for w, k in zip(self.word.to_pylist(), self.lang.tolist())], np.int64)


def _cut(text: np.ndarray, most: int) -> int:
    """The place after the last end of a piece in the first ``most`` bytes, or else after the first one."""
    ends = np.flatnonzero(BREAK[text[:most]])
    if len(ends):
        return int(ends[-1]) + 1
    for at in range(most, len(text), most):
        ends = np.flatnonzero(BREAK[text[at : at + most]])
        if len(ends):
            return at + int(ends[0]) + 1
    return len(text)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes, bounds of texts in them and their languages, about ``most`` bytes at once. A longer text is
    cut after a character that ends a piece."""
    held, size, langs = [], 0, []
    for batch in batches:
        data, bounds = text_buffers(batch.column(0))
        names = batch.column(1).fill_null("und").to_pylist()
        for i in range(len(names)):
            lo, end = int(bounds[i]), int(bounds[i + 1])
            while lo < end:
                hi = end
                if end - lo > most:
                    hi = _cut(data[lo:end], most) + lo
                if size and size + hi - lo > most:
                    yield np.concatenate(held), np.cumsum([0, *map(len, held)]), langs
                    held, size, langs = [], 0, []
                held.append(data[lo:hi])
                langs.append(names[i])
                size, lo = size + hi - lo, hi
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)]), langs


def tokenise(data: np.ndarray, bounds: np.ndarray, langs: list[str]) -> tuple[Tokens, list[str]]:
    low = LOWER[data]
    part = BREAK[low]
    inside = ~(part | BLANK[low])
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(part), start)
    same = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    coded = words.dictionary_encode()
    names, of = np.unique(np.array(langs, object), return_inverse=True)
    width = max(len(coded.dictionary), 1)
    ids, kinds = pd.factorize(of[row] * width + coded.indices.to_numpy().astype(np.int64))
    return Tokens(ids.astype(np.int32), np.r_[same, False][: len(ids)], kinds // width, coded.dictionary.take(pa.array(kinds % width))), list(names)


def distinct_suffixes(ids: np.ndarray, same: np.ndarray, keep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of two words or more, sorted, and how often each is met. Suffixes end at ``most``
    words, at the end of a piece and before words that are not to be kept; absent words are -1."""
    good = keep[ids]
    on = same.copy()
    on[:-1] &= good[:-1] & good[1:]
    at = np.flatnonzero(on)
    columns = [ids[at], ids[at + 1]]
    alive = np.ones(len(at), bool)
    for j in range(2, most):
        before = np.minimum(at + j - 1, len(ids) - 1)
        alive &= on[before]
        columns.append(np.where(alive, ids[np.minimum(before + 1, len(ids) - 1)], np.int32(-1)))
    wide = np.int64(len(keep) + 1)
    keys = [columns[0].astype(np.int64) + 1]
    for c in columns[1:]:
        if int(keys[-1].max(initial=0) + 1) * int(wide) < 2**62:
            keys[-1] = keys[-1] * wide + c + 1
        else:
            keys.append(c.astype(np.int64) + 1)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    new[:1] = True
    first = np.flatnonzero(new)
    table = np.stack([c[order[first]] for c in columns], axis=1) if len(at) else np.zeros((0, most), np.int32)
    return table, np.diff(np.r_[first, len(at)])


def prefix_keys(table: np.ndarray, checks: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each suffix's prefix and how many words it is to have: one, or more while the shorter one is
    heavy. A suffix that ends with a heavy prefix keeps its key, and counts as one to be added up later.
    ``heavy`` has a row of slots for each number of words."""
    slots = np.uint64(heavy.shape[1])
    h = mix(checks.astype(np.uint64))
    key = checks.astype(np.uint64)[table[:, 0]]
    depth = np.ones(len(table), np.int64)
    for j in range(1, table.shape[1]):
        more = (depth == j) & heavy[j - 1, key % slots]
        if not more.any():
            break
        depth[more] = j + 1
        more &= table[:, j] >= 0
        key[more] = mix(key[more] * _STEP + h[table[more, j]])
    return key, depth


def _bit(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def pack_groups(tokens: Tokens, names: list[str], numbers: np.ndarray, table, count, key, depth, groups: int, named: int) -> Iterator[tuple]:
    """(lang, group, words, suffixes, depths, counts) for each group that this chunk has suffixes of. A word is
    written as its number, or as ``named`` and its place among ``words`` if it has none."""
    if not len(table):
        return
    lang = tokens.lang[table[:, 0]]
    where = lang * groups + (mix(key) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    table, count, depth, where = table[order], count[order].astype(np.int64), depth[order].astype(np.int8), where[order]
    coded = np.where(table >= 0, numbers[table], np.int32(-1))
    cuts = np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = coded[lo:hi].T.copy()
        other = own == named
        used, place = np.unique(table[lo:hi].T[other], return_inverse=True)
        own[other] += place.astype(np.int32)
        words = "\n".join(tokens.word.take(pa.array(used)).to_pylist())
        yield names[lang[order[lo]]], int(where[lo] % groups), words, squeeze(own.tobytes()), squeeze(depth[lo:hi].tobytes()), squeeze(count[lo:hi].tobytes())


def subtrees(rows: pa.Table, names: pa.Array, params: Phrases) -> pa.Table:
    """The nodes of one group met ``min_count`` times or more, and all those above its prefixes. ``names``: the
    words that have numbers, each after its language."""
    others: dict[str, int] = {}
    tables, depths, counts = [], [], []
    plain = zstandard.ZstdDecompressor().decompress
    for words, suffixes, depth, count in zip(*(rows[c].to_pylist() for c in ("words", "suffixes", "depths", "counts")), strict=True):
        table = np.frombuffer(plain(suffixes), np.int32).reshape(params.max_words, -1).T.copy()
        if words:
            of = np.array([len(names) + others.setdefault(w, len(others)) for w in words.split("\n")], np.int32)
            high = table >= len(names)
            table[high] = of[table[high] - len(names)]
        tables.append(table)
        depths.append(np.frombuffer(plain(depth), np.int8))
        counts.append(np.frombuffer(plain(count), np.int64))
    table, depth, count = np.concatenate(tables), np.concatenate(depths), np.concatenate(counts)
    other = list(others)
    word = lambda w: names[w].as_py().rpartition(" ")[2] if w < len(names) else other[w - len(names)]
    wide = np.int64(len(names) + len(other) + 1)
    node = table[:, 0].astype(np.int64)
    out: list[tuple[str, int]] = []
    for m in range(2, params.max_words + 1):
        has = table[:, m - 1] >= 0
        table, depth, count = table[has], depth[has], count[has]
        _, first, inverse = np.unique(node[has] * wide + table[:, m - 1], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inverse, count)
        open_ = np.zeros(len(first), bool)
        open_[inverse[depth > m]] = True
        live = open_ | (total >= params.min_count)
        out += [(" ".join(map(word, table[first[k], :m].tolist())), int(total[k])) for k in np.flatnonzero(live)]
        go = live[inverse]
        table, depth, count, node = table[go], depth[go], count[go], inverse[go]
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(out), pa.string()), "phrase": pa.array([p for p, _ in out], pa.string()), "n": pa.array([n for _, n in out], pa.int64())})


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null")


def count_words(texts: DataFrame, params: Phrases) -> DataFrame:
    """(lang, phrase, n) of single words."""

    def run(batches):
        for chunk in text_chunks(batches, params.chunk):
            tokens, names = tokenise(*chunk)
            lang = pa.array(names, pa.string()).take(pa.array(tokens.lang)) if len(tokens.lang) else pa.array([], pa.string())
            n = np.bincount(tokens.ids, minlength=len(tokens.lang)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([lang, tokens.word.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _check() -> F.Column:
    """What :meth:`Tokens.checks` gives."""
    return F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary"))


def frequent_bitmap(words: DataFrame, params: Phrases) -> np.ndarray:
    """One bit for each checksum slot that a frequent word has; 2^bits bits whatever the corpus."""
    slot = _check().bitwiseAND((1 << params.bits) - 1) + 1
    parts = words.where(F.col("n") >= params.min_count).select(slot.alias("s"))
    parts = parts.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros(max(1 << (params.bits - 3), 4096), np.uint8)
    for b, bits in parts.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", params: Phrases = Phrases()) -> DataFrame:
    """(lang, phrase, n): every word, and every phrase up to ``max_words`` words met ``min_count`` times."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    words = settle(count_words(texts, params), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    limit = max(params.budget // 8, -(-2 * total // params.slots))
    groups = max(1, -(-2 * total // params.budget))
    top = words.where(F.col("n") >= params.min_count).orderBy(F.desc("n"), "lang", "phrase").limit(params.named).toArrow()
    named = spark.sparkContext.broadcast(pc.binary_join_element_wise(top["lang"], top["phrase"], " ").combine_chunks())
    bitmap = spark.sparkContext.broadcast(frequent_bitmap(words, params))
    mask = (1 << params.bits) - 1

    def suffixes_of(batches, heavy):
        for chunk in text_chunks(batches, params.chunk):
            tokens, names = tokenise(*chunk)
            checks = tokens.checks(names)
            table, count = distinct_suffixes(tokens.ids, tokens.same, _bit(bitmap.value, checks & mask), params.max_words)
            yield tokens, names, table, count, *prefix_keys(table, checks, heavy.value)

    slot = F.pmod(_check(), F.lit(params.slots)).alias("slot")
    over = words.groupBy(slot).agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    heavy = np.zeros((params.max_words, params.slots), bool)
    for depth_now in range(1, params.max_words + 1):
        found = [r["slot"] for r in over.select("slot").collect()]
        heavy[depth_now - 1, found] = True
        shared = spark.sparkContext.broadcast(heavy.copy())
        if not found or depth_now == params.max_words:
            break

        def loads(batches, shared=shared, want=depth_now + 1):
            held = np.zeros(params.slots, np.int64)
            for _, _, table, _, key, depth in suffixes_of(batches, shared):
                below = key[(depth == want) & (table[:, want - 1] >= 0)]
                held += np.bincount((below % np.uint64(params.slots)).astype(np.int64), minlength=params.slots)
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(held[at])], names=["slot", "n"])

        over = texts.mapInArrow(loads, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > limit)

    def pack(batches):
        for tokens, names, table, count, key, depth in suffixes_of(batches, shared):
            full = pc.binary_join_element_wise(pa.array(names, pa.string()).take(pa.array(tokens.lang)), tokens.word.cast(pa.string()), " ")
            numbers = np.asarray(pc.index_in(full, value_set=named.value).fill_null(len(named.value))).astype(np.int32)
            packed = list(pack_groups(tokens, names, numbers, table, count, key, depth, groups, len(named.value)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*packed, strict=True) if packed else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["lang", "g", "words", "suffixes", "depths", "counts"])

    def build(rows: pa.Table) -> pa.Table:
        return subtrees(rows, named.value, params)

    blocks = texts.mapInArrow(pack, "lang string, g int, words string, suffixes binary, depths binary, counts binary")
    nodes = blocks.groupBy("lang", "g").applyInArrow(build, "lang string, phrase string, n bigint")
    longer = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= params.min_count)
    return settle(longer, "phrases").unionByName(words)


def _part(first, length) -> F.Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", params: Phrases = Phrases()) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    counts = count_phrases(docs, text_col, lang_col, params)
    words = counts.where(~F.contains("phrase", F.lit(" ")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    found = counts.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    size = F.size("w")

    # Shorter phrases that a longer one met as often holds.
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _part(i, m))))
    )
    held = found.where(size > 2).select("lang", inner.alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    free = found.join(held, ["lang", "phrase"], "left").where("held is null or held < a").drop("held")

    cuts = free.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, size - F.col("k")).alias("tail"))
    often = counts.where(F.col("n") >= params.min_count)
    for name, side in (("l", "head"), ("r", "tail")):
        cuts = cuts.join(often.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * big("total"), big("l") * big("r"))
    best = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= params.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
