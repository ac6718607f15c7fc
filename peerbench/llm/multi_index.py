"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the normalised vectors are quantised on their own; a pair of centroids names a cell, and
every vector is in the list of its cell. A query goes through the cells by the sum of its distances to
the two centroids, taken from a heap over the sorted distances, until the cells passed hold ``enough``
vectors; those are ranked by their exact cosine with the original vectors in double precision.

Equal vectors are one entry, with the few smallest ids that an answer can need. ``enough`` is measured:
for ``CALIBRATION`` queries the true neighbours are found by one pass over all vectors, and the number
is set so that ``RECALL`` of them would have been met. Vectors that crowd like a cloud of noise need
a large share of the list for that, clustered ones little.

The codebooks are fitted on at most ``TRAIN`` vectors, those with the smallest hash of their id, the
documented bound of the index; every vector is indexed. Codebooks and list sizes have at most
``MOST_CENTROIDS`` rows and its square. Lists are dealt out by first centroid, in blocks of about
``BLOCK`` vectors by ``BLOCK`` queries, however full one is.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the one most vectors have, or rows with a null id; rows that repeat an
id count once, with the least vector. Without other vectors a query has no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.tables import settle

TRAIN = 20_000
MOST_CENTROIDS = 1024
#: Vectors in a cell, if all cells were as full; the number of centroids follows from it.
PER_CELL = 50
CALIBRATION = 96
RECALL = 0.96
BLOCK = 2048


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return len(self.first)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _matrix(column) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_half(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means from k distinct rows."""
    rows = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        of = _squares(x, c).argmin(1)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.vstack([c, np.full((k - len(c), c.shape[1]), 1e3)]) if len(c) < k else c


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: int) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by d1[i] + d2[j], until those passed hold ``enough`` vectors; empty ones are left out."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    # the next column to visit in each row; row a + 1 opens when row a has been entered
    heap, passed = [(s1[0] + s2[0], 0, 0)], 0
    while heap and passed < enough:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        if sizes[i, j]:
            passed += int(sizes[i, j])
            yield i, j
        if b == 0 and a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        if b + 1 < len(s2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (usual[0].n if usual else 0))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which the SQL condition
    ``is_query`` on ``id`` holds, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = settle(_valid(vectors, id_col, vector_col), "vectors")
    # equal vectors: the k + 1 smallest ids answer for all (cut within each task first)
    small = rows.selectExpr("*", "row_number() over (partition by v order by id) as n").where(F.col("n") <= k + 1)
    entries = small.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = settle(entries.select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries")
    queries = settle(rows.where(is_query).select(F.col("id").alias("query_id"), "v").join(entries.select("entry", "v"), "v").select("query_id", "entry"), "queries")
    asked = queries.select("entry").distinct()
    total = entries.count()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not total or asked.isEmpty():
        return spark.createDataFrame([], out)

    cells = min(MOST_CENTROIDS, max(2, round((total / PER_CELL) ** 0.5)))
    train = _unit(_matrix(entries.orderBy(F.xxhash64("entry"), "entry").limit(TRAIN).select("v").toArrow()["v"]))
    half = train.shape[1] // 2
    books = Codebooks(fit_half(train[:, :half], cells, 1), fit_half(train[:, half:], cells, 2))
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = shared.value.distances(_unit(_matrix(batch.column(1)))) if batch.num_rows else (np.zeros((0, 1)), np.zeros((0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1.argmin(1).astype(np.int32)), pa.array(d2.argmin(1).astype(np.int32)), batch.column(1)], names=["entry", "i", "j", "v"])

    placed = settle(entries.select("entry", "v").mapInArrow(place, "entry bigint, i int, j int, v array<double>"), "index")
    sizes = np.zeros((cells, cells), np.int64)
    counted = placed.groupBy("i", "j").count().toArrow()  # cells ** 2 rows at most
    sizes[counted["i"].to_numpy(), counted["j"].to_numpy()] = counted["count"].to_numpy()

    ask = placed.join(asked, "entry", "left_semi")
    enough = _calibrate(placed, ask, books, sizes, k)
    full = sizes.sum(1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = shared.value.distances(_unit(_matrix(batch.column(1))))
            row, first, lists = [], [], []
            for q in range(batch.num_rows):
                seen: dict[int, list[int]] = {}
                for i, j in traverse(d1[q], d2[q], sizes, enough):
                    seen.setdefault(i, []).append(j)
                row += [q] * len(seen)
                first += seen
                lists += seen.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(first, pa.int32()), pa.array(lists, pa.list_(pa.int32())), batch.column(1).take(at)], names=["entry", "i", "js", "v"])

    visits = settle(ask.select("entry", "v").repartition("entry").mapInArrow(visit, "entry bigint, i int, js array<int>, v array<double>"), "visits")
    asked_of = np.zeros(cells, np.int64)
    for r in visits.groupBy("i").count().collect():  # cells rows at most
        asked_of[r.i] = r["count"]
    blocks = lambda n: F.array(*[F.lit(int(-(-x // BLOCK) or 1)) for x in n])[F.col("i")]
    # only cells that some query goes to are sent
    wanted = visits.select("i", F.explode("js").alias("j")).distinct()
    left = placed.join(wanted, ["i", "j"], "left_semi").withColumn("vb", F.pmod(F.xxhash64("entry"), blocks(full))).withColumn("qb", F.explode(F.sequence(F.lit(0), blocks(asked_of) - 1)))
    right = visits.withColumn("qb", F.pmod(F.xxhash64("entry"), blocks(asked_of))).withColumn("vb", F.explode(F.sequence(F.lit(0), blocks(full) - 1)))
    keys = [F.col("i"), F.col("vb").cast("long").alias("vb"), F.col("qb").cast("long").alias("qb")]
    left, right = left.select("entry", "j", "v", *keys), right.select("entry", "js", "v", *keys)

    def rank(own: pa.Table, asking: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        if own.num_rows and asking.num_rows:
            own = own.sort_by([("j", "ascending"), ("entry", "ascending")])
            j, entry, query = own["j"].to_numpy(), own["entry"].to_numpy(), asking["entry"].to_numpy()
            (x, far_x), (y, far_y) = scaled(_matrix(asking["v"])), scaled(_matrix(own["v"]))
            cells = np.unique(j)
            begin, end = np.searchsorted(j, cells), np.searchsorted(j, cells, "right")
            for q, js in enumerate(asking["js"].combine_chunks()):
                met = np.flatnonzero(np.isin(cells, np.asarray(js.values)))
                if not len(met):
                    continue
                # the stretches of the list that hold the visited cells, and no other vector
                seen = np.concatenate([np.arange(begin[c], end[c]) for c in met])
                score = (y[seen] @ x[q]) / (far_x[q] * far_y[seen])
                best = np.lexsort((entry[seen], -score))[: k + 1]
                got.append((np.full(len(best), query[q]), entry[seen[best]], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*got, strict=True))
        return pa.table({"query": pa.array(a, pa.int64()), "entry": pa.array(b, pa.int64()), "score": pa.array(c)})

    by = ["i", "vb", "qb"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "query bigint, entry bigint, score double")
    best = met.selectExpr("*", "row_number() over (partition by query order by score desc, entry) as n").where(F.col("n") <= k + 1)
    found = best.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("met"))
    each = queries.join(found, F.col("query") == F.col("entry"))
    flat = "flatten(transform(met, m -> transform(m.ids, x -> struct(-m.score as far, x as id))))"
    each = each.selectExpr("query_id", f"slice(array_sort(filter({flat}, x -> x.id <> query_id)), 1, {k}) as best")
    each = each.select("query_id", F.posexplode("best").alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, so that squares neither overflow nor vanish, and their lengths."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.linalg.norm(x, axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all of ``b``, from the vectors as they are."""
    (a, far_a), (b, far_b) = scaled(a), scaled(b)
    return (a @ b.T) / (far_a[:, None] * far_b[None, :])


def _calibrate(placed: DataFrame, ask: DataFrame, books: Codebooks, sizes: np.ndarray, k: int) -> int:
    """How many vectors a query has to pass to meet RECALL of the true neighbours of some queries."""
    some = ask.orderBy(F.xxhash64("entry"), "entry").limit(CALIBRATION).select("entry", "v").toArrow()
    ids, x = some["entry"].to_numpy(), _matrix(some["v"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = cosines(x, _matrix(batch.column(3)))
            n = min(k + 1, batch.num_rows)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            q = np.repeat(np.arange(len(ids)), n)
            at = pa.array(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(q), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(score[q, best.ravel()])], names=["q", "entry", "i", "j", "score"])

    met = placed.select("entry", "i", "j", "v").mapInArrow(exact, "q bigint, entry bigint, i int, j int, score double")
    best = met.selectExpr("*", "row_number() over (partition by q order by score desc, entry) as n").where(F.col("n") <= k + 1).collect()
    d1, d2 = books.distances(_unit(x))
    passed = []
    for q, own in enumerate(ids):
        # the cells that come no later than the neighbour's, by the same sums
        far = d1[q][:, None] + d2[q][None, :]
        passed += [int(sizes[far <= far[r.i, r.j]].sum()) for r in best if r.q == q and r.entry != own]
    return int(np.quantile(passed, RECALL, method="higher")) + 1 if passed else 1
