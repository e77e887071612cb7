"""Nearest vectors by inner product through an inverted multi-index.

Both halves of a vector are quantised by their own codebook; a pair of
centroids is a cell.  For a query, the inner products of its halves with the
two codebooks are sorted, and a heap walks the pairs in the order of their sum
until the visited cells hold the wanted share of all vectors; the vectors of
those cells are ranked again by their exact inner product.

Codebooks, and the share that reaches the wanted recall, are fitted on a
bounded sample; every vector is indexed.  Cells are gathered to blocks of
bounded size (a large cell is several blocks), so a task holds one block and
a bounded number of queries.  Queries of one cell, and of neighbouring ones, are
searched together, and a block is copied only for those that visit it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hammerline.llm._spark import cut

#: Rows of the sample, rows of a block, queries of a group and groups that meet a block in one task.
SAMPLE, BLOCK, GROUP, TOGETHER = 20_000, 4096, 512, 16
#: Share of true neighbours that the visited cells should hold, measured on the sample, and how many times the wanted number
#: of neighbours is visited at least.
TARGET, LEAST = 0.96, 10
#: Pairs of a block and the queries that visit it are broadcast up to this many.
BROADCAST_ROWS = 500_000
MERGE = 64


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, the most common length, finite components, not all zero."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (common["d"] if common else 0))


def codebook(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """k-means centroids; the first ones are spread evenly over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(at, x[:, j], minlength=k) / np.maximum(n, 1), c[:, j])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, n: int):
        self.half = max(1, sample.shape[1] // 2)
        self.k = int(np.clip(np.sqrt(n) / 4, 1, min(256, len(sample))))
        self.books = codebook(sample[:, : self.half], self.k), codebook(sample[:, self.half :], self.k)
        self.counts = np.zeros(self.k**2, np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.k + nearest(x[:, self.half :], self.books[1])

    def walk(self, q: np.ndarray, wanted: float, counts: np.ndarray) -> list[int]:
        """Cells in descending order of the summed half products, until they hold `wanted` vectors."""
        a, b = self.books[0] @ q[: self.half], self.books[1] @ q[self.half :]
        oa, ob = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[oa].tolist(), b[ob].tolist()
        # Pair (i, j) enters once (i - 1, j) and (i, j - 1) have left, so the heap stays as small as the frontier.
        heap, done, out, held, k = [(-a[0] - b[0], 0, 0)], [0] * self.k, [], 0, self.k
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * k + ob[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            done[i] = j + 1
            if i + 1 < k and done[i + 1] == j and (j == 0 or done[i + 1] >= j):
                heapq.heappush(heap, (-a[i + 1] - b[j], i + 1, j))
            if j + 1 < k and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
        return out

    def share(self, sample: np.ndarray, top: int, target: float) -> float:
        """The share of vectors to visit so that `target` of the sample's true neighbours are in the visited cells."""
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=self.k**2)
        need = []
        for i in range(min(200, len(sample))):
            score = sample @ sample[i]
            score[i] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(top, len(sample) - 1)]
            order = self.walk(sample[i], np.inf, counts.tolist())
            before = np.zeros(self.k**2)
            before[order] = np.cumsum(counts[order])
            need += (before[cells[near]] / len(sample)).tolist()
        return float(np.quantile(need, target)) if need else 1.0

    def lay_out(self) -> None:
        """Blocks: small cells share one, a large one has several."""
        self.first, self.split = np.zeros(self.k**2, np.int64), np.ones(self.k**2, np.int64)
        block, held = 0, 0
        for cell, n in enumerate(self.counts.tolist()):
            if n > BLOCK or held + n > BLOCK:
                block, held = block + (held > 0), 0
            self.first[cell], self.split[cell] = block, max(1, -(-n // BLOCK))
            held += n
            if n > BLOCK:
                block, held = block + self.split[cell], 0
        self.blocks = int(block + 1)


def _matrix(column, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in column]).reshape(-1, width) if len(column) else np.empty((0, width))


def _top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the `top` rows of each q, the best score first, ties to the smaller id."""
    o = np.lexsort((ids, -score, q))
    head = np.concatenate([[True], q[o][1:] != q[o][:-1]]) if len(o) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0)) if len(o) else np.empty(0, int)
    return o[np.arange(len(o)) - start < top]


_FOUND = "grp long, super long, q binary, id binary, score binary"


def nearest_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", query_every: int = 20, top: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): for each id divisible by `query_every` its `top` nearest other rows.

    Rows without an id, and vectors that are null, zero, of another length than
    the most common, or hold null or non-finite components take no part.  A row
    with the query's own id is never its neighbour.  Rows that repeat an id are
    candidates each; a repeated query id is searched once, with its smallest
    vector.  Ties go to the smaller id.  Other columns are not read; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vector)
    n = v.count()
    got = v.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow()
    sample = np.array(got.column("v").to_pylist(), np.float64) if got.num_rows else np.ones((1, 2))
    width = sample.shape[1]
    index = MultiIndex(sample, max(n, 1))
    wanted = max(LEAST * top, index.share(sample, top, target) * n)
    plain = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain.value.cells(x).astype(np.int64) if len(x) else np.empty(0, np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "v"])

    rows = cut(v.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(assign, "id long, cell long, v binary"))
    # There are 65,536 cells at most.
    for r in rows.groupBy("cell").count().collect():
        index.counts[r["cell"]] = r["count"]
    index.lay_out()
    shared = spark.sparkContext.broadcast(index)

    queries = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")
    queries = cut(queries)
    asked = np.zeros(index.k**2, np.int64)
    for r in queries.groupBy("cell").count().collect():
        asked[r["cell"]] = r["count"]
    before = spark.sparkContext.broadcast((np.cumsum(asked) - asked, np.maximum(asked, 1)))

    def gather(batches):
        # Groups follow the order of the cells, and a cell's queries are dealt evenly over its own.
        first, size = before.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            spread = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((first[cell] + spread % size[cell]) // GROUP)], ["id", "v", "grp"])

    queries = queries.mapInArrow(gather, "id long, v binary, grp long")

    def route(key, table):
        index, grp = shared.value, key[0].as_py()
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v"), width)
        counts = index.counts.tolist()
        visits = np.zeros((len(ids), index.k**2), bool)
        for i, q in enumerate(x):
            visits[i, index.walk(q, wanted, counts)] = True
        out = []
        cells = np.flatnonzero(index.counts)
        last = index.first + index.split
        for block in range(index.blocks):
            own = cells[(index.first[cells] <= block) & (block < last[cells])]
            who = np.flatnonzero(visits[:, own].any(1))
            if len(who):
                out.append((block, grp // TOGETHER, grp, ids[who].tobytes(), x[who].tobytes(), own.tobytes(), np.packbits(visits[np.ix_(who, own)]).tobytes()))
        kinds = [pa.int64()] * 3 + [pa.binary()] * 4
        return pa.table([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["b2", "m2", "grp", "ids", "x", "cells", "visits"])

    routed = cut(queries.groupBy("grp").applyInArrow(route, "b2 long, m2 long, grp long, ids binary, x binary, cells binary, visits binary"))

    def place(batches):
        index = shared.value
        for batch in batches:
            cell = batch.column(1).to_numpy()
            spread = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(index.first[cell] + spread % index.split[cell]), *batch.columns], ["block", "id", "cell", "v"])

    visited = routed.select(F.col("b2").alias("block"), F.col("m2").alias("meet")).distinct()
    visited = F.broadcast(visited) if visited.count() <= BROADCAST_ROWS else visited
    placed = rows.mapInArrow(place, "block long, id long, cell long, v binary").join(visited, "block").select("block", "id", "cell", "v", "meet")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            ids, cell, x = left.column("id").to_numpy(), left.column("cell").to_numpy(), _matrix(left.column("v"), width)
            for r in right.to_pylist():
                qid, qx = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], np.float64).reshape(-1, width)
                cells = np.frombuffer(r["cells"], np.int64)
                visits = np.unpackbits(np.frombuffer(r["visits"], np.uint8), count=len(qid) * len(cells)).reshape(len(qid), -1).astype(bool)
                at = np.searchsorted(cells, cell)
                rough = np.where(visits[:, at] & (qid[:, None] != ids), qx @ x.T, -np.inf)
                edge = np.partition(rough, -top, 1)[:, -top] if rough.shape[1] >= top else np.full(len(qid), -np.inf)
                # All within rounding of the last place are ranked by their exact products.
                q, c = np.nonzero((rough >= edge[:, None] - 1e-9 * (1 + np.abs(edge[:, None]))) & np.isfinite(rough) if top else rough > np.inf)
                score = np.einsum("ij,ij->i", qx[q], x[c])
                keep = _top(qid[q], ids[c], score, top)
                out.append((r["grp"], left.column("block")[0].as_py() // MERGE, qid[q][keep].tobytes(), ids[c][keep].tobytes(), score[keep].tobytes()))
        return _table(out)

    def _table(out):
        kinds = [pa.int64()] * 2 + [pa.binary()] * 3
        return pa.table([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["grp", "super", "q", "id", "score"])

    def merged(table):
        q = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("q")])
        ids = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("id")])
        score = np.concatenate([np.frombuffer(b.as_buffer(), np.float64) for b in table.column("score")])
        keep = _top(q, ids, score, top)
        return q[keep], ids[keep], score[keep]

    def some(key, table):
        q, ids, score = merged(table)
        return _table([(key[0].as_py(), key[1].as_py(), q.tobytes(), ids.tobytes(), score.tobytes())])

    def last(key, table):
        q, ids, score = merged(table)
        head = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
        start = np.maximum.accumulate(np.where(head, np.arange(len(q)), 0)) if len(q) else np.empty(0, int)
        return pa.table({"query_id": q, "rank": (np.arange(len(q)) - start + 1).astype(np.int32), "id": ids, "score": score})

    found = placed.groupBy("block", "meet").cogroup(routed.groupBy("b2", "m2")).applyInArrow(search, _FOUND)
    found = found.groupBy("grp", "super").applyInArrow(some, _FOUND)
    return found.groupBy("grp").applyInArrow(last, "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
