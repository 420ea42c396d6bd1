"""Exact top-k inner products over integer vectors: norm-sorted, SVD-rotated, pruned by residual bounds.

Candidates are range-partitioned and sorted by falling length. Each task walks its candidates in that order against
a block of queries and stops when no query's length times the next candidate's length can reach the query's k-th
best score. Within a slice, the first rotated components give a partial sum, Cauchy-Schwarz over the remaining
components bounds the rest, and only pairs whose bound reaches the k-th best score get their exact integer product.
The rotation is the eigenbasis of all candidates' second moments, so early components carry most of a product; any
rotation leaves results exact.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without an
id; vectors of different lengths multiply over their common components, candidates being cut to the longest query
before they are sorted; an empty vector scores 0. Rows with the
query's id are the query's own; a query row that is repeated counts once, a repeated candidate as often as it
stands. Ties go to the smaller id. Scores beyond 64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Bytes of one block of queries, as sent to every task, and candidates that give the first thresholds.
BLOCK_BYTES, HEAD_ROWS = 16_000_000, 2_000
#: Candidates compared at a time, and the parts of the rotated components after which bounds are taken.
SLICE, STEPS = 512, (0.125, 0.25, 0.5)
#: Components up to which vectors are rotated; of wider ones the first components as they are give the partial sums.
MOST_ROTATED = 2_048
#: Integer sums below this are exact in float64.
EXACT = float(2**53)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<double> of integers, norm) of the vectors that take part, each component floor(scale * x)."""
    scaled = table.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("v"))
    finite = scaled.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
    # floor() of a double is a long in Spark: beyond 2**53 doubles are integers already
    whole = finite.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, cut or filled with zeros to `width`."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        out[i, : min(width, b - a)] = flat[a : min(b, a + width)]
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of v v' / |v|^2 over all vectors, largest first: width rows per task reach the driver's sum."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            largest = np.maximum(np.abs(m).max(1, initial=0.0), 1.0)[:, None]
            m = m / largest  # squares stay finite
            m = m / np.maximum(np.sqrt((m * m).sum(1)), 1e-30)[:, None]
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(width), pa.int32()), "at": pa.array([list(range(width))] * width, pa.list_(pa.int32())), "value": pa.array(list(total), pa.list_(pa.float64()))})

    parts = vectors.select("v").mapInArrow(moments, "row int, at array<int>, value array<double>")
    sums = parts.select("row", F.explode(F.arrays_zip("at", "value")).alias("x")).groupBy("row", F.col("x.at").alias("at")).agg(F.sum("x.value").alias("value"))
    gram = np.zeros((width, width))
    for row in sums.collect():  # width * width numbers
        gram[row["row"], row["at"]] = row["value"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class _Searcher:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.vectors, self.rotation, self.k = ids, vectors, rotation, k
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.turned = self._turn(vectors)
        width = vectors.shape[1]
        self.cuts = sorted({max(1, int(width * s)) for s in STEPS} | {width})
        self.rests = [np.sqrt((self.turned[:, c:] ** 2).sum(1)) for c in self.cuts]
        self.scores = np.full((len(ids), k), -np.inf)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf)

    def _turn(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated vectors; wide ones, for which no rotation was made, as they are."""
        return vectors @ self.rotation if self.rotation.shape[0] == vectors.shape[1] else vectors

    def reachable(self, norm: float) -> bool:
        return bool((self.norms * norm * (1 + 1e-9) + 1e-6 >= np.maximum(self.floor, self.scores[:, -1])).any()) if len(self.ids) else False

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in candidates, of falling length."""
        norms = np.sqrt((vectors * vectors).sum(1))
        limit = np.maximum(self.floor, self.scores[:, -1])
        live = np.flatnonzero(self.norms * norms.max(initial=0.0) * (1 + 1e-9) + 1e-6 >= limit)
        if not len(live) or not len(ids):
            return
        turned = self._turn(vectors)
        pad = 1e-9 * norms.max(initial=0.0) * self.norms + 1e-6
        # partial sums grow cut by cut over the queries and candidates that still have a pair within reach
        cols, done = np.arange(len(ids)), 0
        partial = np.zeros((len(live), len(cols)))
        for cut, rests in zip(self.cuts, self.rests, strict=True):
            partial += self.turned[live, done:cut] @ turned[cols, done:cut].T
            rest = np.sqrt((turned[cols, cut:] ** 2).sum(1))
            within = partial + rests[live][:, None] * rest[None, :] >= (limit - pad)[live][:, None]
            done, some_q, some_c = cut, within.any(1), within.any(0)
            live, cols = live[some_q], cols[some_c]
            if not len(live):
                return
            within = within[some_q][:, some_c]
            partial = partial[some_q][:, some_c]
        q, c = np.nonzero(within)
        c = cols[c]
        keep = self.ids[live[q]] != ids[c]
        q, c = live[q[keep]], c[keep]
        for a in range(0, len(q), 65536):
            self._exact(q[a : a + 65536], ids[c[a : a + 65536]], vectors[c[a : a + 65536]])

    def _exact(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        mine = self.vectors[q]
        if len(q) and np.abs(mine).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, mine.shape[1]) < EXACT:
            scores = np.einsum("ij,ij->i", mine, vectors)
        else:
            scores = np.array([min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1) for a, b in zip(mine, vectors, strict=True)], dtype=object)
            self.scores = self.scores.astype(object) if self.scores.dtype != object else self.scores
        order = np.lexsort((ids, -scores.astype(float), q)) if scores.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), dtype=int)
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        for s, e in zip(starts, np.r_[starts[1:], len(q)], strict=True):
            row, e = q[s], min(e, s + self.k)
            pairs = sorted([*zip((-self.scores[row]).tolist(), self.best[row].tolist(), strict=True), *zip((-scores[s:e]).tolist(), ids[s:e].tolist(), strict=True)])[: self.k]
            self.scores[row], self.best[row] = [-p for p, _ in pairs], [i for _, i in pairs]

    def rows(self):
        for i, (query, row) in enumerate(zip(self.ids.tolist(), self.best.tolist(), strict=True)):
            for j, found in enumerate(row):
                if self.scores[i, j] != -np.inf and self.scores[i, j] >= self.floor[i]:
                    yield i, query, found, int(self.scores[i, j])


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with candidates of other ids.

    Both frames are `integer_vectors`. Queries go in blocks of BLOCK_BYTES at most, each block a pass over the
    candidates whose result is written before the next: the driver and every task hold one block at a time, however
    many there are, and candidates are never copied per query.
    """
    spark = candidates.sparkSession
    wanted = stash(queries.select("id", "v").distinct(), "topk-queries")
    n, width = (wanted.agg(F.count("*"), F.max(F.size("v"))).first() or (0, 0))[:2]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    # components beyond the longest query have no part in any product, nor in the order of lengths
    cut = F.when(F.size("v") > width, F.slice("v", 1, width)).otherwise(F.col("v"))
    common = candidates.select("id", cut.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    order = [F.col("norm").desc(), F.col("id")]
    sorted_candidates = stash(common.repartitionByRange(*order).sortWithinPartitions(*order), "topk-candidates")
    rotation = _rotation(sorted_candidates, width) if width <= MOST_ROTATED else np.eye(1)
    head = sorted_candidates.orderBy(*order).limit(HEAD_ROWS).select("id", "v").toArrow().combine_chunks()
    blocks = -(-n * width * 8 // BLOCK_BYTES)
    found = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id", "v").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids, vectors = np.asarray(rows["id"].combine_chunks()), _matrix(rows["v"].combine_chunks(), width)
        first = _Searcher(ids, vectors, rotation, k)
        if head.num_rows:
            head_ids, head_vectors = np.asarray(head["id"].combine_chunks()), _matrix(head["v"].combine_chunks(), width)
            for a in range(0, len(head_ids), SLICE):
                first.offer(head_ids[a : a + SLICE], head_vectors[a : a + SLICE])
        sent = spark.sparkContext.broadcast((ids, vectors, rotation, first.scores[:, -1].copy(), block << 40))

        def search(batches, sent=sent):
            ids, vectors, rotation, floor, base = sent.value
            searcher, open_ = _Searcher(ids, vectors, rotation, k), True
            searcher.floor = floor
            for batch in batches:
                if not open_:
                    continue
                own, matrix = np.asarray(batch.column("id")), _matrix(batch.column("v"), vectors.shape[1])
                for a in range(0, len(own), SLICE):
                    open_ = searcher.reachable(float(np.sqrt((matrix[a] ** 2).sum())))
                    if not open_:
                        break
                    searcher.offer(own[a : a + SLICE], matrix[a : a + SLICE])
            rows = list(searcher.rows())
            if rows:
                i, query, vec, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"query": pa.array([base + x for x in i], pa.int64()), "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

        part = sorted_candidates.select("id", "v").mapInArrow(search, "query long, query_id long, vec_id long, score long")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")  # k rows a task at most
        ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        done = stash(ranked, "topk-found")
        sent.destroy()
        found = done if found is None else found.unionAll(done)
        if (block + 1) % 64 == 0:
            found = stash(found, "topk-found")
    return found
