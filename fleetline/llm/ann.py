"""Approximate nearest neighbours by score-aware quantisation and four-bit tables.

Vectors are cut into subspaces of two dimensions with 16 codewords each.  Codebooks and
codes minimise an anisotropic loss: the part of the residual parallel to the vector,
which is what changes its inner product with the queries that matter, weighs ``eta``
times the orthogonal part.  Codewords are the solution of the weighted least-squares
system, codes come from coordinate descent over the subspaces.  Two four-bit codes
share a byte, so a scan adds one entry of a 256-entry table per byte and vector.  The
nearest by Euclidean distance are the greatest by q.x - |x|^2 / 2, with |x|^2 stored
exactly.  The best ``rerank`` of each block of the index (and all that tie with the
last) are ranked again by the distance of the original vectors in double precision.

The index (vectors with their codes) is written once and stays where it is: tasks read it block by
block, and a vector that is ranked again is at hand in its block.  What moves are the queries, broadcast in groups of at
most ``QUERY_BYTES``, and the ``k`` best per query of each task.  The codebooks are fitted on at
most ``sample`` vectors (the first by a hash of the id); every vector is indexed.

Cases: null ids, and vectors null, zero, holding null or non-finite components or not
of the most frequent length take no part; a query's own id is never its neighbour;
ties go to the smaller id; a repeated query id is asked once; with k candidates or
fewer all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import materialise

SAMPLE = 16_384
RERANK = 512
BLOCK_ROWS = 16_384
#: bytes of query vectors that a task holds at a time
QUERY_BYTES = 16 << 20
THRESHOLD = 0.2


class AnisotropicCodebook:
    """16 codewords for every two dimensions, fitted with the anisotropic loss."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 4, seed: int = 0):
        dim = x.shape[1]
        self.dim, self.parts = dim, -(-dim // 4) * 2  # an even number of subspaces
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        x, u = self._padded(x), self._unit(self._padded(x))
        rng = np.random.default_rng(seed)
        picks = x[rng.choice(len(x), 16, replace=len(x) < 16)]
        self.words = picks.reshape(16, self.parts, 2).transpose(1, 0, 2).copy()  # parts x 16 x 2
        for r in range(rounds + 4):
            eta, self.eta = self.eta, self.eta if r >= 4 else 1.0  # plain k-means first
            codes = self._assign(x, u)
            self._solve(x, u, codes)
            self.eta = eta

    def _padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * 2))
        out[:, : self.dim] = x
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def _assign(self, x: np.ndarray, u: np.ndarray, sweeps: int = 2) -> np.ndarray:
        parts, w = x.reshape(len(x), self.parts, 2), self.words
        us = u.reshape(parts.shape)
        codes = np.empty((len(x), self.parts), np.int64)
        for s in range(self.parts):
            codes[:, s] = ((parts[:, s, None, :] - w[s][None]) ** 2).sum(2).argmin(1)
        if self.eta > 1:
            part = lambda s: (us[:, s] * (parts[:, s] - w[s][codes[:, s]])).sum(1)
            parallel = sum(part(s) for s in range(self.parts))
            for _ in range(sweeps):
                for s in range(self.parts):
                    rest = parallel - part(s)
                    r = parts[:, s, None, :] - w[s][None]
                    loss = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + (us[:, s, None, :] * r).sum(2)) ** 2
                    codes[:, s] = loss.argmin(1)
                    parallel = rest + part(s)
        return codes

    def _solve(self, x: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of least loss for given codes: a linear system over all of them."""
        size = self.parts * 32
        place = (np.arange(self.parts) * 32 + codes * 2)[:, :, None] + np.arange(2)  # rows x parts x 2
        flat = place.reshape(len(x), -1)
        a = np.zeros((size, size))
        for lo in range(0, len(x), 2048):
            z = np.zeros((min(2048, len(x) - lo), size))
            np.put_along_axis(z, flat[lo : lo + 2048], u[lo : lo + 2048], 1)
            a += (self.eta - 1) * (z.T @ z)
        a[np.diag_indices(size)] += np.bincount(flat.ravel(), minlength=size) + 1e-3
        b = np.bincount(flat.ravel(), (self.eta * x).ravel(), size) + 1e-3 * self.words.ravel()
        self.words = np.linalg.solve(a, b).reshape(self.words.shape)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed codes: one byte for two subspaces."""
        x = self._padded(x)
        codes = self._assign(x, self._unit(x)).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: inner product with the two codewords a byte names."""
        q = self._padded(q).reshape(len(q), self.parts, 2)
        one = np.einsum("qsd,swd->qsw", q, self.words)
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), self.parts // 2, 256).astype(np.float32)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(_usable(F.col("v")), F.lit(False)))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (top["n"] if top else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


class _Best:
    """The k best (score, id) of each query, over blocks."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0)] * n

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids[i]):
            ids, scores = np.r_[self.ids[i], ids], np.r_[self.scores[i], scores]
        order = np.lexsort((ids, scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]


def index_vectors(vectors: DataFrame, book, dim: int) -> DataFrame:
    """id, v, code of every vector, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                some = b.slice(lo, 4096)
                codes = book.value.encode(_matrix(some.column("v"), dim))
                yield pa.record_batch([some.column("id"), some.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "code"])

    return materialise(vectors.select("id", "v").mapInArrow(encode, "id long, v array<double>, code binary"), "vector-index")


def scan_index(index: DataFrame, queries: pa.Table, book, dim: int, k: int, rerank: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best of every query, by table scan and exact rerank within a block."""
    asked = index.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), _matrix(queries.column("v").combine_chunks(), dim)))

    def scan(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, best: _Best) -> None:
        q_ids, q = asked.value
        half = (x**2).sum(1).astype(np.float32) / 2
        for lo in range(0, len(q), 256):
            for i, table in enumerate(book.value.tables(q[lo : lo + 256]), lo):
                approx = -half
                for byte, own in zip(codes, table):
                    approx = approx + own[byte]
                approx[ids == q_ids[i]] = -np.inf
                found = np.flatnonzero(approx >= np.partition(approx, -rerank)[-rerank]) if len(approx) > rerank else np.arange(len(approx))
                found = found[ids[found] != q_ids[i]]
                best.add(i, ids[found], np.sqrt(((x[found] - q[i]) ** 2).sum(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, _ = asked.value
        best, held, n = _Best(len(q_ids), k), [], 0

        def block() -> None:
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            codes = np.frombuffer(b"".join(c for b in held for c in b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            scan(ids, np.concatenate([_matrix(b.column("v"), dim) for b in held]), np.ascontiguousarray(codes.T), best)

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                held.append(b.slice(lo, 1024))
                n += held[-1].num_rows
                if n >= block_rows:
                    block()
                    held, n = [], 0
        if n:
            block()
        counts = [len(x) for x in best.ids]
        yield pa.record_batch([pa.array(np.repeat(q_ids, counts)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, rerank: int = RERANK, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest.

    ``vectors`` and ``queries``: id, v, as ``usable_vectors`` gives them.
    """
    spark = vectors.sparkSession
    asked = materialise(queries.dropDuplicates(["id"]), "vector-queries")
    nq = asked.count()
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toArrow()
    if not some.num_rows or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(some.column("v")[0])
    book = spark.sparkContext.broadcast(AnisotropicCodebook(_matrix(some.column("v").combine_chunks(), dim)))
    index = index_vectors(vectors, book, dim)
    groups = -(-nq * dim * 8 * 5 // (4 * query_bytes))  # a hash deals out evenly, within a quarter
    out = None
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()
        if own.num_rows:
            found = scan_index(index, own, book, dim, k, rerank, block_rows)
            out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
