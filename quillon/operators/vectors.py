"""Similarity search over a table of vectors, exact and by cells.

Queries are taken in blocks of bounded size. A block goes to the workers, and every task keeps
the best rows of each of its queries, so what is shuffled is a few rows a query and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.runtime import own_tables

#: Queries that are sent to the workers at once: at 1,000 dimensions 32 MB.
BLOCK_QUERIES = 4096
#: Rows from which the cells of the approximate index are learned, those with the least hashes.
SAMPLE_ROWS = 20_000
#: Scores that a worker computes at once (32 MB).
SCORES = 4_000_000
#: Cells of the approximate index: as many as the square root of the rows, within these bounds.
LEAST_CELLS, MOST_CELLS = 32, 1000
#: Share of the cells that a query looks into. Vectors without much of a cluster structure have neighbours in far cells too.
PROBED = 0.75

_FOUND = "qid bigint, cid bigint, score double"


class EmbeddingMismatchError(ValueError):
    """An index was built with another model than the one that queries it."""


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class _Best:
    """The k best rows of every query of a block, kept while rows stream by.

    A row whose score reaches the present k-th best of a query is noted; notes are thinned out
    from time to time. Copies of a row count once and ties all stay until the order of ids
    decides, so neither the order of batches nor repeated rows can matter.
    """

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.floor = np.full(len(ids), -np.inf)
        self.query, self.row, self.score = [], [], []
        self.noted = 0

    def add(self, queries: np.ndarray, own: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of rows ``own`` (down) for the queries of these numbers (across)."""
        r, q = np.nonzero(scores >= self.floor[queries])
        q, other = queries[q], own[r] != self.ids[queries[q]]
        self.query.append(q[other]), self.row.append(own[r][other]), self.score.append(scores[r, np.searchsorted(queries, q)][other])
        self.noted += int(other.sum())
        if self.noted > 4 * self.k * len(self.ids) + SCORES // 8:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, s = (np.concatenate(x) if x else np.empty(0) for x in (self.query, self.row, self.score))
        order = np.lexsort((-s, c, q))
        q, c, s = q[order], c[order], s[order]
        new = np.ones(q.size, dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s = q[new], c[new], s[new]
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(q.size) - np.repeat(begin, np.diff(np.append(begin, q.size)))
        last = place == self.k - 1
        self.floor[q[last].astype(np.int64)] = s[last]
        top = place < self.k
        q, c, s = q[top], c[top], s[top]
        self.query, self.row, self.score, self.noted = [q], [c], [s], q.size
        return q, c, s


def _partial_top(ids: np.ndarray, vectors: np.ndarray, k: int, centroids: np.ndarray | None = None, probes: int = 0):
    """A map over batches of (id, vector) to the k nearest rows of each query of the block, one task at a time.

    With centroids a row is compared with those queries only that look into its cell.
    """
    if centroids is not None:
        near = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :probes]
        looks = np.zeros((len(ids), len(centroids)), dtype=bool)
        np.put_along_axis(looks, near, True, axis=1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, k)
        every = np.arange(len(ids))
        # a few rows first, so that there is a k-th best to compare with
        step, most = 4 * k + 16, max(1, SCORES // len(ids))
        for batch in batches:
            m, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
            at = 0
            while at < len(own) and m.size:
                part, names = m[at : at + min(step, most)], own[at : at + min(step, most)]
                at, step = at + min(step, most), step * 2
                if centroids is None:
                    best.add(every, names, part @ vectors.T)
                else:
                    cell = (part @ centroids.T).argmax(axis=1)
                    for c in np.unique(cell):
                        asking, inside = np.flatnonzero(looks[:, c]), cell == c
                        if asking.size:
                            best.add(asking, names[inside], part[inside] @ vectors[asking].T)
                best.thin()
        q, c, s = best.thin()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q.astype(np.int64)]), pa.array(c.astype(np.int64)), pa.array(s.astype(np.float64))], names=["qid", "cid", "score"])

    return rows


def _clean(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that have both, without null elements."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return df.where(F.col(row_id).isNotNull() & whole).select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).alias("v"))


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return partial.groupBy("qid", "cid").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, a block at a time; the driver holds one block."""
    ids, vectors = [], []
    for r in asked.dropDuplicates(["id"]).toLocalIterator():
        ids.append(r.id), vectors.append(r.v)
        if len(ids) == BLOCK_QUERIES:
            yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)


def _search(corpus: DataFrame, asked: DataFrame, k: int, centroids: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """Partial results of all blocks. A lone block stays a plan; of several each is run and written before the next is fetched."""
    spark = corpus.sparkSession
    if k <= 0:
        return spark.createDataFrame([], _FOUND)
    path, first, several = f"{own_tables(spark)}/found-{uuid.uuid4().hex}", None, False
    for ids, vectors in _blocks(asked):
        part = corpus.mapInArrow(_partial_top(ids, vectors, k, centroids, probes), _FOUND)
        if first is None:
            first = part
            continue
        if not several:
            first.write.parquet(path)
            several = True
        part.write.mode("append").parquet(path)
    if first is None:
        return spark.createDataFrame([], _FOUND)
    return spark.read.schema(_FOUND).parquet(path) if several else first


def top_k(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, cid, score, rank): the k rows of largest inner product for every query, exactly.

    A query's own row is left out. Ties are broken by the lower id. The queries are taken in
    blocks of bounded size; each block is one pass over the rows that keeps k rows a query and
    task, so what is shuffled does not grow with the rows of a task. Rows with a null id,
    a null vector or null elements are left out; k of 0 gives no rows.
    """
    return _ranked(_search(_clean(rows, row_id, vector), _clean(queries, row_id, vector), k), k)


def learn_cells(rows: DataFrame, cells: int, row_id: str = "vec_id", vector: str = "embedding", rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means over at most ``SAMPLE_ROWS`` rows, those with the least hashes of their ids."""
    drawn = _clean(rows, row_id, vector).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    sample = np.array([r.v for r in drawn.collect()], dtype=np.float64)
    if not len(sample):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[: min(cells, len(sample))]]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def approximate_top_k(rows: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probed: float = PROBED, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Like ``top_k`` over the cells next to each query only; every row is indexed.

    There are about as many cells as the square root of the rows unless told. A row meets the
    queries that look into its cell where it lies, so no vector is shuffled and no cell can be hot.
    """
    corpus, asked = _clean(rows, row_id, vector), _clean(queries, row_id, vector)
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, round(corpus.count() ** 0.5)))
    centroids = learn_cells(rows, cells, row_id, vector)
    if not len(centroids):
        return _ranked(rows.sparkSession.createDataFrame([], _FOUND), max(k, 1))
    return _ranked(_search(corpus, asked, k, centroids, max(1, round(probed * len(centroids)))), max(k, 1))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, wanted, met): how many of the exact neighbours (qid, cid) of each query a search found."""
    met = found.select("qid", "cid", F.lit(1).alias("met"))
    return exact.select("qid", "cid").join(met, ["qid", "cid"], "left").groupBy("qid").agg(F.count("*").alias("wanted"), F.count("met").alias("met"))


def check_signature(stored: str | None, wanted: str) -> None:
    """Refuse an index of another model or prefix; an index without a signature is accepted."""
    if stored is not None and stored.strip() != wanted:
        raise EmbeddingMismatchError(f"the index was built with {stored.strip()!r}, the queries need {wanted!r}")


def signature(model: str, query_prefix: str = "", passage_prefix: str = "") -> str:
    return f"{model}|query={query_prefix}|passage={passage_prefix}"
