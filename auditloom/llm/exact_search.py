"""Exact top-k by inner product over a pivot-distance index.

With M the largest norm, a vector v becomes (v, sqrt(M^2 - |v|^2)) and a query (q, 0); then the squared
distance is |q|^2 + M^2 - 2 q.v, so nearest and highest score are the same order. Pivots come from a
bounded sample; each vector is keyed by its nearest pivot and its distance to it and the table is range
partitioned and sorted by this key, with the id last, so that a vector that occurs very often is split
over partitions too. A run of ``SECTION`` rows of one pivot in rising distance is an annulus: by the triangle inequality
its vectors are no nearer to a query than the query's distance to the pivot lies outside it.

Queries are answered in blocks of bounded size, each sent to the tasks that hold the index. A first job
scores each query's home annulus only and yields a first bound; the second expands annuli in order of
their lower bound and stops where even the bound can't reach the k-th score. Nothing that could reach
it is skipped, so results are exact.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without id; shorter vectors are filled with zeros; rows equal in id and components count once; a row is
no candidate for queries of its own id; with fewer candidates than k, all are returned; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
SAMPLE_ROWS = 4096
MAX_PIVOTS = 128
SECTION = 256
QUERY_BLOCK = 4096
PARTITION_ROWS = 20_000


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of the usable vectors."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return table.where(F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), v.alias("v")).distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as floats, filled with zeros."""
    out = np.zeros((len(column), dim))
    lengths = np.array(pc.list_value_length(column), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))


def choose_pivots(sample: np.ndarray, seed: int = 1) -> np.ndarray:
    """Centres of a few rounds of k-means from spread-out seeds."""
    n = int(min(MAX_PIVOTS, max(1, np.sqrt(len(sample)))))
    rng = np.random.default_rng(seed)
    pivots = sample[[0]]
    for _ in range(n - 1):
        near = _distances(sample, pivots).min(axis=1) ** 2
        if near.sum() <= 0:
            break
        pivots = np.concatenate([pivots, sample[[rng.choice(len(sample), p=near / near.sum())]]])
    for _ in range(5):
        owner = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[owner == k].mean(axis=0) if (owner == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def build_index(vectors: DataFrame, pivots: np.ndarray, dim: int, top: float, rows: int) -> DataFrame:
    """(pivot, distance, vec_id, v) sorted by this key in range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(_matrix(batch.column("v"), dim), top), pivots)
            owner = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(d[np.arange(len(owner)), owner]), batch.column("vec_id"), batch.column("v")],
                                             ["pivot", "distance", "vec_id", "v"])

    keyed = vectors.mapInArrow(run, "pivot int, distance double, vec_id bigint, v array<bigint>")
    parts = max(1, -(-rows // PARTITION_ROWS))
    return materialize(keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id"), "index")


class Best:
    """The k best of each query so far: score falling, id rising."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.rows = np.zeros((0, 3), np.int64)
        self.k, self.kth, self.kth_id = k, floor.astype(np.float64), np.full(queries, np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([query, score, vec_id], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        rank = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.kth[last[:, 0]], self.kth_id[last[:, 0]] = last[:, 1], last[:, 2]


def _search(index: DataFrame, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, top: float, k: int, floor: np.ndarray, home_only: bool) -> DataFrame:
    """(query_id, vec_id, score): each task's best candidates of the block's queries."""
    exact = float(np.abs(queries).max(initial=0)) * np.sqrt(top) * queries.shape[1] < 2**52
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    to_pivot = _distances(lifted, pivots)
    home = to_pivot.argmin(axis=1)
    reach = (queries**2).sum(axis=1) + top  # twice the score is this minus the squared distance
    slack = 1e-6 * (1 + np.sqrt(np.abs(reach)))
    dim = queries.shape[1]
    as_int = queries.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(query_ids), k, floor)
        for batch in batches:
            pivot, distance, ids = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy(), batch.column("vec_id").to_numpy()
            x = _matrix(batch.column("v"), dim)
            # on reread a task's files come in any order, so a section also ends where the distance falls
            cuts = np.nonzero((np.diff(pivot) != 0) | (np.diff(distance) < 0))[0] + 1
            starts = np.concatenate([np.arange(a, b, SECTION) for a, b in zip([0, *cuts], [*cuts, len(pivot)], strict=True)]) if len(pivot) else []
            annuli = list(zip(starts, [*starts[1:], len(pivot)], strict=True))
            lower = np.stack([np.maximum(np.maximum(distance[a] - to_pivot[:, pivot[a]], to_pivot[:, pivot[a]] - distance[b - 1]), 0) for a, b in annuli]) if annuli else np.zeros((0, len(query_ids)))
            for s in np.argsort(lower.min(axis=1) if len(query_ids) else np.zeros(0)):
                a, b = annuli[s]
                if home_only:
                    active = np.nonzero((home == pivot[a]) & (lower[s] <= slack))[0]
                else:
                    bound = (reach - np.maximum(lower[s] - slack, 0) ** 2) / 2
                    active = np.nonzero(bound + 1 >= best.kth)[0]
                if not len(active):
                    continue
                by_id = a + np.argsort(ids[a:b], kind="stable")
                scores = queries[active] @ x[by_id].T if exact else as_int[active] @ x[by_id].astype(np.int64).T
                better = (scores > best.kth[active, None]) | (scores == best.kth[active, None]) & (ids[by_id] < best.kth_id[active, None])
                better &= ids[by_id] != query_ids[active, None]
                some = np.nonzero(better.any(axis=1))[0]
                if not len(some):
                    continue
                ranked = np.where(better[some], -scores[some].astype(np.float64), np.inf)
                first = np.argsort(ranked, axis=1, kind="stable")[:, :k]
                row, col = np.nonzero(np.isfinite(np.take_along_axis(ranked, first, axis=1)))
                at = first[row, col]
                best.add(active[some[row]], scores[some[row], at].astype(np.int64), ids[by_id[at]])
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.rows[:, 0]]), pa.array(best.rows[:, 2]), pa.array(best.rows[:, 1])], ["query_id", "vec_id", "score"])

    return index.select("pivot", "distance", "vec_id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(table: DataFrame, query_step: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best for each row whose id ``query_step`` divides."""
    vectors = materialize(integer_vectors(table), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % query_step == 0).alias("q")).first()
    rows, top, dim = stats["n"], float(stats["top"] or 0), max(1, stats["dim"] or 1)
    if not rows or not stats["q"]:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().combine_chunks().column("v")
    pivots = choose_pivots(_lifted(_matrix(sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample, dim), top))
    index = build_index(vectors, pivots, dim, top, rows)
    blocks = -(-stats["q"] // QUERY_BLOCK)
    answers = None
    for block in range(blocks):
        asked = index.where((F.col("vec_id") % query_step == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).select("vec_id", "v").toArrow()
        ids = asked.column("vec_id").to_numpy()
        queries = _matrix(asked.column("v").combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.int64())), dim)
        ids, keep = np.unique(ids, return_index=True)
        queries = queries[keep]
        probe = _ranked(_search(index, ids, queries, pivots, top, k, np.full(len(ids), -np.inf), True), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        floor = np.full(len(ids), -np.inf)
        floor[np.searchsorted(ids, probe.column("query_id").to_numpy())] = probe.column("score").to_numpy()
        # ties with the bound must come back, so it is met and not exceeded
        found = _ranked(_search(index, ids, queries, pivots, top, k, floor - 0.5, False), k)
        found = materialize(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "answers")
        answers = found if answers is None else answers.union(found)
    return answers
