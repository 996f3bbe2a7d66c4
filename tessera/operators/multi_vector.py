"""Late interaction over an index: bags of vectors, found through the centroids near their vectors, exact in the end.

A bag's score for a query is the sum, over the query's vectors, of the best inner product with one of the bag's. Each vector
of a bag lies within a known distance of its centroid, so the products with the centroids and those distances bound the
score from above, at the cost of a table lookup instead of products of whole vectors. Only bags whose bound reaches what the
query's k best bags of a first pass really have are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector import query_blocks
from tessera.session import written

#: Centroids at most, the sampled vectors they are fitted on (all vectors are indexed), and rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 256, 16_384, 6
#: Decimals to which scores are rounded before they are ranked.
DIGITS = 12


def _centroids(sample: np.ndarray, most: int) -> np.ndarray:
    """Means of the vectors nearest to them, begun with evenly spaced ones of the sample; ties go to the first."""
    n = max(1, min(most, int(np.sqrt(len(sample)) * 4), len(sample)))
    means = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(sample, means)[0]
        sums, counts = np.zeros_like(means), np.bincount(near, minlength=n)
        np.add.at(sums, near, sample)
        means[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return means


def _nearest(vectors: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector its centroid and the distance to it, rounded up."""
    near = ((means * means).sum(1) - 2 * vectors @ means.T).argmin(1)
    return near, np.sqrt(((vectors - means[near]) ** 2).sum(1)) * (1 + 1e-9)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of a column of bags, and where each bag's begin."""
    inner = column.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(np.diff(column.offsets.to_numpy()))]
    return flat.reshape(int(at[-1]), -1) if at[-1] else np.zeros((0, 1)), at


@dataclass
class MultiVectorIndex:
    """lists: (id, vecs, centroids, radii), a written table; of each bag its centroids and its vectors' largest distances."""

    lists: DataFrame
    means: np.ndarray

    @classmethod
    def build(cls, bags: DataFrame, centroids: int = CENTROIDS) -> MultiVectorIndex:
        """bags: (id, vecs array<array<double>>). Bags without vectors, or with null ones, take no part; all widths are one."""
        bags = bags.select("id", "vecs").where("size(vecs) > 0 AND forall(vecs, v -> v IS NOT NULL AND size(v) > 0)")
        vectors = bags.select(F.explode("vecs").alias("v"))
        sample = np.array([r.v for r in vectors.orderBy(F.xxhash64("v")).limit(SAMPLE).collect()], float)
        means = _centroids(sample, centroids) if len(sample) else np.zeros((0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, at = _matrix(batch.column("vecs"))
                near, far = _nearest(v, means)
                lists = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own, where = np.unique(near[a:b], return_inverse=True)
                    radii = np.zeros(len(own))
                    np.maximum.at(radii, where, far[a:b])
                    lists.append((own.tolist(), radii.tolist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in lists], pa.list_(pa.int32())), pa.array([x for _, x in lists], pa.list_(pa.float64()))], ["id", "vecs", "centroids", "radii"])

        kind = dict(bags.dtypes)["id"]
        return cls(written(bags.mapInArrow(run, f"id {kind}, vecs array<array<double>>, centroids array<int>, radii array<double>"), "lists"), means)

    def _pairs(self, block: DataFrame, k: int, floors: DataFrame | None) -> DataFrame:
        """(query_id, id, score): each task's k best bags of each query, in full; by bounds first, or all whose bound reaches the floor.

        block: (query_id, vecs), a bounded set, goes to all tasks. Without floors a task compares its k best by bound only.
        """
        asked = block.join(floors, "query_id", "left") if floors is not None else block.withColumn("floor", F.lit(None).cast("double"))
        rows = asked.orderBy("query_id").collect()  # a block of the stated set
        kind = dict(block.dtypes)["query_id"]
        schema = f"query_id {kind}, id {dict(self.lists.dtypes)['id']}, score double"
        if not rows or not len(self.means):
            return block.sparkSession.createDataFrame([], schema)
        means = self.means
        q = np.array([v for r in rows for v in r.vecs], float)
        at = np.r_[0, np.cumsum([len(r.vecs) for r in rows])]
        floor = np.array([-np.inf if r.floor is None else r.floor for r in rows])
        first = floors is None
        shared = block.sparkSession.sparkContext.broadcast((q, at, floor, q @ means.T, np.sqrt((q * q).sum(1)) * (1 + 1e-9), [r.query_id for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_, at_, floor_, near, length, names = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, own = _matrix(batch.column("vecs"))
                listed, radii = batch.column("centroids").flatten().to_numpy(), batch.column("radii").flatten().to_numpy()
                lists = np.r_[0, np.cumsum(np.diff(batch.column("centroids").offsets.to_numpy()))]
                best = np.maximum.reduceat(near[:, listed] + length[:, None] * radii, lists[:-1], axis=1)  # query vector x bag
                bound = np.add.reduceat(best, at_[:-1], axis=0)
                bound += 1e-9 * (1 + np.abs(bound))
                who, which, scores = [], [], []
                for i in range(len(names)):
                    if first:
                        some = np.argsort(-bound[i], kind="stable")[:k]
                    else:
                        some = np.flatnonzero(bound[i] >= floor_[i])
                    for j in some.tolist():
                        exact = (q_[at_[i] : at_[i + 1]] @ v[own[j] : own[j + 1]].T).max(1).sum()
                        who.append(i)
                        which.append(j)
                        scores.append(round(float(exact), DIGITS))
                names_ = pa.array([names[i] for i in who], pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())
                yield pa.RecordBatch.from_arrays([names_, batch.column("id").take(pa.array(which, pa.int64())), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

        return self.lists.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): each query's k best bags, exactly; ties go to the smaller id.

        queries: (query_id, vecs), a stated set, taken in blocks; those without vectors have no answer.
        """
        queries = queries.where("size(vecs) > 0").select("query_id", F.col("vecs").cast("array<array<double>>").alias("vecs"), F.flatten("vecs").alias("flat"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = []
        for block in query_blocks(queries, ["query_id"], "flat"):
            block = written(block.drop("flat"), "asked")
            first = written(ranked(self._pairs(block, k, None)), "first")
            floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            out.append(ranked(self._pairs(block, k, floors)))
        return reduce(DataFrame.union, out)
