"""Exact nearest vectors of one large set in another: a grid of block pairs, of which bounds of lengths leave some out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, written

#: Vectors of a block; a task holds one block of either side and a matrix of their products.
BLOCK = 4096
#: Decimals to which products are rounded before they are ranked, so that sums in another order give the same ties.
DIGITS = 12


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (id, vec) with their length and the number of their block; blocks hold vectors of like lengths, longest first."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x))
    sized = rows.where("vec IS NOT NULL").select("id", "vec", length.alias("length"))
    parts = max(1, -(-sized.count() // block))
    dealt = sized.repartitionByRange(parts, F.desc("length"), F.xxhash64("id")) if parts > 1 else sized.coalesce(1)
    return written(dealt.withColumn("block", F.spark_partition_id()), "blocks")


def _products(k: int, kind: pa.DataType, digits: int):
    """Of a block of queries and a block of vectors each query's k best.

    One matrix product says which vectors can be among them; these products are taken again in the order of the components,
    so that equal vectors have equal scores wherever they lie.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], kind), "id": pa.array([], kind), "score": pa.array([], pa.float64())})
        q, v = (np.array(side.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(side.num_rows, -1) for side in (left, right))
        order = np.argsort(np.array(right.column("id").to_pylist()), kind="stable")
        v = v[order]
        near = q @ v.T
        if k < near.shape[1] and np.isfinite(near).all():
            size = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
            floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * 10.0**-digits - 1e-12 * size
            who, at = np.nonzero(near >= floor[:, None])
        else:
            who, at = np.indices(near.shape).reshape(2, -1)
        score = np.zeros(len(who))
        for x, y in zip(q.T, v.T, strict=True):
            score += x[who] * y[at]
        score = np.round(score, digits)
        best = np.lexsort((at, -np.where(np.isnan(score), np.inf, score), who))
        who, at, score = who[best], at[best], score[best]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, at, score = who[first], at[first], score[first]
        return pa.table({"query_id": left.column("id").combine_chunks().take(pa.array(who)), "id": right.column("id").combine_chunks().take(pa.array(order[at])), "score": pa.array(score)})

    return run


def top_products(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, digits: int = DIGITS) -> DataFrame:
    """(query_id, id, score, rank): the k rows of vectors with the largest inner products with each row of queries.

    queries and vectors: (id, vec array<double>), ids of one type, vectors of one width; null vectors take no part. Scores are
    rounded to `digits`, ties go to the smaller id. Neither side is broadcast: both are dealt to blocks by length, and a task compares one block with
    one other. First all query blocks meet the block of the longest vectors. A query block's other pairs are left out if
    the product of the two blocks' largest lengths is below the k-th best score that each of its queries has by then. What
    is moved is each vector once for each pair of its block that remains.
    """
    kind = dict(vectors.dtypes)["id"]
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    a, b = _blocks(queries, block), _blocks(vectors, block)
    spans = [side.groupBy("block").agg(F.max("length").alias("most"), F.count("*").alias("n")) for side in (a, b)]
    rows = f"query_id {kind}, id {kind}, score double"

    def met(pairs: DataFrame) -> DataFrame:
        left = a.join(pairs, F.col("block") == F.col("qb")).select("id", "vec", "qb", "vb")
        right = b.join(pairs, F.col("block") == F.col("vb")).select("id", "vec", F.col("qb").alias("of"), F.col("vb").alias("in"))
        return left.groupBy("qb", "vb").cogroup(right.groupBy("of", "in")).applyInArrow(_products(k, arrow, digits), rows)

    pairs = spans[0].select(F.col("block").alias("qb"), F.col("most").alias("q_most")).crossJoin(spans[1].select(F.col("block").alias("vb"), F.col("most").alias("v_most"), "n"))  # a row a pair of blocks
    pairs = written(pairs, "pairs")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = written(met(pairs.where("vb = 0").select("qb", "vb")), "best")
    place = first.withColumn("rank", F.row_number().over(order))
    floors = a.select(F.col("id").alias("query_id"), F.col("block").alias("qb")).join(place.where(F.col("rank") == k).select("query_id", "score"), "query_id", "left")
    floors = floors.groupBy("qb").agg(F.when(F.count("*") == F.count("score"), F.min("score")).alias("floor"))
    open_ = pairs.where("vb > 0").join(floors, "qb").where(F.col("floor").isNull() | (F.col("q_most") * F.col("v_most") * (1 + 1e-9) + 10.0**-digits >= F.col("floor"))).select("qb", "vb")
    found = first.unionByName(met(written(open_, "open")))
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
    discard(first, pairs, a, b)
    return out


def top_members(queries: DataFrame, vectors: DataFrame, members: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(query_id, doc_id, score): each query's k best of members (doc_id, vec_id), rows that share the vectors they name.

    queries and vectors: (id, vec), see top_products. Ties go to the smaller doc_id. A query's k best are among the k
    smallest members of its k best vectors that have any, and of those that tie with the k-th, so members are never paired
    with all queries. Ties beyond k go by each vector's smallest member, by which vectors are numbered.
    """
    within = F.row_number().over(Window.partitionBy("vec_id").orderBy("doc_id"))
    few = written(members.join(vectors.where("vec IS NOT NULL").select(F.col("id").alias("vec_id")), "vec_id", "left_semi").withColumn("place", within).where(F.col("place") <= k), "members")
    firsts = few.where("place = 1").select("vec_id", F.col("doc_id").alias("first"))
    numbered = written(firsts.join(vectors.withColumnRenamed("id", "vec_id"), "vec_id").select(F.col("first").alias("id"), "vec"), "vectors")
    best = top_products(queries.withColumn("id", F.col("id").cast(dict(numbered.dtypes)["id"])), numbered, k, digits=digits)
    met = best.select("query_id", F.col("id").alias("first"), "score").join(firsts, "first").join(few.select("vec_id", "doc_id"), "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    kept = met.select("query_id", "doc_id", "score", F.row_number().over(order).alias("place")).where(F.col("place") <= k)
    return written(kept.select(F.col("query_id").cast(dict(queries.dtypes)["id"]).alias("query_id"), "doc_id", "score"), "best")
