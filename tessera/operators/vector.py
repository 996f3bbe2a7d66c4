"""Exact vector search and vector aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot
from tessera.operators.lexical import top_k


#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 64_000_000


def query_blocks(asked: DataFrame, key: list[str], vector: str, most: int | None = None) -> list[DataFrame]:
    """A stated query set in blocks of about `most` bytes (BLOCK_BYTES) of vectors, each small enough to be broadcast."""
    size = asked.agg(F.sum(8 * F.size(vector) + 64).alias("b")).first().b or 0
    n = -(-size // (most or BLOCK_BYTES)) or 1
    return [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) for k in range(n)]


def inner_products(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score): every query against every vector; the stated query set is broadcast block by block."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("__q"))
    every = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector).alias("__v"))
    parts = [every.crossJoin(F.broadcast(block)).select("query_id", "doc_id", dot(F.col("__q"), F.col("__v")).alias("score")) for block in query_blocks(asked, ["query_id"], "__q")]
    return reduce(DataFrame.union, parts)


def overfetch_then_filter(scores: DataFrame, k: int, factor: int, keep: Column) -> DataFrame:
    """The k best of those among the factor * k best that pass `keep`; not the same as filtering first."""
    fetched = top_k(scores, k * factor).drop("rank")
    return top_k(fetched.where(keep), k)


def mean_vector(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, vector): the mean of each group's vectors scaled to unit length; a zero mean stays zero."""
    parts = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    packed = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return packed.select(by, F.transform("v", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("vector"))


def max_sim(tokens_a: Column, tokens_b: Column) -> Column:
    """Late interaction: the sum over the vectors of a of their best inner product with a vector of b."""
    best = F.transform(tokens_a, lambda x: F.array_max(F.transform(tokens_b, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def norm_scores(scores: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Adds norm_score: the score over the group's best score."""
    return scores.withColumn("norm_score", F.col(score) / F.max(score).over(Window.partitionBy(by)))
