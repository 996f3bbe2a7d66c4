"""Fusing, boosting, filtering and reranking ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion (fixed value).
RRF_K = 60


def rrf(left: DataFrame, right: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, left_rank, right_rank, score): the sum of 1 / (k + rank) over the lists that have the pair."""
    a = left.select("query_id", "doc_id", F.col("rank").alias("left_rank"))
    b = right.select("query_id", "doc_id", F.col("rank").alias("right_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full")
    return both.withColumn("score", F.coalesce(1 / (k + F.col("left_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("right_rank")), F.lit(0.0)))


def min_max(rows: DataFrame, by: str = "query_id", score: str = "score", out: str = "norm") -> DataFrame:
    """Adds the score scaled to 0..1 within its group; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(out, F.when(high == low, 1.0).otherwise((F.col(score) - low) / F.nullif(high - low, F.lit(0.0))))


def alpha_blend(dense: Column, lexical: Column, tags: Column, alpha: float = 0.6, beta: float = 0.1) -> Column:
    return alpha * F.coalesce(dense, F.lit(0.0)) + (1 - alpha) * F.coalesce(lexical, F.lit(0.0)) + beta * F.coalesce(tags, F.lit(0.0))


def heuristic_bonus(same_type: Column, same_source: Column, recall: Column) -> Column:
    """What the rerank adds (fixed weights): 0.08 for the type, 0.06 for the source, 0.05 times the token recall."""
    return F.when(same_type, 0.08).otherwise(0.0) + F.when(same_source, 0.06).otherwise(0.0) + 0.05 * recall


def boosted(score: Column, overlap: Column, weight: float = 0.03) -> Column:
    return score + weight * overlap


def tag_filter(rows: DataFrame, overlap: str, query_has_tags: Column) -> DataFrame:
    """Drops rows without overlap, but only for queries that have tags."""
    return rows.where(~query_has_tags | (F.col(overlap) > 0))


def merge_rounds(rounds: list[DataFrame], k: int) -> DataFrame:
    """One list of several retrieval rounds: each document once with its best score, then the k best again."""
    from functools import reduce

    from tessera.operators.lexical import top_k

    every = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score") for r in rounds])
    return top_k(every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


#: How many times the results asked for a dense search fetches before it filters and adds bonuses (fixed value).
OVERFETCH = 30


def tag_aware(rows: DataFrame, k: int, mode: str, overlap: str = "overlap", useful: str = "query_has_tags", weight: float = 0.03) -> DataFrame:
    """The k best of rows (query_id, doc_id, score, overlap, query_has_tags) by one of three modes.

    none: as they are; boost: weight for each overlap; filter: without overlap a row goes, if its query has tags at all.
    """
    from tessera.operators.lexical import top_k

    if mode == "filter":
        rows = tag_filter(rows, overlap, F.col(useful))
    if mode == "boost":
        rows = rows.withColumn("score", boosted(F.col("score"), F.col(overlap), weight))
    return top_k(rows, k)


def fetched(scores: DataFrame, k: int, candidates: int, mode: str) -> DataFrame:
    """What a lexical search fetches: `candidates` where tags decide afterwards, else k."""
    from tessera.operators.lexical import top_k

    return top_k(scores, k if mode == "none" else candidates).drop("rank")


def overfetched(scores: DataFrame, k: int, keep: Column | None = None, bonus: Column | None = None) -> DataFrame:
    """The OVERFETCH * k best of each query, those that pass `keep`, with the bonus added."""
    from tessera.operators.lexical import top_k

    rows = top_k(scores, OVERFETCH * k).drop("rank")
    rows = rows if keep is None else rows.where(keep)
    return rows if bonus is None else rows.withColumn("score", F.col("score") + bonus)
