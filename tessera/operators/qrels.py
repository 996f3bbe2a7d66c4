"""Relevance labels from evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_evidence, token_recall, tokens
from tessera.operators import sparse_grid
from tessera.operators.vector import query_blocks
from tessera.session import written


def page_overlaps(page: Column, start: Column, end: Column) -> Column:
    """Whether a page lies in a range; the end defaults to the start, nulls and texts that are no number give false."""
    p, a = page.try_cast("int"), start.try_cast("int")
    b = F.coalesce(end.try_cast("int"), a)
    return F.coalesce((p >= a) & (p <= b), F.lit(False))


def _shared(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, token, x) and (query_id, token, y) of distinct tokens, whose products add up to those that a pair shares."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct().withColumn("y", F.lit(1.0))
    d = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(q.select("token").distinct(), "token", "left_semi")
    return written(d.withColumn("x", F.lit(1.0)), "words"), q


def candidates(queries: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id, shared): pairs that share at least `least` distinct tokens."""
    pairs = sparse_grid.products(*_shared(queries, docs))
    return pairs.select("query_id", "doc_id", F.round("score").cast("long").alias("shared")).where(F.col("shared") >= least)


def best_candidates(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, shared): of candidates() of one token or more at least the k that share most with each query."""
    return sparse_grid.best(*_shared(queries, docs), k).select("query_id", "doc_id", F.round("score").cast("long").alias("shared"))


def inner_words(queries: DataFrame) -> DataFrame:
    """(query_id, token): the distinct words of each query's normalised text but its first and last.

    They have a space on either side, so a document that holds the text holds them as words of its own.
    """
    words = F.split(F.col("norm"), " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    return queries.select("query_id", F.explode(F.array_distinct(inner)).alias("token"))


def exact_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose normalised text holds the query's, found through its rarest inner word.

    Queries of fewer than three words are looked for in all documents, as a stated set, in blocks that are broadcast.
    Documents are normalised once for their words, and again for those that share the word.
    """
    q = written(queries.select("query_id", normalize_evidence(F.col("text")).alias("norm")), "queries")
    d = docs.select("doc_id", normalize_evidence(F.col("text")).alias("norm"))
    inner = inner_words(q)
    words = written(d.select("doc_id", F.explode(F.array_distinct(F.split(F.col("norm"), " "))).alias("token")).join(inner.select("token").distinct(), "token", "left_semi"), "words")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "token", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))["token"].alias("token"))
    keyed = rarest.join(q, "query_id").select("query_id", F.col("norm").alias("qn"), "token")
    pairs = words.join(keyed, "token").select("query_id", "doc_id", "qn")
    found = pairs.join(d, "doc_id").where(F.col("norm").contains(F.col("qn"))).select("query_id", "doc_id")
    short = written(q.where(F.size(F.split("norm", " ")) < 3).select("query_id", F.col("norm").alias("qn"), F.split("norm", "").alias("letters")), "short")
    if short.isEmpty():
        return found
    for block in query_blocks(short, ["query_id"], "letters"):
        found = found.union(d.join(F.broadcast(block), F.col("norm").contains(F.col("qn"))).select("query_id", "doc_id"))
    return found


def cascade(queries: DataFrame, docs: DataFrame, exact: DataFrame, gate: float = 0.6, most: int = 5) -> DataFrame:
    """(query_id, doc_id, stage, score): exact matches; for queries without any, the `most` best by token recall >= gate."""
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    size = rest.select("query_id", F.size(F.array_distinct(tokens(F.col("text")))).alias("n"))
    fuzzy = candidates(rest, docs, 1).join(size, "query_id").withColumn("score", F.round(F.col("shared") / F.col("n"), 6)).where(F.col("score") >= gate)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    fuzzy = fuzzy.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query_id", "doc_id", F.lit("fuzzy").alias("stage"), "score")
    return exact.select("query_id", "doc_id", F.lit("exact").alias("stage"), F.lit(1.0).alias("score")).unionByName(fuzzy)


def evidence_score(evidence: Column, answer: Column, text: Column, same_type: Column) -> Column:
    """20 for the evidence as a substring, 8 for the answer, 10 times the token recall, 2 for the type (fixed weights)."""
    hay = normalize_evidence(text)
    return (
        F.when(hay.contains(normalize_evidence(evidence)), 20.0).otherwise(0.0) + F.when(hay.contains(normalize_evidence(answer)), 8.0).otherwise(0.0)
        + 10 * token_recall(tokens(evidence), tokens(text)) + F.when(same_type, 2.0).otherwise(0.0)
    )


def gated(score: Column, same_source: Column, on_page: Column) -> Column:
    """An evidence score, 0 for another source or page than the query names; null conditions, where it names none, pass."""
    return F.when(F.coalesce(same_source, F.lit(True)) & F.coalesce(on_page, F.lit(True)), score).otherwise(0.0)
