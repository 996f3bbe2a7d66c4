"""BM25: corpus statistics and top-k search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import sparse_grid
from tessera.session import written

#: Queries of a block that documents meet.
ASKS = sparse_grid.QUERIES


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


def doc_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, token): a row per occurrence; documents without tokens give none."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("token"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, df, cf, idf) of every token; idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over all N documents.

    Occurrences are summed within documents before documents are counted, both with partial aggregation.
    """
    n = docs.agg(F.count("*").alias("n"))
    per_doc = doc_tokens(docs, id_col, text_col).groupBy("id", "token").agg(F.count("*").alias("tf"))
    per_token = per_doc.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return per_token.crossJoin(F.broadcast(n)).select("token", "df", "cf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, model: Bm25 = Bm25(), doc_id: str = "doc_id", query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of each pair that shares a token; repeated query tokens count repeatedly.

    Only occurrences of query tokens are shuffled. Lengths and N come from one pass over all documents.
    """
    return occurrence_scores(*occurrences(docs, queries, doc_id, query_id, text_col), model)


def occurrences(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What occurrence_scores() takes: occurrences of query tokens, totals (written, as each reading of them would read all
    texts) and query_tokens()."""
    totals = docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = query_tokens(queries, query_id, text_col)
    vocabulary = wanted.select("token").distinct()
    tf = doc_tokens(docs, doc_id, text_col).join(vocabulary, "token", "left_semi").groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return written(tf, "occurrences"), written(totals, "totals"), wanted


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, slack: float = 0.0, only: tuple[str, str] | None = None, model: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, score): of bm25_scores() at least each query's k best by top_k(), and those within `slack` of them.

    only: a column of docs and one of queries that have to be equal; other pairs are left out before the k best are taken.
    The search leaves out pairs where they are found, block by block, so that they are neither sorted nor moved.
    """
    tf, totals, wanted = occurrences(docs, queries)
    left, right = weights(tf, totals, wanted, model)
    if only is not None:
        left = left.join(docs.select(F.col("doc_id").alias("id"), F.col(only[0]).alias("only")), "id")
        right = right.join(queries.select("query_id", F.col(only[1]).alias("only")).distinct(), "query_id")
    return sparse_grid.best(left, right, k, slack)


def query_tokens(queries: DataFrame, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, token, qtf): each token of each query once, and how often the query has it."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def weights(tf: DataFrame, totals: DataFrame, wanted: DataFrame, model: Bm25 = Bm25()) -> tuple[DataFrame, DataFrame]:
    """(id, token, x) and (query_id, token, y) whose products add up to BM25, of what occurrence_scores() takes."""
    length = 1 - model.b + model.b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    left = tf.crossJoin(F.broadcast(totals)).select("id", "token", (F.col("tf") * (model.k1 + 1) / (F.col("tf") + model.k1 * length)).alias("x"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    right = wanted.join(df, "token").crossJoin(F.broadcast(totals)).select("query_id", "token", (idf * F.col("qtf")).alias("y"))
    return left, written(right, "weights")


def occurrence_scores(tf: DataFrame, totals: DataFrame, wanted: DataFrame, model: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, score) from tf (id, token, tf, dl), a written table, the row totals (n, avgdl) and query_tokens()."""
    return sparse_grid.products(*weights(tf, totals, wanted, model), queries=ASKS)


def top_k(scores: DataFrame, k: int, by: str | list[str] = "query_id", score: str = "score", tie: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best rows of each group with their rank from 1: score (rounded) descending, then `tie` ascending."""
    keys = [by] if isinstance(by, str) else by
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    rounded = scores.withColumn(score, F.round(score, digits))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
