"""Batch job: how well do the retrieval methods find the documents that hold each question's passage?

    python -m jobs.retrieval_report --documents documents.parquet --questions benchmark.parquet --output report --config jobs/retrieval_report.json

Reads documents (doc_id, text) and questions (item_id, text). Documents whose normalised text holds a question's are
relevant to it. Each method ranks documents for each question: bm25, overlap (share of the question's distinct tokens) and
rrf (both fused). Written, a folder for each method:

    output/hits/method=...     query_id, rank, doc_id, score, relevant: the first `top` documents
    output/metrics/method=...  query_id, k, hit, precision, recall, mrr, ndcg, for each of `ks`
    output/summary/method=...  k, questions and the metrics' means (recall over questions with relevant documents)

A method's folders are replaced whole, also by nothing, so a rerun gives the same result and a run with fewer methods
leaves the others' folders alone. A question without tokens has no hits; its metrics are zeros. Repeated rows of questions
count once; documents need distinct ids.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from tessera.functions.text import tokens
from tessera.operators import fusion, lexical, metrics, qrels
from tessera.session import discard, written

LOG = logging.getLogger("retrieval_report")
METHODS = ("bm25", "overlap", "rrf")
SCHEMAS = {
    "hits": "query_id long, rank long, doc_id long, score double, relevant boolean, method string",
    "metrics": "query_id long, k int, hit int, precision double, recall double, mrr double, ndcg double, method string",
    "summary": "k int, questions long, hit double, precision double, recall double, mrr double, ndcg double, method string",
}


@dataclass(frozen=True)
class Settings:
    methods: tuple[str, ...] = METHODS
    top: int = 10
    #: Ranks that fusion looks at.
    pool: int = 50
    ks: tuple[int, ...] = (1, 5, 10)

    def __post_init__(self) -> None:
        if not self.methods or not set(self.methods) <= set(METHODS) or not self.ks or min(self.top, self.pool, *self.ks) < 1:
            raise ValueError(f"methods are of {METHODS}; top, pool and ks are 1 or more")


def overlap_scores(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): which share of the question's distinct tokens the document has; at least the k best of each."""
    size = questions.select("query_id", F.size(F.array_distinct(tokens(F.col("text")))).alias("n"))
    return qrels.best_candidates(questions, docs, k).join(size, "query_id").select("query_id", "doc_id", (F.col("shared") / F.col("n")).alias("score"))


def run(spark: SparkSession, documents: str, questions: str, output: str, settings: Settings = Settings()) -> dict[str, int]:
    """Ranks documents for questions by each method, judges the ranks, writes hits, metrics and a summary."""
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("long").alias("query_id"), "text").where("query_id IS NOT NULL").distinct()
    counts = {"documents read": docs.count(), "questions read": asked.count()}
    LOG.info("read %d documents of %s, %d questions of %s", counts["documents read"], documents, counts["questions read"], questions)

    relevant = written(qrels.exact_matches(asked, docs).distinct(), "relevant")
    most = settings.pool
    ranked = {
        "bm25": lambda: lexical.top_k(lexical.bm25_best(docs, asked, most), most),
        "overlap": lambda: lexical.top_k(overlap_scores(asked, docs, most), most),
    }
    needed = {m for m in ranked if m in settings.methods or "rrf" in settings.methods}
    runs = {m: written(ranked[m]().select("query_id", "rank", "doc_id", "score"), "run") for m in sorted(needed)}
    if "rrf" in settings.methods:
        runs["rrf"] = written(lexical.top_k(fusion.rrf(runs["bm25"], runs["overlap"]), settings.top, digits=8).select("query_id", "rank", "doc_id", "score"), "run")

    for method in settings.methods:
        first = runs[method].where(F.col("rank") <= settings.top)
        marked = first.join(relevant.withColumn("relevant", F.lit(True)), ["query_id", "doc_id"], "left")
        parts = {"hits": marked.withColumn("relevant", F.coalesce("relevant", F.lit(False)))}
        measured = metrics.retrieval_metrics(first, relevant, asked, list(settings.ks))
        parts["metrics"] = measured.select("query_id", "k", "hit", *(F.round(m, 6).alias(m) for m in metrics.METRICS[1:]))
        for part in ("hits", "metrics", "summary"):
            if part == "summary":  # from what has been written, not from a second search
                done = read_part(spark, output, "metrics").where(F.col("method") == method)
                parts[part] = done.groupBy("k").agg(F.count("*").alias("questions"), *(F.round(F.avg(m), 6).alias(m) for m in metrics.METRICS))
            names = [c.split()[0] for c in SCHEMAS[part].split(", ")][:-1]
            path = f"{output}/{part}/method={method}"
            parts[part].select(*names).write.mode("overwrite").parquet(path)
            counts[f"{method} {part} written"] = n = spark.read.parquet(path).count()
            LOG.info("wrote %d rows to %s", n, path)
    discard(relevant, *runs.values())
    return counts


def read_part(spark: SparkSession, output: str, part: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[part]).parquet(f"{output}/{part}")


def read(spark: SparkSession, output: str) -> DataFrame:
    """All that the job has written, with `part` (hits, metrics, summary) and nulls where a part has no such column."""
    hits, measured, means = (read_part(spark, output, part).withColumn("part", F.lit(part)) for part in SCHEMAS)
    whole = hits.unionByName(measured.withColumn("hit", F.col("hit").cast("double")), allowMissingColumns=True)
    return whole.unionByName(means, allowMissingColumns=True)


if __name__ == "__main__":
    main("retrieval_report", Settings, {"documents": "Parquet table of documents", "questions": "Parquet table of questions", "output": "folder of the report"}, run)
