"""Incremental job: keeps a lexical index of a growing folder of documents, from which BM25 searches are answered.

    python -m jobs.lexical_index --documents documents.parquet --output index --checkpoint index-checkpoint --config jobs/lexical_index.json

A file stream over `documents` (doc_id, text, source) takes the files that its checkpoint hasn't seen, then ends. Each
batch writes folders of its own, replacing what an attempt that died may have left, so an interrupted run is just run
again and nothing is indexed twice:

    output/postings/batch=N/bucket=B    token, doc_id, tf (occurrences), dl (tokens of the document)
    output/vocabulary/batch=N/bucket=B  token, df (documents), cf (occurrences), of this batch's documents alone
    output/documents/batch=N            doc_id, source, dl

A document's first delivery counts: ids that an earlier batch has are left out, and of several rows of one id in a batch
the least (source, text) is taken. Rows without an id are left out; null and empty texts have no tokens, their documents
count. Files are not to change once they are there. Buckets are by the token's MD5, so a search reads only its tokens' ones.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from tessera.functions.text import tokens
from tessera.operators import lexical
from tessera.session import written

LOG = logging.getLogger("lexical_index")
INPUT = "doc_id long, text string, source string"
SCHEMAS = {
    "postings": "token string, doc_id long, tf long, dl long, batch int, bucket int",
    "vocabulary": "token string, df long, cf long, batch int, bucket int",
    "documents": "doc_id long, source string, dl long, batch int",
}


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    #: Files of one batch at most; 0: all that are new.
    files_at_a_time: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.buckets <= 256 or self.files_at_a_time < 0:
            raise ValueError("buckets are 1 to 256, files_at_a_time is 0 or more")


def bucket(token: Column, buckets: int) -> Column:
    """By the first byte of the token's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int"), F.lit(buckets)).alias("bucket")


def read_part(spark: SparkSession, output: str, part: str) -> DataFrame:
    """What is at output/part; nothing, if no batch has written yet."""
    schema = SCHEMAS[part]
    try:
        return spark.read.schema(schema).parquet(f"{output}/{part}")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def add(batch: DataFrame, number: int, output: str, settings: Settings) -> None:
    """Indexes the documents of one batch that no earlier batch has."""
    spark = batch.sparkSession
    known = read_part(spark, output, "documents").where(F.col("batch") < number).select("doc_id")
    first = batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source", "text")).alias("row"))
    fresh = first.join(known, "doc_id", "left_anti").select("doc_id", "row.source", tokens(F.col("row.text")).alias("t"))
    fresh = fresh.select("doc_id", "source", "t", F.size("t").cast("long").alias("dl")).persist()
    try:
        each = fresh.select("doc_id", "dl", F.explode("t").alias("token")).groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
        _write(each.select("token", "doc_id", "tf", "dl", bucket(F.col("token"), settings.buckets)), f"{output}/postings/batch={number}")
        own = read_part(spark, output, "postings").where(F.col("batch") == number)
        _write(own.groupBy("token", "bucket").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), f"{output}/vocabulary/batch={number}")
        fresh.select("doc_id", "source", "dl").write.mode("overwrite").parquet(f"{output}/documents/batch={number}")
    finally:
        fresh.unpersist()


def _write(rows: DataFrame, path: str) -> None:
    """In folders by bucket; Spark evens the files out by size, whatever the buckets hold."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def pattern(path: str) -> str:
    """A glob that only `path` fits: a file stream over a glob may also name a single file, over a plain path it may not."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{\\") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Adds the documents of all files that are new since the last run to the index."""
    reader = spark.readStream.schema(INPUT)
    if settings.files_at_a_time:
        reader = reader.option("maxFilesPerTrigger", settings.files_at_a_time)
    seen: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        add(batch, number, output, settings)
        seen.append(number)

    query = reader.parquet(pattern(documents)).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = {"documents read": sum(p.numInputRows for p in query.recentProgress if p.batchId in seen)}
    LOG.info("read %d documents of %s in %d batches", counts["documents read"], documents, len(seen))
    for part in SCHEMAS:
        counts[f"{part} written"] = n = read_part(spark, output, part).where(F.col("batch").isin(seen)).count() if seen else 0
        LOG.info("wrote %d rows to %s/%s", n, output, part)
    return counts


def search(spark: SparkSession, output: str, questions: DataFrame, top: int = 10, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, doc_id, score: the `top` best documents by BM25 of each question (query_id, text).

    Only buckets that hold tokens of the questions are read; df comes from postings, so all batches count.
    """
    wanted = written(lexical.query_tokens(questions), "asked")
    hit = wanted.select("token", bucket(F.col("token"), settings.buckets)).distinct()
    tf = read_part(spark, output, "postings").join(hit, ["bucket", "token"], "left_semi").select(F.col("doc_id").alias("id"), "token", "tf", "dl")
    totals = read_part(spark, output, "documents").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    scores = lexical.occurrence_scores(written(tf, "occurrences"), totals, wanted)
    return lexical.top_k(scores, top).select("query_id", "rank", "doc_id", "score")


def statistics(spark: SparkSession, output: str) -> DataFrame:
    """token, df, cf over all batches."""
    return read_part(spark, output, "vocabulary").groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def read(spark: SparkSession, output: str) -> DataFrame:
    """All that the job has written, with `part` (postings, vocabulary, documents) and nulls where a part has no such column."""
    parts = [read_part(spark, output, part).withColumn("part", F.lit(part)) for part in SCHEMAS]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


if __name__ == "__main__":
    main("lexical_index", Settings, {"documents": "folder or file of Parquet documents", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}, run)
