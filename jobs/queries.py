"""The jobs as queries: each runs twice into one new folder of the shared one and returns what is there after that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import lexical_index, retrieval_report
from tessera.plans.retrieval import _BM25, _EXACT, _RECALL, _RRF, _TOK, _TOP
from tessera.session import shared_dir


def job1_retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    output = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        retrieval_report.run(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", output)
    return retrieval_report.read(spark, output)


def job2_lexical_index(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        lexical_index.run(spark, f"{sf}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return lexical_index.read(spark, f"{folder}/index")


_REPORT = f"""
WITH {_BM25}, {_RECALL}, {_RRF}, {_EXACT},
fs AS (SELECT query_id, doc_id, round(raw, 8) AS score FROM fused),
h AS (SELECT 'bm25' AS method, query_id, rank, doc_id, score FROM br WHERE rank <= 10
      UNION ALL SELECT 'overlap', query_id, rank, doc_id, score FROM rr WHERE rank <= 10
      UNION ALL (SELECT 'rrf', query_id, {_TOP} AS rank, doc_id, score FROM fs QUALIFY {_TOP} <= 10)),
hits AS (SELECT h.*, e.doc_id IS NOT NULL AS relevant FROM h LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM ex) e USING (query_id, doc_id)),
rel AS (SELECT query_id, count(DISTINCT doc_id) AS r FROM ex GROUP BY query_id),
ask AS (SELECT method, query_id, k FROM (SELECT DISTINCT item_id AS query_id FROM benchmark), (SELECT unnest(['bm25', 'overlap', 'rrf']) AS method), (SELECT unnest([1, 5, 10]) AS k)),
m AS (SELECT a.method, a.query_id, k, (count(rank) > 0)::INT::DOUBLE AS hit, round(count(rank) / k, 6) AS precision, round(count(rank) / max(r), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr,
      round(CASE WHEN max(r) IS NULL THEN 0 ELSE coalesce(sum(1 / log2(rank + 1)), 0) / list_sum(list_transform(range(1, least(max(r), k) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg
      FROM ask a LEFT JOIN hits g ON g.method = a.method AND g.query_id = a.query_id AND g.relevant AND g.rank <= k LEFT JOIN rel ON rel.query_id = a.query_id GROUP BY a.method, a.query_id, k),
means AS (SELECT method, k, count(*) AS questions, round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY method, k)
SELECT 'hits' AS part, * FROM hits UNION ALL BY NAME SELECT 'metrics' AS part, * FROM m UNION ALL BY NAME SELECT 'summary' AS part, * FROM means
"""
_BUCKET = "('0x' || substr(md5(token), 1, 2))::INT % 16 AS bucket"
_INDEX = f"""
WITH d AS (SELECT doc_id, min({{'source': source, 'text': text}}) AS d FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, d.source AS source, {_TOK.replace("text", "d.text")} AS t FROM d),
p AS (SELECT token, doc_id, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM t) GROUP BY token, doc_id)
SELECT 'postings' AS part, token, doc_id, tf, dl, 0 AS batch, {_BUCKET} FROM p
UNION ALL BY NAME SELECT 'vocabulary' AS part, token, count(*) AS df, sum(tf)::BIGINT AS cf, 0 AS batch, {_BUCKET} FROM p GROUP BY token
UNION ALL BY NAME SELECT 'documents' AS part, doc_id, source, len(t) AS dl, 0 AS batch FROM t
"""
QUERIES = {"job1_retrieval_report": job1_retrieval_report, "job2_lexical_index": job2_lexical_index}
ORACLES = {"job1_retrieval_report": _REPORT, "job2_lexical_index": _INDEX}
