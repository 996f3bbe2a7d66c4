"""Queries that match whole tables with each other: synonyms of all phrases, evidence against chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import linking, questions
from tessera.operators.multi_vector import MultiVectorIndex
from tessera.operators.open_extraction import extracted
from tessera.plans.retrieval import docs, items, table, vectors

THRESHOLD, MOST = 0.3, 20


def synonym_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as the phrase p<id>, held against all others; phrases of two letters and digits take no part."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").cast("array<double>").alias("vec"))
    return linking.synonyms(v, threshold=THRESHOLD, most=MOST).withColumn("score", F.round("score", 6))


def evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as evidence, a fourth of them of unknown documents; documents as chunks of their sources."""
    q = F.col("query_id")
    e = items(spark, sf).select(q.alias("evidence_id"), F.when(q % 4 != 0, F.concat(F.lit("src"), (q % 20).cast("string"))).alias("doc"), "text", (q % 9).cast("int").alias("page"))
    c = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text", (F.col("doc_id") % 50).alias("page_start"), (F.col("doc_id") % 50 + 1).alias("page_end"))
    return e, c


def evidence_matches(spark: SparkSession, sf: str) -> DataFrame:
    return questions.match_evidence(*evidence(spark, sf))


def late_interaction_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best bags of four vectors by MaxSim, over the index; every hundredth bag asks."""
    v = vectors(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bags = v.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("vecs"))
    found = MultiVectorIndex.build(bags).search(bags.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vecs"), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def open_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document that gives any: its entities, triples and malformed triples, by the rule that stands in for a model."""
    rows = extracted(docs(spark, sf).select("doc_id", "text"), "doc_id")
    counts = [F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("entity", "entities"), ("triple", "triples"), ("error", "errors"))]
    return rows.groupBy("doc_id").agg(*counts, F.min(F.when(F.col("kind") == "triple", F.concat_ws("|", "s", "r", "o"))).alias("least"))


def typed_node_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of suppliers, documents and passages as nodes, some without a type, record or text; beside them the counts of the same job."""
    supplier, passages, d = table(spark, sf, "supplier"), table(spark, sf, "benchmark"), docs(spark, sf)
    entities = supplier.select(F.concat(F.lit("entity:"), F.col("s_suppkey").cast("string")).alias("uid"), F.when(F.col("s_suppkey") % 3 == 0, "entity").alias("type"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("text"))
    papers = passages.select(F.concat(F.lit("doc:"), F.col("item_id").cast("string")).alias("uid"), F.lit("").alias("type"), "text")
    chunks = d.select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("uid"), F.lit(None).cast("string").alias("type"))
    nodes = entities.select("uid", "type").union(papers.select("uid", "type")).union(chunks)
    texts, counts = linking.typed_node_texts(nodes, entities.where("text IS NOT NULL").union(papers), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "text"))
    return texts.select("uid", "type", F.md5("text").alias("text"), *(F.lit(n).cast("long").alias(name) for name, n in counts.items()))


QUERIES = {f.__name__: f for f in (synonym_edges, evidence_matches, late_interaction_topk, open_extraction, typed_node_texts)}
ORACLES = {
    "synonym_edges": f"""WITH v AS (SELECT vec_id AS id, embedding FROM embeddings WHERE length('p' || vec_id) > 2),
        s AS (SELECT q.id AS query_id, d.id, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 12) AS score FROM v q, v d),
        r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {MOST + 1})
        SELECT query_id AS source, id AS target, round(score / best, 6) AS score FROM r WHERE best > 0 AND score / best >= {THRESHOLD} AND query_id <> id""",
    "late_interaction_topk": """WITH v AS (SELECT vec_id // 4 AS bag, vec_id, embedding FROM embeddings), p AS (SELECT q.bag AS query_id, d.bag AS id, q.vec_id, max(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))) AS s FROM v q, v d WHERE q.bag % 100 = 0 GROUP BY ALL),
        m AS (SELECT query_id, id, round(sum(s), 12) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "open_extraction": """WITH e AS (SELECT doc_id, count(DISTINCT n) AS entities FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM documents) GROUP BY doc_id),
        s AS (SELECT doc_id, regexp_extract_all(unnest(string_split_regex(text, '[.!?] ')), '[A-Z][a-z]+') AS w FROM documents),
        p AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '|stands before|' || w[i + 1])) AS t FROM s),
        t AS (SELECT doc_id, count(*) AS triples, min(t) AS least FROM p GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS errors FROM s WHERE len(w) = 1 GROUP BY doc_id)
        SELECT doc_id, entities, coalesce(triples, 0) AS triples, coalesce(errors, 0) AS errors, least FROM e LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "typed_node_texts": r"""WITH d AS (SELECT 'entity:' || s_suppkey AS uid, 'entity' AS type, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS text FROM supplier UNION ALL SELECT 'doc:' || item_id, 'document', text FROM benchmark
        UNION ALL SELECT 'chunk:' || doc_id, 'chunk', CASE WHEN doc_id % 2 = 0 THEN text END FROM documents),
        t AS (SELECT uid, type, left(coalesce(nullif(trim(regexp_replace(translate(text, chr(160) || '−—', ' --'), '[ \t\n\r\f\x0B]+', ' ', 'g')), ''), 'Node: ' || uid), 512) AS text FROM d)
        SELECT uid, type, md5(text) AS text, count(*) OVER () AS nodes, (count_if(type = 'entity') OVER ())::BIGINT AS entity_texts, (count_if(type = 'chunk') OVER ())::BIGINT AS chunk_texts, (count_if(type = 'document') OVER ())::BIGINT AS document_texts,
        (count_if(starts_with(text, 'Node:')) OVER ())::BIGINT AS fallbacks, (count_if(trim(text) = '') OVER ())::BIGINT AS empty FROM t""",
}
