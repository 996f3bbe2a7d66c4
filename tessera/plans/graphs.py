"""Queries over graphs made of the star schema (typed edges) and of postings (entities and chunks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import graph, losses, ranking
from tessera.operators.components import connected_components
from tessera.operators.lexical import doc_tokens
from tessera.plans.retrieval import _TOK, docs, table, whole_vectors


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as triples: a customer's nation, an order's customer, with a yes/no object and a loop as noise."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("s"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "_")).alias("r"), F.concat(F.lit("Status "), "o_orderstatus").alias("o"), F.col("o_orderkey").alias("ord"))
    return o.union(o.where("chunk_id % 7 = 0").select("chunk_id", "s", "r", F.lit("Yes").alias("o"), "ord")).union(o.where("chunk_id % 11 = 0").select("chunk_id", "s", "r", F.upper("s").alias("o"), "ord"))


_TRIPLES = """t0 AS (SELECT o_orderkey AS chunk_id, 'Customer ' || o_custkey AS s, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')) AS r, 'Status ' || o_orderstatus AS o, o_orderkey AS ord FROM orders),
trip AS (SELECT * FROM t0 UNION ALL SELECT chunk_id, s, r, 'Yes', ord FROM t0 WHERE chunk_id % 7 = 0 UNION ALL SELECT chunk_id, s, r, upper(s), ord FROM t0 WHERE chunk_id % 11 = 0),
good AS (SELECT * FROM trip WHERE lower(s) <> lower(o) AND lower(o) NOT IN ('yes', 'no', 'true', 'false')),
named AS (SELECT chunk_id, s AS entity, ord FROM good UNION ALL SELECT chunk_id, o, ord FROM good UNION ALL SELECT o_orderkey, 'Segment ' || c_mktsegment, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey)"""
_EID = "'entity:' || left(md5(lower({0})), 12)"


def clerks(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of each order's customer segment and of its priority, as entities that no triple may name."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("Segment "), "c_mktsegment").alias("entity"), F.col("o_orderkey").alias("ord"))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.assemble(clerks(spark, sf), triples(spark, sf))[0]


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.assemble(clerks(spark, sf), triples(spark, sf))[1]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges: supplier to part (r = line number) with the quantity as weight."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v"), F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("w"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).union(table(spark, sf, "part").select(F.col("p_partkey") + 1_000_000))


_EDGES = "edges AS (SELECT l_suppkey AS u, l_partkey + 1000000 AS v, l_linenumber AS r, l_quantity AS w FROM lineitem), nodes AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + 1000000 FROM part)"


def edges_with_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_inverse(edges(spark, sf), 7).groupBy("r", "is_inverse").agg(F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"))


def invalid_edge_split(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("relation"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"))
    o = table(spark, sf, "orders").where("o_orderkey % 10 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uid"), F.col("o_orderkey").alias("id"))
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), (F.col("c_custkey") + 100_000_000).alias("id"))
    rel = spark.createDataFrame([(i, n) for i, n in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])], "id int, name string")
    good, bad = graph.encode(o.union(c), rel, raw)
    return good.select(F.lit("good").alias("part"), F.concat(F.lit("o"), F.col("u").cast("string")).alias("source")).union(bad.select(F.lit("bad"), "source"))


def entity_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("uid"))
    return ranking.dense_ids(rows, "uid").select("uid", F.col("id").cast("long").alias("id"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, chunk_id, w): documents' tokens of ten letters or more, w occurrences."""
    return doc_tokens(docs(spark, sf)).where(F.length("token") >= 10).groupBy(F.col("token").alias("entity"), F.col("id").alias("chunk_id")).agg(F.count("*").cast("double").alias("w"))


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, entity, w): benchmark passages' entities with their counts."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("sample"), F.explode(tokens(F.col("text"))).alias("entity"))
    return q.where(F.length("entity") >= 10).groupBy("sample", "entity").agg(F.count("*").cast("double").alias("w"))


_M = f"""m AS (SELECT token AS entity, doc_id AS chunk_id, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) WHERE length(token) >= 10 GROUP BY ALL),
st AS (SELECT sample, entity, count(*)::DOUBLE AS w FROM (SELECT item_id AS sample, unnest({_TOK}) AS entity FROM benchmark) WHERE length(entity) >= 10 GROUP BY ALL)"""


def mention_map(spark: SparkSession, sf: str) -> DataFrame:
    by_entity, _ = graph.mention_map(mentions(spark, sf))
    return by_entity.where("size(chunks) > 1").select("entity", F.size("chunks").alias("n"), F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def entity_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.propagate_lite(starts(spark, sf), mentions(spark, sf)))


def ranker_simple(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.rank_chunks(starts(spark, sf), mentions(spark, sf)))


def ranker_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.rank_chunks(starts(spark, sf), mentions(spark, sf), idf=True))


def ranker_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.rank_chunks(starts(spark, sf), mentions(spark, sf), top=5))


def ranker_idf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.rank_chunks(starts(spark, sf), mentions(spark, sf), idf=True, top=5))


def doc_best_entity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.best_entity(starts(spark, sf), mentions(spark, sf))


def fact_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Facts (supplier, part) with a score: each end gets score / degree, entities the mean, chunks (nations) the sum."""
    f = edges(spark, sf).select("u", "v", (F.col("w") / 50).alias("s"))
    ends = f.select(F.col("u").alias("entity"), "s").union(f.select("v", "s"))
    per = ends.groupBy("entity").agg(F.sum("s").alias("t"), F.count("*").alias("n")).select("entity", (F.col("t") / F.col("n") / F.col("n")).alias("w"))
    owner = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("chunk_id"))
    return per.join(owner, "entity").groupBy("chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))


def strict_negatives(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("u"), F.lit(0).alias("r"), F.col("s_suppkey").alias("v"))
    return graph.strict_negatives(s, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))).groupBy("u").agg(F.count("*").alias("negatives"), F.sum("v").alias("sum_v"))


def relation_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_graph(graph.with_inverse(edges(spark, sf), 7))


def relation_profile(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_profile(edges(spark, sf))


def degree_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.degree_profile(edges(spark, sf), nodes(spark, sf))
    return p.select("nodes", "zeros", "max_degree", F.round("mean_degree", 6).alias("mean_degree"), F.col("median_degree"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their customers."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    e = o.select(F.col("o_orderkey").alias("u"), (F.col("o_custkey") + 100_000_000).alias("v"))
    return connected_components(e)


def segment_softmax(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return ranking.softmax(e, "user_id", "value").select("event_id", F.round("softmax", 8).alias("softmax"))


def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.fusion import min_max

    return min_max(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("norm", 8).alias("norm"))


def pna_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).select("v", F.col("w").alias("m"))
    b = table(spark, sf, "part").select((F.col("p_partkey") + 1_000_000).alias("v"), F.col("p_size").cast("double").alias("m"))
    return graph.pna(e, b).withColumn("y", F.round("y", 5))


def _spmm(spark: SparkSession, sf: str, add: str, mul: str) -> DataFrame:
    """Over all edges; a supplier's vector is that of its number's place among the vectors, a relation's that of its number."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = v.count()
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % n).alias("vec_id")).join(v, "vec_id").select("id", "vec")
    rel = edges(spark, sf).select(F.col("r").alias("id")).distinct().join(v, F.col("id") == F.col("vec_id")).select("id", "vec")
    return graph.relational_spmm(edges(spark, sf), x, rel, add, mul).withColumn("y", F.round("y", 5))


def relational_spmm_add_mul(spark: SparkSession, sf: str) -> DataFrame:
    return _spmm(spark, sf, "add", "mul")


def relational_spmm_min_mul(spark: SparkSession, sf: str) -> DataFrame:
    return _spmm(spark, sf, "min", "mul")


def relational_spmm_max_add(spark: SparkSession, sf: str) -> DataFrame:
    return _spmm(spark, sf, "max", "add")


def message_passing(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers over nations and regions with three dimensions."""
    n = table(spark, sf, "nation")
    e = n.select(F.col("n_nationkey").cast("long").alias("u"), (F.col("n_regionkey") + 100).cast("long").alias("v"), F.lit(0).alias("r"))
    e = graph.with_inverse(e, 1).drop("is_inverse")
    ids = n.select(F.col("n_nationkey").cast("long").alias("id")).union(table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("long")))
    x = ids.select("id", F.array(*(F.round(F.sin(F.col("id") + i), 3) for i in range(3))).alias("vec"))
    rel = spark.createDataFrame([(0, [0.5, 1.0, -1.0]), (1, [0.25, 0.5, 0.75])], "id int, vec array<double>")
    return graph.message_passing(e, x, rel, 2).withColumn("x", F.round("x", 6))


def training_losses(spark: SparkSession, sf: str) -> DataFrame:
    v = whole_vectors(spark, sf)
    out = losses.of_products(v.where("id % 100 = 0"), v, 4)
    return out.select(*(F.round(c, 6).alias(c) for c in ("bce", "list_ce", "kl", "mse")))


def logical_query(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of supplier 1 or 2, and not of supplier 3, by line 1 to 2 relations."""
    q = graph.Query(edges(spark, sf), nodes(spark, sf))
    return q.evaluate(("i", ("u", ("p", ("e", 1), 1), ("p", ("e", 2), 2)), ("n", ("p", ("e", 3), 1))))


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """Hops from nation 0's region tree, three steps at most."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("u"), (F.col("n_regionkey") + 100).cast("long").alias("v"))
    e = n.union(n.select("v", "u")).withColumn("w", F.lit(1.0))
    return graph.hops(e, spark.createDataFrame([(0, 0), (1, 1)], "start long, id long"), 3).select("start", "id", "hops")


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, edges_with_inverse, invalid_edge_split, entity_ids, mention_map, entity_propagation, ranker_simple, ranker_idf, ranker_topk, ranker_idf_topk, doc_best_entity, fact_scores, strict_negatives, relation_graph, relation_profile, degree_profile, components, segment_softmax, minmax_normalise, pna_aggregate, relational_spmm_add_mul, relational_spmm_min_mul, relational_spmm_max_add, message_passing, training_losses, logical_query, reachability)}
QUERIES["connected_components"] = QUERIES.pop("components")

_SPMM = """n AS (SELECT count(*) AS n FROM embeddings), y AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
x AS (SELECT s_suppkey AS u, dim, v AS xv FROM supplier CROSS JOIN n JOIN y ON vec_id = s_suppkey % n),
rl AS (SELECT r, dim, v AS rv FROM (SELECT DISTINCT r FROM edges) JOIN y ON vec_id = r)
SELECT v, dim::INT AS dim, round({0}, 5) AS y FROM edges JOIN x USING (u) JOIN rl USING (r, dim) GROUP BY ALL"""
_RANK = "SELECT sample, chunk_id, round(sum(s.w * m.w), 6) AS score FROM {0} s JOIN m USING (entity) GROUP BY ALL"
_TOP5 = "top5 AS (SELECT sample, entity, 1.0::DOUBLE AS w FROM st QUALIFY row_number() OVER (PARTITION BY sample ORDER BY w DESC, entity) <= 5)"
_IDF = "idf AS (SELECT entity, 1 / sum(w) AS idf FROM m GROUP BY entity)"
_DS = "ds AS (SELECT q.vec_id AS row, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS t, (q.label = d.label)::INT::DOUBLE AS y FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0), z AS (SELECT *, 1 / (1 + exp(-4 * t)) AS p FROM ds)"
ORACLES = {
    "graph_nodes": f"""WITH {_TRIPLES} SELECT {_EID.format('entity')} AS uid, arg_max(entity, (ord, entity)) AS name, 'entity' AS type FROM named GROUP BY 1 UNION ALL SELECT DISTINCT 'chunk:' || chunk_id, chunk_id::VARCHAR, 'chunk' FROM named""",
    "graph_edges": f"""WITH {_TRIPLES}, e AS (SELECT 'chunk:' || chunk_id AS source, 'mentions' AS relation, {_EID.format('entity')} AS target, chunk_id, ord FROM named UNION ALL SELECT {_EID.format('s')}, r, {_EID.format('o')}, chunk_id, ord FROM good)
        SELECT left(md5(source || '|' || relation || '|' || target), 16) AS edge_id, source, relation, target, arg_max(chunk_id, (ord, chunk_id)) AS chunk_id FROM e GROUP BY source, relation, target""",
    "edges_with_inverse": f"WITH {_EDGES}, i AS (SELECT u, v, r, false AS is_inverse FROM edges UNION ALL SELECT v, u, r + 7, true FROM edges) SELECT r, is_inverse, count(*) AS n, sum(u)::BIGINT AS su, sum(v)::BIGINT AS sv FROM i GROUP BY ALL",
    "invalid_edge_split": """SELECT CASE WHEN o_orderkey % 10 <> 0 AND c.c_custkey IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'good' ELSE 'bad' END AS part, 'o' || o_orderkey AS source
        FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""",
    "entity_ids": "SELECT s_name AS uid, row_number() OVER (ORDER BY s_name) - 1 AS id FROM supplier",
    "mention_map": f"WITH {_M} SELECT entity, count(DISTINCT chunk_id)::INT AS n, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunks FROM m GROUP BY entity HAVING count(DISTINCT chunk_id) > 1",
    "entity_propagation": f"""WITH {_M}, c AS (SELECT sample, chunk_id, sum(st.w * m.w) AS w FROM st JOIN m USING (entity) GROUP BY ALL), f AS (SELECT sample, entity, sum(c.w * m.w) AS w FROM c JOIN m USING (chunk_id) GROUP BY ALL),
        g AS (SELECT sample, entity, 0.7::DOUBLE * w / greatest(sum(w) OVER (PARTITION BY sample), 1) AS w FROM f), e AS (SELECT sample, entity, sum(w) AS w FROM (SELECT * FROM st UNION ALL SELECT * FROM g) GROUP BY ALL)
        SELECT sample, chunk_id, round(sum(e.w * m.w), 6) AS score FROM e JOIN m USING (entity) GROUP BY ALL""",
    "ranker_simple": f"WITH {_M} {_RANK.format('st')}",
    "ranker_idf": f"WITH {_M}, {_IDF}, s2 AS (SELECT sample, entity, w * idf AS w FROM st JOIN idf USING (entity)) {_RANK.format('s2')}",
    "ranker_topk": f"WITH {_M}, {_TOP5} {_RANK.format('top5')}",
    "ranker_idf_topk": f"WITH {_M}, {_IDF}, {_TOP5}, s2 AS (SELECT sample, entity, w * idf AS w FROM top5 JOIN idf USING (entity)) {_RANK.format('s2')}",
    "doc_best_entity": f"WITH {_M} SELECT sample, chunk_id, max(st.w) AS score, arg_min(entity, (-st.w, entity)) AS entity FROM st JOIN m USING (entity) GROUP BY ALL",
    "fact_scores": f"""WITH {_EDGES}, f AS (SELECT u, v, w / 50 AS s FROM edges), e AS (SELECT u AS entity, s FROM f UNION ALL SELECT v, s FROM f), p AS (SELECT entity, sum(s) / count(*) / count(*) AS w FROM e GROUP BY entity)
        SELECT s_nationkey AS chunk_id, round(sum(w), 6) AS score FROM p JOIN supplier ON s_suppkey = entity GROUP BY 1""",
    "strict_negatives": "SELECT n.u, count(*) AS negatives, sum(s_suppkey)::BIGINT AS sum_v FROM (SELECT DISTINCT s_nationkey AS u FROM supplier) n JOIN supplier s ON s.s_nationkey <> n.u GROUP BY n.u",
    "relation_graph": f"""WITH {_EDGES}, i AS (SELECT u, v, r FROM edges UNION ALL SELECT v, u, r + 7 FROM edges), h AS (SELECT DISTINCT u AS node, r FROM i), t AS (SELECT DISTINCT v AS node, r FROM i)
        SELECT DISTINCT x.r AS a, y.r AS b, 'hh' AS kind FROM h x JOIN h y USING (node) UNION ALL SELECT DISTINCT x.r, y.r, 'tt' FROM t x JOIN t y USING (node)
        UNION ALL SELECT DISTINCT x.r, y.r, 'ht' FROM h x JOIN t y USING (node) UNION ALL SELECT DISTINCT x.r, y.r, 'th' FROM t x JOIN h y USING (node)""",
    "relation_profile": f"WITH {_EDGES} SELECT r, count(*) AS edges, count(DISTINCT u) AS heads, count(DISTINCT v) AS tails FROM edges GROUP BY r",
    "degree_profile": f"""WITH {_EDGES}, d AS (SELECT id, count(*) AS d FROM (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) GROUP BY id), a AS (SELECT coalesce(d, 0) AS d FROM nodes LEFT JOIN d USING (id))
        SELECT count(*) AS nodes, count(*) FILTER (d = 0) AS zeros, max(d) AS max_degree, round(avg(d), 6) AS mean_degree, quantile_cont(d, 0.5)::DOUBLE AS median_degree FROM a""",
    "connected_components": """WITH e AS (SELECT o_orderkey AS u, o_custkey + 100000000 AS v FROM orders), c AS (SELECT v, min(u) AS component FROM e GROUP BY v)
        SELECT u AS id, component FROM e JOIN c USING (v) UNION SELECT v, component FROM c""",
    "segment_softmax": "WITH e AS (SELECT event_id, user_id, exp(value - max(value) OVER (PARTITION BY user_id)) AS x FROM events) SELECT event_id, round(x / sum(x) OVER (PARTITION BY user_id), 8) AS softmax FROM e",
    "minmax_normalise": "SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 8) AS norm FROM events WINDOW w AS (PARTITION BY user_id)",
    "pna_aggregate": f"""WITH {_EDGES}, a AS (SELECT v, w AS m FROM edges UNION ALL SELECT p_partkey + 1000000, p_size::DOUBLE FROM part), g AS (SELECT v, avg(m) AS mean, max(m) AS max, min(m) AS min, sqrt(greatest(avg(m * m) - avg(m) * avg(m), 1e-6)) AS std, count(*) AS deg FROM a GROUP BY v),
        s AS (SELECT *, coalesce(ln(deg) / nullif(avg(ln(deg)) OVER (), 0), 1.0::DOUBLE) AS s FROM g), l AS (SELECT v, s, unnest(['mean', 'max', 'min', 'std']) AS agg, unnest([mean, max, min, std]) AS value FROM s),
        z AS (SELECT v, agg, value, unnest(['one', 'log', 'inverse']) AS scaler, unnest([1.0::DOUBLE, s, 1 / greatest(s, 1e-2)]) AS f FROM l) SELECT v, agg, scaler, round(value * f, 5) AS y FROM z""",
    "relational_spmm_add_mul": f"WITH {_EDGES}, " + _SPMM.format("sum(w * (rv * xv))"),
    "relational_spmm_min_mul": f"WITH {_EDGES}, " + _SPMM.format("min(w * (rv * xv))"),
    "relational_spmm_max_add": f"WITH {_EDGES}, " + _SPMM.format("max(w * (rv + xv))"),
    "message_passing": """WITH e AS (SELECT n_nationkey AS u, n_regionkey + 100 AS v, 0 AS r FROM nation UNION ALL SELECT n_regionkey + 100, n_nationkey, 1 FROM nation), ids AS (SELECT n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey + 100 FROM region),
        x0 AS (SELECT id, dim, round(sin(id + dim), 3) AS x FROM ids, (SELECT unnest([0, 1, 2]) AS dim)), rl AS (SELECT 0 AS r, unnest([0, 1, 2]) AS dim, unnest([0.5, 1.0, -1.0])::DOUBLE AS rv UNION ALL SELECT 1, unnest([0, 1, 2]), unnest([0.25, 0.5, 0.75])::DOUBLE),
        x1 AS (SELECT id, dim, sum(x) AS x FROM (SELECT v AS id, dim, rv * x AS x FROM e JOIN x0 ON x0.id = e.u JOIN rl USING (r, dim) UNION ALL SELECT * FROM x0 UNION ALL SELECT * FROM x0) GROUP BY ALL),
        x2 AS (SELECT id, dim, sum(x) AS x FROM (SELECT v AS id, dim, rv * x AS x FROM e JOIN x1 ON x1.id = e.u JOIN rl USING (r, dim) UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x0) GROUP BY ALL)
        SELECT id::BIGINT AS id, dim::INT AS dim, round(x, 6) AS x FROM x2""",
    "training_losses": f"""WITH {_DS}, b AS (SELECT row, avg(-ln(p)) FILTER (y > 0) AS pos, avg(-ln(1 - p)) FILTER (y = 0) AS neg FROM z GROUP BY row), w AS (SELECT *, p / (sum(p) OVER (PARTITION BY row) + 1e-5) AS q FROM z), c AS (SELECT row, sum(-y * ln(q + 1e-5)) / sum(y) AS l FROM w GROUP BY row HAVING sum(y) > 0),
        k AS (SELECT avg(tt * ln(tt / pp) + (1 - tt) * ln((1 - tt) / (1 - pp))) AS kl FROM (SELECT greatest(1e-6, least(1 - 1e-6, (t + 1) / 2)) AS tt, greatest(1e-6, least(1 - 1e-6, p)) AS pp FROM z))
        SELECT (SELECT round(avg((coalesce(pos, 0) + coalesce(neg, 0)) / ((pos IS NOT NULL)::INT + (neg IS NOT NULL)::INT)), 6) FROM b) AS bce, (SELECT round(avg(l), 6) FROM c) AS list_ce, (SELECT round(kl, 6) FROM k) AS kl, (SELECT round(avg((p - (t + 1) / 2) * (p - (t + 1) / 2)), 6) FROM z) AS mse""",
    "logical_query": f"WITH {_EDGES} SELECT DISTINCT v AS id FROM edges WHERE ((u = 1 AND r = 1) OR (u = 2 AND r = 2)) AND v NOT IN (SELECT v FROM edges WHERE u = 3 AND r = 1)",
    "reachability": """WITH RECURSIVE e AS (SELECT n_nationkey AS u, n_regionkey + 100 AS v FROM nation UNION ALL SELECT n_regionkey + 100, n_nationkey FROM nation), p AS (SELECT 0 AS start, 0 AS id, 0 AS hops UNION SELECT 1, 1, 0 UNION SELECT p.start, e.v, p.hops + 1 FROM p JOIN e ON e.u = p.id WHERE p.hops < 3)
        SELECT start::BIGINT AS start, id::BIGINT AS id, min(hops)::INT AS hops FROM p GROUP BY start, id""",
}
