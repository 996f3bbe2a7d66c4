"""Queries over graph search, records and reranking: facts, linking, tails, samples, look-ups, fallbacks, page recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import dot, tokens
from tessera.operators import filings, fusion, graph, graph_search, linking, metrics, pair_grid, providers, qrels, ranking, records, vector
from tessera.operators.lexical import top_k
from tessera.operators.vector_grid import top_members
from tessera.plans.graphs import _EDGES, _TRIPLES, edges, triples
from tessera.plans.retrieval import _BM25, _DENSE, _EXACT, _NORM, _RECALL, _TOK, _TOP, _WANT, best, bm25_topk, docs, exact, filled_vectors, home, items, labelled_ranks, nearest, recall_run, scores, table, vectors, whole_vectors
from tessera.plans.texts import _TAGS, doc_tags
from tessera.session import written


def _vectors(spark: SparkSession, sf: str, rows: DataFrame, at: Column) -> DataFrame:
    """rows with vec: the vector whose number is `at` modulo the number of vectors."""
    v = vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = F.lit(vectors(spark, sf).count())
    return rows.withColumn("vec_id", F.pmod(at, n)).join(v, "vec_id").drop("vec_id")


_VEC = "nv AS (SELECT count(*) AS nv FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """(fact_id, s, o): each supplier with each of its parts."""
    pairs = edges(spark, sf).select(F.col("u").alias("s"), F.col("v").alias("o")).distinct()
    return pairs.withColumn("fact_id", F.col("s") * 10_000_000 + F.col("o"))


def _queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Column]:
    """(id, vec) of the vectors that ask and of all, and how many there are."""
    v = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return v.where("id % 100 = 0"), v, F.lit(v.count())


def _fact_scores(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """(query_id, fact_id, score) of each query's k best facts: facts share vectors, so these are compared once."""
    q, v, n = _queries(spark, sf)
    members = _facts(spark, sf).select(F.col("fact_id").alias("doc_id"), F.pmod(F.col("s") * 31 + F.col("o"), n).alias("vec_id"))
    return top_members(q, v, members, k).withColumnRenamed("doc_id", "fact_id")


def _mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, chunk_id): suppliers and parts by the orders that have them."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("chunk_id")).union(rows.select(F.col("l_partkey") + 1_000_000, "l_orderkey"))


def _chunks(spark: SparkSession, sf: str, n: Column) -> DataFrame:
    """(doc_id, vec_id): orders with their vectors."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.pmod("o_orderkey", n).alias("vec_id"))


_FACTS = f"""{_EDGES}, {_VEC}, f0 AS (SELECT DISTINCT u AS s, v AS o FROM edges), f AS (SELECT s * 10000000 + o AS fact_id, s, o, embedding FROM f0 CROSS JOIN nv JOIN embeddings ON vec_id = (s * 31 + o) % nv),
q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), fs AS (SELECT query_id, fact_id, s, o, round({_DOT.format('qe', 'embedding')}, 12) AS score FROM q, f),
men AS (SELECT DISTINCT l_suppkey AS entity, l_orderkey AS chunk_id FROM lineitem UNION SELECT l_partkey + 1000000, l_orderkey FROM lineitem), deg AS (SELECT entity, count(*) AS n FROM men GROUP BY entity),
dc AS (SELECT query_id, o_orderkey AS chunk_id, {_DOT.format('qe', 'embedding')} AS score FROM orders CROSS JOIN nv JOIN embeddings ON vec_id = o_orderkey % nv CROSS JOIN q)"""
_FTOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)"


def fact_search(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the facts of their suppliers and parts; the ten best of each query."""
    q, v, n = _queries(spark, sf)
    entities = written(graph_search.fact_entities(_fact_scores(spark, sf, 40), _facts(spark, sf), _mentioned(spark, sf), 10), "entities")
    best_ = graph_search.fact_top_chunks(entities, _mentioned(spark, sf), _chunks(spark, sf, n), v, q, 10)
    return best_.select("query_id", "rank", "doc_id", "score")


def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = graph_search.fact_entities(_fact_scores(spark, sf, 40), _facts(spark, sf), _mentioned(spark, sf), 10)
    return found.withColumn("score", F.round("score", 8))


def linked_names(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    facts = _facts(spark, sf).select("fact_id", text("s").alias("s"), text("o").alias("o"))
    mentions = _mentioned(spark, sf).select(text("entity").alias("entity"), "chunk_id")
    q, v, n = _queries(spark, sf)
    documents = top_members(q, v, _chunks(spark, sf, n).withColumn("doc_id", F.concat(F.lit("order:"), text("doc_id"))), 20)
    return graph_search.linked_names(_fact_scores(spark, sf, 50), facts, mentions, documents, 50, 20).select("query_id", "doc_id", F.round("score", 8).alias("score"))


def fact_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts between entities; every seventh supplier is something else."""
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 == 0, "chunk").otherwise("entity").alias("type"))
    nodes = nodes.union(table(spark, sf, "part").select(F.col("p_partkey") + 1_000_000, "p_name", F.lit("entity")))
    rows = edges(spark, sf).select("u", F.concat(F.lit("r"), F.col("r").cast("string")).alias("relation"), "v")
    return graph_search.facts(rows, nodes).groupBy("text").agg(F.count("*").alias("n"))


def entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "chunk").otherwise("entity").alias("type"))
    nodes = nodes.union(table(spark, sf, "part").select(F.col("p_partkey") + 1_000_000, F.when(F.col("p_size") > 40, "document").otherwise("entity")))
    return graph_search.entity_types_only(edges(spark, sf), nodes, ["entity"]).groupBy("r").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def typed_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = whole_vectors(spark, sf).withColumn("type", F.concat(F.lit("t"), F.col("label").cast("string")))
    return graph_search.typed_nearest(v.where("id % 100 = 0"), v, 3).select("query_id", "type", "rank", "doc_id", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


def tail_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Tails of every hundredth vector under two relations, among all vectors and among those of one type."""
    nodes = whole_vectors(spark, sf).select("id", "vec", F.when(F.col("label") % 2 == 0, "entity").otherwise("chunk").alias("type"))
    relations = nodes.where("id IN (1, 2)").select("id", "vec")
    heads = nodes.where("id % 100 = 0").select(F.col("id").alias("u"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("r"))
    one = lambda scope, types: graph_search.tail_predictions(heads, relations, nodes, 5, types).select(F.lit(scope).alias("scope"), "u", "r", "rank", "v", F.round("score", 6).alias("score"))
    return one("all", None).union(one("entity", ["entity"]))


def matched_edges(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("u"), F.explode(F.array(F.lit(1), F.lit(9))).alias("r"))
    return graph_search.match_edges(edges(spark, sf), asked).groupBy("u", "r").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def easy_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left after those of all returned lines, with their inverses, are dropped; by relation, and by any relation."""
    from tessera.operators.graph import with_inverse

    every = with_inverse(edges(spark, sf), 7).drop("is_inverse")
    batch = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v"), F.col("l_linenumber").alias("r"))
    count = lambda name, left: left.groupBy("r").agg(F.count("*").alias("n")).withColumn("mode", F.lit(name))
    return count("relation", graph_search.without_easy_edges(every, batch, 7)).unionByName(count("one_hop", graph_search.without_easy_edges(every, batch, 7, one_hop=True)))


def negatives_as_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier's nation against all nations, both ways, as questions for a tail."""
    positives = table(spark, sf, "supplier").select((F.col("s_suppkey") + 100).alias("u"), F.lit(0).alias("r"), F.col("s_nationkey").cast("long").alias("v"))
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph_search.as_tail_queries(graph_search.all_negatives(positives, nodes), 1).groupBy("u", "r").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def type_codes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_search.type_codes(table(spark, sf, "part"), "p_type", "p_partkey")


def query_init(spark: SparkSession, sf: str) -> DataFrame:
    """Nations ask: their suppliers, by one over the number of their lines, times the nation's vector."""
    degree = edges(spark, sf).groupBy("u").agg((1 / F.count("*")).alias("w"))
    starts = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("sample"), F.col("s_suppkey").alias("u")).join(degree, "u").select("sample", F.col("u").alias("node"), "w")
    questions = _vectors(spark, sf, table(spark, sf, "nation").select(F.col("n_nationkey").alias("sample")), F.col("sample"))
    out = graph_search.query_init(starts, questions)
    return out.select("sample", "node", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 8))


def resolved_uids(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names as they are, with the prefix, and unknown ones."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    nodes = c.select(F.when(k < 2, F.concat(F.lit("entity:"), F.col("c_name"))).otherwise(F.col("c_name")).alias("uid"))
    rows = c.select("c_custkey", F.when(k == 1, F.concat(F.lit("entity:"), F.col("c_name"))).when(k == 3, F.concat(F.col("c_name"), F.lit("?"))).otherwise(F.col("c_name")).alias("raw"), graph_search.relation_key(F.concat(F.when(k == 0, F.lit("inverse_")).otherwise(F.lit("")), F.col("c_mktsegment"))).alias("relation"))
    return graph_search.resolved_uids(rows, "raw", nodes).select("c_custkey", "uid", "relation")


def sample_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders ask: their customer, if in credit, is the start, their large parts are the targets."""
    starts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), F.lit("start").alias("role"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("uid"))
    targets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.lit("target").alias("role"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("uid"))
    nodes = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"))
    nodes = nodes.union(table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey") + 10_000_000, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return graph_search.sample_masks(starts.union(targets), nodes).select("sample", "role", "id", "w")


def hard_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the query's label are answers; those with an odd id are hard."""
    return labelled_ranks(spark, sf, "before").where("doc_id % 2 = 1").select("query_id", "doc_id", (F.col("before") + 1).cast("int").alias("rank"))


def type_means(spark: SparkSession, sf: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("1p", "2p", "2i", "2in", "pni"))), (F.col("query_id") / 100 % 5 + 1).cast("int"))
    rows = hard_ranks(spark, sf).groupBy("query_id").agg(F.avg(1 / F.col("rank")).alias("mrr")).withColumn("type", names)
    return metrics.type_means(rows, "mrr").withColumn("value", F.round("value", 6))


def overridden(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, of which every fifth has a new row; and new rows of parts that there aren't."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_partkey % 5 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(None).cast("long").alias("p_size"))
    return records.override(p.withColumn("p_size", F.col("p_size").cast("long")), new.union(new.select(F.col("p_partkey") + 100_000_000, "p_name", "p_size")), "p_partkey")


def company_fallback(spark: SparkSession, sf: str) -> DataFrame:
    tickers = F.array(*map(F.lit, (*records.TICKERS, "ZZZ")))
    s = table(spark, sf, "supplier")
    rows = s.select("s_suppkey", F.concat(F.lit("a/b\\"), F.lower(F.element_at(tickers, (F.col("s_suppkey") % 6 + 1).cast("int"))), F.lit("_10-Q_2024.htm")).alias("source"), F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>")).alias("uids"))
    names = spark.createDataFrame([("Apple Inc.", "e1"), ("Apple", "e2"), ("Morgan Stanley", "e3"), ("NVIDIA Corp", "e4"), ("The Home Depot", "e5")], "name string, uid string")
    return records.with_company(rows, "source", "uids", names).select("s_suppkey", F.array_join("uids", ",").alias("uids"))


def by_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Orders known by their key, by their customer and by a name with a blank."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("chunk_id"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" o"), F.col("o_orderkey").cast("string"))).otherwise("").alias("uid"))
    return records.by_alias(o, "ord")


def source_chunks(spark: SparkSession, sf: str) -> DataFrame:
    good = F.to_json(F.struct(F.col("source").alias("source_pdf"), "lang"))
    nodes = docs(spark, sf).select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("uid"), F.when(F.col("doc_id") % 11 == 0, "entity").otherwise("chunk").alias("type"), F.when(F.col("doc_id") % 7 == 0, "{bad").when(F.col("doc_id") % 7 == 1, '{"lang": "en"}').otherwise(good).alias("attributes"))
    return records.source_chunks(nodes).select("source", F.array_join("chunks", ",").alias("chunks"))


def name_index(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("uid"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 9 == 0, "chunk").otherwise("entity").alias("type"))
    return records.name_index(nodes, "p_partkey").select("name", F.array_join("uids", ",").alias("uids"))


def numbered_queries(spark: SparkSession, sf: str) -> DataFrame:
    return records.numbered(items(spark, sf).select("query_id"), "query_id", "r_text")


def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return records.group_sizes(table(spark, sf, "lineitem"), "l_orderkey").withColumn("mean", F.round("mean", 6))


def tag_presence(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' tags beside those of the documents of one language."""
    d = doc_tags(spark, sf)
    asked = d.join(docs(spark, sf).where("lang = 'de'").select("doc_id"), "doc_id", "left_semi")
    out = records.presence(d, asked, ["named_entities", "organizations", "dates"])
    return out.select("field", *(F.round(c, 6).alias(c) for c in out.columns if c != "field"))


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = bm25_topk(spark, sf).select("query_id", "doc_id").join(items(spark, sf), "query_id").join(docs(spark, sf).select("doc_id", F.col("text").alias("hay"), "lang"), "doc_id")
    return rows.select("query_id", "doc_id", records.candidate_score(F.col("text"), F.concat(F.lit(" "), F.col("lang"), F.lit("e ")), F.col("hay")).alias("score"))


def gated_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence scores of the passages' ten best documents, 0 for another source; every third passage names none."""
    rows = bm25_topk(spark, sf).select("query_id", "doc_id").join(home(spark, sf), "query_id").join(docs(spark, sf).select("doc_id", F.col("text").alias("hay"), "lang", "source"), "doc_id")
    score = qrels.evidence_score(F.col("text"), F.col("text"), F.col("hay"), F.col("lang") == F.col("want_lang"))
    return rows.select("query_id", "doc_id", F.round(qrels.gated(score, F.when(F.col("query_id") % 3 != 0, F.col("source") == F.col("want_source")), F.lit(None).cast("boolean")), 5).alias("score"))


_SUMMARIES = ("Net sales by segment", "COMMISSION  file number and registrant", "Cash and registrant's shares", "Telephone number", "Nothing of note")


def table_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _SUMMARIES)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("summary"), (F.col("p_size") % 7).cast("int").alias("page"), F.when(F.col("p_partkey") % 4 == 0, "text").otherwise("table").alias("modality"))
    return p.select("p_partkey", filings.bad_table(F.col("summary"), F.col("page")).alias("bad"), filings.good_table(F.col("summary"), F.col("modality"), F.col("page")).alias("good"))


def page_recall(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.lit(1).alias("page_start"), F.when(F.col("doc_id") % 4 != 0, (F.col("n_chars") / 300).cast("int")).alias("page_end"))
    wanted = home(spark, sf).select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("want_source")).alias("source"), (F.col("query_id") % 4 + 1).cast("int").alias("page"))
    return metrics.page_and_evidence_recall(bm25_topk(spark, sf), d, wanted, exact(spark, sf), [1, 5, 10])


def document_recall(spark: SparkSession, sf: str) -> DataFrame:
    found = bm25_topk(spark, sf).select("query_id", F.lit("lexical").alias("type"), "doc_id", "score").union(top_k(recall_run(spark, sf).drop("rank"), 10).select("query_id", F.lit("overlap"), "doc_id", "score"))
    return metrics.document_recall(found, exact(spark, sf)).withColumn("recall", F.round("recall", 6))


def overfetch_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """Dense search, 30 times over-fetched: vectors of the query's label, with a bonus for ids that end alike."""
    v = filled_vectors(spark, sf).withColumn("type", F.lit(0))
    s = pair_grid.best_products(v.where("id % 100 = 0"), v, fusion.OVERFETCH * 5, block=pair_grid.MANY, match="label").withColumnRenamed("id", "doc_id").drop("type", "rank")
    rows = fusion.overfetched(s, 5, F.col("same"), F.when(F.col("doc_id") % 10 == 0, 0.06).otherwise(0.0))
    return top_k(rows, 5).select("query_id", "rank", "doc_id", "score")


def tag_aware_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 in three modes; tags are source and language, and every third passage has none."""
    q = home(spark, sf).select("query_id", "want_source", "want_lang", (F.col("query_id") % 3 != 0).alias("query_has_tags"))
    found, out = best(spark, sf, 40), None  # one search for all modes: none fetches more than 40
    for mode in ("none", "boost", "filter"):
        rows = fusion.fetched(found, 5, 40, mode).join(q, "query_id").join(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id")
        rows = rows.withColumn("overlap", F.when(F.col("query_has_tags"), (F.col("source") == F.col("want_source")).cast("int") + (F.col("lang") == F.col("want_lang")).cast("int")).otherwise(0))
        first = fusion.tag_aware(rows, 5, mode).select(F.lit(mode).alias("mode"), "query_id", "rank", "doc_id", "score")
        out = first if out is None else out.union(first)
    return out


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """BM25's twenty best, reranked by the fallback of a cross-encoder: the share of the passage's tokens."""
    from tessera.functions.text import token_recall

    rows = top_k(best(spark, sf, 20), 20).drop("rank").join(items(spark, sf), "query_id").join(docs(spark, sf).select("doc_id", F.col("text").alias("hay")), "doc_id")
    return providers.reranked(rows, 5, "text", "hay", token_recall(tokens(F.col("text")), tokens(F.col("hay"))), weight=10.0).select("query_id", "rank", "doc_id", "score")


def picked_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ten nearest vectors those that a model picked by their ranks; every second query's picks are unusable."""
    near = nearest(spark, sf, 10)
    picks = near.select("query_id").distinct().withColumn("picks", F.when(F.col("query_id") % 200 == 0, F.array(F.lit(4), F.lit(2), F.lit(11))).otherwise(F.array(F.lit(0))).cast("array<long>"))
    return providers.picked(near, picks, 3).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def repaired_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that a model misspelt, among the parts of the same brand."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))
    written = p.groupBy("query_id").agg(F.max("name").alias("name")).select("query_id", F.concat(F.translate("name", "aeiou", "eioua"), F.lit("s")).alias("text"))
    return providers.repaired(written, p)


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.element_at(F.array(F.lit("Net Sales and total assets of "), F.lit("the purchases of property, plant and equipment, "), F.lit("cash flow; CASH FLOW ")), (F.col("doc_id") % 3 + 1).cast("int")), "text")
    return docs(spark, sf).select("doc_id", F.array_join(records.retrieval_keywords(text, F.array("lang", F.lit("net sales")), F.array("source")), ",").alias("keywords"))


def captions(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(records.caption(F.split("text", "\n"))).alias("caption"))


def cleaned_question_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.struct(F.array("lang", "source").alias("industries"), F.array(F.lit("THE"), F.lit("zzz")).alias("domains"), F.array(F.lit("a")).alias("sectors"), F.array(F.lit("Risk"), F.lit("Acme")).alias("named_entities"), F.array(F.lit("Acme"), F.col("source")).alias("organizations"))
    out = docs(spark, sf).select("doc_id", records.question_tags(tags, F.col("text")).alias("t"))
    return out.select("doc_id", *(F.array_join(f"t.{f}", ",").alias(f) for f in ("industries", "domains", "sectors", "named_entities")))


def variadic_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' lines: their places by part, by price, and the order's sum and mean."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string"), F.col("l_shipdate").cast("date").cast("string")).alias("line"), "l_quantity")
    out = ranking.variadic(rows.groupBy("l_orderkey", "line").agg(F.sum("l_quantity").alias("l_quantity")), "l_orderkey", "line", "l_quantity")
    return out.select("l_orderkey", F.md5("line").alias("line"), F.col("place").cast("long").alias("place"), F.col("sorted").cast("long").alias("sorted"), F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))


def extended_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' finished orders and then their open ones, of which the second to fourth are cut out."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    both = ranking.extend(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey", "o_orderkey")
    spans = both.select("o_custkey").distinct().select("o_custkey", F.lit(1).alias("start"), F.lit(4).alias("end"))
    return ranking.slices(both, "o_custkey", "place", spans).select("o_custkey", "o_orderkey", "part", F.col("place").cast("long").alias("place"))


def node_update(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' states and messages (of every second one) under a map to four numbers."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_acctbal") / 1000), F.col("s_nationkey").cast("double")).alias("vec"))
    m = s.where("id % 2 = 0").select("id", F.transform("vec", lambda x: x * 0.5).alias("vec"))
    out = graph.node_update(s, m, [[1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, -1.0], [0.25, 0.25, 0.25, 0.25], [-1.0, 0.5, 0.0, 2.0]], [0.0, 1.0, -1.0, 0.5])
    return out.select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


def decoded_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each passage with their source, pages and the first 500 characters."""
    hits = bm25_topk(spark, sf).where("rank <= 5").join(table(spark, sf, "documents").select("doc_id", "source", F.lit(1).alias("page_start"), (F.col("n_chars") / 300).cast("int").alias("page_end"), F.md5(F.substring("text", 1, 500)).alias("preview")), "doc_id")
    return hits.select("query_id", "rank", "doc_id", "source", "page_start", "page_end", "preview")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    top = bm25_topk(spark, sf).where("rank <= 3").join(docs(spark, sf).select("doc_id", "text"), "doc_id")
    passages = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("p"))
    return passages.join(items(spark, sf), "query_id").select("query_id", F.md5(providers.qa_prompt(F.col("text"), F.col("p"), 1000)).alias("prompt"))


def graph_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as edges from orders to parts (by their places), in eight parts: nodes and boundaries, and their numbers."""
    n = table(spark, sf, "part").count()
    e = table(spark, sf, "lineitem").select(F.pmod(F.col("l_suppkey") * 17 + F.col("l_partkey"), F.lit(n)).alias("u"), F.col("l_partkey").alias("v"))
    parts = graph.part_nodes(graph.partitioned(e, n, 8), table(spark, sf, "part").select(F.col("p_partkey").alias("id")), n, 8)
    return parts.select("part", "id", "owned", F.col("local").cast("long").alias("local"))


def typed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Pessimistic ranks among candidates of the answer's own type (its number modulo 3)."""
    return labelled_ranks(spark, sf, "as_high", kind=F.col("id") % 3).select("query_id", "type", "doc_id", (F.col("as_high") + 1).alias("rank"))


def padded_topk(spark: SparkSession, sf: str) -> DataFrame:
    few = bm25_topk(spark, sf).where(F.col("rank") <= F.col("query_id") % 7 + 1)
    return ranking.padded(few, "query_id", 5).select("query_id", "rank", "doc_id")


def preview_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text_preview"), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).otherwise("").alias("chunk_id"), F.lit(None).cast("string").alias("summary"), F.col("source").alias("name"))
    return rows.select("doc_id", F.md5(linking.preview_text()).alias("text"))


QUERIES = {f.__name__: f for f in (graph_partitions, typed_ranks, padded_topk, preview_texts, variadic_ops, extended_lists, node_update, decoded_hits, prompts, fact_search, fact_entities, linked_names, fact_texts, entity_edges, typed_topk, tail_predictions, matched_edges, easy_edges, negatives_as_tails, type_codes, query_init, resolved_uids, sample_masks, hard_ranks, type_means, overridden, company_fallback, by_alias, source_chunks, name_index, numbered_queries, group_sizes, tag_presence, candidate_scores, gated_evidence, table_rules, page_recall, document_recall, overfetch_bonus, tag_aware_bm25, reranked, picked_facts, repaired_names, keywords, captions, cleaned_question_tags)}

_MM = "CASE WHEN max({0}) OVER {1} = min({0}) OVER {1} THEN 1.0 ELSE ({0} - min({0}) OVER {1}) / (max({0}) OVER {1} - min({0}) OVER {1}) END"
_HARD = f"""{_DENSE}, ld AS (SELECT query_id, doc_id, score, label = qlabel AS positive, doc_id % 2 = 1 AS hard FROM ds), ra AS (SELECT *, {_TOP} AS ra FROM ld),
hr AS (SELECT query_id, doc_id, hard, ra - row_number() OVER (PARTITION BY query_id ORDER BY ra) + 1 AS rank FROM ra WHERE positive)"""
_ENTS = f"""chosen AS (SELECT * FROM fs QUALIFY {_FTOP} <= 40), ends AS (SELECT query_id, s AS entity, score FROM chosen UNION ALL SELECT query_id, o, score FROM chosen),
ent AS (SELECT query_id, entity, avg(score / coalesce(n, 1)) AS score FROM ends LEFT JOIN deg USING (entity) GROUP BY ALL)"""
_CLEAN = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_CHUNKS3 = "(['Net Sales and total assets of ', 'the purchases of property, plant and equipment, ', 'cash flow; CASH FLOW '])[doc_id % 3 + 1] || text"
ORACLES = {
    "graph_partitions": """WITH n AS (SELECT count(*) AS n FROM part), e AS (SELECT (l_suppkey * 17 + l_partkey) % n AS u, floor(l_partkey * 8 / n)::INT AS part FROM lineitem, n), a AS (SELECT floor(p_partkey * 8 / n)::INT AS part, p_partkey AS id, true AS owned FROM part, n UNION ALL SELECT DISTINCT e.part, u, false FROM e, n WHERE floor(u * 8 / n) <> e.part)
        SELECT part, id, owned, row_number() OVER (PARTITION BY part ORDER BY owned DESC, id) - 1 AS local FROM a""",
    "typed_ranks": f"WITH {_DENSE}, ld AS (SELECT query_id, doc_id, doc_id % 3 AS type, score, label = qlabel AS positive FROM ds) SELECT p.query_id, p.type, p.doc_id, 1 + count(n.doc_id) AS rank FROM ld p LEFT JOIN ld n ON n.query_id = p.query_id AND n.type = p.type AND NOT n.positive AND n.score >= p.score WHERE p.positive GROUP BY ALL",
    "padded_topk": f"WITH {_BM25}, run AS (SELECT *, {_TOP} AS rank FROM bms QUALIFY {_TOP} <= 10), f AS (SELECT * FROM run WHERE rank <= query_id % 7 + 1), p AS (SELECT q.query_id, k AS rank FROM (SELECT DISTINCT query_id FROM f) q, (SELECT unnest(range(1, 6)) AS k)) SELECT p.query_id, p.rank, doc_id FROM p LEFT JOIN f USING (query_id, rank)",
    "preview_texts": "SELECT doc_id, md5(left(CASE doc_id % 3 WHEN 0 THEN coalesce(nullif(text, ''), source) WHEN 1 THEN doc_id::VARCHAR ELSE source END, 512)) AS text FROM documents",
    "variadic_ops": """WITH r AS (SELECT l_orderkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice::VARCHAR, l_shipdate::DATE::VARCHAR) AS line, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, md5(line) AS line, row_number() OVER (w ORDER BY line) - 1 AS place, row_number() OVER (w ORDER BY q DESC, line) - 1 AS sorted, round(sum(q) OVER w, 4) AS sum, round(avg(q) OVER w, 6) AS mean FROM r WINDOW w AS (PARTITION BY l_orderkey)""",
    "extended_lists": "WITH b AS (SELECT o_custkey, o_orderkey, (o_orderstatus = 'O')::INT AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT * FROM b WHERE place BETWEEN 1 AND 3",
    "node_update": """WITH s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 1000 * 0.5::DOUBLE ELSE 0 END AS c, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey * 0.5::DOUBLE ELSE 0 END AS d FROM supplier),
        y AS (SELECT id, [a + 0.5::DOUBLE * c, b - d + 1, (a + b + c + d) / 4 - 1, 0.5::DOUBLE * b - a + 2 * d + 0.5::DOUBLE] AS y FROM s), m AS (SELECT id, y, list_avg(y) AS m FROM y), v AS (SELECT id, y, m, sqrt(list_avg(list_transform(y, lambda x: (x - m) * (x - m))) + 1e-5::DOUBLE) AS sd FROM m)
        SELECT id, (generate_subscripts(y, 1) - 1)::INT AS dim, round(greatest((unnest(y) - m) / sd, 0), 6) AS x FROM v""",
    "decoded_hits": f"WITH {_BM25}, run AS (SELECT *, {_TOP} AS rank FROM bms QUALIFY {_TOP} <= 5) SELECT query_id, rank, doc_id, d.source, 1 AS page_start, (n_chars // 300)::INT AS page_end, md5(left(text, 500)) AS preview FROM run JOIN documents d USING (doc_id)",
    "prompts": f"""WITH {_BM25}, run AS (SELECT *, {_TOP} AS rank FROM bms QUALIFY {_TOP} <= 3), p AS (SELECT query_id, string_agg('[' || rank || '] ' || d.text, chr(10) ORDER BY rank) AS p FROM run JOIN documents d USING (doc_id) GROUP BY query_id)
        SELECT query_id, md5(left(p, 1000) || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS prompt FROM p JOIN benchmark ON item_id = query_id""",
    "fact_search": f"""WITH {_FACTS}, {_ENTS}, c AS (SELECT query_id, chunk_id, score FROM ent JOIN men USING (entity) UNION ALL SELECT query_id, chunk_id, score * 0.05::DOUBLE FROM dc),
        t AS (SELECT query_id, chunk_id AS doc_id, round(sum(score), 6) AS score FROM c GROUP BY ALL) SELECT query_id, {_TOP} AS rank, doc_id, score FROM t QUALIFY {_TOP} <= 10""",
    "fact_entities": f"WITH {_FACTS}, {_ENTS} SELECT query_id, entity, round(score, 8) AS score FROM ent",
    "linked_names": f"""WITH {_FACTS}, ft AS (SELECT *, {_FTOP} AS rank FROM fs QUALIFY {_FTOP} <= 50), nn AS (SELECT *, {_MM.format('score', 'w')} AS norm FROM ft WINDOW w AS (PARTITION BY query_id)), ch AS (SELECT * FROM nn WHERE rank <= 20),
        ends AS (SELECT query_id, s AS entity, norm FROM ch UNION ALL SELECT query_id, o, norm FROM ch), e0 AS (SELECT query_id, entity::VARCHAR AS doc_id, round(avg(norm / coalesce(n, 1)), 12) AS score FROM ends LEFT JOIN deg USING (entity) GROUP BY ALL), e AS (SELECT * FROM e0 QUALIFY {_TOP} <= 20),
        d0 AS (SELECT query_id, 'order:' || chunk_id AS doc_id, round(score, 12) AS score FROM dc), d1 AS (SELECT * FROM d0 QUALIFY {_TOP} <= 20), d AS (SELECT query_id, doc_id, {_MM.format('score', 'w')} * 0.05::DOUBLE AS score FROM d1 WINDOW w AS (PARTITION BY query_id)),
        a AS (SELECT query_id, doc_id, round(score, 12) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM d)) SELECT query_id, doc_id, round(score, 8) AS score FROM a QUALIFY {_TOP} <= 30""",
    "fact_texts": f"WITH {_EDGES} SELECT s_name || ' [SEP] r' || r || ' [SEP] ' || p_name AS text, count(*) AS n FROM edges JOIN supplier ON s_suppkey = u AND s_suppkey % 7 <> 0 JOIN part ON p_partkey + 1000000 = v GROUP BY 1",
    "entity_edges": f"WITH {_EDGES} SELECT r, count(*) AS n, sum(w) AS w FROM edges JOIN part ON p_partkey + 1000000 = v AND p_size <= 40 WHERE u % 7 <> 0 GROUP BY r",
    "typed_topk": f"""WITH {_DENSE}, t AS (SELECT query_id, 't' || ds.label AS type, doc_id, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 12) AS score FROM ds JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, doc_id) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, doc_id) <= 3)
        SELECT query_id, type, rank, doc_id, round(score, 6) AS score, round({_MM.format('score', 'w')}, 6) AS norm FROM r WINDOW w AS (PARTITION BY query_id, type)""",
    "tail_predictions": f"""WITH s AS (SELECT h.vec_id AS u, r.vec_id AS r, t.vec_id AS v, t.label % 2 = 0 AS ent, round(list_sum(list_transform(list_zip(h.embedding, r.embedding, t.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE * p[3]::DOUBLE)), 6) AS score FROM embeddings h, embeddings r, embeddings t WHERE h.vec_id % 100 = 0 AND r.vec_id IN (1, 2)),
        a AS (SELECT 'all' AS scope, * FROM s UNION ALL SELECT 'entity', * FROM s WHERE ent) SELECT scope, u, r, row_number() OVER w AS rank, v, score FROM a WINDOW w AS (PARTITION BY scope, u, r ORDER BY score DESC, v) QUALIFY row_number() OVER w <= 5""",
    "matched_edges": f"WITH {_EDGES} SELECT u, r, count(*) AS n, sum(v)::BIGINT AS v FROM edges WHERE r IN (1, 9) AND u IN (SELECT s_suppkey FROM supplier) GROUP BY u, r",
    "easy_edges": f"""WITH {_EDGES}, i AS (SELECT u, v, r FROM edges UNION ALL SELECT v, u, r + 7 FROM edges), b AS (SELECT l_suppkey AS u, l_partkey + 1000000 AS v, l_linenumber AS r FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT u, v, r FROM b UNION SELECT v, u, r + 7 FROM b), h AS (SELECT DISTINCT u, v FROM e)
        SELECT r, count(*) AS n, 'relation' AS mode FROM i ANTI JOIN e USING (u, v, r) GROUP BY r UNION ALL SELECT r, count(*), 'one_hop' FROM i ANTI JOIN h USING (u, v) GROUP BY r""",
    "negatives_as_tails": """WITH a AS (SELECT s_suppkey + 100 AS u, 0 AS r, n_nationkey AS v FROM supplier, nation UNION ALL SELECT s_nationkey, 1, n_nationkey FROM supplier, nation) SELECT u, r, count(*) AS n, sum(v)::BIGINT AS v FROM a GROUP BY u, r""",
    "type_codes": "SELECT p_type AS type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_type",
    "query_init": f"""WITH {_EDGES}, {_VEC}, g AS (SELECT u, 1 / count(*) AS w FROM edges GROUP BY u), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
        SELECT s_nationkey AS sample, s_suppkey AS node, dim::INT AS dim, round(x * w, 8) AS x FROM supplier JOIN g ON u = s_suppkey CROSS JOIN nv JOIN e ON vec_id = s_nationkey % nv""",
    "resolved_uids": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'entity:' || c_name WHEN 1 THEN 'entity:' || c_name WHEN 2 THEN c_name END AS uid, c_mktsegment AS relation FROM customer",
    "sample_masks": """WITH s AS (SELECT o_orderkey AS sample, 'start' AS role, c_custkey AS id FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0), t AS (SELECT DISTINCT l_orderkey AS sample, 'target' AS role, p_partkey + 10000000 AS id FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10)
        SELECT *, 1.0::DOUBLE AS w FROM s WHERE sample IN (SELECT sample FROM t) UNION ALL SELECT *, 1.0::DOUBLE FROM t WHERE sample IN (SELECT sample FROM s)""",
    "hard_ranks": f"WITH {_HARD} SELECT query_id, doc_id, rank FROM hr WHERE hard",
    "type_means": f"""WITH {_HARD}, m AS (SELECT query_id, avg(1 / rank) AS mrr FROM hr WHERE hard GROUP BY query_id), t AS (SELECT (['1p', '2p', '2i', '2in', 'pni'])[query_id // 100 % 5 + 1] AS type, avg(mrr) AS v FROM m GROUP BY 1)
        SELECT name, round(avg(v), 6) AS value FROM (SELECT '[' || type || ']' AS name, v FROM t UNION ALL SELECT 'all', v FROM t UNION ALL SELECT CASE WHEN contains(type, 'n') THEN '[negation]' ELSE '[EPFO]' END, v FROM t) GROUP BY name""",
    "overridden": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS p_size FROM part",
    "company_fallback": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'known' ELSE (['e2,e1', 'e5', '', 'e3', '', ''])[s_suppkey % 6 + 1] END AS uids FROM supplier",
    "by_alias": """WITH k AS (SELECT o_orderkey AS ord, unnest([CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END, o_custkey::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 'o' || o_orderkey END, 'chunk:' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE o_custkey END]) AS key FROM orders)
        SELECT key, min(ord) AS ord FROM k WHERE key IS NOT NULL GROUP BY key""",
    "source_chunks": "SELECT source, array_to_string(list_sort(list('chunk:' || doc_id)), ',') AS chunks FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 > 1 GROUP BY source",
    "name_index": "SELECT lower(p_name) AS name, array_to_string(list('p' || p_partkey ORDER BY p_partkey), ',') AS uids FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1",
    "numbered_queries": "SELECT item_id AS query_id, 'r_text_' || lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY item_id))::VARCHAR))::INT, '0') AS qid FROM benchmark",
    "group_sizes": "WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) SELECT size, count(*) AS groups, (SELECT min(size) FROM s) AS least, (SELECT max(size) FROM s) AS most, (SELECT round(avg(size), 6) FROM s) AS mean FROM s GROUP BY size",
    "tag_presence": f"""WITH {_TAGS}, lf AS (SELECT doc_id, 'named_entities' AS field, len(ne) > 0 AS p FROM dt UNION ALL SELECT doc_id, 'organizations', len(org) > 0 FROM dt UNION ALL SELECT doc_id, 'dates', len(dates) > 0 FROM dt)
        SELECT field, round(avg(p::INT), 6) AS chunk_presence_rate, round(avg(p::INT) FILTER (lang = 'de'), 6) AS query_presence_rate, round(1 - avg(p::INT), 6) AS chunk_empty_rate, round(1 - avg(p::INT) FILTER (lang = 'de'), 6) AS query_empty_rate FROM lf JOIN documents USING (doc_id) GROUP BY field""",
    "candidate_scores": f"""WITH {_BM25}, run AS (SELECT * FROM bms QUALIFY {_TOP} <= 10), w AS (SELECT item_id AS query_id, list_transform(regexp_extract_all({_CLEAN.format('text')}, '[a-zA-Z][a-zA-Z]+|\\d[\\d,%.()$-]*'), lambda x: lower(x)) AS ws FROM benchmark)
        SELECT query_id, doc_id, len(list_filter(ws, lambda x: contains(lower(d.text), x))) + CASE WHEN contains(lower(d.text), d.lang || 'e') THEN 8 ELSE 0 END::DOUBLE AS score FROM run JOIN w USING (query_id) JOIN documents d USING (doc_id)""",
    "gated_evidence": f"""WITH {_BM25}, {_WANT}, run AS (SELECT * FROM bms QUALIFY {_TOP} <= 10), qb AS (SELECT item_id AS query_id, {_NORM} AS qn, list_distinct({_TOK}) AS qt FROM benchmark), db AS (SELECT doc_id, lang, source, {_NORM} AS dn, {_TOK} AS dt FROM documents)
        SELECT query_id, doc_id, CASE WHEN query_id % 3 <> 0 AND source <> want_source THEN 0 ELSE round(CASE WHEN contains(dn, qn) THEN 28 ELSE 0 END + 10 * (len(list_intersect(qt, dt)) / len(qt)) + CASE WHEN lang = want_lang THEN 2 ELSE 0 END, 5) END AS score FROM run JOIN qb USING (query_id) JOIN want USING (query_id) JOIN db USING (doc_id)""",
    "table_rules": """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size % 7 AS page, p_partkey % 4 <> 0 AS t FROM part), b AS (SELECT *, k = 1 OR k = 3 OR (k = 2 AND page IN (1, 2, 3)) AS bad FROM p) SELECT p_partkey, bad, t AND NOT bad AND k IN (0, 2) AS good FROM b""",
    "page_recall": f"""WITH {_BM25}, {_EXACT}, run AS (SELECT *, {_TOP} AS rank FROM bms QUALIFY {_TOP} <= 10), ks AS (SELECT unnest([1, 5, 10]) AS k),
        h AS (SELECT run.query_id, rank, (run.query_id % 2 = 1 OR d.source = 'src' || (run.query_id % 20)) AND run.query_id % 4 + 1 BETWEEN 1 AND CASE WHEN d.doc_id % 4 <> 0 THEN n_chars // 300 ELSE 1 END AS p, ex.doc_id IS NOT NULL AS e FROM run JOIN documents d USING (doc_id) LEFT JOIN ex ON ex.query_id = run.query_id AND ex.doc_id = run.doc_id)
        SELECT b.item_id AS query_id, k, coalesce(bool_or(p), false)::INT::DOUBLE AS page_recall, coalesce(bool_or(e), false)::INT::DOUBLE AS evidence_recall FROM benchmark b CROSS JOIN ks LEFT JOIN h ON h.query_id = b.item_id AND h.rank <= k GROUP BY ALL""",
    "document_recall": f"""WITH {_BM25}, {_RECALL}, {_EXACT}, l AS (SELECT * FROM bms QUALIFY {_TOP} <= 10), o AS (SELECT query_id, doc_id, score FROM rr WHERE rank <= 10), a AS (SELECT query_id, 'lexical' AS type, doc_id, score FROM l UNION ALL SELECT query_id, 'overlap', doc_id, score FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type, doc_id) AS rank FROM a), f AS (SELECT query_id, doc_id, min(rank) AS rank FROM r SEMI JOIN ex USING (query_id, doc_id) GROUP BY ALL), g AS (SELECT query_id, count(*) AS n FROM ex GROUP BY query_id), ks AS (SELECT unnest([1, 2, 5, 10]) AS k),
        h AS (SELECT g.query_id, k, count(f.doc_id) / max(n) AS recall FROM g CROSS JOIN ks LEFT JOIN f ON f.query_id = g.query_id AND f.rank <= k GROUP BY ALL) SELECT k, round(avg(recall), 6) AS recall FROM h GROUP BY k""",
    "overfetch_bonus": f"WITH {_DENSE}, f AS (SELECT * FROM ds QUALIFY {_TOP} <= 150), s AS (SELECT query_id, doc_id, round(score + CASE WHEN doc_id % 10 = 0 THEN 0.06 ELSE 0 END::DOUBLE, 6) AS score FROM f WHERE label = qlabel) SELECT query_id, {_TOP} AS rank, doc_id, score FROM s QUALIFY {_TOP} <= 5",
    "tag_aware_bm25": f"""WITH {_BM25}, {_WANT}, f AS (SELECT *, {_TOP} AS place FROM bms QUALIFY {_TOP} <= 40), o AS (SELECT f.*, query_id % 3 <> 0 AS tags, CASE WHEN query_id % 3 <> 0 THEN (d.source = want_source)::INT + (d.lang = want_lang)::INT ELSE 0 END AS n FROM f JOIN documents d USING (doc_id) JOIN want USING (query_id)),
        m AS (SELECT 'none' AS mode, query_id, doc_id, score FROM o WHERE place <= 5 UNION ALL SELECT 'boost', query_id, doc_id, round(score + 0.03::DOUBLE * n, 6) FROM o UNION ALL SELECT 'filter', query_id, doc_id, score FROM o WHERE NOT tags OR n > 0)
        SELECT mode, query_id, row_number() OVER w AS rank, doc_id, score FROM m WINDOW w AS (PARTITION BY mode, query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 5""",
    "reranked": f"""WITH {_BM25}, {_RECALL}, t AS (SELECT * FROM bms QUALIFY {_TOP} <= 20), s AS (SELECT t.query_id, t.doc_id, round(t.score + 10.0::DOUBLE * coalesce(o / n, 0), 6) AS score FROM t JOIN qn USING (query_id) LEFT JOIN (SELECT query_id, doc_id, count(*) AS o FROM qd JOIN dd USING (token) GROUP BY ALL) USING (query_id, doc_id))
        SELECT query_id, {_TOP} AS rank, doc_id, score FROM s QUALIFY {_TOP} <= 5""",
    "picked_facts": f"""WITH {_DENSE}, n AS (SELECT query_id, doc_id, score, {_TOP} AS rank FROM ds QUALIFY {_TOP} <= 10), p AS (SELECT query_id, doc_id, score, CASE WHEN query_id % 200 <> 0 THEN rank WHEN rank = 4 THEN 1 WHEN rank = 2 THEN 2 END AS place FROM n)
        SELECT query_id, place AS rank, doc_id, score FROM p WHERE place <= 3""",
    "repaired_names": """WITH w AS (SELECT p_brand AS query_id, translate(max(p_name), 'aeiou', 'eioua') || 's' AS text FROM part GROUP BY p_brand) SELECT query_id, text, arg_min(p_partkey, (levenshtein(lower(text), lower(p_name)), p_partkey)) AS doc_id FROM w JOIN part ON p_brand = query_id GROUP BY query_id, text""",
    "keywords": f"""WITH t AS (SELECT doc_id, lang, source, {_CHUNKS3} AS t FROM documents), k AS (SELECT doc_id, list_concat([lang, 'net sales', source], CASE WHEN doc_id % 3 = 1 THEN ['purchases of property plant and equipment', 'pp&e'] ELSE [] END, list_transform(regexp_extract_all(t, '(?i)\\b(?:net sales|operating income|net income|gross profit|cash flow|total assets|earnings per share)\\b'), lambda x: lower(x))) AS l FROM t),
        d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM k) SELECT doc_id, array_to_string(l[1:12], ',') AS keywords FROM d""",
    "captions": f"""WITH p AS (SELECT doc_id, list_reverse(string_split(text, chr(10)))[1:12] AS l FROM documents), c AS (SELECT doc_id, list_filter(list_transform(l, lambda x: {_CLEAN.format("translate(x, chr(160) || '−—', ' --')")}), lambda x: length(x) BETWEEN 12 AND 180 AND regexp_matches(x, '[A-Za-z]') AND length(regexp_replace(x, '[^$]', '', 'g')) <= 2 AND length(regexp_replace(x, '[^0-9]', '', 'g')) <= 24) AS l FROM p)
        SELECT doc_id, md5(coalesce(l[1], 'the financial table')) AS caption FROM c""",
    "cleaned_question_tags": """SELECT doc_id, array_to_string(list_filter([lang, source], lambda x: contains(lower(text), lower(x))), ',') AS industries, array_to_string(list_filter(['THE', 'zzz'], lambda x: contains(lower(text), lower(x))), ',') AS domains,
        array_to_string(list_filter(['a'], lambda x: contains(lower(text), x)), ',') AS sectors, 'Acme,' || source AS named_entities FROM documents""",
}
