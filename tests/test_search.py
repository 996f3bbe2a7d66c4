"""Graph search, records and model hooks on small fixtures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import filings, graph_search, metrics, open_extraction, providers, qrels, records
from tessera.operators.multi_vector import MultiVectorIndex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fact_search_averages_ends_and_adds_dense(spark):
    scores = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.4), (0, 3, 0.1)], "query_id int, fact_id int, score double")
    facts = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "c", "b")], "fact_id int, s string, o string")
    mentions = spark.createDataFrame([("a", 10), ("a", 11), ("b", 11), ("b", 11)], "entity string, chunk_id int")
    dense = spark.createDataFrame([(0, 10, 1.0), (0, 12, 0.5)], "query_id int, chunk_id int, score double")
    entities, chunks = graph_search.fact_search(scores, facts, mentions, dense, 1)
    got = {r.entity: round(r.score, 9) for r in entities.collect()}
    assert got == {"a": round((0.4 + 0.2 + 0.2) / 3, 9), "b": 0.45, "c": 0.1}
    got = {r.chunk_id: round(r.score, 9) for r in chunks.collect()}
    assert got == {10: round(0.8 / 3 + 0.05, 9), 11: round(0.8 / 3 + 0.45, 9), 12: 0.025}
    assert graph_search.fact_search(scores.limit(0), facts, mentions, dense.limit(0), 1)[1].count() == 0


def test_linked_names_scale_and_cap(spark):
    scores = spark.createDataFrame([(0, k, float(10 - k)) for k in range(5)], "query_id int, fact_id int, score double")
    facts = spark.createDataFrame([(k, f"s{k}", f"o{k}") for k in range(5)], "fact_id int, s string, o string")
    mentions = spark.createDataFrame([("s0", 1), ("s0", 2)], "entity string, chunk_id int")
    documents = spark.createDataFrame([(0, "d1", 3.0), (0, "d2", 1.0)], "query_id int, doc_id string, score double")
    out = {r.doc_id: round(r.score, 6) for r in graph_search.linked_names(scores, facts, mentions, documents, 5, 2).collect()}
    assert out == {"o0": 1.0, "o1": 0.75, "d1": 0.05, "d2": 0.0}
    assert graph_search.linked_names(scores, facts, mentions, documents, 5, 2, most=1).count() == 1


def test_edges_matched_dropped_and_turned(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 5), (1, 2, 1), (3, 1, 0)], "u int, v int, r int")
    batch = spark.createDataFrame([(1, 2, 0)], "u int, v int, r int")
    assert sorted(map(tuple, graph_search.without_easy_edges(edges, batch, 5).select("u", "v", "r").collect())) == [(1, 2, 1), (3, 1, 0)]
    assert [tuple(r) for r in graph_search.without_easy_edges(edges, batch, 5, one_hop=True).select("u", "v", "r").collect()] == [(3, 1, 0)]
    assert graph_search.match_edges(edges, spark.createDataFrame([(1, 0), (1, 0), (9, 9)], "u int, r int")).count() == 1
    turned = graph_search.as_tail_queries(spark.createDataFrame([(1, 0, 2, "tail"), (7, 0, 2, "head")], "u int, r int, v int, side string"), 5)
    assert sorted(map(tuple, turned.collect())) == [(1, 0, 2), (2, 5, 7)]


def test_samples_without_start_or_target_go(spark):
    samples = spark.createDataFrame([(1, "start", "a"), (1, "target", "b"), (1, "target", "?"), (2, "start", "a"), (2, "target", "?"), (3, "target", "b")], "sample int, role string, uid string")
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "id int, uid string")
    assert sorted((r.sample, r.role, r.id, r.w) for r in graph_search.sample_masks(samples, nodes).collect()) == [(1, "start", 0, 1.0), (1, "target", 1, 1.0)]


def test_records(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id int, a string, b int")
    new = spark.createDataFrame([(1, None, 9), (3, "z", 1)], "id int, a string, b int")
    assert sorted(map(tuple, records.override(rows, new, "id").collect())) == [(1, None, 9), (2, "y", 5)]
    aliases = spark.createDataFrame([(0, "c1", None, " "), (1, "c2", "c1", "u")], "ord int, chunk_id string, id string, uid string")
    assert {r.key: r.ord for r in records.by_alias(aliases, "ord").collect()} == {"c1": 0, "chunk:c1": 0, "c2": 1, "chunk:c2": 1, "u": 1}
    assert records.metadata(spark.createDataFrame([("t", 1)], "text string, page int")).columns == ["page"]
    assert one(spark, F.array_join(records.chunk_uids(F.array(F.lit("a"), F.lit(" "), F.lit("b"))), ",")) == "chunk:a,chunk:b"
    assert one(spark, records.caption(F.array(F.lit("Net sales by region"), F.lit("$1 $2 $3 and more"), F.lit("x")))) == "Net sales by region"
    assert one(spark, records.candidate_score(F.lit("net sales 12% sales"), F.lit(" 12% "), F.lit("Sales rose 12%"))) == 3 + 8
    found = one(spark, F.array_join(records.retrieval_keywords(F.lit("Net Sales; purchases of property, plant and equipment"), F.array(F.lit("eps")), F.array(F.lit("part ii"))), "|"))
    assert found == "eps|part ii|purchases of property plant and equipment|pp&e|net sales"


def test_front_matter_tables(spark):
    assert one(spark, filings.bad_table(F.lit("The registrant's cash"), F.lit(2))) and not one(spark, filings.bad_table(F.lit("The registrant's cash"), F.lit(4)))
    assert not one(spark, filings.bad_table(F.lit("The registrant's cash"), F.lit(None).cast("int"))) and one(spark, filings.bad_table(F.lit("Commission file"), F.lit(9)))


def test_evidence_counts_on_its_own_source_and_page_only(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert [one(spark, qrels.gated(F.lit(7.0), a, b)) for a, b in ((yes, none), (no, yes), (none, no), (none, none))] == [7.0, 0.0, 0.0, 7.0]


def test_model_hooks(spark):
    rows = spark.createDataFrame([(0, 1, 0.5, "q", "long text"), (0, 2, 0.9, "q", "x")], "query_id int, doc_id int, score double, question string, text string")

    class Longest:
        def predict(self, pairs):
            return [float(len(b)) for _, b in pairs]

    assert [r.doc_id for r in providers.reranked(rows, 1, "question", "text", F.lit(0.0)).collect()] == [2]
    assert [(r.doc_id, r.score) for r in providers.reranked(rows, 1, "question", "text", F.lit(0.0), Longest()).collect()] == [(1, 9.5)]
    ranked = spark.createDataFrame([(q, 10 * q + k, 1.0 / k, k) for q in (1, 2) for k in (1, 2, 3)], "query_id int, doc_id int, score double, rank long")
    picks = spark.createDataFrame([(1, [3, 9, 1]), (2, None)], "query_id int, picks array<long>")
    assert sorted((r.query_id, r.rank, r.doc_id) for r in providers.picked(ranked, picks, 2).collect()) == [(1, 1, 13), (1, 2, 11), (2, 1, 21), (2, 2, 22)]
    written = spark.createDataFrame([(1, "Aple"), (1, "zzzz")], "query_id int, text string")
    names = spark.createDataFrame([(1, 5, "Apple"), (1, 6, "Orange"), (2, 7, "Aple")], "query_id int, doc_id int, name string")
    assert {r.text: r.doc_id for r in providers.repaired(written, names).collect()}["Aple"] == 5


def test_document_recall_over_types(spark):
    found = spark.createDataFrame([(1, "a", 10, 0.9), (1, "b", 11, 0.8), (1, "b", 10, 0.7), (1, "a", 12, 0.1), (2, "a", 5, 1.0)], "query_id int, type string, doc_id int, score double")
    gold = spark.createDataFrame([(1, 11), (1, 12), (1, 12), (3, 1)], "query_id int, doc_id int")
    assert {r.k: r.recall for r in metrics.document_recall(found, gold).collect()} == {1: 0.0, 2: 0.25, 5: 0.5, 10: 0.5}


def test_tokens_meet_queries_in_pieces(spark, monkeypatch):
    from tessera.operators import lexical

    docs = spark.createDataFrame([(k, "the " * (k % 3) + f"w{k % 5} rare{k}") for k in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"the w{q % 5} the rare{q} nowhere") for q in range(40)], "query_id long, text string")
    whole = {(r.query_id, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(docs, queries).collect()}
    monkeypatch.setattr(lexical, "ASKS", 3)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(docs, queries).collect()} == whole and len(whole) > 1600
    assert lexical.bm25_scores(docs.limit(0), queries).count() == 0 and lexical.bm25_scores(docs, queries.limit(0)).count() == 0


def test_large_query_sets_go_block_by_block(spark, monkeypatch):
    from tessera.operators import vector

    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 3)]) for k in range(50)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vector.inner_products(rows, rows).collect()))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 1000)
    assert len(vector.query_blocks(rows, ["vec_id"], "embedding")) == 4
    assert sorted(map(tuple, vector.inner_products(rows, rows).collect())) == whole and len(whole) == 2500
    assert vector.inner_products(rows, rows.limit(0)).count() == 0


def test_lines_of_a_file_are_numbered_by_blocks(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    from tessera.sources import files

    rows = ["\ufeff" + '{"a": 0}', "", *(f'{{"a": {k}}}' if k % 50 else "broken" for k in range(1, 3000))]
    (tmp_path / "x.jsonl").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        good, bad = files.read_jsonl_safe(spark, str(tmp_path / "x.jsonl"), StructType([StructField("a", LongType())]))
        assert {(r.line, r.a) for r in good.collect()} == {(1, 0), *((k + 2, k) for k in range(1, 3000) if k % 50)}
        assert {r.line for r in bad.collect()} == {k + 2 for k in range(50, 3000, 50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    shown = files.markdown_table(spark.range(5), 3)
    assert shown.count("|\n") == 5 and shown.endswith("The first 3 of 5 rows.") and "first" not in files.markdown_table(spark.range(3), 3)


def test_more_model_hooks(spark):
    rows = spark.createDataFrame([(1, "Acme Corp sales increased. Nothing else."), (2, None)], "chunk_id long, passage string")
    nodes, edges = providers.RuleGraph().build(rows)
    assert "Acme Corp" in {r.name for r in nodes.collect()} and edges.where("relation <> 'mentions'").count() == 1

    def picky(text):
        if not text:
            raise ValueError("no text")
        return {"organizations": text.split()[:1]}

    got = {r.chunk_id: r.tags for r in providers.tagged(rows, "passage", picky).collect()}
    assert got == {1: {"organizations": ["Acme"]}, 2: {}}

    class Echo:
        def generate(self, prompt):
            if "fail" in prompt:
                raise RuntimeError
            return prompt[-3:]

    asked = spark.createDataFrame([(1, "abcdef"), (2, "fail")], "k long, prompt string")
    assert {r.k: r.answer for r in providers.answered(asked, "prompt", Echo()).collect()} == {1: "def", 2: None}
    assert providers.MeanOf("k")(asked) == {"k": 1.5}


def test_discovery_of_tagged_questions(spark, tmp_path):
    import json

    from tessera.sources import files

    (tmp_path / "qa").mkdir()
    (tmp_path / "data").mkdir()
    write = lambda path, rows: path.write_text("\n".join(map(json.dumps, rows)))
    write(tmp_path / "qa" / "a.jsonl", [{"question": "x?", "query_semantic_tags": {"a": [], "b": []}}] * 60)
    write(tmp_path / "data" / "b.jsonl", [{"text": "y", "tags": {"a": []}}] * 2)
    write(tmp_path / "data" / "c.jsonl", [{"text": "no tags"}])
    got = [(r.path.rsplit("/", 1)[1], r.records, r.score) for r in files.discover(spark, str(tmp_path), ["b", "a"]).collect()]
    assert got == [("a.jsonl", 50, 50 * (3 + 20 + 5 + 5 + 15) + 100), ("b.jsonl", 2, 2 * (3 + 5))]


@pytest.mark.parametrize("clusters", [3, 40])
def test_multi_vector_search_is_exact_and_compares_few_bags(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 8)) * 4
    bags = [(i, (centres[rng.integers(0, clusters, n := int(rng.integers(1, 6)))] + 0.1 * rng.normal(size=(n, 8))).tolist()) for i in range(400)]
    bags += [(400, bags[7][1]), (401, bags[7][1]), (402, []), (403, None), (404, [[0.0] * 8])]
    frame = spark.createDataFrame(bags, "id long, vecs array<array<double>>").repartition(3)
    index = MultiVectorIndex.build(frame, centroids=64)
    asked = spark.createDataFrame([(i, bags[i][1]) for i in (3, 7, 11)] + [(-1, []), (-2, [[1.0] + [0.0] * 7])], "query_id long, vecs array<array<double>>")
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in index.search(asked, 5).collect()}
    assert len(got) == 4 * 5
    for q, query in ((3, bags[3][1]), (7, bags[7][1]), (11, bags[11][1]), (-2, [[1.0] + [0.0] * 7])):
        score = {i: round(float((np.array(query) @ np.array(v).T).max(1).sum()), 12) for i, v in bags if v}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, round(score[i], 9)) for i in want]
    floors = index.search(asked, 5).where("rank = 5").select("query_id", F.col("score").alias("floor"))
    compared = index._pairs(asked.where("size(vecs) > 0"), 5, floors).count()
    assert compared < 0.5 * 4 * 403
    assert MultiVectorIndex.build(frame.limit(0)).search(asked, 5).count() == 0 == index.search(asked.limit(0), 5).count()


def test_open_extraction_gives_errors_as_rows(spark):
    class Odd:
        """A model that answers as models do."""

        def names(self, text):
            if "fails" in text:
                raise OSError("no answer")
            return {"chat": 'Sure: {"named_entities": ["B", " A ", "B", "", 3]} done', "list": '["A"]'}.get(text, "nothing")

        def triples(self, text, names):
            rows = [["A", "is", "B"], ["A", "is", "B "], ["A", "is"], "A", ["A", " ", "B"], ["B", "has", 5]]
            return json.dumps({"triples": rows}) if names == ["A", "B"] else '{"triples": 5}'

    docs = spark.createDataFrame([(1, "chat"), (2, "list"), (3, "other"), (4, None), (5, "  "), (6, "it fails")], "id long, text string")
    rows = open_extraction.extracted(docs, "id", model=Odd()).collect()
    of = lambda i, kind: [(r.s, r.r, r.o) if kind != "error" else r.reason for r in sorted(rows, key=lambda r: r.ord) if r.id == i and r.kind == kind]
    assert of(1, "entity") == [("A", None, None), ("B", None, None)] and of(1, "triple") == [("A", "is", "B"), ("B", "has", "5")]
    assert of(1, "error") == ["not three parts", "not three parts", "empty part"]
    assert of(2, "error") == ["no list of named_entities", "no list of triples"] and of(3, "error") == ["no JSON object", "no list of triples"]
    assert of(6, "error") == ["model failed: OSError", "no list of triples"] and not {4, 5} & {r.id for r in rows}
    open_extraction.register(spark)
    sql = spark.sql("SELECT t.s, t.o FROM VALUES ('Red Blue. Green') AS d(text), LATERAL open_extract(d.text) t WHERE t.kind = 'triple'")
    assert [tuple(r) for r in sql.collect()] == [("Red", "Blue")]

