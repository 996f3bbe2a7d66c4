"""Extraction, linking and report rules on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction, filings, linking, providers, vector_grid
from tessera.plans import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_canonical_relations(spark):
    names = {"Located  in": "located_in", "has telephone number": "has_phone", "has_phone": "has_phone", "reported": "reported", "newly reported": "files_report", "recorded gains": "reported", "x" * 40: "related_to", "": "related_to", "makes for": "makes_for", "is expected by": "expects"}
    rows = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.c for r in rows.select("n", extraction.canonical_relation(F.col("n")).alias("c")).collect()} == names
    assert len(extraction.WHITELIST) == 25 and len(extraction.CANONICAL) == 56


def test_grounding(spark):
    triples = [["Apple", "acquired", "Beats"], ["apple", "acquired", "beats"], ["Apple", "acquired"], ["Apple", "", "Beats"], ["Apple", "owns", "Mars"], ["Tim", "is", "here"], ["U.S", "is", "Apple"]]
    rows = spark.createDataFrame([(1, triples, ["Apple"], "Apple acquired Beats; Tim is here in the US.")], "chunk_id long, triples array<array<string>>, entities array<string>, passage string")
    clean, noisy = extraction.grounded(rows)
    assert [(r.s, r.r, r.o) for r in clean.orderBy("ord").collect()] == [("Apple", "acquired", "Beats"), ("U.S", "is", "Apple")]
    assert [r.reason for r in noisy.orderBy("ord").collect()] == ["invalid_triple_shape", "empty_element", "entity_not_grounded_in_passage", "neither_subject_nor_object_in_ner_entities"]


def test_focus_and_changes(spark):
    text = "One. Sales grew a lot. Three. Four. " * 30
    assert one(spark, extraction.focus_passage(F.lit(text), ["grew"], most=100)).startswith("One. Sales grew a lot. Three. One.")
    rows = spark.createDataFrame([(1, "Nothing here. Acme Corp sales rose 5 %. Costs fell.", ["Acme", "Acme Corp"])], "chunk_id long, passage string, entities array<string>")
    got = [(r.s, r.r) for r in extraction.change_triples(rows).orderBy("ord").collect()]
    assert got == [("Acme Corp", "increased"), ("Acme Corp", "decreased")]
    assert one(spark, extraction.mostly_numeric(F.lit("$1,234 (5%)"))) and not one(spark, extraction.mostly_numeric(F.lit("abc 1")))


def test_negatives_avoid_edges(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 0, 0)], "u long, v long, r int")
    drawn = extraction.negatives(edges, spark.range(3), 6, 1).collect()
    assert drawn and all((r.nu, r.nv) not in {(0, 1), (1, 2), (2, 0)} for r in drawn)


def test_linking(spark):
    ents = spark.createDataFrame([("e1", "Apple", 0, [1.0, 0.0]), ("e2", "APPLE", 1, [0.0, 1.0]), ("e3", "Tim Cook", 2, [0.6, 0.8])], "uid string, name string, ord int, vec array<double>")
    surf = spark.createDataFrame([("Apple", None), ("apple", None), ("Cook", [0.6, 0.8]), ("far", [-1.0, 0.0])], "surface string, vec array<double>")
    assert {(r.surface, r.uid, r.how) for r in linking.link(surf, ents).collect()} == {("Apple", "e1", "exact"), ("apple", "e1", "lower"), ("Cook", "e3", "vector")}
    terms = spark.createDataFrame([(1, "apple"), (2, "Cook"), (3, "x")], "id long, term string")
    assert {(r.id, r.uid) for r in linking.resolve(terms, ents).collect()} == {(1, "e1"), (1, "e2"), (2, "e3")}
    syn = linking.synonyms(ents.select(F.col("uid").alias("id"), "name", "vec"), ents.select(F.col("uid").alias("id"), "name", "vec")).collect()
    assert {(r.source, r.target) for r in syn} == {("e2", "e3"), ("e3", "e2")}
    q = spark.createDataFrame([(1, "a", "red cat"), (2, "b", "none")], "id long, source string, text string")
    c = spark.createDataFrame([(10, "a", "a red cat"), (11, "a", "dog"), (12, "b", "sole")], "chunk_id long, source string, text string")
    assert {(r.id, r.chunk_id) for r in linking.best_chunk(q, c).collect()} == {(1, 10), (2, 12)}
    s = linking.training_samples(spark.createDataFrame([(1, "e1")], "id long, uid string"), spark.createDataFrame([(1, 10), (2, 11)], "id long, chunk_id long"), spark.createDataFrame([(10, "e3")], "chunk_id long, uid string")).collect()
    assert len(s) == 1 and s[0].target_nodes == {"chunk": ["chunk:10"], "entity": ["e3"]}
    assert one(spark, linking.node_type(F.lit("doc:1"))) == "document"
    assert one(spark, linking.map_text(F.expr("map('b', '2', 'a', null)"), F.lit("n"))) == "name: n\nb: 2"


def test_roles_and_scores(spark):
    rows = [("Form 10-K ... Commission File Number", "1", "cover_page"), ("Risk factors we face", "9", "risk_factor"), ("Table of Contents", "2", "table_of_contents"), ("See note 3 on leases", "x", "footnote"), ("  ", None, "unknown"), ("Plain", "1", "section_content")]
    df = spark.createDataFrame([(t, p, r) for t, p, r in rows], "text string, page string, want string").withColumns({"modality": F.lit("text"), "section": F.lit(None).cast("string")})
    got = filings.chunk_tags(df).collect()
    assert all(r.chunk_role == r.want for r in got) and next(r for r in got if r.want == "cover_page").evidence_type == "metadata"
    tagged = filings.chunk_tags(spark.createDataFrame([("Net sales and revenue of 2023", "3", "table", "x")], "text string, page string, modality string, section string")).withColumn("companies", F.array(F.lit("AAPL"))).withColumn("retrieval_keywords", F.array().cast("array<string>"))
    both = tagged.select(F.struct("*").alias("c"), F.expr("named_struct('financial_metrics', array('revenue'), 'business_topics', array(), 'risk_topics', array(), 'expected_sections', array(), 'retrieval_keywords', array(), 'companies', array('aapl'), 'years', array('2023'), 'evidence_type_needed', 'table', 'intent', 'calculate')").alias("q"))
    assert abs(both.select(filings.tag_score("q", "c").alias("s")).first().s - (0.28 + 0.08 + 0.06 + 0.08 + 0.08 + 0.08 + 0.05)) < 1e-9
    assert one(spark, filings.intent(F.lit("How much did revenue change?"))) == "calculate"
    assert one(spark, filings.good_table(F.lit("Net sales by region"), F.lit("table"))) and not one(spark, filings.good_table(F.lit("Table of contents: income"), F.lit("table")))


def test_embed_text(spark):
    df = spark.createDataFrame([("d/AAPL_10-K_2024.pdf", 3, "table", None, "Sums", "|a|", None), ("MSFT_DEF_1.pdf", None, "text", "Hello  world", "", None, None)], "source_pdf string, page int, modality string, text string, summary string, table_markdown string, key_values array<string>")
    a, b = (r.x for r in df.select(filings.embed_text({"AAPL": "Apple"}).alias("x")).collect())
    assert a == "Company: Apple\nTicker: AAPL\nFiling type: 10-K\nSource filing: AAPL_10-K_2024.pdf\nPage: 3\nModality: table\nTable summary: Sums\nTable markdown: |a|"
    assert b == "Company: MSFT\nTicker: MSFT\nFiling type: DEF 14A proxy statement\nSource filing: MSFT_DEF_1.pdf\nModality: text\nPassage: Hello world"


def test_html_tables(spark):
    html = "<p>x</p><table><tr><th></th><th>2023</th><th>2022</th></tr><tr><td>Sales</td><td>$</td><td>1,200</td><td>(900)</td></tr></table><TABLE><tr><td> a  b</td></tr></TABLE>"
    rows = filings.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string"))
    assert [(r.table_index, r.row_index, r.cells) for r in rows.orderBy("table_index", "row_index").collect()] == [(0, 0, ["2023", "2022"]), (0, 1, ["Sales", "1,200", "(900)"]), (1, 0, ["a b"])]


def test_providers(spark):
    rows = spark.createDataFrame([(1, "Tim Cook leads Apple"), (2, None)], "id long, text string")
    got = {r.id: r for r in providers.recognised(providers.encoded(rows, "text"), "text").collect()}
    assert got[1].entities == ["Tim Cook", "Apple"] and abs(sum(x * x for x in got[2].vec) - 1) < 1e-9
    calls = iter([ValueError(), "ok"])

    def flaky(_: str) -> str:
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.with_retries(flaky)("p") == "ok"
    answer, docs = providers.reason("q", lambda q: [("a", 1.0 if q == "q" else 2.0), (q, 0.5)], lambda q, d: "So the answer is: 1" if "t" in d else "t", steps=3)
    assert answer.endswith("1") and docs[0] == ("a", 2.0)


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_grid_products_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    v = np.round(rng.normal(size=(60, 5)), 1) * rng.choice([0.1, 1, 30], (60, 1))
    v[10:14] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame([*rows, (99, None)], "id long, vec array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in vector_grid.top_products(frame, frame, 6, block).collect()}
    assert len(got) == 60 * 6
    for i in range(60):
        score = np.round(v @ v[i], 9)
        want = sorted(range(60), key=lambda j: (-score[j], j))[:6]
        assert [got[i, r + 1][0] for r in range(6)] == want
    assert vector_grid.top_products(frame.limit(0), frame, 3, block).count() == 0 == vector_grid.top_products(frame, frame.limit(0), 3, block).count()
    assert vector_grid.top_products(frame.where("id < 2"), frame.where("id < 3"), 9, block).count() == 6


def test_synonyms_of_all_phrases(spark):
    phrases = spark.createDataFrame([(i, name, vec) for i, (name, vec) in enumerate([("alpha", [1.0, 0.0]), ("alphas", [0.9, 0.1]), ("beta", [0.0, 1.0]), ("ab", [1.0, 0.0]), (None, [1.0, 0.0]), ("zero", [0.0, 0.0]), ("gamma", None)])], "id long, name string, vec array<double>")
    got = {(r.source, r.target): round(r.score, 6) for r in linking.synonyms(phrases).collect()}
    assert got == {(0, 1): 0.9, (1, 0): 1.0}
    assert {r.source for r in linking.synonyms(phrases, phrases.where("id = 1")).collect()} == {1}



def test_grounded_triples_see_whole_passages(spark, tmp_path):
    text = " ".join(c * 40 for c in "abc")  # the second and third word end beyond 60 characters
    spark.createDataFrame([(1, text, "en", "s", 122)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    n = {r.reason: r.n for r in rules.grounded_triples(spark, str(tmp_path)).collect()}
    assert n["clean"] == 1 and n["entity_not_grounded_in_passage"] == 1


def test_typed_node_texts_and_their_counts(spark):
    nodes = spark.createDataFrame([("chunk:1", None), ("2", "chunk"), ("chunk:3", ""), ("chunk:4", None), ("entity:a", None), ("b", None), ("doc:c", None), ("d", None), (None, None), ("d", None)], "uid string, type string")
    records = spark.createDataFrame([("chunk:3", "chunk", "record  three"), ("b", "entity", " bee "), ("entity:a", None, "  "), ("d", "document", "x" * 600)], "uid string, type string, text string")
    chunks = spark.createDataFrame([("1", "one"), ("chunk:1", "whole one"), ("2", "two"), ("4", "")], "chunk_id string, text string")
    texts, counts = linking.typed_node_texts(nodes, records, chunks)
    want = [("2", "chunk", "two"), ("b", "entity", "bee"), ("chunk:1", "chunk", "whole one"), ("chunk:3", "chunk", "record three"), ("chunk:4", "chunk", "Node: chunk:4"), ("d", "document", "x" * 512), ("d", "document", "x" * 512), ("doc:c", "document", "Node: doc:c"), ("entity:a", "entity", "Node: entity:a")]
    assert sorted((r.uid, r.type, r.text) for r in texts.collect() if r.uid) == want
    assert counts == {"nodes": 10, "entity_texts": 2, "chunk_texts": 4, "document_texts": 3, "fallbacks": 4, "empty": 0}
    assert linking.typed_node_texts(nodes.limit(0), records, chunks)[1]["nodes"] == 0
