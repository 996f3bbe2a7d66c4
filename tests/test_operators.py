"""Small fixtures with results worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.operators import fusion, graph, losses, metrics, qrels, ranking, tags, vector
from tessera.operators.components import connected_components
from tessera.operators.joins import left_join_unique
from tessera.sources import files
from tessera.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_rules(spark):
    assert one(spark, T.entity_key(F.lit("  Café   Noir, Inc! "))) == "café noir inc"
    assert one(spark, T.tag_key(F.lit("Smith & Sons, Inc."))) == "smith and sons"
    assert one(spark, T.tag_key(F.lit("Inc."))) == ""
    assert one(spark, T.first_text(F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "b"
    assert one(spark, T.sentences(F.lit("The U.S. market grew a lot in May. Profits of Apple Inc. rose as well! ok"))) == ["The U.S. market grew a lot in May.", "Profits of Apple Inc. rose as well! ok"]
    assert len(one(spark, T.preview(F.lit("x" * 500), 350))) == 350
    assert one(spark, T.attributes_map(F.lit('{"a": 1}'))) == {"a": "1"}
    assert one(spark, T.attributes_map(F.lit("a: 1"))) == {"raw": "a: 1"}
    assert one(spark, T.parsed_json(F.lit('```json\n{"a": [1]}\n```')).cast("string")) == '{"a":[1]}'


def test_toy_graph(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (0, 2, 2)], "u long, v long, r int")
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    assert graph.with_inverse(edges, 3).count() == 6
    negatives = graph.strict_negatives(edges.where("r = 0"), nodes).collect()
    assert {r.v for r in negatives} == {0, 2}
    assert {(r.id, r.component) for r in connected_components(edges).collect()} == {(0, 0), (1, 0), (2, 0)}
    paths = {(r.id, r.hops): tuple(r.path) for r in graph.hops(edges.withColumn("w", F.lit(1.0)), spark.createDataFrame([(0, 0)], "start long, id long"), 3, beam=2).collect()}
    assert paths[(2, 2)] == (0, 1, 2) and paths[(2, 1)] == (0, 2)
    q = graph.Query(edges, nodes)
    assert {r.id for r in q.evaluate(("i", ("p", ("e", 0), 0), ("n", ("e", 0)))).collect()} == {1}
    scores = graph.distmult_scores(spark.createDataFrame([(0, 0)], "u long, r int"), spark.createDataFrame([(0, [1.0, 2.0])], "id int, vec array<double>"), spark.createDataFrame([(0, [1.0, 1.0]), (1, [3.0, 0.5])], "id long, vec array<double>"))
    assert {(r.v, r.score) for r in scores.collect()} == {(0, 3.0), (1, 4.0)}


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(path).agg(F.sum("component"), F.count("*")).first() == Row(0, 201)
    assert connected_components(path.limit(0)).count() == 0


def test_graph_assembly(spark):
    mentions = spark.createDataFrame([(1, "Apple", 1), (1, "APPLE", 2), (2, "Tim", 3)], "chunk_id long, entity string, ord long")
    triples = spark.createDataFrame([(1, "Apple", "led_by", "Tim", 4), (1, "Apple", "is", "Yes", 5), (1, "Apple", "is", " apple ", 6)], "chunk_id long, s string, r string, o string, ord long")
    nodes, edges = graph.assemble(mentions, triples)
    assert {r.name for r in nodes.where("type = 'entity'").collect()} == {"Apple", "Tim"}
    assert edges.where("relation = 'led_by'").count() == 1 and edges.where("relation = 'is'").count() == 0


def test_metrics_edges(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (2, 12, 1)], "query_id long, doc_id long, rank long")
    qrel = spark.createDataFrame([(1, 10), (1, 11)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    m = {(r.query_id, r.k): r for r in metrics.retrieval_metrics(run, qrel, queries, [2]).collect()}
    assert m[(1, 2)].precision == 1.0 and m[(1, 2)].recall == 0.5
    assert m[(2, 2)].recall is None and m[(2, 2)].ndcg == 0.0 and m[(3, 2)].hit == 0
    answers = spark.createDataFrame([("a", "The cat sat", "cat sat down"), ("b", "yes", "no"), ("c", "", "")], "key string, p string, g string")
    a = {r.key: r for r in metrics.answer_scores(answers, "key", "p", "g").collect()}
    assert round(a["a"].f1, 3) == 0.8 and a["b"].f1 == 0 and a["c"].em == 1


def test_fusion_and_vectors(spark):
    a = spark.createDataFrame([(1, 10, 1)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id long, doc_id long, rank long")
    s = {r.doc_id: r.score for r in fusion.rrf(a, b).collect()}
    assert abs(s[10] - (1 / 61 + 1 / 62)) < 1e-12 and abs(s[11] - 1 / 61) < 1e-12
    assert [r.norm for r in fusion.min_max(spark.createDataFrame([(1, 2.0), (1, 2.0)], "query_id long, score double")).collect()] == [1.0, 1.0]
    assert one(spark, vector.max_sim(F.expr("array(array(1.0D, 0.0D))"), F.expr("array(array(0.5D, 0.0D), array(0.25D, 1.0D))"))) == 0.5
    zero = vector.mean_vector(spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "k long, embedding array<double>"), "k").first()
    assert list(zero["vector"]) == [0.0, 0.0]


def test_page_overlap(spark):
    rows = spark.createDataFrame([("3", "2", "4"), ("3", "3", None), ("x", "1", "9"), ("3", None, "4")], "p string, a string, b string")
    assert [r[0] for r in rows.select(qrels.page_overlaps(F.col("p"), F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_tags(spark):
    q, c = F.array(F.lit("Apple Inc."), F.lit("Inc."), F.lit("X")), F.array(F.lit("apple"), F.lit("Inc"))
    assert one(spark, tags.overlap(q, c)) == ["Apple Inc."]
    assert one(spark, tags.overlap_count([(q, c)])) == 1
    assert one(spark, tags.cleaned(F.array(F.lit(" A "), F.lit("a"), F.lit("N/A"), F.lit("b")))) == ["A", "b"]


def test_ranking(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(10)], "id long, g string, v double")
    assert [r.id for r in ranking.round_robin(rows, "g", "id", 4).orderBy("round", "g").collect()] == [0, 1, 2, 3]
    assert [r.n for r in ranking.dense_ids(rows, "id", "n").orderBy("id").collect()] == list(range(10))
    assert {r.id for r in ranking.keep_last(rows, F.col("g"), ["id"]).collect()} == {8, 9}
    total = ranking.softmax(rows, "g", "v").groupBy("g").agg(F.sum("softmax").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in total)


def test_losses_registry():
    import pytest

    assert losses.build(["mse", "bce"]) == [losses.mse, losses.bce]
    with pytest.raises(ValueError):
        losses.build(["none"])


def test_left_join_unique(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(60)], "id long, key string")
    right = spark.createDataFrame([("hot", 40, 1), ("k0", 1, 2), ("k6", 1, 3)], "key string, n long, x int")
    for hot in (1, 1024):
        out = {r.id: r.x for r in left_join_unique(left, right, "key", "n", ["x"], hot_keys=hot).collect()}
        assert len(out) == 60 and out[1] == 1 and out[0] == 2 and out[6] == 3 and out[3] is None and out[12] is None


def test_files(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("n", LongType())])
    (tmp_path / "a.jsonl").write_text('﻿{"id": "a", "n": 1}\n\n{"id": "b"\n[1]\n{"id": "c", "n": 3}\n')
    good, bad = files.read_jsonl_safe(spark, str(tmp_path / "a.jsonl"), schema)
    assert {r.id for r in good.collect()} == {"a", "c"} and sorted(r.line for r in bad.collect()) == [3, 4]
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [{"id": "x", "n": 1}, {"id": "y"}]}))
    assert {r.id for r in files.read_json_any(spark, str(tmp_path / "b.json"), schema).collect()} == {"x", "y"}
    nodes = spark.createDataFrame([("u", 'A "q"', "entity", "x,1")], "uid string, name string, type string, note string")
    relations, edges = spark.createDataFrame([("r",)], "name string"), spark.createDataFrame([("u", "r", "u")], "source string, relation string, target string")
    files.write_graph(nodes, relations, edges, str(tmp_path / "g"))
    back = files.read_graph(spark, str(tmp_path / "g"))
    assert back["nodes"].first()["attributes"] == {"note": "x,1"} and back["nodes"].first()["name"] == 'A "q"'
    (tmp_path / "n.csv").write_text("uid,name\na,NA\nb,\n")
    ids = files.read_indexed_csv(spark, str(tmp_path / "n.csv"), StructType([StructField("uid", StringType()), StructField("name", StringType())]), ["uid"])
    assert [(r.uid, r.name, r.id) for r in ids.orderBy("id").collect()] == [("a", "NA", 0), ("b", "", 1)]
    work = lambda df: df.withColumn("done", F.lit(True))
    todo = spark.range(4).withColumnRenamed("id", "k")
    files.resume(todo.where("k < 2"), str(tmp_path / "r"), "k", work)
    assert files.resume(todo, str(tmp_path / "r"), "k", work).count() == 4
    rows = spark.createDataFrame([("1", "text", "a"), ("2", "table", "b")], "chunk_id string, modality string, text string")
    encode = lambda df: df.withColumn("vec", F.array(F.lit(1.0)))
    files.write_index(rows, str(tmp_path / "i"), encode, {"dim": 1})
    files.write_index(rows, str(tmp_path / "i"), encode, {"dim": 1})
    assert files.read_index(spark, str(tmp_path / "i"), rows).count() == 2
    assert files.markdown_table(spark.createDataFrame([("a", 0.5)], "k string, v double")).splitlines()[-1] == "| a | 0.5000 |"


def test_stream_enriches_each_chunk_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = events.enrich(source, lambda df: df.withColumn("x", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for log in ("commits", "offsets"):  # as if the run had died between its first write and the mark
        for p in (tmp_path / "ck" / log).iterdir():
            if log == "commits" or not p.name.startswith(("0", ".0")):
                p.unlink()
    events.enrich(source, lambda df: df.withColumn("x", F.lit(2)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == 2 and again.where("x = 2 AND batch = 0").count() == 2
