"""Queries over all pairs of vectors: their SQL on an odd table, and small blocks against plain answers."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from tessera.operators import graph_search, losses, pair_grid
from tessera.plans import catalog

ASKING = ("tail_predictions", "filtered_rank_metrics", "training_losses", "unbiased_hits", "hard_ranks", "auroc_by_query", "typed_ranks", "type_means", "late_interaction", "typed_topk", "kg_rank_pessimistic")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Vectors of sixteenths, whose products lie between two roundings, with copies; some have no label, some are null."""
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("odd")
    vecs = {i: [rng.randrange(-8, 9) / 16 for _ in range(5)] for i in range(620)}
    vecs |= {i: vecs[i - 300] for i in range(350, 420)} | {i: None for i in (7, 300, 405, 411, 412, 413)}
    table = [(i, v, None if i % 29 == 11 or i == 200 else i % 7 % 4) for i, v in vecs.items()]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return str(folder), con


def compared(spark, odd, name):
    out = catalog.QUERIES[name](spark, odd[0])
    assert rows(out.toPandas()) == rows(odd[1].execute(catalog.ORACLES[name]).df())
    return out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ASKING)
def test_pairs_meet_in_blocks_with_the_answers_of_sql(spark, odd, name):
    plan = compared(spark, odd, name)
    assert name == "training_losses" or "FlatMapCoGroupsInArrow" in plan  # training_losses reads sums that blocks gave
    assert "lambda x_0" not in plan.split("== Physical Plan ==")[-1].replace("isnotnull(lambda x_0", "")  # no array function a pair


def test_one_label_has_no_negatives(spark, tmp_path):
    spark.createDataFrame([(i, [float(i % 5), 1.0], 3) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["auroc_by_query"](spark, str(tmp_path)).collect() == []
    hits = catalog.QUERIES["unbiased_hits"](spark, str(tmp_path)).orderBy("query_id").collect()
    assert [r.query_id for r in hits] == [0, 100] and all(math.isnan(r.hits_3_50) for r in hits)
    assert all(math.isnan(x) for x in duckdb.sql(catalog.ORACLES["unbiased_hits"].replace("FROM embeddings q, embeddings d", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' q, '{tmp_path}/embeddings.parquet/*.parquet' d")).df()["hits_3_50"])


def _vectors(spark, n=90, seed=2):
    rng = random.Random(seed)
    table = [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(0, 6 if i % 3 else 1) for _ in range(3)] if i % 17 else None, rng.choice("ab") if i % 13 else None, rng.randrange(4) or None) for i in range(n)]
    return {r[0]: r for r in table}, spark.createDataFrame(table, "id long, vec array<double>, label string, type int")


def _score(a, b, digits):
    if a is None or b is None:
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):  # sum() would correct its rounding
        total += x * y
    return float(pair_grid.rounded(np.array(total), digits))


def test_ranks_of_small_blocks_are_those_of_all_pairs(spark):
    table, v = _vectors(spark)
    got = {(r.query_id, r.type, r.id): (r.above, r.as_high, r.below, r.before, r.place, r.negatives) for r in pair_grid.ranks(v.where("id % 6 = 0"), v, asked=4, block=9).collect()}
    want = {}
    for j in range(0, 90, 6):
        for kind in (1, 2, 3, None):
            scored = {i: _score(table[j][1], r[1], 6) for i, r in table.items() if r[3] == kind}
            order = sorted(scored, key=lambda i: (scored[i] is None, -(scored[i] or 0), i))
            own = [i for i in order if table[j][2] is not None and table[i][2] == table[j][2]]
            others = [scored[i] for i in order if None not in (table[i][2], table[j][2]) and i not in own]
            for place, i in enumerate(own, 1):
                s = scored[i]
                count = lambda f: sum(1 for x in others if s is not None and x is not None and f(x, s))  # noqa: B023, E731
                want[j, kind, i] = (count(float.__gt__), count(float.__ge__), count(float.__lt__), order.index(i) - place + 1, place, len(others))
    assert got == want and len(got) > 300


def test_best_of_each_type_in_small_blocks(spark):
    table, v = _vectors(spark, seed=5)
    got = {(r.query_id, r.type, r.rank): (r.id, r.score) for r in pair_grid.best_products(v.where("id % 6 = 0"), v, 4, 2, asked=4, block=9).collect()}
    want = {}
    for j in range(0, 90, 6):
        for kind in (1, 2, 3, None):
            scored = [(i, _score(table[j][1], r[1], 2)) for i, r in table.items() if r[3] == kind]
            want |= {(j, kind, n): pair for n, pair in enumerate(sorted(scored, key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:4], 1)}
    assert got == want and any(score is None for _, score in got.values())


def test_scores_that_are_not_finite_rank_as_in_sql():
    q, v = np.array([[1.0, 0.0], [np.inf, 1.0]]), np.array([[np.nan, 0.0], [np.inf, 0.0], [1.0, 2.0], [0.0, 0.0]])
    got = pair_grid.products(q, v, 6)
    assert np.isnan(got[0, 0]) and got[0, 2] == 1 and np.isinf(got[1, 1]) and np.isnan(got[1, 3])
    found = pair_grid._ranked([np.array([np.nan, np.inf, 1.0, 0.0])], np.array([0, 0, 1, 0], np.uint8), 6)
    assert [found[c].tolist() for c in ("above", "as_high", "below", "negatives")] == [[2], [2], [1], [3]]
    assert pair_grid.rounded(np.array([0.0078125, -0.0078125, 2.5, 1e300, np.nan]), 6)[:4].tolist() == [0.007813, -0.007813, 2.5, 1e300]


def test_tails_are_those_of_all_scores(spark):
    table, v = _vectors(spark, 40)
    nodes = v.where("vec IS NOT NULL").withColumn("type", F.col("label"))
    heads = nodes.where("id % 5 = 1").select(F.col("id").alias("u"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("r"))
    for scope in (None, ["a"]):
        got = {(r.u, r.r, r["rank"]): (r.v, r.score) for r in graph_search.tail_predictions(heads, nodes.where("id IN (1, 2)").select("id", "vec"), nodes, 3, scope).collect()}
        for (u, r) in {(u, r) for u, r, _ in got}:
            asked = [x * y for x, y in zip(table[u][1], table[r][1], strict=True)]
            scored = [(i, _score(asked, row[1], 6)) for i, row in table.items() if row[1] is not None and (scope is None or row[2] in scope)]
            assert [got[u, r, n] for n in (1, 2, 3)] == sorted(scored, key=lambda p: (-p[1], p[0]))[:3]
        assert len(got) == 3 * heads.count()


def test_losses_of_blocks_are_those_of_rows(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.uniform(-0.5, 0.5) for _ in range(3)], rng.randrange(3) if i % 11 else None) for i in range(50)], "id long, vec array<double>, label int")
    q = v.where("id % 4 = 1")
    pairs = q.select(F.col("id").alias("row"), F.col("vec").alias("q"), F.col("label").alias("ql")).crossJoin(v)
    t = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    flat = pairs.select("row", (F.col("label") == F.col("ql")).cast("double").alias("y"), t.alias("t")).withColumn("logit", F.col("t") * 4).where("row <> 33")
    want = {name: f(flat).first()[0] for name, f in losses.LOSSES.items()}
    got = losses.of_products(q.where("id <> 33"), v, 4).first().asDict()
    assert got.keys() == want.keys() and all(abs(got[name] - want[name]) < 1e-9 for name in want)


def test_bags_without_vectors_have_null_scores(spark):
    rng = random.Random(3)
    bags = {i: [[rng.randrange(-4, 5) / 4 for _ in range(2)] for _ in range(i % 4)] for i in range(20)}
    frame = spark.createDataFrame(list(bags.items()), "id int, vecs array<array<double>>")
    got = {(r.query_id, r.id): r.score for r in pair_grid.max_sims(frame.where("id % 3 = 0"), frame, 5, asked=2, block=3).collect()}
    best = lambda a, b: sum(max(sum(x * y for x, y in zip(p, z, strict=True)) for z in b) for p in a) if a and b else None
    assert got == {(j, i): best(bags[j], bags[i]) for j in range(0, 20, 3) for i in range(20)}


def test_spearman_ranks_packed_scores_not_rows(spark, odd):
    plan = compared(spark, odd, "spearman_by_query")
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """Vectors of several widths, with nulls inside, empty, null, of large numbers, infinite and not numbers; ids below zero, one null, some twice."""
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("ragged")
    vecs = {i: [None if rng.random() < 0.1 and j else rng.randrange(-8, 9) / 16 for j in range(rng.choice((3, 5, 5, 5)))] for i in range(-150, 350)}
    vecs |= {0: [0.5, None, 0.25], 11: [], 12: None, 13: [None, None, None], 14: [3e9, 1.0], 15: [float("inf"), 1.0, 0.0, 0.0, 0.0], 16: [float("nan"), 1.0], None: [0.5, 0.25, 0.5, 0.0, 0.0], 200: [1.0, 2e7, -3.0, 1.0, 1.0], 300: []}
    twice = [(i, [rng.randrange(-8, 9) / 16 for _ in range(5)], 1) for i in (5, 6, 100)]
    spark.createDataFrame([(i, v, i and i % 3) for i, v in vecs.items()] + twice, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return str(folder), con


def test_spearman_of_ragged_vectors_is_that_of_sql(spark, ragged):
    compared(spark, ragged, "spearman_by_query")


def _spearman(xs, ys):
    mean_ranks = lambda keys: [sum(k < key for k in keys) + (keys.count(key) + 1) / 2 for key in keys]
    with np.errstate(all="ignore"):
        return float(np.corrcoef(mean_ranks(xs), mean_ranks(ys))[0, 1])


def test_spearman_of_small_blocks_is_that_of_all_pairs(spark):
    for seed, scale in ((6, 1.0), (7, 1e5)):  # steps in two bytes; in four, and scores of eight
        table, v = _vectors(spark, seed=seed)
        table = {i: (i, r[1] and [x / scale for x in r[1]], r[3]) for i, r in table.items()}
        v = spark.createDataFrame(list(table.values()), "id long, vec array<double>, type int")
        got = {r.query_id: r.spearman for r in pair_grid.rank_correlations(v.where("id % 6 = 0"), v, asked=4, block=9).collect()}
        assert sorted(got) == list(range(0, 90, 6))
        for j, found in got.items():
            scored = [(s is None, s or 0.0) for s in (_score(table[j][1], r[1], 6) for r in table.values())]
            want = _spearman(scored, [(r[2] is None, r[2] or 0) for r in table.values()])
            assert math.isnan(want) and math.isnan(found) or abs(want - found) < 1e-9


def test_integers_in_steps_are_the_sorted_integers():
    rng = np.random.default_rng(1)
    for spread, packs in ((30_000, True), (1 << 29, False)):
        values = rng.integers(-spread, spread, (7, 300)).astype(np.int32)
        values[:, 40], values[2, 200:] = (1 << 31) - 1, -(1 << 29)
        spans = np.array([[0, 30], [30, 31], [31, 300]])
        found = pair_grid._steps(values, spans)
        assert (found is not None) == packs
        for n in range(len(values) if packs else 0):
            own = found[1] == n
            want = np.concatenate([np.sort(values[n, a:b]) for a, b in spans])
            assert found[0].dtype == np.uint16 and (pair_grid._stepped(found[0][n], found[2][own], found[3][own]) == want).all()


@pytest.mark.parametrize("table", ["odd", "ragged"])
def test_overfetched_rows_are_the_best_of_blocks(spark, table, request):
    plan = compared(spark, request.getfixturevalue(table), "overfetch_bonus")
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan  # no pair of a query with a vector is a row of a join


def test_best_of_many_are_scored_in_parts_and_told_if_labels_match(spark):
    rng = random.Random(10)
    v = spark.createDataFrame([(i, [rng.randrange(-9, 10) / 8 for _ in range(3)] if i % 50 else None, 0, rng.choice("abc") if i % 7 else None) for i in range(3000)], "id long, vec array<double>, type int, label string")
    found = [{(r.query_id, r.rank): (r.id, r.score, r.same) for r in pair_grid.best_products(v.where("id % 3 = 0"), v, 5, block=block, match="label").collect()} for block in (3000, 300)]
    assert 1000 * 3000 > pair_grid.SCORED > 1000 * 300 and found[0] == found[1] and len(found[0]) == 5000
    label = {r.id: r.label for r in v.collect()}
    assert all(same == (label[j] is not None and label[j] == label[i]) for (j, _), (i, _, same) in found[0].items())
