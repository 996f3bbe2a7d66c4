"""Partitions with small cuts, best walks, and gradients against finite differences and enumeration."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph_cut, graph_paths

EDGE = "u long, r long, v long, w double"


def test_minimal_cut_finds_communities_within_its_capacity(spark):
    rng = random.Random(3)
    n, parts = 240, 4
    home = [i % parts for i in range(n)]  # contiguous ranges cut through all of them
    pairs = [(i, rng.choice([j for j in range(n) if home[j] == home[i] and j != i])) for i in range(n) for _ in range(6)]
    pairs += [(rng.randrange(n), rng.randrange(n)) for _ in range(60)] + [(5, 5), (6, None), pairs[0]]
    edges = spark.createDataFrame(pairs, "u long, v long")
    owners = graph_cut.minimal_cut(edges, n, parts, rounds=30)
    sizes = [r["count"] for r in owners.groupBy("part").count().collect()]
    assert len(sizes) == parts and sum(sizes) == n and max(sizes) <= 63
    contiguous = spark.range(n).select("id", F.floor(F.col("id") * parts / n).cast("int").alias("part"))
    before, after = graph_cut.cut_size(edges, contiguous).first(), graph_cut.cut_size(edges, owners).first()
    assert before.pairs == after.pairs == len({frozenset(p) for p in pairs if None not in p and p[0] != p[1]})
    assert after.cut < 0.35 * before.cut
    assert {tuple(r) for r in graph_cut.minimal_cut(edges, n, parts, rounds=30).collect()} == {tuple(r) for r in owners.collect()}


def test_minimal_cut_edges(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert sorted(map(tuple, graph_cut.minimal_cut(empty, 5, 2).collect())) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    assert graph_cut.minimal_cut(empty, 0, 2).count() == 0
    assert {r.part for r in graph_cut.minimal_cut(spark.createDataFrame([(0, 1)], "u long, v long"), 3, 1).collect()} == {0}
    with pytest.raises(ValueError):
        graph_cut.minimal_cut(spark.createDataFrame([(0, 9)], "u long, v long"), 3, 2)
    owners = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "id long, part int")
    own = graph_cut.owned_edges(spark.createDataFrame([(2, 0), (1, 0), (0, 1), (1, 2)], "u long, v long"), owners)
    assert sorted(map(tuple, graph_cut.owned_nodes(own, owners).collect())) == [(0, 0, True, 0), (0, 1, False, 1), (0, 2, False, 2), (1, 0, False, 2), (1, 1, True, 0), (1, 2, True, 1)]


def walks_by_enumeration(edges, starts, target, steps, k):
    """All walks that end where they meet the target; edges: {(u, r, v): w} or a function of the step."""
    found = []
    front = [((), s, 0.0) for s in set(starts)]
    for step in range(1, steps + 1):
        now = edges(step)
        front = [((*walk, e), e[2], total + w) for walk, at, total in front if at != target for e, w in now.items() if e[0] == at]
        found += [(-total / step, step, walk) for walk, at, total in front if at == target]
    return [(m, n, w) for m, n, w in sorted(found)[:k]]


def test_best_walks_are_those_of_an_enumeration(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(2), rng.randrange(9), rng.randrange(1, 40) / 4) for _ in range(45)]
    rows += [(u, r, v, w - 0.25) for u, r, v, w in rows[:10]]  # repeated edges count once, with the larger weight
    table = {}
    for u, r, v, w in rows:
        table[u, r, v] = max(w, table.get((u, r, v), w))
    starts, targets = [(1, 0), (1, 3), (1, 3), (2, 4), (3, 7), (4, None)], [(1, 5), (2, 4), (3, 8), (4, 1)]
    frames = [spark.createDataFrame(rows, EDGE), spark.createDataFrame(starts, "query long, id long"), spark.createDataFrame(targets, "query long, id long")]
    out = graph_paths.best_walks(*frames, steps=4, beam=6, k=6).orderBy("query", "place").collect()
    for query, target in targets:
        want = walks_by_enumeration(lambda _: table, [s for q, s in starts if q == query and s is not None], target, 4, 6)
        got = [(-r.mean, r.length, tuple(tuple(e) for e in r.walk)) for r in out if r.query == query]
        assert [(round(m, 9), n) for m, n, _ in got] == [(round(m, 9), n) for m, n, _ in want]
        assert all(abs(-m * n - sum(table[e] for e in w)) < 1e-9 for m, n, w in got)
        assert query != 2 or not got  # it starts at its target
    by_step = spark.createDataFrame([(q, s, u, r, v, w + s * u) for q in (1, 3) for s in (1, 2, 3) for (u, r, v), w in table.items()], "query long, step int, " + EDGE)
    out = graph_paths.best_walks(by_step, *frames[1:], steps=3, beam=5, k=5).collect()
    for query, target in ((1, 5), (3, 8)):
        want = walks_by_enumeration(lambda s: {e: w + s * e[0] for e, w in table.items()}, [s for q, s in starts if q == query], target, 3, 5)
        assert sorted(round(r.mean, 9) for r in out if r.query == query) == sorted(round(-m, 9) for m, _, _ in want)
    assert graph_paths.best_walks(frames[0].limit(0), *frames[1:], steps=2).count() == 0


@pytest.mark.parametrize("message", ["distmult", "transe"])
def test_gradients_are_finite_differences(spark, message):
    rng = np.random.default_rng(7)
    n, dims, layers = 6, 3, 3
    edges = [(int(u), int(r), int(v), float(w)) for (u, v), r, w in zip(rng.permutation(list(itertools.product(range(n), range(n))))[:14], rng.integers(0, 2, 14), rng.normal(size=14), strict=True)]
    x, rel, a = rng.normal(size=(n, dims)), rng.normal(size=(2, dims)), [0.5, -1.0, 2.0]

    def score(target, weights):
        state = x
        for layer in range(layers):
            new = state + x
            for (u, r, v, _), w in zip(edges, weights[layer], strict=True):
                new[v] += w * (rel[r] * state[u] if message == "distmult" else rel[r] + state[u])
            state = new
        return float(state[target] @ a)

    plain = [[w for *_, w in edges]] * layers
    vectors = lambda m, name: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], f"{name} long, vec array<double>")
    targets = spark.createDataFrame([(10, 2), (11, 4)], "query long, id long")
    out = graph_paths.edge_gradients(spark.createDataFrame(edges, EDGE), vectors(x, "id"), vectors(rel, "r"), targets, a, layers, message)
    got = {(r["query"], r["step"], r["u"], r["r"], r["v"]): r["g"] for r in out.collect()}
    for query, target in ((10, 2), (11, 4)):
        for layer in range(layers):
            for k, (u, r, v, w) in enumerate(edges):
                weights = [list(p) for p in plain]
                weights[layer][k] = w + 1e-5
                up = score(target, weights)
                weights[layer][k] = w - 1e-5
                assert abs((up - score(target, weights)) / 2e-5 - got.get((query, layer + 1, u, r, v), 0.0)) < 1e-5
    walks = graph_paths.explained(spark.createDataFrame(edges, EDGE), vectors(x, "id"), vectors(rel, "r"), spark.createDataFrame([(10, 0), (10, 1), (11, 3)], "query long, id long"), targets, a, layers, message, k=4).collect()
    assert all(abs(r.mean * r.length - sum(got[r.query, step + 1, *e] for step, e in enumerate(map(tuple, r.walk)))) < 1e-9 for r in walks)
