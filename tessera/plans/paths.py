"""Queries over the graph of suppliers and parts: partitions with small cuts, best walks, explanations by gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph_cut, graph_paths
from tessera.plans.graphs import _EDGES, edges
from tessera.plans.retrieval import table

PARTS = 8
READOUT, LAYERS = [0.5, -0.25, 1.0], 2
STEPS, BEAM, BEST = 4, 5, 5


def places(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Lines as edges between the places of suppliers and, after them, those of parts; how many places there are."""
    suppliers, parts = table(spark, sf, "supplier").count(), table(spark, sf, "part").count()
    u, v = F.pmod("l_suppkey", F.lit(suppliers)), F.pmod("l_partkey", F.lit(parts)) + suppliers
    return table(spark, sf, "lineitem").select(u.alias("u"), v.alias("v")), suppliers + parts


def graph_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """One row: neighbours, the cut of contiguous parts, and whether minimal_cut's is below it with all parts within 5 %."""
    e, n = places(spark, sf)
    owners = graph_cut.minimal_cut(e, n, PARTS)
    contiguous = spark.range(n).select("id", F.floor(F.col("id") * PARTS / n).cast("int").alias("part"))
    before, after = graph_cut.cut_size(e, contiguous), graph_cut.cut_size(e, owners).withColumnRenamed("cut", "found").drop("pairs")
    most = owners.groupBy("part").count().agg((F.max("count") <= 1.05 * n / PARTS + 1).alias("balanced"), F.sum("count").alias("nodes"))
    return before.crossJoin(after).crossJoin(most).select("nodes", "pairs", F.col("cut").alias("contiguous_cut"), (F.col("found") < F.col("cut")).alias("better"), "balanced")


def compact_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each part of minimal_cut: whether its nodes and needed sources are numbered without gaps, and no edge lacks one."""
    e, n = places(spark, sf)
    owners = graph_cut.minimal_cut(e, n, PARTS)
    own = graph_cut.owned_edges(e, owners)
    ids = graph_cut.owned_nodes(own, owners)
    ends = own.select("part", F.col("u").alias("id")).union(own.select("part", "v")).distinct().join(ids, ["part", "id"], "left")
    lost = ends.groupBy("part").agg(F.count_if(F.col("local").isNull()).alias("lost"))
    numbered = ids.groupBy("part").agg((F.max("local") + 1 == F.count("*")).alias("gapless"), (F.max(F.when(F.col("owned"), F.col("local"))) < F.coalesce(F.min(F.when(~F.col("owned"), F.col("local"))), F.count("*"))).alias("owned_first"))
    return numbered.join(lost, "part").select("part", "gapless", "owned_first", "lost")


def both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Edges and, with relations from 8 on, their inverses."""
    e = edges(spark, sf).select("u", "v", "r", F.col("w").cast("double").alias("w"))
    return e.union(e.select(F.col("v"), F.col("u"), F.col("r") + 7, "w"))


def asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(query, id) of starts and targets: every 25th supplier is a target, the three with the next keys are its starts."""
    targets = table(spark, sf, "supplier").where("s_suppkey % 25 = 0").select(F.col("s_suppkey").alias("query"), F.col("s_suppkey").alias("id"))
    return targets.select("query", F.explode(F.array(*(F.col("id") + i for i in (1, 2, 3)))).alias("id")), targets


def _named(walks: DataFrame) -> DataFrame:
    """The walk as text: nodes and, between them, relations."""
    text = F.array_join(F.transform("walk", lambda e: F.concat_ws("-", e["u"], e["r"], e["v"])), " ")
    return walks.select("query", F.col("place").cast("long").alias("place"), F.round("mean", 6).alias("mean"), "length", text.alias("walk"))


def best_walks(spark: SparkSession, sf: str) -> DataFrame:
    """The walks of four edges at most from any of three suppliers to another with the largest mean quantity."""
    starts, targets = asked(spark, sf)
    return _named(graph_paths.best_walks(both_ways(spark, sf), starts, targets, STEPS, BEAM, BEST))


def states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges weighted by share of 50, first states by the nodes' keys and relations' vectors by their numbers."""
    e = both_ways(spark, sf).withColumn("w", F.col("w") / 50)
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).union(table(spark, sf, "part").select(F.col("p_partkey") + 1_000_000))
    x = ids.select("id", F.array(*((F.pmod(F.col("id") * p, F.lit(q)) / q) for p, q in ((7, 31), (11, 37), (13, 41)))).alias("vec"))
    rel = spark.range(1, 15).select(F.col("id").alias("r"), F.array(*((F.pmod(F.col("id") * p, F.lit(17)) - 8) / 8 for p in (3, 5, 7))).alias("vec"))
    return e, x, rel


def explained_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Why suppliers score as they do after two layers: the walks with the largest mean gradients."""
    starts, targets = asked(spark, sf)
    return _named(graph_paths.explained(*states(spark, sf), starts, targets, READOUT, LAYERS, beam=BEAM, k=BEST))


QUERIES = {f.__name__: f for f in (graph_cuts, compact_parts, best_walks, explained_walks)}

_BOTH = f"{_EDGES}, b AS (SELECT u, v, r, w::DOUBLE AS w FROM edges UNION ALL SELECT v, u, r + 7, w::DOUBLE FROM edges), tg AS (SELECT s_suppkey AS query, s_suppkey AS id FROM supplier WHERE s_suppkey % 25 = 0), st AS (SELECT query, id + unnest([1, 2, 3]) AS id FROM tg)"
_PLACES = f"k AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS p), e AS (SELECT DISTINCT l_suppkey % s AS u, l_partkey % p + s AS v FROM lineitem, k)"


def _walks(steps: int, edge: str) -> str:
    """Layers of arrivals and the walks that end at the targets; `edge` gives (query, step, u, r, v, w) as e."""
    layers = ["l0 AS (SELECT query, id, 0 AS rank, 0.0::DOUBLE AS score, [] AS walk FROM (SELECT DISTINCT query, id FROM st))"]
    for i in range(1, steps + 1):
        layers.append(f"""l{i} AS (SELECT f.query, e.v AS id, row_number() OVER (PARTITION BY f.query, e.v ORDER BY f.score + e.w DESC, e.u, e.r, f.rank) AS rank, f.score + e.w AS score, list_append(f.walk, {{'u': e.u, 'r': e.r, 'v': e.v}}) AS walk
        FROM l{i - 1} f JOIN tg ON tg.query = f.query AND tg.id <> f.id JOIN {edge.format(i)} e ON e.query = f.query AND e.u = f.id QUALIFY rank <= {BEAM})""")
    ends = " UNION ALL ".join(f"SELECT l.query, {i} AS length, score / {i} AS mean, walk FROM l{i} l JOIN tg ON tg.query = l.query AND tg.id = l.id WHERE rank <= {BEST}" for i in range(1, steps + 1))
    return f"""{", ".join(layers)}, fin AS ({ends}) SELECT query, row_number() OVER (PARTITION BY query ORDER BY mean DESC, length, walk) AS place, round(mean, 6) AS mean, length,
        array_to_string(list_transform(walk, lambda x: concat_ws('-', x.u, x.r, x.v)), ' ') AS walk FROM fin QUALIFY place <= {BEST}"""


def _gradients() -> str:
    dims = "(SELECT unnest([0, 1, 2]) AS dim)"
    pick = lambda *values: f"([{', '.join(values)}])[dim + 1]"
    x0 = pick(*(f"(id * {p} % {q}) / {q}" for p, q in ((7, 31), (11, 37), (13, 41))))
    rl = pick(*(f"(r * {p} % 17 - 8) / 8" for p in (3, 5, 7)))
    return f"""{_BOTH}, c AS (SELECT u, v, r, w / 50 AS w FROM b), x0 AS (SELECT id, dim, {x0} AS x FROM nodes, {dims}), rl AS (SELECT r, dim, {rl} AS rv FROM (SELECT unnest(range(1, 15)) AS r), {dims}),
    x1 AS (SELECT id, dim, sum(x) AS x FROM (SELECT v AS id, dim, rv * x * w AS x FROM c JOIN x0 ON x0.id = c.u JOIN rl USING (r, dim) UNION ALL SELECT * FROM x0 UNION ALL SELECT * FROM x0) GROUP BY ALL),
    g2 AS (SELECT query, id, dim, {pick(*map(str, READOUT))}::DOUBLE AS g FROM tg, {dims}),
    g1 AS (SELECT query, id, dim, sum(g) AS g FROM (SELECT query, u AS id, dim, g * rv * w AS g FROM c JOIN g2 ON g2.id = c.v JOIN rl USING (r, dim) UNION ALL SELECT * FROM g2) GROUP BY ALL),
    e2 AS (SELECT query, u, r, v, sum(g * rv * x) AS w FROM (SELECT DISTINCT u, r, v FROM c) c JOIN g2 ON g2.id = c.v JOIN rl USING (r, dim) JOIN x1 ON x1.id = c.u AND x1.dim = rl.dim GROUP BY ALL),
    e1 AS (SELECT query, u, r, v, sum(g * rv * x) AS w FROM (SELECT DISTINCT u, r, v FROM c) c JOIN g1 ON g1.id = c.v JOIN rl USING (r, dim) JOIN x0 ON x0.id = c.u AND x0.dim = rl.dim GROUP BY ALL)"""


ORACLES = {
    "graph_cuts": f"WITH {_PLACES} SELECT s + p AS nodes, count(*) AS pairs, count_if(floor(u * {PARTS} / (s + p)) <> floor(v * {PARTS} / (s + p)))::BIGINT AS contiguous_cut, true AS better, true AS balanced FROM e, k GROUP BY s, p",
    "compact_parts": f"SELECT unnest(range({PARTS}))::INT AS part, true AS gapless, true AS owned_first, 0::BIGINT AS lost",
    "best_walks": f"WITH {_BOTH}, e AS (SELECT query, u, r, v, w FROM (SELECT u, r, v, max(w) AS w FROM b GROUP BY ALL), (SELECT query FROM tg)), {_walks(STEPS, 'e')}",
    "explained_walks": f"WITH {_gradients()}, {_walks(LAYERS, 'e{}')}",
}
