"""Why a node scores as it does: gradients of its score by edge and layer, and the walks with the largest mean gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, written


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and vec: the sum of the vectors of each key. They are taken apart only for the sums, which tasks begin."""
    each = rows.select(*keys, F.posexplode("vec").alias("dim", "y")).groupBy(*keys, "dim").agg(F.sum("y").alias("y"))
    in_order = F.array_sort(F.collect_list(F.struct("dim", "y")))
    return each.groupBy(*keys).agg(F.transform(in_order, lambda s: s["y"]).alias("vec"))


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _sent(relation: Column, state: Column, message: str) -> Column:
    """What an edge of weight one sends: distmult multiplies, transe adds."""
    if message not in ("distmult", "transe"):
        raise ValueError("messages are distmult or transe")
    return _times(relation, state) if message == "distmult" else F.zip_with(relation, state, lambda x, y: x + y)


def layer_states(edges: DataFrame, x: DataFrame, rel: DataFrame, layers: int, message: str = "distmult") -> list[DataFrame]:
    """(id, vec) before the first layer and after each: x' = x + boundary + sum of w * message; the boundary is the first x.

    edges: (u, r, v, w); x: (id, vec), a row for each node; rel: (r, vec). Each state is a written table.
    """
    states = [written(x.select("id", "vec"), "state")]
    for _ in range(layers):
        from_ = states[-1].select(F.col("id").alias("u"), F.col("vec").alias("xu"))
        sent = edges.join(from_, "u").join(rel.select("r", F.col("vec").alias("rv")), "r")
        sent = sent.select(F.col("v").alias("id"), F.transform(_sent(F.col("rv"), F.col("xu"), message), lambda y: y * F.col("w")).alias("vec"))
        states.append(written(_summed(sent.union(states[-1]).union(states[0]), "id"), "state"))
    return states


def edge_gradients(edges: DataFrame, x: DataFrame, rel: DataFrame, targets: DataFrame, readout: list[float], layers: int, message: str = "distmult") -> DataFrame:
    """(query, step, u, r, v, g): how a target's score grows with the weight that an edge has in layer `step`, from 1.

    targets: (query, id), one node a query, whose score is the inner product of readout and its state after the last layer.
    The messages' adjoint is carried back from the target a layer at a time, so only edges from which it can be reached in
    the layers left have rows. Nodes with the same edges twice have a row for each (edges are told apart by their columns).
    """
    states = layer_states(edges, x, rel, layers, message)
    relations = rel.select("r", F.col("vec").alias("rv"))
    back = written(targets.select("query", "id", F.array(*map(F.lit, readout)).cast("array<double>").alias("vec")), "adjoint")
    parts = []
    for step in range(layers, 0, -1):
        at = edges.join(back.select("query", F.col("id").alias("v"), F.col("vec").alias("gv")), "v").join(relations, "r")
        before = states[step - 1].select(F.col("id").alias("u"), F.col("vec").alias("xu"))
        product = _times(F.col("gv"), _sent(F.col("rv"), F.col("xu"), message))
        g = F.aggregate(product, F.lit(0.0), lambda total, y: total + y)
        parts.append(written(at.join(before, "u").select("query", F.lit(step).alias("step"), "u", "r", "v", g.alias("g")), "gradients"))
        if step > 1:
            own = F.transform(_times(F.col("gv"), F.col("rv")) if message == "distmult" else F.col("gv"), lambda y: y * F.col("w"))
            carried = at.select("query", F.col("u").alias("id"), own.alias("vec")).union(back)  # a node's own state goes on too
            old, back = back, written(_summed(carried, "query", "id"), "adjoint")
            discard(old)
    discard(back, *states)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def best_walks(edges: DataFrame, starts: DataFrame, targets: DataFrame, steps: int, beam: int = 10, k: int = 10) -> DataFrame:
    """(query, place, mean, length, walk): the k walks from any of a query's starts to its target with the largest mean weight.

    edges: (u, r, v, w), with `query` and `step` (from 1) if weights differ by them; starts: (query, id); targets: (query,
    id), one a query. A walk has 1 to `steps` edges, may come back to a node, and ends where it meets the target. An edge
    (u, r, v) that repeats counts once, with its largest weight. Layer by layer, each node keeps its `beam` best arrivals
    with the node, relation and rank they came from; with beam >= k the answer is exact. Of equal sums the arrival with
    the smaller (u, r, rank) is first; of equal means the shorter walk, then the smaller. Walks are read backwards from
    the targets. A query without a walk has no row; nulls fit nothing. The last layer holds only arrivals at the targets, the
    one before it only those at targets and at nodes with an edge to them: from others a walk can't end in time.
    """
    own = [c for c in ("query", "step") if c in edges.columns]
    kept = edges.groupBy(*own, "u", "r", "v").agg(F.max("w").alias("w"))
    kept = written(kept, "edges")
    ends = targets.select("query", F.col("id").alias("end"))
    front = starts.select("query", "id").distinct().select("query", "id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    into = lambda rows, at: rows.join(at, [c for c in ("query", "v") if c in rows.columns])
    layers: list[DataFrame] = []
    for step in range(1, steps + 1):
        now = kept.where(F.col("step") == step).drop("step") if "step" in own else kept
        open_ = front.join(ends, "query").where("id <> end").select("query", F.col("id").alias("u"), F.col("rank").alias("from_rank"), "score")
        if step >= steps - 1:  # the targets' edges are few beside all arrivals: they come first
            at = ends.select("query", F.col("end").alias("v")).distinct()
            if step < steps:
                at = at.union(into(kept.drop("w", "r"), at).select("query", F.col("u").alias("v"))).distinct()
            now = into(now, at)
        on = ["query", "u"] if "query" in now.columns else ["u"]
        arrivals = open_.join(now, on).select("query", F.col("v").alias("id"), "u", "r", "from_rank", (F.col("score") + F.col("w")).alias("score"))
        order = Window.partitionBy("query", "id").orderBy(F.desc("score"), "u", "r", "from_rank")
        front = written(arrivals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam), "layer")
        layers.append(front)
    order = Window.partitionBy("query").orderBy(F.desc("mean"), "length", "walk")
    found = None
    edge = F.struct("u", "r", F.col("id").alias("v"))
    for length in range(steps, 0, -1):
        last = layers[length - 1].join(ends, "query").where((F.col("id") == F.col("end")) & (F.col("rank") <= k))
        walks = last.select("query", F.lit(length).alias("length"), (F.col("score") / length).alias("mean"), F.col("u").alias("at"), F.col("from_rank").alias("place"), F.array(edge).alias("walk"))
        for step in range(length - 1, 0, -1):
            to = layers[step - 1].select("query", F.col("id").alias("at"), F.col("rank").alias("place"), F.col("u").alias("next"), F.col("from_rank").alias("next_place"), edge.alias("edge"))
            walks = walks.join(to, ["query", "at", "place"]).select("query", "length", "mean", F.col("next").alias("at"), F.col("next_place").alias("place"), F.concat(F.array("edge"), "walk").alias("walk"))
        walks = walks.select("query", "length", "mean", "walk")
        found = walks if found is None else found.union(walks)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "place", "mean", "length", "walk")


def explained(edges: DataFrame, x: DataFrame, rel: DataFrame, starts: DataFrame, targets: DataFrame, readout: list[float], layers: int, message: str = "distmult", beam: int = 10, k: int = 10) -> DataFrame:
    """best_walks() by the gradients of the targets' scores: the walks that most make each target score as it does."""
    return best_walks(edge_gradients(edges, x, rel, targets, readout, layers, message).withColumnRenamed("g", "w"), starts, targets, layers, beam, k)
