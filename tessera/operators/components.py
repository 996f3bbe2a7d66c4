"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable from each end of an edge.

    Each round, every node takes the neighbour (or itself) with the smallest hash for that round as its label, edges
    are relabelled and loops dropped; on average a fixed share of the nodes goes each round, so rounds grow with the
    logarithm of the graph. Only counts come to the driver. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    live = written(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels: DataFrame | None = None
    for r in range(max_rounds):
        if live.isEmpty():
            break
        nearest = live.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(r)).alias("h"), F.col("v").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(r)).alias("h"), F.col("u").alias("id"))
        step = written(nearest.select(F.col("u").alias("id"), F.least("m", own)["id"].alias("label")), "labels")
        if labels is None:
            labels, old = step, None
        else:
            to = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
            old, labels = labels, written(labels.join(to, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
        left = step.select(F.col("id").alias("u"), F.col("label").alias("lu"))
        right = step.select(F.col("id").alias("v"), F.col("label").alias("lv"))
        before, live = live, written(live.join(left, "u").join(right, "v").where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(), "edges")
        discard(before, *([old, step] if old is not None else []))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if labels is None:
        return live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
