"""Partitions of a graph's nodes with few edges between parts: label propagation under a capacity, in rounds of swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, written

#: By how much a part may be larger than the mean.
SLACK = 0.05
ROUNDS = 12


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) once for each two different nodes with an edge (u, v) between them."""
    pairs = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def minimal_cut(edges: DataFrame, nodes: int, parts: int, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """(id, part) of the nodes 0 .. nodes - 1: as few pairs of neighbours as rounds of moves find lie in different parts.

    It begins with contiguous ranges. In each round, a node would like to move to the other part that most of its neighbours
    are in (ties: the smaller number), half of the nodes at a time, so that two neighbours seldom pass each other. Those
    who would go from one part to another and those who would come back are ranked by what they gain, and change places as
    long as a pair gains together; more go if they gain and the other part stays within (1 + slack) times the mean, rounded
    up. The round with the least cut counts, so the cut is never above the contiguous one's. It ends after `rounds`, or when
    two rounds in a row gain less than a thousandth.

    edges: (u, v); direction, repeats and loops don't matter, ids beyond the range fail. A part's candidates for another
    part are ranked in one task: fewer than the nodes of a part, which one worker is to hold anyway.
    """
    spark = edges.sparkSession
    if edges.where(~F.col("u").between(0, nodes - 1) | ~F.col("v").between(0, nodes - 1)).limit(1).count():
        raise ValueError(f"edges have ids beyond 0 .. {nodes - 1}")
    near = written(neighbours(edges), "neighbours")
    most = max(-(-nodes // parts), int(nodes * (1 + slack) / parts))
    state = written(spark.range(nodes).select("id", F.floor(F.col("id") * parts / nodes).cast("int").alias("part")), "parts")
    best, least, idle = state, None, 0
    for r in range(rounds + 1):
        around = near.join(state.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id"), F.col("part").alias("other")).agg(F.count("*").alias("n"))
        inner = F.coalesce(F.max(F.when(F.col("other") == F.col("part"), F.col("n"))), F.lit(0))
        outer = F.max(F.when(F.col("other") != F.col("part"), F.struct("n", (-F.col("other")).alias("to"))))
        wish = around.join(state, "id").groupBy("id", "part").agg(inner.alias("inner"), F.sum("n").alias("degree"), outer.alias("outer"))
        wish = written(wish.select("id", "part", "inner", "degree", (-F.col("outer.to")).alias("to"), (F.coalesce("outer.n", F.lit(0)) - F.col("inner")).alias("gain")), "wishes")
        cut = wish.agg((F.sum(F.col("degree") - F.col("inner")) / 2).cast("long")).first()[0] or 0
        if least is None or cut < least:
            idle = 0 if least is None or cut < 0.999 * least else idle + 1
            if best is not state:
                discard(best)
            best, least = state, cut
        else:
            idle += 1
        if r == rounds or idle == 2:
            discard(wish)
            break
        able = wish.where(F.col("to").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0))
        order = Window.partitionBy("part", "to").orderBy(F.desc("gain"), F.xxhash64("id"), "id")
        ranked = written(able.select("id", F.col("part").alias("from"), "to", "gain", F.row_number().over(order).alias("place")), "ranked")
        back = ranked.select(F.col("to").alias("from"), F.col("from").alias("to"), "place", F.col("gain").alias("other"))
        swaps = ranked.join(back, ["from", "to", "place"]).where("gain + other > 0").groupBy("from", "to").agg(F.count("*").alias("swaps"))
        room = state.groupBy(F.col("part").alias("to")).agg(F.floor((F.lit(most) - F.count("*")) / (parts - 1 or 1)).alias("room"))
        quota = ranked.select("from", "to").distinct().join(swaps, ["from", "to"], "left").join(room, "to").select("from", "to", F.coalesce("swaps", F.lit(0)).alias("swaps"), F.greatest("room", F.lit(0)).alias("room"))
        moves = ranked.join(quota, ["from", "to"]).where("place <= swaps OR (place <= swaps + room AND gain > 0)").select("id", "to")
        old, state = state, written(state.join(moves, "id", "left").select("id", F.coalesce("to", "part").alias("part")), "parts")
        discard(wish, ranked, *([old] if old is not best else []))
    discard(near, *([state] if state is not best else []))
    return best


def cut_size(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: pairs (neighbours, each once), cut (those in different parts). owners: (id, part)."""
    a, b = (owners.select(F.col("id").alias(c), F.col("part").alias(f"p{c}")) for c in "ab")
    met = neighbours(edges).where("a < b").join(a, "a").join(b, "b")
    return met.agg(F.count("*").alias("pairs"), F.count_if(F.col("pa") != F.col("pb")).alias("cut"))


def owned_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """edges (u, v, ...) with part: the owner of the target v."""
    return edges.join(owners.select(F.col("id").alias("v"), "part"), "v").select(*edges.columns, "part")


def owned_nodes(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(part, id, owned, local): each part's nodes and then the sources that its edges need from others, numbered from 0.

    edges: as owned_edges() gives them. A part is what one worker holds, so its nodes are numbered in one task.
    """
    own = owners.select("part", "id", F.lit(True).alias("owned"))
    needed = edges.select("part", F.col("u").alias("id")).distinct().join(owners.withColumnRenamed("part", "home"), "id")
    boundary = needed.where("home <> part").select("part", "id", F.lit(False).alias("owned"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("owned"), "id")) - 1
    return own.unionByName(boundary).withColumn("local", place)
