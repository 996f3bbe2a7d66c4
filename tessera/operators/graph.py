"""Knowledge graphs: assembly, integer encoding, mentions, propagation, message passing, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import edge_id, entity_id, entity_key
from tessera.operators.vector import query_blocks
from tessera.session import written


def low_value_triple(s: Column, r: Column, o: Column) -> Column:
    """Subject equals object, a yes/no object, or a status relation (fixed values)."""
    same = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " ")))
    return (same(s) == same(o)) | same(o).isin("yes", "no", "true", "false") | r.isin("filer_status", "shell_company_status")


def assemble(mentions: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from mentions (chunk_id, entity, ord) and triples (chunk_id, s, r, o, ord).

    A node's name and an edge's provenance come from the last writer by ord. Low-value triples go.
    """
    kept = triples.where(~low_value_triple(F.col("s"), F.col("r"), F.col("o")))
    ends = kept.select("chunk_id", F.col("s").alias("entity"), "ord").union(kept.select("chunk_id", "o", "ord"))
    named = mentions.select("chunk_id", "entity", "ord").union(ends).where(entity_key(F.col("entity")) != "")
    entities = named.groupBy(entity_id(F.col("entity")).alias("uid")).agg(F.max_by("entity", F.struct("ord", "entity")).alias("name")).withColumn("type", F.lit("entity"))
    chunk_uid = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    chunks = named.select(chunk_uid.alias("uid"), F.col("chunk_id").cast("string").alias("name"), F.lit("chunk").alias("type")).distinct()
    mention = named.select(chunk_uid.alias("source"), F.lit("mentions").alias("relation"), entity_id(F.col("entity")).alias("target"), "chunk_id", "ord")
    stated = kept.select(entity_id(F.col("s")).alias("source"), F.col("r").alias("relation"), entity_id(F.col("o")).alias("target"), "chunk_id", "ord")
    every = mention.union(stated).withColumn("edge_id", edge_id(F.col("source"), F.col("relation"), F.col("target")))
    edges = every.groupBy("edge_id").agg(F.first("source").alias("source"), F.first("relation").alias("relation"), F.first("target").alias("target"), F.max_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"))
    return entities.unionByName(chunks), edges


def encode(nodes: DataFrame, relations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): edges (source, relation, target) as integers (u, v, r) by nodes (id, uid) and relations (id, name).

    Edges with an unknown end or relation are in bad, as they were. The dimension tables join without hints: Spark
    broadcasts those that are small.
    """
    u = nodes.select(F.col("uid").alias("source"), F.col("id").alias("u"))
    v = nodes.select(F.col("uid").alias("target"), F.col("id").alias("v"))
    r = relations.select(F.col("name").alias("relation"), F.col("id").alias("r"))
    joined = edges.join(u, "source", "left").join(v, "target", "left").join(r, "relation", "left")
    known = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("r").isNotNull()
    return joined.where(known).select("u", "v", "r"), joined.where(~known).select("source", "relation", "target")


def with_inverse(edges: DataFrame, relations: int | Column) -> DataFrame:
    """(u, v, r, is_inverse): the edges, and (v, u, r + relations) for each."""
    n = F.lit(relations) if isinstance(relations, int) else relations
    return edges.select("u", "v", "r", F.lit(False).alias("is_inverse")).union(edges.select("v", "u", F.col("r") + n, F.lit(True)))


def mention_map(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, chunks) and (chunk_id, entities), sorted and distinct.

    A row holds all chunks of its entity: an array of up to 2**31 ids. Operators here work on the pairs instead.
    """
    pairs = mentions.select("entity", "chunk_id").distinct()
    return pairs.groupBy("entity").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks")), pairs.groupBy("chunk_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))


def spread(weights: DataFrame, mentions: DataFrame, of: str, to: str) -> DataFrame:
    """Sparse product: (sample, to, w) = the sum of weights (sample, of, w) over mentions (entity, chunk_id, w)."""
    m = mentions.select(of, to, F.col("w").alias("__m"))
    return weights.join(m, of).groupBy("sample", to).agg(F.sum(F.col("w") * F.col("__m")).alias("w"))


def propagate_lite(start: DataFrame, mentions: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(sample, chunk_id, score): c = sM, f = cMᵀ / max(sum, 1), e = s + alpha f, out = eM."""
    c = spread(start, mentions, "entity", "chunk_id")
    f = spread(c, mentions, "chunk_id", "entity")
    total = f.groupBy("sample").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("total"))
    f = f.join(total, "sample").select("sample", "entity", (F.col("w") / F.col("total") * alpha).alias("w"))
    e = start.select("sample", "entity", "w").union(f).groupBy("sample", "entity").agg(F.sum("w").alias("w"))
    return spread(e, mentions, "entity", "chunk_id").withColumnRenamed("w", "score")


def inverse_frequency(mentions: DataFrame) -> DataFrame:
    """(entity, idf): 1 over the number of mention edges."""
    return mentions.groupBy("entity").agg((1 / F.sum("w")).alias("idf"))


def rank_chunks(start: DataFrame, mentions: DataFrame, idf: bool = False, top: int | None = None) -> DataFrame:
    """(sample, chunk_id, score): entities' weights summed over their chunks, by 1/degree, of the `top` best as 1, or both."""
    s = start
    if top is not None:
        w = Window.partitionBy("sample").orderBy(F.desc("w"), "entity")
        s = s.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).select("sample", "entity", F.lit(1.0).alias("w"))
    if idf:
        s = s.join(inverse_frequency(mentions), "entity").select("sample", "entity", (F.col("w") * F.col("idf")).alias("w"))
    return spread(s, mentions, "entity", "chunk_id").withColumnRenamed("w", "score")


def best_entity(weights: DataFrame, mentions: DataFrame) -> DataFrame:
    """(sample, chunk_id, score, entity): the best entity's weight, and which it is (ties: the smaller id)."""
    joined = weights.join(mentions.select("entity", "chunk_id").distinct(), "entity")
    best = joined.groupBy("sample", "chunk_id").agg(F.min(F.struct((-F.col("w")).alias("m"), F.col("entity"))).alias("b"))
    return best.select("sample", "chunk_id", (-F.col("b.m")).alias("score"), F.col("b.entity").alias("entity"))


def strict_negatives(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, r, v): for each (u, r) that has an edge, the nodes that are no tail of it: pairs of a stated set, anti-joined."""
    heads = edges.select("u", "r").distinct()
    return heads.crossJoin(nodes.select(F.col("id").alias("v"))).join(edges.select("u", "r", "v").distinct(), ["u", "r", "v"], "left_anti")


def relation_graph(edges: DataFrame) -> DataFrame:
    """(a, b, kind): relations that share a node as heads (hh), tails (tt), head and tail (ht), tail and head (th).

    Nodes are joined by their distinct relations, so a hub costs the square of its relations, not of its edges.
    """
    heads, tails = edges.select(F.col("u").alias("node"), "r").distinct(), edges.select(F.col("v").alias("node"), "r").distinct()
    parts = []
    for kind, x, y in (("hh", heads, heads), ("tt", tails, tails), ("ht", heads, tails), ("th", tails, heads)):
        parts.append(x.select("node", F.col("r").alias("a")).join(y.select("node", F.col("r").alias("b")), "node").select("a", "b", F.lit(kind).alias("kind")).distinct())
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def relation_profile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("r").agg(F.count("*").alias("edges"), F.count_distinct("u").alias("heads"), F.count_distinct("v").alias("tails"))


def degree_profile(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, zeros, max, mean and median degree (both directions)."""
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v"))
    degree = nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("d")), "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.count("*").alias("nodes"), F.count_if(F.col("d") == 0).alias("zeros"), F.max("d").alias("max_degree"), F.avg("d").alias("mean_degree"), F.percentile("d", 0.5).alias("median_degree"))


def relational_spmm(edges: DataFrame, x: DataFrame, rel: DataFrame, add: str = "add", mul: str = "mul") -> DataFrame:
    """(v, dim, y): y[v] = add over edges (u, v, r, w) of w * mul(rel[r], x[u]), a dimension a row; add: add, min or max.

    Edges are dealt by v while they are single numbers; vectors come to them, x in blocks that are broadcast, so what is
    added up has no shuffle of its own. With more than one block each gives a row for each v and dimension at most.
    """
    xs, rs = x.select(F.col("id").alias("u"), F.col("vec").alias("xv")), written(rel.select(F.col("id").alias("r"), F.col("vec").alias("rv")), "relations")  # its size is known: few are broadcast
    both = F.zip_with("rv", "xv", lambda a, b: a * b if mul == "mul" else a + b)
    fold = {"add": F.sum, "min": F.min, "max": F.max}[add]
    dealt = edges.select("u", "v", "r", "w").repartition("v")
    blocks = query_blocks(xs, ["u"], "xv")
    parts = []
    for block in blocks:
        met = dealt.join(F.broadcast(block), "u").join(rs, "r").select("v", "w", F.posexplode(both).alias("dim", "m")).where("m IS NOT NULL")
        parts.append(met.groupBy("v", "dim").agg(fold(F.col("w") * F.col("m")).alias("y")))
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).groupBy("v", "dim").agg(fold("y").alias("y"))


def pna(messages: DataFrame, boundary: DataFrame) -> DataFrame:
    """(v, agg, scaler, y) of messages (v, m) and one boundary row per node: mean, max, min, std times three scalers.

    Scalers: 1, ln(deg) over its mean over nodes, and the reciprocal of that (0.01 at least); deg counts the boundary.
    """
    every = messages.select("v", "m").union(boundary.select("v", "m"))
    agg = every.groupBy("v").agg(F.avg("m").alias("mean"), F.max("m").alias("max"), F.min("m").alias("min"), F.avg(F.col("m") * F.col("m")).alias("sq"), F.count("*").alias("deg"))
    mean_log = agg.agg(F.avg(F.log("deg")).alias("ml"))
    scale = F.log("deg") / F.nullif(F.col("ml"), F.lit(0.0))
    agg = agg.crossJoin(F.broadcast(mean_log)).withColumn("std", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(1e-6)))).withColumn("s", F.coalesce(scale, F.lit(1.0)))
    long_ = agg.select("v", "s", F.explode(F.create_map(*(x for n in ("mean", "max", "min", "std") for x in (F.lit(n), F.col(n))))).alias("agg", "value"))
    scalers = F.create_map(F.lit("one"), F.lit(1.0), F.lit("log"), F.col("s"), F.lit("inverse"), 1 / F.greatest(F.col("s"), F.lit(1e-2)))
    return long_.select("v", "agg", "value", F.explode(scalers).alias("scaler", "f")).select("v", "agg", "scaler", (F.col("value") * F.col("f")).alias("y"))


def message_passing(edges: DataFrame, x: DataFrame, rel: DataFrame, layers: int, message: str = "distmult", keep_every: int = 2) -> DataFrame:
    """(id, dim, x) after `layers` rounds of x' = x + boundary + sum of messages; distmult: r * x, transe: r + x.

    x: (id, vec). State is kept a dimension a row and written every keep_every rounds, so lineage stays short.
    """
    state = boundary = x.select("id", F.posexplode("vec").alias("dim", "x"))
    rs = rel.select(F.col("id").alias("r"), F.posexplode("vec").alias("dim", "rv"))
    for k in range(layers):
        m = F.col("rv") * F.col("x") if message == "distmult" else F.col("rv") + F.col("x")
        sent = edges.join(state.withColumnRenamed("id", "u"), "u").join(rs, ["r", "dim"]).select(F.col("v").alias("id"), "dim", m.alias("x"))
        state = sent.union(state).union(boundary).groupBy("id", "dim").agg(F.sum("x").alias("x"))
        if (k + 1) % keep_every == 0:
            state = written(state, "messages")
    return state


def node_update(states: DataFrame, messages: DataFrame, weights: list[list[float]], bias: list[float], epsilon: float = 1e-5) -> DataFrame:
    """(id, vec): relu of the normalised linear map of each node's state and message, put together; no message counts as zeros.

    states and messages: (id, vec); weights: a row for each output. The map is part of the plan, so it runs where the rows lie.
    """
    both = states.join(messages.select("id", F.col("vec").alias("__m")), "id", "left")
    joined = F.concat("vec", F.coalesce("__m", F.transform("vec", lambda x: F.lit(0.0))))
    rows = F.array(*(F.array(*map(F.lit, row), F.lit(b)) for row, b in zip(weights, bias, strict=True)))
    dots = F.transform(rows, lambda w: F.aggregate(F.zip_with(w, F.concat(joined, F.array(F.lit(1.0))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    n = len(weights)
    out = both.select("id", dots.alias("y")).withColumn("mean", F.aggregate("y", F.lit(0.0), lambda s, x: s + x) / n)
    out = out.withColumn("std", F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n + epsilon))
    return out.select("id", F.transform("y", lambda x: F.greatest((x - F.col("mean")) / F.col("std"), F.lit(0.0))).alias("vec"))


def distmult_queries(heads: DataFrame, rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, r, q): h * r of each stated (u, r), whose inner products with tails are the scores."""
    hr = heads.join(nodes.select(F.col("id").alias("u"), F.col("vec").alias("h")), "u").join(rel.select(F.col("id").alias("r"), F.col("vec").alias("w")), "r")
    return hr.select("u", "r", F.zip_with("h", "w", lambda a, b: a * b).alias("q"))


def distmult_scores(heads: DataFrame, rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, r, v, score): sum of h * r * t of each stated (u, r) against all nodes (id, vec), in blocks of (u, r)."""
    hr = distmult_queries(heads, rel, nodes)
    score = F.aggregate(F.zip_with("q", "t", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    tails = nodes.select(F.col("id").alias("v"), F.col("vec").alias("t"))
    return reduce(DataFrame.union, [tails.crossJoin(F.broadcast(block)).select("u", "r", "v", score.alias("score")) for block in query_blocks(hr, ["u", "r"], "q")])


def hops(edges: DataFrame, starts: DataFrame, most: int, beam: int | None = None) -> DataFrame:
    """(start, id, hops, score, path): each node's best paths from each start, `beam` kept per node and step.

    starts: (start, id); edges: (u, v, w), scores add up. A frontier join per step; without beam the shortest only.
    """
    front = starts.select("start", "id", F.lit(0).alias("hops"), F.lit(0.0).alias("score"), F.array("id").alias("path"))
    seen = written(front, "paths")
    front = seen
    for step in range(1, most + 1):
        step_rows = front.join(edges.select(F.col("u").alias("id"), "v", "w"), "id").where(~F.array_contains("path", F.col("v")))
        step_rows = step_rows.select("start", F.col("v").alias("id"), F.lit(step).alias("hops"), (F.col("score") + F.col("w")).alias("score"), F.concat("path", F.array("v")).alias("path"))
        w = Window.partitionBy("start", "id").orderBy(F.desc("score"), "path")
        step_rows = step_rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= (beam or 1)).drop("__r")
        if beam is None:
            step_rows = step_rows.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = written(step_rows, "paths")
        seen = seen.unionByName(front)
    return seen


def partitioned(edges: DataFrame, nodes: int, parts: int) -> DataFrame:
    """edges (u, v, ...) with part: the owner of the target v, of ids 0 .. nodes - 1 in `parts` contiguous ranges."""
    return edges.withColumn("part", F.floor(F.col("v") * parts / nodes).cast("int"))


def part_nodes(edges: DataFrame, ids: DataFrame, nodes: int, parts: int) -> DataFrame:
    """(part, id, owned, local): each part's nodes and then the sources that its edges need from others, numbered from 0.

    edges: as partitioned() gives them; ids: (id). A part is what one worker holds, so its nodes are numbered in one task.
    """
    own = ids.select(F.floor(F.col("id") * parts / nodes).cast("int").alias("part"), "id", F.lit(True).alias("owned"))
    boundary = edges.select("part", F.col("u").alias("id")).distinct().where(F.floor(F.col("id") * parts / nodes) != F.col("part")).withColumn("owned", F.lit(False))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("owned"), "id")) - 1
    return own.unionByName(boundary).withColumn("local", place)


class Query:
    """Complex logical queries as DataFrames of one column id: projection, intersection, union, negation."""

    def __init__(self, edges: DataFrame, nodes: DataFrame) -> None:
        self.edges, self.nodes = edges, nodes.select("id").distinct()

    def entity(self, *ids: int) -> DataFrame:
        return self.nodes.where(F.col("id").isin(*ids))

    def project(self, of: DataFrame, r: int) -> DataFrame:
        return self.edges.where(F.col("r") == r).join(of.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()

    def both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.intersect(b)

    def either(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.union(b).distinct()

    def without(self, a: DataFrame) -> DataFrame:
        return self.nodes.join(a, "id", "left_anti")

    def evaluate(self, query: tuple) -> DataFrame:
        """Of nested tuples: ("e", id), ("p", query, relation), ("i", a, b), ("u", a, b), ("n", a)."""
        op, *args = query
        if op == "e":
            return self.entity(args[0])
        if op == "p":
            return self.project(self.evaluate(args[0]), args[1])
        if op == "n":
            return self.without(self.evaluate(args[0]))
        return (self.both if op == "i" else self.either)(self.evaluate(args[0]), self.evaluate(args[1]))
