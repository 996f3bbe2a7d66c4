"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one queue.

Trees see vectors lifted to one length: with M the largest length, a vector x gets the component sqrt(M * M - |x| * |x|),
a query q becomes q * M / |q| with 0 there. The nearest lifted vectors are those with the largest inner products, so
lengths take part in the splits. Each tree splits at the median along the difference of two random vectors of its node.

A query walks all trees at once through one priority queue over all trees' open branches, likeliest first: of a branch's
planes, each adds the negative logarithm of the chance that a neighbour lies on that side, a logistic function of the
query's distance to the plane whose slope is fitted on the sample. It goes on until the visited leaves hold as many
vectors as the sample's own queries need for a recall of RECALL. For tables larger than the sample that number grows with the
power of n that the sample shows in a forest of a quarter of it.

Candidates meet their queries leaf by leaf, within blocks of leaves. Those below the (k + 1)-th best of the sampled
vectors that the query meets can't be in its answer and end there; so do all but the best of a block. The rest are
reranked by their inner products in double precision, summed without rounding errors, so that ties are ties.

Equal vectors are one vector for the index, with its smallest ids (k + 1 suffice for any query's answer), so a vector
with many copies costs no more than others, and its queries are searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tables import table
from tessera.operators.joins import left_join_unique
from tessera.session import written

TREES = 16
#: Vectors that the trees are fitted on, at most: those with the smallest hashes of their ids, as many as have this many
#: bytes as floats. All vectors are indexed.
SAMPLE, SAMPLE_BYTES = 60_000, 16_000_000
#: Sampled vectors in a leaf, at most.
LEAF = 128
#: The recall that the sample's queries are to have, how many of them are asked, and how often a neighbour is counted in
#: each tree: vectors in the leaves that any query visits, at least.
RECALL, ASKED, LEAST = 0.95, 128, 8000
#: Bounds of the power of n with which visited vectors grow beyond the sample.
GROWTH = (0.5, 1.0)
#: Vectors that one block of leaves is to hold; queries that are searched at a time in one.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 20_000
#: Pairs that a block scores at a time, and gathers before it puts aside all that can't be in an answer.
PAIRS = 2_000_000


@dataclass
class Tree:
    """Node i splits at normals[i] . x > offsets[i] into kids[i]; a kid below 0 is the leaf -kid - 1."""

    normals: np.ndarray
    offsets: np.ndarray
    kids: list[tuple[int, int]]
    root: int
    leaves: int

    @classmethod
    def grow(cls, vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        normals, offsets, kids, leaves = [], [], [], 0
        root = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(vectors)), -1, 0)]  # rows, parent, side
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) <= leaf:
                me = -leaves - 1
                leaves += 1
            else:
                i, j = rng.choice(rows, 2, replace=False)
                normal = vectors[i] - vectors[j]
                normal = (normal / (np.linalg.norm(normal) or 1.0)).astype(np.float32)
                along = vectors[rows] @ normal.astype(float)
                # cut midway between two different values, those nearest to the median: rounding moves no vector across
                ranked = np.sort(along)
                cuts = np.flatnonzero(np.diff(ranked) > 1e-12 * np.abs(ranked).max())
                if len(cuts):
                    at = cuts[np.abs(cuts + 1 - len(rows) // 2).argmin()]
                    middle = (ranked[at] + ranked[at + 1]) / 2
                    right = along > middle
                else:  # equal along this direction: cut by rank, all go left when assigned
                    middle, right = ranked[-1] + 1e-9 * abs(ranked[-1]) + 1e-300, np.arange(len(rows)) >= len(rows) // 2
                me = len(normals)
                normals.append(normal)
                offsets.append(middle)
                kids.append([0, 0])
                todo += [(rows[right], me, 1), (rows[~right], me, 0)]
            if parent < 0:
                root = me
            else:
                kids[parent][side] = me
        width = vectors.shape[1] if vectors.ndim == 2 else 0
        return cls(np.array(normals, np.float32).reshape(-1, width), np.array(offsets), [tuple(k) for k in kids], root, leaves)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                right = vectors[rows] @ self.normals[node].astype(float) > self.offsets[node]
                todo += [(self.kids[node][0], rows[~right]), (self.kids[node][1], rows[right])]
        return out


def grow_forest(vectors: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [Tree.grow(np.asarray(vectors, float), leaf, rng) for _ in range(trees)]


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors at one length, `longest`, by one more component."""
    return np.c_[vectors, np.sqrt(np.maximum(0.0, longest**2 - (vectors * vectors).sum(1)))]


def towards(queries: np.ndarray, longest: float) -> np.ndarray:
    """The points of that length from which the lifted vectors with the largest inner products are the nearest."""
    unit = queries / np.abs(queries).max(1, keepdims=True)  # first by the largest component: squares may leave the range of doubles
    return np.c_[unit * (longest / np.sqrt((unit * unit).sum(1)))[:, None], np.zeros(len(queries))]


def own_neighbours(vectors: np.ndarray, k: int, asked: int) -> np.ndarray:
    """The k nearest (all, if fewer) of each of the first `asked` vectors among the others."""
    n = min(k, len(vectors) - 1)
    near = []
    for a in range(0, min(asked, len(vectors)), 16):
        score = vectors[a : min(a + 16, asked)] @ vectors.T
        score[np.arange(len(score)), a + np.arange(len(score))] = -np.inf
        near.append(np.argpartition(-score, n - 1, axis=1)[:, :n])
    return np.concatenate(near)


def slope(forest: list[Tree], points: np.ndarray, queries: np.ndarray, near: np.ndarray) -> float:
    """By how much the log odds that a neighbour lies on its query's side of a plane grow with the query's distance to it.

    Fitted on the planes of the trees' first nodes, and on the queries and their nearest points.
    """
    normals = [t.normals[:31] for t in forest if len(t.offsets)]
    if not normals:
        return 1.0
    planes, offsets = np.concatenate(normals), np.concatenate([t.offsets[:31] for t in forest if len(t.offsets)])
    side = queries @ planes.T - offsets
    margin = np.abs(side)
    same = np.stack([((points[own] @ planes.T > offsets) == (mine > 0)).mean(0) for own, mine in zip(near, side, strict=True)])
    scale = float(margin.mean()) or 1.0
    grid = np.geomspace(0.02, 200, 70) / scale
    loss = [(same * np.logaddexp(0, -g * margin) + (1 - same) * np.logaddexp(0, g * margin)).mean() for g in grid]
    return float(grid[int(np.argmin(loss))])


def needed(forest: list[Tree], points: np.ndarray, queries: np.ndarray, near: np.ndarray, rise: float, recall: float = RECALL) -> float:
    """Vectors in visited leaves after which that share of all queries' neighbours has been met."""
    leaves = [t.assign(points) for t in forest]
    sizes = [np.bincount(at, minlength=t.leaves) for at, t in zip(leaves, forest, strict=True)]
    met = np.full(near.shape, np.inf)
    for q, found in enumerate(search_forest(forest, queries, np.inf, sizes, rise)):
        seen = [np.full(t.leaves, np.inf) for t in forest]
        for (tree, leaf), total in zip(found, np.cumsum([sizes[tree][leaf] for tree, leaf in found]).tolist(), strict=True):
            seen[tree][leaf] = total
        met[q] = np.min([s[at[near[q]]] for s, at in zip(seen, leaves, strict=True)], 0)
    return float(np.sort(met, axis=None)[int(np.ceil(recall * met.size)) - 1])


@dataclass
class Index:
    """The forest, the length it lifts to, its slope, and the vectors that a query visits."""

    forest: list[Tree]
    longest: float
    rise: float
    visits: float

    @classmethod
    def fit(cls, known: np.ndarray, n: int, k: int, longest: float, trees: int = TREES) -> Index:
        """From a sample of a table of n vectors, the longest of which has that length."""

        if len(known) < 2:
            return cls(grow_forest(lifted(known, longest), trees), longest, 1.0, float(len(known)))
        points, queries = lifted(known, longest), towards(known[:ASKED], longest)

        def grown(some: int) -> tuple[list[Tree], float, float]:
            near = own_neighbours(known[:some], k, ASKED)
            forest = grow_forest(points[:some], trees)
            rise = slope(forest, points[:some], queries[:some], near)
            return forest, rise, needed(forest, points[:some], queries[:some], near, rise)

        forest, rise, visits = grown(len(known))
        if n > len(known) >= 4 * ASKED:  # how much more do the sample's queries need in the forest of its first quarter?
            few, slow, less = grown(len(known) // 4)
            power = np.log(needed(few, points, queries, own_neighbours(known, k, ASKED), slow) / less) / np.log(4)
            visits *= (n / len(known)) ** float(np.clip(power, *GROWTH))
        return cls(forest, longest, rise, visits)


def search_forest(forest: list[Tree], queries: np.ndarray, vectors: float, sizes: list[np.ndarray], rise: float) -> list[list[tuple[int, int]]]:
    """The (tree, leaf) pairs that each query visits, likeliest first, until they hold so many vectors; one at least.

    sizes: the vectors of each tree's leaves; rise: see slope().
    """
    sides = [queries @ t.normals.T - t.offsets if len(t.offsets) else np.zeros((len(queries), 0)) for t in forest]
    near = [np.logaddexp(0, -rise * np.abs(m)).tolist() for m in sides]
    far = [np.logaddexp(0, rise * np.abs(m)).tolist() for m in sides]
    right = [(m > 0).tolist() for m in sides]
    held = [x.tolist() for x in sizes]
    out = []
    for q in range(len(queries)):
        queue = [(0.0, i, t.root) for i, t in enumerate(forest)]
        found: list[tuple[int, int]] = []
        seen = 0.0
        while queue and (seen < vectors or not found):
            cost, i, node = heapq.heappop(queue)
            kids, stay, cross, up = forest[i].kids, near[i][q], far[i][q], right[i][q]
            while node >= 0 and not (queue and queue[0][0] < cost):
                heapq.heappush(queue, (cost + cross[node], i, kids[node][not up[node]]))
                cost, node = cost + stay[node], kids[node][up[node]]
            if node >= 0:
                heapq.heappush(queue, (cost, i, node))
            else:
                found.append((i, -node - 1))
                seen += held[i][-node - 1]
        out.append(found)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _first_places(group: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Of `order`, which sorts rows by group, those that are among the first n of their group."""
    some = group[order]
    starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]]) if len(some) else np.zeros(0, np.int64)
    place = np.arange(len(some)) - np.repeat(starts, np.diff(np.r_[starts, len(some)]))
    return order[place < n]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision; the products are added without rounding errors."""
    return np.fromiter(map(math.fsum, (a * b).tolist()), float, len(a))


def _contenders(asking: np.ndarray, score: np.ndarray, wide: np.ndarray, k: int) -> np.ndarray:
    """Where the pairs are that rounding leaves open to be among their query's k best."""
    last = _first_places(asking, np.lexsort((-score, asking)), k)
    least = np.full(len(wide), np.inf)
    np.minimum.at(least, asking[last], score[last])
    full = np.bincount(asking[last], minlength=len(wide)) == k
    return np.flatnonzero(~full[asking] | (score >= (least - wide)[asking]))


def _best_rows(asking: np.ndarray, at: np.ndarray, score: np.ndarray, q: np.ndarray, x: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, exact score) of each query's k best pairs; ties go to the smaller rep. score: as rounded."""
    near = _contenders(asking, score, np.abs(q).sum(1) * np.abs(x).max(initial=0.0) * 1e-12, k)
    asking, at = asking[near], at[near]
    exact = exact_products(q[asking], x[at])
    chosen = _first_places(asking, np.lexsort((reps[at], -exact, asking)), k)
    return asking[chosen], at[chosen], exact[chosen]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", least: int = LEAST, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k nearest rows of vectors but itself.

    Nearness is the inner product; ties go to the smaller id. queries is a subset of the rows of vectors. Rows without an
    id, and vectors that are null, empty, zero, hold null or non-finite components or differ in length from most, take
    no part. Rows that repeat id and vector are one row; another vector under a query's id is a row like others, and a query
    id with several vectors gets the list of each. Fewer candidates than k give fewer rows; empty tables give an empty
    result. Other columns are not looked at. Queries visit leaves with `least` vectors at least; trees * n make the
    search exact.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    spark_vector = F.col(vector_col).cast(kind)
    fit = f"{id_col} IS NOT NULL AND {vector_col} IS NOT NULL AND size({vector_col}) > 0 AND forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector_col}, x -> x <> 0)"
    key = F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","))

    def keyed(df: DataFrame) -> DataFrame:
        return df.where(fit).select(F.col(id_col).cast("long").alias("id"), spark_vector.alias("vector"))

    rows = keyed(vectors)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    width = sizes[0].n
    rows = rows.where(F.size("vector") == width).withColumn("key", key)
    rows = rows.groupBy("id", "key").agg(F.first("vector").alias("vector"))
    own = Window.partitionBy("key").orderBy("id")
    members = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1)
    members = written(members.withColumn("rep", F.min("id").over(Window.partitionBy("key"))), "members")
    distinct = members.where("place = 1").select("rep", "key", "vector")
    asked = keyed(queries).where(F.size("vector") == width).withColumn("key", key).select("id", "key").distinct()
    weights = asked.groupBy("key").agg(F.count("*").alias("asked"))
    wanted = written(distinct.join(weights, "key"), "wanted")
    n, n_asked = distinct.count(), wanted.count()
    if not n_asked:
        return empty

    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(max(2, min(SAMPLE, SAMPLE_BYTES // (4 * width)))).select("vector").toArrow()
    known = _matrix(sample.column("vector").combine_chunks())
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = math.sqrt(distinct.agg(F.max(squares)).first()[0])
    if not 0 < longest < math.inf:  # squares beyond the range of doubles: trees see the vectors as they are, scaled
        longest = 1.0
    found = Index.fit(known, n, k, longest, trees)
    forest, rise = found.forest, found.rise
    known_leaves = [t.assign(lifted(known, longest)).astype(np.int32) for t in forest]
    held = [np.bincount(at, minlength=t.leaves) * (n / len(known)) for at, t in zip(known_leaves, forest, strict=True)]
    shared = spark.sparkContext.broadcast((forest, known.astype(np.float32), known_leaves, held))
    to_visit = max(float(least), found.visits)
    per_leaf = n / max(t.leaves for t in forest)
    together = max(1, int(BLOCK_VECTORS / per_leaf))
    salts = max(1, int(np.ceil(per_leaf / BLOCK_VECTORS)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = shared.value[0]
        for batch in batches:
            v = _matrix(batch.column("vector"))
            at = lifted(v, longest)
            salt = pa.array((np.arange(len(v)) % salts).astype(np.int32))
            for i, t in enumerate(trees_):
                leaf = t.assign(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(leaf // together, pa.int32()), salt, pa.array(leaf, pa.int32()), batch.column("rep"), batch.column("key"), batch.column("vector")], ["tree", "block", "salt", "leaf", "rep", "key", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, known, known_leaves, held = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                q = _matrix(batch.column("vector"))
                rows, floor = [], np.full(len(q), -np.inf)
                for i, found in enumerate(search_forest(trees_, towards(q, longest), to_visit, held, rise)):
                    met = np.zeros(len(known), bool)
                    by: dict[tuple[int, int], list[int]] = {}
                    open_ = [np.zeros(t.leaves, bool) for t in trees_]
                    for tree, leaf in found:
                        by.setdefault((tree, leaf // together), []).append(leaf)
                        open_[tree][leaf] = True
                    rows += [(tree, block, i, leaves) for (tree, block), leaves in by.items()]
                    for leaves, mine in zip(open_, known_leaves, strict=True):
                        met |= leaves[mine]
                    if met.sum() > k:  # of the sampled vectors that this query will meet the (k + 1)-th best bounds its answer
                        score = known[met] @ q[i]
                        floor[i] = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                floor -= 1e-6 * np.maximum(1e-30, np.abs(q).sum(1) * np.abs(known).max(initial=0.0))
                at = pa.array([r[2] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(batch.column(c).take(at) for c in ("rep", "key", "vector")), pa.array(floor).take(at), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["tree", "block", "rep", "key", "vector", "floor", "leaves"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The block's best candidates of each query, from the leaves that it visits."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_pairs = 0
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("leaf").to_numpy(), kind="stable")
            x, leaf, reps, keys = _matrix(left.column("vector").combine_chunks())[order], left.column("leaf").to_numpy()[order], left.column("rep").to_numpy()[order], left.column("key").combine_chunks().take(pa.array(order))
            q, floor, leaves = _matrix(right.column("vector").combine_chunks()), right.column("floor").to_numpy(), right.column("leaves").combine_chunks()
            wide = np.abs(q).sum(1) * np.abs(x).max(initial=0.0) * 1e-12
            asking = np.repeat(np.arange(len(q)), np.diff(leaves.offsets.to_numpy()))
            wanted = leaves.flatten().to_numpy()
            by = np.argsort(wanted, kind="stable")
            asking, wanted = asking[by], wanted[by]
            edges = np.flatnonzero(np.r_[True, wanted[1:] != wanted[:-1], True]) if len(wanted) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                first, last = np.searchsorted(leaf, wanted[a]), np.searchsorted(leaf, wanted[a], "right")
                step = max(1, PAIRS // max(1, last - first))
                for c in range(a, b, step):
                    who = asking[c : min(b, c + step)]
                    score = q[who] @ x[first:last].T
                    i, j = np.nonzero(score >= floor[who, None])
                    found.append((who[i], first + j, score[i, j]))
                    open_pairs += len(i)
                    if open_pairs > PAIRS:
                        who, at, score = (np.concatenate(f) for f in zip(*found, strict=True))
                        near = _contenders(who, score, wide, k + 1)
                        found, open_pairs = [(who[near], at[near], score[near])], 0
        if not found:
            return pa.table({"q": pa.array([], pa.string()), "c": pa.array([], pa.string()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asking, at, score = (np.concatenate(f) for f in zip(*found, strict=True))
        asking, at, score = _best_rows(asking, at, score, q, x, reps, k + 1)
        return pa.table({"q": right.column("key").combine_chunks().take(pa.array(asking)), "c": keys.take(pa.array(at)), "rep": pa.array(reps[at]), "score": pa.array(score)})

    spread = f"tree int, block int, salt int, leaf int, rep long, key string, vector {kind}"
    indexed = distinct.mapInArrow(index, spread)
    visits = written(wanted.select("rep", "key", "vector").mapInArrow(visit, f"tree int, block int, rep long, key string, vector {kind}, floor double, leaves array<int>"), "visits")
    chunks = visits.groupBy("tree", "block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("chunks"))
    indexed = indexed.join(chunks, ["tree", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    visits = visits.join(chunks, ["tree", "block"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).drop("chunks")
    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = ("tree", "block", "salt", "chunk")
    found = indexed.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(rerank, "q string, c string, rep long, score double")
    found = found.repartition("q").groupBy("q", "c", "rep").agg(F.max("score").alias("score"))  # a pair may meet in several trees
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep", "c")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "c", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "c")
    ranked = best.join(members.select(F.col("key").alias("c"), "id"), "c").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score", (F.col("q") == F.col("c")).alias("same")))).alias("list"))
    lists = written(wanted.select("key", "asked").join(lists, F.col("key") == F.col("q")).select("key", "asked", "list"), "lists")
    answered = left_join_unique(asked, lists, "key", "asked", ["list"])
    near = F.slice(F.filter("list", lambda x: ~(x["same"] & (x["id"] == F.col("id")))), 1, k)
    out = answered.select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: The exact answer, which the query gives where its leaves hold all vectors (up to LEAST / TREES of them); products of
#: floats are exact in doubles and are added here as integers, scaled by 2**100.
OP8_SQL = """
WITH d AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT row_number() OVER () AS n, vec_id, embedding FROM d),
p AS (SELECT q.n AS q, c.n AS c, unnest(q.embedding)::DOUBLE * unnest(c.embedding)::DOUBLE AS x FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.n <> c.n),
s AS (SELECT q, c, sum((x * pow(2.0, 100))::HUGEINT)::DOUBLE / pow(2.0, 100) AS score FROM p GROUP BY ALL),
r AS (SELECT a.vec_id AS query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, b.vec_id))::INT AS rank, b.vec_id, score FROM s JOIN v a ON a.n = q JOIN v b ON b.n = c)
SELECT * FROM r WHERE rank <= 20
"""
