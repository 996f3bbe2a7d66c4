"""Near duplicates by the Jaccard similarity of 5-word shingles, with prefix filters under several global orders.

A pair with similarity t or more shares one of the first n - ceil(t * n) + 1 elements of both its sets under *any*
order of all elements. Candidates must pass that filter under three orders at once; all three put elements that occur in
one document only first, then: (1) rarest first; (2) by octave of rarity, hashed within; (3) hashed.

1. Tasks shingle whole texts. Within a task's block of documents, equal elements are counted before anything is
   shuffled; then each element's document frequency is counted over all blocks. An element sends one entry a block.
2. Blocks get back the elements that more than one document has. A document of which fewer than t of the elements are
   shared has no partner (n long and the fact are kept; its set is dropped). For the others, shared elements suffice:
   intersections hold nothing else, and unions follow from the sizes.
3. Documents with equal sets become one representative.
4. Representatives that share a prefix element of order 1 are candidates. First each list (an element's representatives)
   is cut into chunks of about CHUNK, whose members link to one pivot; pivots are linked likewise, level by level, so
   that nobody meets many. Verified links are joined into components. Then, with components known, each document takes
   the likeliest one of another component in each list; in the end all pairs across the components that are left are
   candidates. Their lists are gone through in blocks; of a pair, sizes and parity sketches bound the intersection, and
   only pairs that the bound leaves open become rows. No pair that could change the result is left out, and none
   within a component is looked at again.
5. Candidates must pass the filters of orders 2 and 3 and the bound of their sketches as well; all three come from a small
   row for each representative, so whole sets are joined only to what is left, and compared exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import digest_of, one_of_each
from tessera.llm.shingles import mix, shingle_sets
from tessera.llm.sieve import bitmap, split
from tessera.llm.tables import release_memory, table, text_blocks
from tessera.operators.components import connected_components
from tessera.operators.joins import free_prefix, left_join_unique
from tessera.session import discard, free_shuffles, remove, shared_dir, written

#: The threshold in hundredths, so that it is compared in integers.
THRESHOLD = 75
#: Bytes of text in one task's block; its documents share counts before the shuffle.
BLOCK_BYTES = 4_000_000
#: Documents in one block, so that two bytes hold a place.
BLOCK_DOCS = 50_000
#: In place of a document's place: several documents of the block have the element.
SEVERAL = 0xFFFF
#: Elements that one group of the document-frequency count is to hold on average.
PART_ELEMENTS = 750_000
#: Rounds of candidates: the members of each list's chunks with a pivot; each document with the most promising one of another
#: component in each list; all pairs across components that are then left.
ROUNDS = ("pivot", "best", "all")
#: Members of a list that meet one pivot, on average at most.
CHUNK = 32
#: Bits of a set's sketch.
SKETCH_BITS = 2048
#: Rows of prefix lists that one group holds (about 300 bytes each).
LIST_ROWS = 8192
#: Pairs verified at a time.
VERIFY_ROWS = 512

_ROWS = "part int, key long, payload binary"


def least_shared(n: np.ndarray | int, threshold: int = THRESHOLD) -> np.ndarray | int:
    """ceil(threshold / 100 * n): the fewest elements that a set of n shares with any partner."""
    return -(-threshold * n // 100)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte values go byte plane by byte plane: sorted ones then compress well."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T) if a.dtype.itemsize == 8 else np.ascontiguousarray(a) for a in arrays]
    return b"".join([np.array([len(arrays), *map(len, arrays)], "<i8").tobytes(), *(a.tobytes() for a in planes)])


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", 1 + len(types))[1:]
    out, at = [], 8 * (1 + len(types))
    for size, kind in zip(sizes.tolist(), types, strict=True):
        width = np.dtype(kind).itemsize
        if width == 8:
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * size, at).reshape(8, size).T).view(kind).ravel())
        else:
            out.append(np.frombuffer(data, kind, size, at))
        at += size * width
    return out


def _shingle_blocks(parts: int):
    """Of (doc_id, text): for each block and part of the elements' space, the block's distinct elements with counts.

    An element of one document in the block carries that document's place in the block; where documents of the block
    share it, the list of places goes to the block's own key only. The row with part < 0 has the documents themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        blocks = 0
        held: list[tuple[np.ndarray, list[np.ndarray], list[int]]] = []
        size = docs = 0

        def send(number: int) -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            sets = [s for h in held for s in h[1]]
            seconds = np.array([s for h in held for s in h[2]], np.uint64)
            n = np.array([len(s) for s in sets], np.int64)
            elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            places = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(elements, kind="stable")
            elements, places = elements[order], places[order]
            first = np.flatnonzero(np.r_[True, elements[1:] != elements[:-1]]) if len(elements) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[first, len(elements)])
            distinct = elements[first]
            sums = np.array([s.sum() if len(s) else 0 for s in sets], np.uint64)
            mixed = np.array([mix(s).sum() if len(s) else 0 for s in sets], np.uint64)
            several = np.repeat(counts > 1, counts)
            key = (task << 24) | number
            valid = ~np.isnan(ids.astype(float)) if ids.dtype == object else np.ones(len(ids), bool)
            plain = np.array([0 if x is None else x for x in ids], np.int64) if ids.dtype == object else ids
            rows = [(-1 - key % parts, key, _pack(plain, valid, n, sums, mixed, seconds, elements[several], places[several]))]
            at = (distinct >> np.uint64(32)).astype(np.int64) * parts >> 32
            edges = np.searchsorted(at, np.arange(parts + 1))
            place = np.where(counts == 1, places[first], np.uint16(SEVERAL)).astype("<u2")
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if b > a:
                    small = bool((counts[a:b] == 1).all())
                    rows.append((p, key, _pack(distinct[a:b], place[a:b], np.zeros(0, "<u2") if small else counts[a:b].astype("<u2"))))
            return pa.RecordBatch.from_arrays([pa.array([abs(r[0] + 1) if r[0] < 0 else r[0] for r in rows], pa.int32()), pa.array([-1 - r[1] if r[0] < 0 else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["part", "key", "payload"])

        for batch in text_blocks(batches, "text", 1_000_000, BLOCK_DOCS):
            if held and (size >= BLOCK_BYTES or docs + batch.num_rows > BLOCK_DOCS):
                yield send(blocks)
                held, size, docs, blocks = [], 0, 0, blocks + 1
                release_memory()
            ids = batch.column("doc_id")
            held.append((np.array(ids.to_pylist(), object if ids.null_count else np.int64), *shingle_sets(batch.column("text"))))
            size += batch.column("text").nbytes
            docs += batch.num_rows
        if held:
            yield send(blocks)

    return run


def _frequencies(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block, the elements of this part that more than one document of the corpus has, with that number.

    Rows of key < 0 (a block's documents) pass.
    """
    keys = rows.column("key").to_numpy()
    payloads = rows.column("payload")
    release_memory()
    out_keys, out = [], []
    elements, places, counts, owners = [], [], [], []
    for i, k in enumerate(keys):
        data = payloads[i].as_buffer().to_pybytes()
        if k < 0:
            out_keys.append(-1 - k)
            out.append((True, data))
            continue
        e, p, c = _unpack(data, "<u8", "<u2", "<u2")
        elements.append(e)
        places.append(p)
        counts.append(c if len(c) else np.ones(len(e), "<u2"))
        owners.append(np.full(len(e), i, np.int32))
    if elements:
        e, p, c, o = (np.concatenate(x) for x in (elements, places, counts, owners))
        order = np.argsort(e, kind="stable")
        e, p, c, o = e[order], p[order], c[order], o[order]
        first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        total = np.add.reduceat(c.astype(np.int64), first)
        df = np.repeat(total, np.diff(np.r_[first, len(e)]))
        shared = df > 1
        e, p, o, df = e[shared], p[shared], o[shared], df[shared]
        order = np.argsort(o, kind="stable")
        e, p, o, df = e[order], p[order], o[order], df[order]
        edges = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else []
        for a, b in zip(edges, np.r_[edges[1:], len(o)] if len(o) else [], strict=True):
            out_keys.append(int(keys[o[a]]))
            out.append((False, _pack(e[a:b], p[a:b], df[a:b])))
    return pa.table({"key": pa.array(out_keys, pa.int64()), "documents": pa.array([x[0] for x in out], pa.bool_()), "payload": pa.array([x[1] for x in out], pa.binary())})


def _documents(threshold: int):
    """A block's documents again, each with its shared elements (rarest first) if it can have a partner."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        flags = rows.column("documents").to_pylist()
        payloads = rows.column("payload")
        parts = []
        for i, is_documents in enumerate(flags):
            data = payloads[i].as_buffer().to_pybytes()
            if is_documents:
                ids, valid, n, sums, mixed, seconds, local, local_places = _unpack(data, "<i8", "?", "<i8", "<u8", "<u8", "<u8", "<u8", "<u2")
            else:
                parts.append(_unpack(data, "<u8", "<u2", "<i8"))
        if parts:
            e, p, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            e, p, df = np.zeros(0, np.uint64), np.zeros(0, "<u2"), np.zeros(0, np.int64)
        several = p == SEVERAL
        groups, group_df = e[several], df[several]
        order = np.argsort(groups)
        groups, group_df = groups[order], group_df[order]
        local_df = group_df[np.searchsorted(groups, local)] if len(local) else np.zeros(0, np.int64)
        e, p, df = np.r_[e[~several], local], np.r_[p[~several], local_places], np.r_[df[~several], local_df]
        shared = np.bincount(p, minlength=len(ids)) if len(p) else np.zeros(len(ids), np.int64)
        alive = (n > 0) & (shared >= least_shared(n, threshold))
        keep = alive[p] if len(p) else np.zeros(0, bool)
        e, p, df = e[keep], p[keep], df[keep]
        order = np.lexsort((e, df, p))
        e, p, df = e[order], p[order], df[order]
        bounds = np.searchsorted(p, np.arange(len(ids) + 1))
        sets = [e[a:b].astype("<u8").tobytes() if ok else None for ok, a, b in zip(alive, bounds[:-1], bounds[1:], strict=True)]
        octave = np.floor(np.log2(np.maximum(df, 1))).astype(np.uint8)
        octaves = [octave[a:b].tobytes() if ok else None for ok, a, b in zip(alive, bounds[:-1], bounds[1:], strict=True)]
        signature = [f"{int(k):x}-{int(a):016x}{int(b):016x}{int(c):x}" if ok else None for ok, k, a, b, c in zip(alive, n, sums, mixed, seconds, strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~valid), "n": pa.array(n), "signature": pa.array(signature, pa.string()), "elements": pa.array(sets, pa.binary()), "octaves": pa.array(octaves, pa.binary())})

    return run


def _prefix_rows(threshold: int):
    """(element, id, n) of each representative's prefix under order 1; unshared elements come first and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, element = [], [], []
            for i, size, data in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("elements").to_pylist(), strict=True):
                e = np.frombuffer(data, "<u8")
                rest = size - least_shared(size, threshold) + 1 - (size - len(e))
                if rest > 0:
                    element.append(e[:rest])
                    ids.append(np.full(min(rest, len(e)), i, np.int64))
                    n.append(np.full(min(rest, len(e)), size, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(element).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(n))], ["element", "id", "n"])

    return run


def _prefix(e: np.ndarray, rank: np.ndarray, n: int, threshold: int) -> np.ndarray:
    rest = max(0, n - least_shared(n, threshold) + 1 - (n - len(e)))
    return e if rest >= len(e) else e[np.argpartition(rank, rest - 1)[:rest]] if rest else e[:0]


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two arrays of distinct elements share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


_GATE = "id long, n long, size long, bits binary, second binary, third binary"


def _gates(threshold: int):
    """(id, n, size, bits, second, third) of each representative: the number of shared elements; the parity, bit by bit, of
    how many of them hash to it; the prefixes under orders 2 and 3, four bytes an element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits, second, third = [], [], [], []
            for n, data, octaves in zip(batch.column("n").to_pylist(), batch.column("elements").to_pylist(), batch.column("octaves").to_pylist(), strict=True):
                e, octave = np.frombuffer(data, "<u8"), np.frombuffer(octaves, np.uint8).astype(np.uint64)
                sizes.append(len(e))
                hits = np.bincount((mix(e + np.uint64(5)) >> np.uint64(32)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
                bits.append(np.packbits((hits & 1).astype(np.uint8)).tobytes())
                for out, rank in ((second, (octave << np.uint64(58)) | (mix(e + np.uint64(2)) >> np.uint64(6))), (third, mix(e + np.uint64(3)))):
                    out.append(np.unique(_prefix(e, rank, n, threshold).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (bits, second, third))], ["id", "n", "size", "bits", "second", "third"])

    return run


_PAIR = "a long, b long"


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _filter(threshold: int):
    """Of pairs with both gates (columns that end in a or b): those that orders 2 and 3 and the sketches leave open.

    Two sets whose parities differ in d bits differ in d elements at least, so they share (|a| + |b| - d) / 2 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFY_ROWS):
                batch = whole.slice(at, VERIFY_ROWS)
                na, nb, sa, sb = (batch.column(c).to_numpy() for c in ("na", "nb", "sizea", "sizeb"))
                bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(na), -1) for c in ("bitsa", "bitsb")]
                most = (sa + sb - np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)) // 2
                open_ = (100 + threshold) * most >= threshold * (na + nb)
                prefixes = [batch.column(c).to_pylist() for c in ("seconda", "secondb", "thirda", "thirdb")]
                kept = [k for k in np.flatnonzero(open_).tolist() if all(_meet(np.frombuffer(prefixes[i][k], "<u4"), np.frombuffer(prefixes[i + 1][k], "<u4")) for i in (0, 2))]
                if kept:
                    yield _pairs(batch.column("a").take(pa.array(kept)), batch.column("b").take(pa.array(kept)))

    return run


def _verify(threshold: int):
    """Of rows (a, b, na, nb, ea, eb): the pairs (a, b) that are links, by the exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFY_ROWS):
                get = {c: whole.column(c).slice(at, VERIFY_ROWS).to_pylist() for c in ("a", "b", "na", "nb", "ea", "eb")}
                out = []
                for a, b, na, nb, ea, eb in zip(*get.values(), strict=True):
                    same = _meet(np.frombuffer(ea, "<u8"), np.frombuffer(eb, "<u8"))
                    same -= same == na == nb  # equal sets are one representative: these differ, but for a hash
                    if 100 * same >= threshold * (na + nb - same):
                        out.append((a, b))
                if out:
                    yield _pairs([x[0] for x in out], [x[1] for x in out])

    return run


def _across(threshold: int, only_best: bool):
    """Of lists' rows: pairs of different components that sizes and sketches leave open, inside each list.

    only_best: of each left row's open pairs the one with the largest bounded similarity. See _filter for the bound.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        element, ids, n, c, main, size, role = (rows.column(x).to_numpy() for x in ("element", "id", "n", "c", "main", "size", "role"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        order = np.argsort(element, kind="stable")
        edges = np.flatnonzero(np.r_[True, element[order][1:] != element[order][:-1], True])
        out_a, out_b = [], []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            some = order[x:y]
            left, right = some[(role[some] != 1) & (c[some] != main[some])], some[role[some] != 0]
            for at in range(0, len(left), 64):
                i = left[at : at + 64, None]
                both = n[i] + n[right]
                ok = (c[i] != c[right]) & (np.maximum(n[i], n[right]) * threshold <= np.minimum(n[i], n[right]) * 100) & ((c[right] == main[right]) | (ids[i] < ids[right]))
                u, v = np.nonzero(ok)
                if len(u):
                    j, k = i[u, 0], right[v]
                    most = (size[j] + size[k] - np.bitwise_count(bits[j] ^ bits[k]).sum(1).astype(np.int64)) // 2
                    open_ = (100 + threshold) * most >= threshold * both[u, v]
                    if only_best:
                        likely = np.where(open_, most / both[u, v], -1.0)
                        best = np.lexsort((v, -likely, u))
                        open_[best[np.r_[False, u[best][1:] == u[best][:-1]]]] = False
                    out_a.append(ids[j[open_]])
                    out_b.append(ids[k[open_]])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        pairs = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)], axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _pairs_to_pivots(postings: DataFrame, threshold: int, longest: int) -> DataFrame:
    """(a, b): each member of a list with its chunk's pivot, and the pivots with theirs, up to one for the whole list.

    postings: (element, id, n, held); longest: the most that held is. A list's members are dealt over powers of CHUNK by
    a hash of their ids, so lists of like sizes have like chunks and their pairs are mostly the same.
    """
    depth = sum(((F.col("held") > CHUNK**k).cast("int") for k in range(1, 13)), F.lit(0))
    members = postings.select("element", "id", "n", depth.alias("depth")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.pow(F.lit(CHUNK), F.col("depth")).cast("long")))
    out, level = None, 0
    while True:
        pivots = members.groupBy("element", "chunk").agg(F.min(F.struct(F.xxhash64("id", F.lit(0)).alias("h"), "id", "n")).alias("p"), F.first("depth").alias("depth"))
        deeper = CHUNK ** (level + 1) < longest
        if deeper:
            pivots = written(pivots, "pivots")
        met = members.join(pivots.select("element", "chunk", "p"), ["element", "chunk"]).select(F.col("id").alias("a"), F.col("p.id").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb"))
        met = met.where(_sized(threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = met if out is None else out.union(met)
        if not deeper:
            return out
        level += 1
        members = pivots.where(F.col("depth") >= level).select("element", "p.id", "p.n", "depth", F.floor(F.col("chunk") / CHUNK).cast("long").alias("chunk"))


def _sized(threshold: int) -> Column:
    return (F.greatest("na", "nb") * threshold <= F.least("na", "nb") * 100) & (F.col("a") != F.col("b"))


def _mixed_lists(own: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows (element, id, n, c) of lists with several components, with each list's size and largest component, and the
    sketches (id, size, bits); written."""
    largest = own.groupBy("element", "c").agg(F.count("*").alias("k")).groupBy("element").agg(F.count("*").alias("kinds"), F.sum("k").alias("held"), F.max(F.struct("k", "c")).alias("top"))
    largest = largest.where("kinds > 1").select("element", "held", F.col("top.c").alias("main"), (F.col("held") - F.col("top.k")).alias("outside"))
    return written(own.join(largest, "element").join(sketches, "id"), "mixed")


def _pairs_across(mixed: DataFrame, threshold: int, only_best: bool) -> DataFrame:
    """(a, b): all candidates across components, from _mixed_lists.

    Lists are dealt over groups of about LIST_ROWS rows; a longer list's rows are cut in chunks of that size, each chunk
    of rows outside the list's largest component meeting each chunk of all rows.
    """
    groups = max(1, mixed.count() // LIST_ROWS)
    short = mixed.where(F.col("held") <= LIST_ROWS).withColumns({"role": F.lit(2), "x": F.pmod(F.xxhash64("element"), F.lit(groups)).cast("int"), "y": F.lit(-1), "list": F.lit(0).cast("long")})
    long_ = mixed.where(F.col("held") > LIST_ROWS)
    chunks, own_chunks = F.ceil(F.col("held") / LIST_ROWS).cast("int"), F.ceil(F.col("outside") / LIST_ROWS).cast("int")
    mine = lambda of: F.pmod(F.xxhash64("id"), of).cast("int")
    outside = long_.where("c <> main").withColumns({"role": F.lit(0), "x": F.explode(F.sequence(F.lit(0), chunks - 1)), "y": mine(own_chunks), "list": F.col("element")})
    every = long_.withColumns({"role": F.lit(1), "x": mine(chunks), "y": F.explode(F.sequence(F.lit(0), own_chunks - 1)), "list": F.col("element")})
    rows = short.unionByName(outside).unionByName(every)
    return rows.groupBy("list", "x", "y").applyInArrow(_across(threshold, only_best), "a long, b long")


@contextmanager
def _bucketed(rows: DataFrame) -> Iterator[DataFrame]:
    """rows, written as a table bucketed by id; it goes at the end, also of a run that fails."""
    spark = rows.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path, buckets = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        rows.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, linked (whether another row is in its component).

    Two texts link when 100 * intersection >= threshold * union of their shingle sets; component_id is the smallest id
    reachable by links. A null or empty text, or one without words, has an empty set and links with nothing. Equal
    sets always link, so rows that repeat a text share a component. Rows without an id link like others, but give no
    component its name; a component without any id has null. Empty tables give empty results; other columns are not
    looked at. Ids that repeat with different texts act as one document in components.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    volume = base.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(volume / 6 / PART_ELEMENTS))
    blocks = base.mapInArrow(_shingle_blocks(parts), _ROWS)
    shared = written(blocks.groupBy("part").applyInArrow(_frequencies, "key long, documents boolean, payload binary"), "shared")
    del blocks
    free_shuffles(spark)  # every element of every block was in it
    documents = shared.groupBy("key").applyInArrow(_documents(threshold), "doc_id long, n long, signature string, elements binary, octaves binary")
    shingled = written(documents, "shingled")
    discard(shared)
    del documents
    free_shuffles(spark)

    alive = shingled.where("signature IS NOT NULL")
    named = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    reps = alive.groupBy("signature").agg(F.min(named).alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("elements").alias("elements"), F.first("octaves").alias("octaves"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")
    documents = written(shingled.select("doc_id", "n", "signature"), "documents")
    discard(shingled)
    every = written(reps.select("id", "n", "elements").mapInArrow(_prefix_rows(threshold), "element long, id long, n long"), "prefixes")
    lists = written(every.groupBy("element").agg(F.count("*").alias("held")).where("held > 1"), "lists")
    longest = lists.agg(F.max("held")).first()[0] or 0
    postings = written(every.join(lists, "element"), "prefixes")
    discard(every, lists)

    # bucketed by id, so that no round of verification shuffles the tables themselves
    with _bucketed(reps.select("id", "n", "elements", "octaves").mapInArrow(_gates(threshold), _GATE)) as gates, _bucketed(reps.select("id", "n", "elements")) as sets:

        def both_sides(pairs: DataFrame, of: DataFrame, **named: str) -> DataFrame:
            for side in "ab":
                pairs = pairs.join(of.select(F.col("id").alias(side), *(F.col(c).alias(f"{to}{side}") for c, to in named.items())), side)
            return pairs

        def verified(pairs: DataFrame) -> DataFrame:
            open_ = both_sides(pairs.distinct(), gates, n="n", size="size", bits="bits", second="second", third="third").mapInArrow(_filter(threshold), _PAIR)
            return both_sides(open_, sets, n="n", elements="e").mapInArrow(_verify(threshold), _PAIR)

        components: DataFrame | None = None
        links: DataFrame | None = None
        for kind in ROUNDS:
            if components is None:
                pairs = _pairs_to_pivots(postings, threshold, longest)
            else:
                own = written(postings.join(components, "id", "left").select("element", "id", "n", F.coalesce("component", "id").alias("c")), "labelled")
                mixed = _mixed_lists(own, gates.select("id", "size", "bits"))
                pairs = _pairs_across(mixed, threshold, kind == "best")
            found = written(verified(pairs), "links")
            if components is not None:
                discard(own, mixed, components)
            links = found if links is None else links.union(found)
            components = written(connected_components(links, "a", "b"), "components")
            free_shuffles(spark)

    discard(postings)
    classes = reps.join(components, "id", "left").select("signature", "least", "copies", F.coalesce("component", "id").alias("c"))
    totals = classes.groupBy("c").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size"))
    classes = written(classes.join(totals, "c").where("size > 1").select("signature", F.when(F.col("component_id") < 2**63 - 1, F.col("component_id")).alias("component_id"), "copies", F.lit(True).alias("linked")), "classes")
    out = left_join_unique(documents.select("doc_id", F.col("n").alias("n_shingles"), "signature"), classes, "signature", "copies", ["component_id", "linked"])
    return out.select("doc_id", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("linked", F.lit(False)).alias("linked"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS seen FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id isn't one of gone (a column of ids); few others of them are shuffled."""
    name = f"{free_prefix(*docs.columns)}gone"
    gone = written(gone.toDF(name).distinct(), "gone")
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    maybe, clear = split(docs, hashed, bitmap(gone.select(F.xxhash64(name).alias("h")), "h"))
    return clear.union(maybe.join(gone, F.col("doc_id") == F.col(name), "left_anti"))


def stage_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs of which none of the same component has a smaller id; all columns, whatever their names.

    Of linked rows without ids one stays, if no row of their component has an id; for that, each of their texts gets a
    number from 2**63 - 2 downwards, which no id of docs may reach. Rows of one id stay or go together.
    """
    p = free_prefix(*docs.columns)
    unnamed = docs.where("doc_id IS NULL").select(digest_of().alias(f"{p}sha")).distinct()
    unnamed = written(unnamed.withColumn(f"{p}own", F.lit(2**63 - 2) - F.monotonically_increasing_id()), "unnamed")
    moved = F.col("doc_id") != F.col("component_id")
    if unnamed.isEmpty():
        return _without(docs, near_duplicates(docs).where(moved).select("doc_id"))
    named = docs.where("doc_id IS NOT NULL")
    rest = docs.where("doc_id IS NULL").join(unnamed, digest_of() == F.col(f"{p}sha"))
    both = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(rest.select(f"{p}own", "text"))
    near = written(near_duplicates(both).select(F.col("doc_id").alias(f"{p}id"), F.col("linked").alias(f"{p}linked"), moved.alias(f"{p}moved")).distinct(), "near")
    rest = rest.join(near.where(f"NOT {p}moved"), F.col(f"{p}own") == F.col(f"{p}id"))
    alone = F.lit(-1) - F.monotonically_increasing_id()  # rows that link with nothing, as empty texts do, all stay
    rest = one_of_each(rest.withColumn(f"{p}group", F.when(F.col(f"{p}linked"), F.col(f"{p}own")).otherwise(alone)), docs.columns, F.col(f"{p}group"))
    return _without(named, near.where(f"{p}moved").select(f"{p}id")).union(rest)
