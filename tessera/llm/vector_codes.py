"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, learnt by Hamerly's Lloyd rounds.

Everything is integer: components are floor(1024 * x), entries are floors of means, distances are squared and exact. Each
round's table holds, for each part of each vector, its entry, one upper bound of the distance to it and one lower bound of
the distance to any other. When entries move, the bounds move with them; only where the upper bound isn't strictly below
the lower one is the part's own distance taken, and only if that isn't strictly below either are all entries gone through.
Bounds are rounded outwards, and a strict bound rules ties out, so codes are those of a full search: ties go to the lower
index.

A task sends one sum an entry; the codebooks (4 * 256 entries at most) go through the driver, nothing else does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import table
from tessera.operators.joins import left_join_unique
from tessera.session import discard, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts whose distances to all entries are held at a time.
STEP = 4096


def _outwards(squared: np.ndarray, up: bool) -> np.ndarray:
    """The root of exact squared distances, as a bound."""
    return np.nextafter(np.sqrt(squared.astype(float)), np.inf if up else -np.inf)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    if len(x) and len(entries) and 4 * max(int(np.abs(x).max()), int(np.abs(entries).max()), 1) ** 2 * x.shape[1] < 1 << 53:
        a, b = x.astype(float), entries.astype(float)  # all sums are integers below 2 ** 53, so none is rounded
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1) if len(entries) else np.zeros((len(x), 0), np.int64)


def assign(x: np.ndarray, entries: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of x: nearest entry (ties: lower index), upper bound, lower bound, and whether all entries were scanned.

    known: entry, upper and lower bound before the entries moved, each by at most `moved`; none: all rows are scanned.
    """
    n = len(x)
    if known is None:
        best, upper, lower, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), np.arange(n)
    else:
        best, upper, lower = known[0].copy(), known[1].copy(), known[2].copy()
        order = np.argsort(-moved, kind="stable")
        most = np.full(len(moved), moved[order[0]])
        most[order[0]] = moved[order[1]] if len(order) > 1 else 0.0
        upper = np.nextafter(upper + moved[best], np.inf)
        lower = np.nextafter(lower - most[best], -np.inf)
        near = np.flatnonzero(upper >= lower)
        upper[near] = _outwards(((x[near] - entries[best[near]]) ** 2).sum(1), True)
        open_ = near[upper[near] >= lower[near]]
    for a in range(0, len(open_), STEP):
        some = open_[a : a + STEP]
        d = squared_distances(x[some], entries)
        first = d.argmin(1)
        least = d[np.arange(len(some)), first]
        best[some], upper[some] = first, _outwards(least, True)
        if d.shape[1] > 1:
            d[np.arange(len(some)), first] = np.iinfo(np.int64).max
            lower[some] = _outwards(d.min(1), False)
        else:
            lower[some] = np.inf
    scanned = np.zeros(n, bool)
    scanned[open_] = True
    return best, upper, lower, scanned


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def usable(vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """row (all columns but the vector, as a struct) and x (floor(scale * component)) of the rows that take part; x's length.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do those whose length isn't the
    one that most vectors have whose length is a multiple of `parts` (of equally many the shortest), nor those with a
    component whose distances could be beyond 64 bits (over a hundred thousand for the usual lengths).
    """
    others = F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != vector_col])
    v = F.col("v")
    rows = vectors.select(others.alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.where(finite & (F.size(v) > 0) & (F.size(v) % parts == 0))
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = lengths[0]["n"] if lengths else 0
    most = int(min(2**30, (2**62 / max(1, width // parts)) ** 0.5 / 2)) // 2
    rows = rows.where((F.size(v) == width) & F.forall(v, lambda x: F.abs(x) < most / scale))
    return rows.select("row", F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("x")), width


def _codebooks(rows: list[list[int]], parts: int) -> np.ndarray:
    """part, entry, component: the first vectors' parts."""
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _round(state: DataFrame, width: int, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """state (key columns, x, entry, upper, lower, scans, error) after all parts are assigned to the books' entries."""
    parts = len(books)
    shared = state.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_, moved_ = shared.value
        for batch in batches:
            x = _rows(batch.column("x"), width).astype(np.int64).reshape(len(batch), parts, -1)
            known = [_rows(batch.column(c), parts) for c in ("entry", "upper", "lower")] if moved_ is not None else None
            out = [assign(x[:, p], books_[p], known and tuple(k[:, p] for k in known), None if moved_ is None else moved_[p]) for p in range(parts)]
            entry, upper, lower, scanned = (np.stack([o[k] for o in out], 1) for k in range(4))
            error = sum(((x[:, p] - books_[p][entry[:, p]]) ** 2).sum(1) for p in range(parts))
            columns = {"entry": _lists(entry.astype(np.int32), pa.int32()), "upper": _lists(upper, pa.float64()), "lower": _lists(lower, pa.float64()), "scans": pa.array(batch.column("scans").to_numpy() + scanned.sum(1), pa.int32()), "error": pa.array(error, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(name, batch.column(name)) for name in batch.schema.names], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _means(state: DataFrame, width: int, books: np.ndarray) -> np.ndarray:
    """The books with each used entry replaced by the floor of its parts' mean."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _rows(batch.column("x"), width).astype(np.int64).reshape(-1, size)
            at = (_rows(batch.column("entry"), parts) + np.arange(parts) * entries).ravel()
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(edges):
                sums[at[order][edges]] += np.add.reduceat(x[order], edges)
                counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), _lists(sums[used], pa.int64())], ["slot", "n", "sums"])

    each = state.select("x", "entry").mapInArrow(run, "slot int, n long, sums array<long>").select("slot", "n", F.posexplode("sums").alias("at", "s"))
    out = books.reshape(parts * entries, size).copy()
    for r in each.groupBy("slot", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["slot"], r["at"]] = r["s"] // r["n"]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The rows that take part (see usable) with their own columns in a struct `row`, codes, error and scans; the codebooks.

    row.codes has a number for each part, error the squared distances to its entries (summed), scans how many of the
    (rounds + 1) * parts searches went through all entries. The codebooks start with the vectors of the `entries` smallest
    ids (nulls last, of equal ids the lesser vector first; repeated rows count each), or of all rows if there are fewer.
    An empty table gives an empty result and no codebooks.
    """
    rows, width = usable(vectors, vector_col, parts, scale)
    blank = F.array(*[F.lit(0.0)] * parts)
    state = rows.select("row", "x", F.array(*[F.lit(0)] * parts).alias("entry"), blank.alias("upper"), blank.alias("lower"), F.lit(0).alias("scans"), F.lit(0).cast("long").alias("error"))
    first = rows.select(F.col("row")[id_col].cast("long").alias("i"), "x").orderBy(F.asc_nulls_last("i"), "x").limit(entries).collect()
    if not first:
        return state.select("row", F.col("entry").alias("codes"), "error", "scans"), np.zeros((parts, 0, 0), np.int64)
    books, moved = _codebooks([r["x"] for r in first], parts), None
    for _ in range(rounds):
        before, state = state, written(_round(state, width, books, moved), "codes")
        discard(before)
        now = _means(state, width, books)
        moved = _outwards(((now - books) ** 2).sum(2), True) * (now != books).any(2)
        books = now
    before, state = state, written(_round(state, width, books, moved), "codes")
    discard(before)
    return state.select("row", F.col("entry").alias("codes"), "error", "scans"), books


def decompress(codes: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a list of codes stands for: its parts' entries, one after the other, divided by scale."""
    tables = [F.array(*[F.array(*[F.lit(int(c) / scale) for c in entry]) for entry in part]) for part in books]
    return F.concat(*[F.element_at(t, F.element_at(codes, p + 1) + 1) for p, t in enumerate(tables)])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    label = F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit(""))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = coded.select(F.col("row.vec_id").cast("long").alias("vec_id"), code.alias("code"), "error", label.alias("label"), "scans")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    out = left_join_unique(rows, sums, "label", "n", ["label_error"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
d{r} AS (SELECT p.n, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{r} c ON c.part = p.part AND c.pos = p.pos GROUP BY p.n, p.part, c.entry),
a{r} AS (SELECT n, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY n, part)""")
        if r < ROUNDS:
            rounds.append(f"""
s{r} AS (SELECT a.part, a.entry, p.pos, sum(p.x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM a{r} a JOIN p ON p.n = a.n AND p.part = a.part GROUP BY a.part, a.entry, p.pos),
c{r + 1} AS (SELECT c.part, c.entry, c.pos, coalesce((s - ((s % k) + k) % k) // k, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.entry = c.entry AND s.pos = c.pos)""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
e AS (SELECT n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, len(embedding) // {PARTS} AS size FROM v),
p AS (SELECT n, pos // size AS part, pos % size AS pos, floor({SCALE} * x)::HUGEINT AS x FROM e),
c0 AS (SELECT part, n - 1 AS entry, pos, x FROM p WHERE n <= {ENTRIES}),{",".join(rounds)},
f AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY n)
SELECT vec_id::BIGINT AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM f JOIN v USING (n)
"""


OP12_SQL = _sql()
