"""The largest inner products of two sparse sets: blocks of documents meet blocks of queries, a pair of blocks a task's group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Documents and queries of a block; a group holds one of either and their products, a slice of documents at a time.
DOCS, QUERIES = 2048, 256
#: Numbers in a slice's dense rows.
CELLS = 4_000_000


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _products(k: int | None, slack: float, doc_kind: pa.DataType, query_kind: pa.DataType):
    """Of a block of documents and one of queries the products above zero: all, or each query's k best and those within slack."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        docs = queries = None
        if left.num_rows and right.num_rows:
            docs, doc = _codes(left.column("id"))
            queries, query = _codes(right.column("query_id"))
            words, word = _codes(right.column("token"))
            at = pc.fill_null(pc.index_in(left.column("token").combine_chunks(), value_set=words), -1).to_numpy(zero_copy_only=False)
            y = np.zeros((len(words), len(queries)))
            np.add.at(y, (word, query), right.column("y").to_numpy())
            known = at >= 0
            doc, at, x = doc[known], at[known], left.column("x").to_numpy()[known]
            order = np.argsort(doc, kind="stable")
            doc, at, x = doc[order], at[order], x[order]
            if "only" in left.column_names:  # a query meets the documents of its own label
                first = np.zeros(len(docs), dtype=np.int64)
                first[_codes(left.column("id"))[1][::-1]] = np.arange(left.num_rows)[::-1]
                asks = np.zeros(len(queries), dtype=np.int64)
                asks[query[::-1]] = np.arange(right.num_rows)[::-1]
                own, asked = np.array(left.column("only").to_pylist(), dtype=object)[first], np.array(right.column("only").to_pylist(), dtype=object)[asks]
            step = max(1, CELLS // max(len(words), len(queries)))
            for begin in range(0, len(docs), step):
                size = min(step, len(docs) - begin)
                lo, hi = np.searchsorted(doc, [begin, begin + size])
                rows = np.zeros((size, len(words)))
                np.add.at(rows, (doc[lo:hi] - begin, at[lo:hi]), x[lo:hi])
                score = rows @ y
                if "only" in left.column_names:
                    part = own[begin : begin + size]
                    score[(part[:, None] != asked[None, :]) | np.equal(part, None)[:, None]] = 0.0
                keep = score > 0
                if k is not None and k < size:
                    keep &= score >= np.partition(score, size - k, axis=0)[size - k] - slack
                d, q = np.nonzero(keep)
                found.append((d + begin, q, score[d, q]))
        if not found:
            return pa.table({"query_id": pa.array([], query_kind), "doc_id": pa.array([], doc_kind), "score": pa.array([], pa.float64())})
        d, q, s = (np.concatenate(parts) for parts in zip(*found, strict=True))
        return pa.table({"query_id": queries.take(pa.array(q)), "doc_id": docs.take(pa.array(d)), "score": pa.array(s)})

    return run


def _arrow(kind: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in kinds:
        raise ValueError(f"ids are long, int or string, not {kind}")
    return kinds[kind]


def products(left: DataFrame, right: DataFrame, k: int | None = None, slack: float = 0.0, docs: int = DOCS, queries: int = QUERIES) -> DataFrame:
    """(query_id, doc_id, score): the sum of x * y over the tokens that a document and a query share, where it is above zero.

    left: (id, token, x), a written table, read twice; right: (query_id, token, y), both weights above zero; with `only` in
    both, pairs of other or null labels are left out. With k, pairs that are not among the query's k best of their block, nor
    within `slack` of the k-th, may be missing: what is left holds all of the query's k best, also of scores that were rounded
    or raised by less than slack. Neither side is broadcast: documents and queries are dealt to blocks by hashes of their ids.
    What is moved is left once for each block of queries and right once for each block of documents.
    """
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["query_id"]
    sizes = left.agg(F.approx_count_distinct("id").alias("n")).first().n, right.agg(F.approx_count_distinct("query_id").alias("n")).first().n
    rows, columns = max(1, -(-sizes[0] // docs)), max(1, -(-sizes[1] // queries))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int")).withColumn("qb", number(columns))
    b = right.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(columns)).cast("int")).withColumn("db", number(rows))
    met = a.groupBy("db", "qb").cogroup(b.groupBy("db", "qb"))
    return met.applyInArrow(_products(k, slack, *map(_arrow, kinds)), f"query_id {kinds[1]}, doc_id {kinds[0]}, score double")


def best(left: DataFrame, right: DataFrame, k: int, slack: float = 0.0, digits: int = 6) -> DataFrame:
    """products() that hold each query's k best by scores rounded to `digits`, written, so that they are found once."""
    return written(products(left, right, k, slack + 2 * 10.0**-digits), "products")
