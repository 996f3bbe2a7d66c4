"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide.

1. Each task builds counting quotient filters of its texts' 64-bit fingerprints, cut into blocks by their top bits.
2. A block's filters from all tasks are merged by sorted remainders; a copy group is one entry a task however large.
3. Texts whose fingerprint is counted more than once are grouped by their bytes (with partial aggregation, so each
   task sends a text once). Texts are compared, not digests. A bitmap of the repeated fingerprints, of fixed size, is
   broadcast first, so that few other texts are moved; those that pass are joined to the whole fingerprints.
4. Documents meet their group by digest; the heaviest groups are broadcast, see left_join_unique.

The text of a document whose fingerprint is unique is never shuffled, up to the bitmap's false positives; those are never
grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.quotient_filter import CountingQuotientFilter
from tessera.llm.sieve import bitmap, split
from tessera.llm.tables import table
from tessera.operators.joins import free_prefix, left_join_unique
from tessera.session import written

#: Distinct fingerprints that a merged block is to hold on average (8 to 16 bytes each).
BLOCK_PRINTS = 1 << 20
#: Fingerprints that a task gathers before it sends its filters.
TASK_PRINTS = 1 << 20


def repeated_fingerprints(docs: DataFrame, fingerprint: str = "fp", rows: int | None = None) -> DataFrame:
    """(fp, n): the fingerprints that occur more than once, n times. fingerprint: a long column; nulls are skipped."""
    rows = docs.count() if rows is None else rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(int(np.ceil(np.log2(max(1, rows / BLOCK_PRINTS)))), int(np.ceil(np.log2(max(1, parts)))), 1)
    low = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            prints = np.sort(np.concatenate(held))
            blocks = (prints >> np.uint64(low)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            mask, ids, payloads = np.uint64((1 << low) - 1), [], []
            for a, b in zip(edges, np.r_[edges[1:], len(prints)], strict=True):
                within = max(1, min(16, int(np.log2(b - a + 1))))
                ids.append(int(blocks[a]))
                payloads.append(CountingQuotientFilter.build(prints[a:b] & mask, within, low).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], ["block", "filter"])

        for batch in batches:
            column = batch.column(0).drop_null()
            if len(column):
                held.append(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                size += len(column)
            if size >= TASK_PRINTS:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def merge(key: tuple, filters: pa.Table) -> pa.Table:
        merged: CountingQuotientFilter | None = None
        stack: list[tuple[int, CountingQuotientFilter]] = []
        for data in filters.column("filter"):
            one = CountingQuotientFilter.from_bytes(data.as_buffer().to_pybytes())
            level = 0
            while stack and stack[-1][0] == level:  # merged two by two, so that each print moves log(filters) times
                one, level = one.merge(stack.pop()[1]), level + 1
            stack.append((level, one))
        while stack:
            top = stack.pop()[1]
            merged = top if merged is None else merged.merge(top)
        many = merged.counts > 1
        prints = merged.prints()[many] | np.uint64(key[0].as_py() << low)
        return pa.table({"fp": pa.array(prints.view(np.int64)), "n": pa.array(merged.counts[many])})

    filters = docs.select(F.col(fingerprint).cast("long")).mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def copies(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of base (doc_id, t) whose text's fingerprint is one of repeated (fp, n), a written table."""
    passed, _ = split(base, F.xxhash64("t"), bitmap(repeated, "fp"))
    return left_join_unique(passed.withColumn("fp", F.xxhash64("t")), repeated, "fp", "n", ["n"]).where("n IS NOT NULL").select("doc_id", "t")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; nothing is normalised, null counts as empty. Of equal texts the
    largest id stays. Rows that repeat id and text are the same document: each is reported, counts in group_size,
    and is kept if its id is. A null id is never kept unless the whole group has none, and then keep_id is null and
    kept true. An empty table gives an empty result. Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    repeated = written(repeated_fingerprints(base.select(F.xxhash64("t").alias("fp")), rows=docs.count()), "repeated")
    groups = copies(base, repeated).groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.select(F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    rows = base.select("doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"))
    out = left_join_unique(rows, groups, "text_sha256", "group_size", ["keep_id", "group_size"])
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.expr("doc_id <=> CASE WHEN group_size IS NULL THEN doc_id ELSE keep_id END").alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def digest_of(text: str = "text") -> Column:
    """The SHA-256 of a text's bytes, in hex; null counts as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def one_of_each(rows: DataFrame, columns: list[str], *keys: Column) -> DataFrame:
    """Of the rows with equal keys the least one, by columns, which are the result's. Tasks send one row a key."""
    p = free_prefix(*rows.columns)
    least = F.min(F.struct(*(F.col(f"`{c}`") for c in columns)))
    return rows.groupBy(*(k.alias(f"{p}k{i}") for i, k in enumerate(keys))).agg(least.alias(f"{p}row")).select(f"{p}row.*")


def stage_exact_dedup(docs: DataFrame) -> DataFrame:
    """Of the rows of docs that exact_dedup keeps, all columns, one for each id and text; of equal texts without ids one.

    Rows whose text's fingerprint is unique stay where they are. To the others the decisions are joined by id and digest,
    so rows of one id with different texts are judged apart. Where rows repeat id and text but not other columns, the
    least one by all columns stays. Further columns may have any names.
    """
    p = free_prefix(*docs.columns)
    text = F.coalesce("text", F.lit(""))
    repeated = written(repeated_fingerprints(docs.select(F.xxhash64(text).alias("fp"))), "repeated")
    rest, alone = split(docs, F.xxhash64(text), bitmap(repeated, "fp"))
    kept = exact_dedup(rest).where("kept").groupBy(F.col("doc_id").alias(f"{p}id"), F.col("text_sha256").alias(f"{p}sha")).agg(F.count("*").alias(f"{p}rows"))
    kept = written(kept, "kept")
    own = digest_of()
    same = rest["doc_id"].eqNullSafe(F.col(f"{p}id")) & (own == F.col(f"{p}sha"))
    out = alone.union(rest.join(kept.where(f"{p}rows = 1"), same, "left_semi"))
    again = kept.where(f"{p}rows > 1")
    if again.isEmpty():
        return out
    return out.union(one_of_each(rest.join(again, same, "left_semi"), docs.columns, F.col("doc_id"), own))
