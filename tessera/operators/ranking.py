"""Keep-first and keep-last, positions, splits, round robin, grouped softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in `order`."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def keep_last(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The last row of each key in `order`, by one aggregation with partial maxima."""
    rest = [c for c in rows.columns if c not in order]
    best = rows.groupBy(key.alias("__key")).agg(F.max(F.struct(*order, *rest)).alias("s"))
    return best.select(*(F.col(f"s.{c}").alias(c) for c in rows.columns))


def dense_ids(rows: DataFrame, order: str, out: str = "id") -> DataFrame:
    """Adds 0, 1, 2 ... in the order of a sortable column, without a single-task window.

    Rows are range-partitioned and sorted; each partition counts from the sum of the counts before it. The partitions'
    counts (one row a partition) are all that is gathered.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    parts = written(parts, "ordered")  # range bounds are sampled: a second evaluation could deal rows otherwise
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("__base"))
    starts = counts.withColumn("__start", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", "__base", F.coalesce("__start", F.lit(0)).alias("__start"))
    return parts.join(F.broadcast(starts), "__p").withColumn(out, F.col("__i") - F.col("__base") + F.col("__start")).drop("__p", "__i", "__base", "__start")


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, one group after another in the order of first appearance, round after round."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("round", F.row_number().over(w.orderBy(order))).withColumn("__first", F.min(order).over(w))
    return ranked.where(F.col("round") <= n).orderBy("round", "__first").limit(n).drop("__first")


def positional_split(rows: DataFrame, order: str, every: int = 5) -> DataFrame:
    """Adds split: dev for each `every`-th row by position, else test."""
    return dense_ids(rows, order, "__pos").withColumn("split", F.when(F.col("__pos") % every == 0, "dev").otherwise("test")).drop("__pos")


def softmax(rows: DataFrame, by: str, value: str, out: str = "softmax") -> DataFrame:
    """Adds the softmax over the group, with the group's maximum taken off first."""
    top = rows.groupBy(by).agg(F.max(value).alias("__m"))
    e = rows.join(top, by).withColumn("__e", F.exp(F.col(value) - F.col("__m")))
    total = e.groupBy(by).agg(F.sum("__e").alias("__s"))
    return e.join(total, by).withColumn(out, F.col("__e") / F.col("__s")).drop("__m", "__e", "__s")


def worst_cases(metrics: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with the lowest hit, mrr and recall (a report)."""
    return metrics.orderBy("hit", "mrr", F.asc_nulls_first("recall"), key).limit(n)


def variadic(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds, within each group: place (0, 1 ... by `order`, unique there), sorted (its place by value, largest first), sum, mean.

    Sums are aggregated before they meet the rows; a group's places need its rows together, sorted, in one task.
    """
    w = Window.partitionBy(by)
    totals = rows.groupBy(by).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("sorted", F.row_number().over(w.orderBy(F.desc(value), order)) - 1)
    return placed.join(totals, by)


def extend(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Both lists (by, order, ...) of each group, one after the other: adds `part` (0 or 1) and place (0, 1 ...)."""
    both = left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("part", order)) - 1)


def slices(rows: DataFrame, by: str, place: str, spans: DataFrame) -> DataFrame:
    """The rows whose place lies in one of their group's spans (by, start, end), end exclusive; each row once."""
    spans = spans.select(F.col(by).alias("__by"), "start", "end")
    return rows.join(spans, (F.col(by) == F.col("__by")) & (F.col(place) >= F.col("start")) & (F.col(place) < F.col("end")), "left_semi")


def padded(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """ranked (by, rank, ...) with k rows for each group: where it has fewer, all other columns are null."""
    places = ranked.select(by).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k)).cast("array<bigint>")))
    return places.join(ranked.where(F.col("rank") <= k), [by, "rank"], "left")
