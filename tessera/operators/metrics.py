"""Retrieval metrics: per query, averaged, filtered ranks, pessimistic ranks, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, hit, precision, recall, mrr, ndcg) from run (query_id, doc_id, rank) and qrels (query_id, doc_id).

    recall counts distinct hits and is null for a query without qrels; ndcg is 0 there. A query absent from the run gets
    zeros.
    """
    rels = qrels.select("query_id", "doc_id").distinct()
    counts = rels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    judged = run.join(rels.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    k_rows = queries.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(ks))))))
    hits = judged.where("hit = 1").select("query_id", "rank", "doc_id")
    rows = k_rows.join(hits, (k_rows["query_id"] == hits["query_id"]) & (hits["rank"] <= k_rows["k"]), "left").select(k_rows["query_id"], "k", "rank", "doc_id")
    agg = rows.groupBy("query_id", "k").agg(F.count("rank").alias("n"), F.count_distinct("doc_id").alias("distinct_n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    out = agg.join(counts, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("relevant", "k"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.select(
        "query_id", "k", (F.col("n") > 0).cast("int").alias("hit"), (F.col("n") / F.col("k")).alias("precision"),
        (F.col("distinct_n") / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("relevant").isNull(), 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


METRICS = ["hit", "precision", "recall", "mrr", "ndcg"]


def metrics_rollup(metrics: DataFrame, group: str) -> DataFrame:
    """Means by (k, group) and over all groups (group 'all'), in one pass over the metrics; nulls don't count."""
    sets = metrics.groupingSets([["k", group], ["k"]], "k", group)
    out = sets.agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n"), F.grouping(group).alias("__all"))
    return out.withColumn(group, F.when(F.col("__all") == 1, F.lit("all")).otherwise(F.col(group))).drop("__all")


def page_and_evidence_recall(run: DataFrame, docs: DataFrame, wanted: DataFrame, evidence: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, page_recall, evidence_recall): whether one of the k first lies on the evidence's page of its source, and
    whether one is evidence itself.

    run: (query_id, doc_id, rank); docs: (doc_id, source, page_start, page_end); wanted: (query_id, source or null, page);
    evidence: (query_id, doc_id). All of wanted have a row for each k.
    """
    found = run.join(docs.withColumnRenamed("source", "__s"), "doc_id").join(wanted, "query_id")
    page = (F.col("source").isNull() | (F.col("source") == F.col("__s"))) & F.col("page").between(F.col("page_start"), F.coalesce("page_end", "page_start"))
    told = evidence.select("query_id", "doc_id").distinct().withColumn("__e", F.lit(True))
    found = found.join(told, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min(F.when(page, F.col("rank"))).alias("__p"), F.min(F.when(F.col("__e"), F.col("rank"))).alias("__q"))
    rows = wanted.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(ks)))))).join(found, "query_id", "left")
    hit = lambda c: F.coalesce((F.col(c) <= F.col("k")).cast("double"), F.lit(0.0))
    return rows.select("query_id", "k", hit("__p").alias("page_recall"), hit("__q").alias("evidence_recall"))


def document_recall(found: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """(k, recall): the mean share of a query's gold documents among the k best of all types together.

    found: (query_id, type, doc_id, score), ranked by score, then type and id; a document may come once a type. gold:
    (query_id, doc_id); queries without gold don't count.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "type", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    rels = gold.select("query_id", "doc_id").distinct()
    first = ranked.join(rels, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    counts = rels.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hits = counts.join(first, "query_id", "left").groupBy("query_id", "k").agg((F.count_if(F.col("rank") <= F.col("k")) / F.first("n")).alias("recall"))
    return hits.groupBy("k").agg(F.avg("recall").alias("recall"))


def hard_ranks(scored: DataFrame, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """(by, tie, rank) of the rows whose booleans positive and hard hold: among the rows that aren't positive."""
    ranks = filtered_ranks(scored, by, score, tie)
    return ranks.join(scored.where("positive AND hard").select(by, tie), [by, tie], "left_semi").select(by, tie, F.col("filtered").alias("rank"))


def type_means(rows: DataFrame, value: str) -> DataFrame:
    """(name, value): the mean of each query type, of all types, of those without negation (EPFO) and of those with it.

    rows: (type, value), a row a query; a type with an n in its name has a negation.
    """
    types = rows.groupBy("type").agg(F.avg(value).alias("value"))
    names = F.array(F.concat(F.lit("["), F.col("type"), F.lit("]")), F.lit("all"), F.when(F.col("type").contains("n"), "[negation]").otherwise("[EPFO]"))
    return types.select(F.explode(names).alias("name"), "value").groupBy("name").agg(F.avg("value").alias("value"))


def filtered_ranks(scored: DataFrame, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Of rows with a boolean `positive`: each positive with rank_all, and rank among non-positives only (filtered)."""
    order = [F.desc(score), F.asc(tie)]
    ranked = scored.withColumn("rank_all", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    positive = ranked.where("positive").withColumn("rank_pos", F.row_number().over(Window.partitionBy(by).orderBy("rank_all")))
    return positive.select(by, tie, "rank_all", (F.col("rank_all") - F.col("rank_pos") + 1).alias("filtered"))


def filtered_rank_metrics(scored: DataFrame, ks: tuple[int, ...] = (1, 10), by: str = "query_id") -> DataFrame:
    """One row: mrr and hits@k averaged over positives, then queries; recall@k by unfiltered rank."""
    return filtered_means(filtered_ranks(scored, by), ks, by)


def filtered_means(ranks: DataFrame, ks: tuple[int, ...] = (1, 10), by: str = "query_id") -> DataFrame:
    """What filtered_rank_metrics() gives, from rows (by, rank_all, filtered) of the positives."""
    per = ranks.groupBy(by).agg(F.avg(1 / F.col("filtered")).alias("mrr"), *(F.avg((F.col("filtered") <= k).cast("double")).alias(f"hits_{k}") for k in ks), *(F.avg((F.col("rank_all") <= k).cast("double")).alias(f"recall_{k}") for k in ks))
    names = ["mrr", *(f"{m}_{k}" for k in ks for m in ("hits", "recall"))]
    return per.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("queries"))


def pessimistic_ranks(scored: DataFrame, by: str | list[str] = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """(by, tie, rank): for each positive 1 + the negatives that score as high or higher, of the same type if `by` names it.

    One window by score instead of a join of positives with negatives.
    """
    keys = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return scored.withColumn("rank", 1 + F.sum(F.when(F.col("positive"), 0).otherwise(1)).over(w)).where("positive").select(*keys, tie, "rank")


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: ~w.isin("a", "an", "the", "")), " ")


def answer_scores(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """(key, em, f1, precision, recall) of rows; tokens overlap as multisets, all in one row's arrays.

    If either side is yes, no or noanswer and they differ, all but em are 0.
    """
    p, g = normalize_answer(F.col(predicted)), normalize_answer(F.col(gold))
    base = rows.select(key, p.alias("p"), g.alias("g"), F.filter(F.split(p, " "), lambda x: x != "").alias("pt"), F.filter(F.split(g, " "), lambda x: x != "").alias("gt"))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    same = F.aggregate(F.array_distinct("pt"), F.lit(0), lambda s, x: s + F.least(count(F.col("pt"), x), count(F.col("gt"), x)))
    special = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    guard = (F.array_contains(special, F.col("p")) | F.array_contains(special, F.col("g"))) & (F.col("p") != F.col("g"))
    base = base.withColumn("n", F.when(guard, 0).otherwise(same))
    precision = F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(F.col("n"), F.size("pt")))
    recall = F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(F.col("n"), F.size("gt")))
    f1 = F.when(F.col("n") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return base.select(key, (F.col("p") == F.col("g")).cast("int").alias("em"), f1.alias("f1"), precision.alias("precision"), recall.alias("recall"))


def unbiased_hits(rank: Column, negatives: Column, k: int, sample: int) -> Column:
    """The chance to rank within k among `sample` drawn negatives: a binomial sum at f = (rank - 1) / negatives; without any it isn't a number."""
    from math import comb

    f = F.when(negatives != 0, (rank - 1) / negatives).otherwise(float("nan"))
    terms = [F.lit(float(comb(sample - 1, i))) * F.pow(f, F.lit(i)) * F.pow(1 - f, F.lit(sample - 1 - i)) for i in range(k)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def auroc(scored: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, auroc) by rank sums with average ranks for ties; null where a class is missing."""
    w = Window.partitionBy(by).orderBy(score)
    ties = F.count("*").over(Window.partitionBy(by, score))
    ranked = scored.withColumn("r", F.rank().over(w) + (ties - 1) / 2)
    agg = ranked.groupBy(by).agg(F.sum(F.when(F.col("positive"), F.col("r"))).alias("s"), F.count_if("positive").alias("p"), F.count("*").alias("n"))
    return agg.select(by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auroc"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, spearman): the correlation of average ranks."""

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    return rows.withColumn("rx", average_rank(x)).withColumn("ry", average_rank(y)).groupBy(by).agg(F.corr("rx", "ry").alias("spearman"))
