"""Semantic chunking of sentences, and greedy merging of neighbouring chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot, sentences
from tessera.operators.providers import HashingEncoder, encoded

#: Sentences of a window and the step between windows; least and most sentences of a chunk (fixed values).
WINDOW, STEP, LEAST, MOST = 32, 24, 3, 16
DIMENSIONS = 32
CHUNK = "doc_id long, chunk_no int, sentence_start int, sentence_end int, text string, vec array<double>"


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, sentence), ord from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.coalesce(text_col, F.lit("")))).alias("ord", "sentence"))


def hashed_vectors(rows: DataFrame, text: str = "sentence", dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds vec: the words' hashed counts at unit length; the deterministic encoder that stands in for a learnt one."""
    return encoded(rows, text, HashingEncoder(dimensions))


def neighbour_distances(rows: DataFrame) -> DataFrame:
    """Adds distance: one minus the cosine of a sentence's vector and the next one's; null for the last."""
    after = F.lead("vec").over(Window.partitionBy("doc_id").orderBy("ord"))
    return rows.withColumn("__next", after).withColumn("distance", F.when(F.col("__next").isNotNull(), 1 - dot(F.col("vec"), F.col("__next")))).drop("__next")


def breakpoints(rows: DataFrame, percentile: float = 0.95) -> DataFrame:
    """(doc_id, ord): ends of stretches, where the distance reaches the percentile of any window that holds it.

    Windows are WINDOW sentences, STEP apart, the last clipped; those of fewer than two distances are skipped. A distance
    belongs to the windows that hold both its sentences.
    """
    n = F.count("*").over(Window.partitionBy("doc_id"))
    d = rows.withColumn("n", n).where("distance IS NOT NULL")
    first = F.greatest(F.ceil((F.col("ord") + 2 - WINDOW) / STEP), F.lit(0))
    last = F.least(F.floor(F.col("ord") / STEP), F.greatest(F.ceil((F.col("n") - WINDOW) / STEP), F.lit(0)))
    held = d.where(first <= last).select("doc_id", "ord", "distance", F.explode(F.sequence(first, last)).alias("w"))
    limit = held.groupBy("doc_id", "w").agg(F.percentile("distance", percentile).alias("limit"), F.count("*").alias("k")).where("k >= 2")
    return held.join(limit, ["doc_id", "w"]).where("distance >= limit").select("doc_id", "ord").distinct()


def _runs(cuts: list[bool], least: int, most: int) -> list[tuple[int, int]]:
    """Bounds of chunks: a cut counts from `least` sentences on, `most` force one, a short tail joins the chunk before."""
    bounds, start = [], 0
    for i, cut in enumerate(cuts):
        size = i - start + 1
        if size >= most or (cut and size >= least):
            bounds.append((start, i + 1))
            start = i + 1
    if start < len(cuts):
        if bounds and len(cuts) - start < least:
            bounds[-1] = (bounds[-1][0], len(cuts))
        else:
            bounds.append((start, len(cuts)))
    return bounds


def segments(rows: DataFrame, cuts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, chunk_no, sentence_start, sentence_end, text, vec) of each run of sentences, see _runs; vec is their mean.

    Rows of a document come together sorted, a partition of documents at a time; the state machine over a document is
    the only step in Python, and a document's rows are bounded by its length.
    """
    joined = rows.join(cuts.withColumn("cut", F.lit(True)), ["doc_id", "ord"], "left").select("doc_id", "ord", "sentence", "vec", F.coalesce("cut", F.lit(False)).alias("cut"))
    packed = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "sentence", "vec", "cut"))).alias("s"))
    lists = packed.select("doc_id", F.col("s.sentence").alias("sentence"), F.col("s.vec").alias("vec"), F.col("s.cut").alias("cut"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                vec = np.stack(list(r.vec))
                for k, (a, b) in enumerate(_runs(list(r.cut), least, most)):
                    mean = vec[a:b].mean(0)
                    out.append((r.doc_id, k, a, b - 1, " ".join(r.sentence[a:b]), mean / (np.linalg.norm(mean) or 1.0)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "sentence_start", "sentence_end", "text", "vec"])

    return lists.mapInPandas(run, CHUNK)


def merged(chunks: DataFrame, similarity: float = 0.85, most_sentences: int = 32, most_words: int = 1000) -> DataFrame:
    """Neighbouring chunks joined while the next one is this similar to the running normalised vector, within limits."""
    fields = ["chunk_no", "sentence_start", "sentence_end", "text", "vec"]
    packed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c")).select("doc_id", *(F.col(f"c.{f}").alias(f) for f in fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                out: list[list] = []
                for start, end, text, vec in zip(r.sentence_start, r.sentence_end, r.text, r.vec, strict=True):
                    vec = np.asarray(vec)
                    if out:
                        last = out[-1]
                        words = len(last[4].split()) + len(text.split())
                        if float(last[5] @ vec) >= similarity and end - last[2] + 1 <= most_sentences and words <= most_words:
                            mean = last[5] + vec
                            last[3], last[4], last[5] = end, f"{last[4]} {text}", mean / (np.linalg.norm(mean) or 1.0)
                            continue
                    out.append([r.doc_id, len(out), start, end, text, vec])
                rows += out
            yield pd.DataFrame(rows, columns=["doc_id", *fields])

    return packed.mapInPandas(run, CHUNK)


def semantic_chunks(docs: DataFrame, encode=hashed_vectors) -> DataFrame:  # noqa: ANN001
    """Sentences, windowed breakpoints, segments and merging in one."""
    rows = neighbour_distances(encode(sentence_rows(docs)))
    return merged(segments(rows, breakpoints(rows)))
