"""Hooks for models that live elsewhere, with deterministic defaults that need no network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Generator(Protocol):
    """A language model: one text for one prompt."""

    def generate(self, prompt: str) -> str: ...


class Encoder(Protocol):
    """A text encoder: one vector for each text."""

    def encode(self, texts: list[str], is_query: bool = False) -> list[list[float]]: ...


class Recogniser(Protocol):
    """A named-entity recogniser."""

    def __call__(self, text: str) -> list[str]: ...


class CapitalisedNames:
    """Runs of capitalised words, the first of each: the recogniser used where none is given."""

    def __call__(self, text: str) -> list[str]:
        return list(dict.fromkeys(m[0].strip() for m in re.finditer(r"(?:[A-Z][\w&.-]+ ?){1,5}", text or "")))


class HashingEncoder:
    """Hashed word counts at unit length: the encoder used where none is given."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str], is_query: bool = False) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"[a-z0-9]+", (text or "[unknown]").lower()):
                v[zlib.crc32(w.encode()) % self.dimensions] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def with_retries(call: Callable[[str], str], tries: int = 3) -> Callable[[str], str]:
    """call, again after an error, `tries` times at most; the last error is raised."""

    def run(prompt: str) -> str:
        for left in reversed(range(tries)):
            try:
                return call(prompt)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    return run


def encoded(rows: DataFrame, text: str, encoder: Encoder | None = None, out: str = "vec", prefix: str = "") -> DataFrame:
    """Adds a vector of each row's text; batches go to the encoder as they come."""
    model = encoder or HashingEncoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = model.encode([prefix + (t or "") for t in batch[text]])
            yield batch

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} array<double>"]))


def recognised(rows: DataFrame, text: str, recogniser: Recogniser | None = None, out: str = "entities") -> DataFrame:
    """Adds the entities of each row's text."""
    model = recogniser or CapitalisedNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [model(t or "") for t in batch[text]]
            yield batch

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} array<string>"]))


def reason(question: str, retrieve: Callable[[str], list[tuple[str, float]]], think: Callable[[str, list[str]], str], steps: int = 3, k: int = 10) -> tuple[str, list[tuple[str, float]]]:
    """Retrieve, think, stop at 'So the answer is:', else retrieve with the thought; lists are merged by their best score."""
    found: dict[str, float] = {}
    thoughts: list[str] = []
    query = question
    for _ in range(steps):
        for doc, score in retrieve(query):
            found[doc] = max(score, found.get(doc, score))
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        thought = think(question, [d for d, _ in best])
        thoughts.append(thought)
        if "so the answer is:" in thought.lower():
            break
        query = thought
    return " ".join(thoughts), sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]


class PairScorer(Protocol):
    """A cross-encoder: one score for each pair of texts."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def reranked(rows: DataFrame, k: int, query: str, text: str, fallback: Column, scorer: PairScorer | None = None, weight: float = 1.0) -> DataFrame:
    """The k best of rows (query_id, doc_id, score, and both texts) after the scorer's scores, or without one the fallback,
    are added `weight` times."""
    from tessera.operators.lexical import top_k

    if scorer is None:
        return top_k(rows.withColumn("score", F.col("score") + weight * fallback), k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] += weight * pd.Series(scorer.predict(list(zip(batch[query], batch[text], strict=True))), index=batch.index, dtype=float)
            yield batch

    return top_k(rows.withColumn("score", F.col("score").cast("double")).mapInPandas(run, rows.withColumn("score", F.col("score").cast("double")).schema), k)


def picked(candidates: DataFrame, picks: DataFrame, most: int) -> DataFrame:
    """Of ranked candidates (query_id, doc_id, score, rank) those that a model picked by their ranks, in its order, `most` at
    most; where it picked none that exists, the first `most`. picks: (query_id, picks array<int> or null)."""
    told = picks.select("query_id", F.posexplode("picks").alias("place", "rank"))
    chosen = candidates.join(told, ["query_id", "rank"])
    rest = candidates.join(chosen.select("query_id").distinct(), "query_id", "left_anti").withColumn("place", F.col("rank") - 1)
    both = chosen.select("query_id", "doc_id", "score", "place").unionByName(rest.select("query_id", "doc_id", "score", "place"))
    order = Window.partitionBy("query_id").orderBy("place", "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("place")


def repaired(generated: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, text, doc_id): for each text that a model wrote, its query's candidate (query_id, doc_id, name) with the
    fewest letters to change (ties: the smaller id)."""
    pairs = generated.join(candidates, "query_id").select("query_id", "text", F.struct(F.levenshtein(F.lower("text"), F.lower("name")).alias("d"), "doc_id").alias("x"))
    return pairs.groupBy("query_id", "text").agg(F.min("x").alias("x")).select("query_id", "text", F.col("x.doc_id").alias("doc_id"))


class Evaluator(Protocol):
    """Figures by name of a table of results."""

    def __call__(self, results: DataFrame) -> dict[str, float]: ...


class MeanOf:
    """The means of columns, nulls left out: the evaluator used where none is given."""

    def __init__(self, *columns: str) -> None:
        self.columns = columns

    def __call__(self, results: DataFrame) -> dict[str, float]:
        return results.agg(*(F.avg(c).alias(c) for c in self.columns)).first().asDict()


class GraphBuilder(Protocol):
    """Makes (nodes, edges) of a table of chunks (chunk_id, passage)."""

    def build(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class RuleGraph:
    """Entities by a recogniser, triples by words of change, assembled: the builder used where none is given."""

    def __init__(self, recogniser: Recogniser | None = None) -> None:
        self.recogniser = recogniser

    def build(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        from tessera.operators.extraction import change_triples
        from tessera.operators.graph import assemble

        rows = recognised(chunks.select("chunk_id", "passage"), "passage", self.recogniser)
        mentions = rows.select("chunk_id", F.posexplode("entities").alias("ord", "entity"))
        return assemble(mentions.select("chunk_id", "entity", "ord"), change_triples(rows))


class Tagger(Protocol):
    """The tags of a text, by field."""

    def __call__(self, text: str) -> dict[str, list[str]]: ...


def tagged(rows: DataFrame, text: str, tagger: Tagger, out: str = "tags") -> DataFrame:
    """Adds a map of each row's tags; a tagger that fails gives an empty one."""

    def one(t: str | None) -> dict[str, list[str]]:
        try:
            return tagger(t or "")
        except Exception:  # a model's failure costs its row's tags, nothing else
            return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [one(t) for t in batch[text]]
            yield batch

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} map<string,array<string>>"]))


def qa_prompt(question: Column, passages: Column, most_chars: int = 12_000) -> Column:
    """A prompt of numbered passages, cut to most_chars, and the question after them."""
    body = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    return F.concat(F.substring(body, 1, most_chars), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def answered(rows: DataFrame, prompt: str, generator: Generator, tries: int = 3, out: str = "answer") -> DataFrame:
    """Adds the model's answer to each row's prompt, asked again after an error, and null if that fails too."""
    ask = with_retries(generator.generate, tries)

    def one(p: str) -> str | None:
        try:
            return ask(p)
        except Exception:  # the last try's error: the row has no answer
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [one(p) for p in batch[prompt]]
            yield batch

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} string"]))
