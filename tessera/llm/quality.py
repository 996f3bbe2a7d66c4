"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text has two kinds of terms: words and pairs of adjacent words, hashed into buckets; and its shape, which is trigrams of
byte classes (letter cases, digits, spaces and the kinds of punctuation) and soft buckets of how varied its words and
lines are. Log counts, weighted by inverse document frequency, are projected by a truncated SVD of the labelled sample,
one for each kind; both parts are scaled to unit length and weighed. Every document's cosines with all labelled vectors
are computed in blocks, exactly; its k nearest vote with weights that rise with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import buffers, mix, word_hashes
from tessera.llm.tables import fold, map_rows, table, text_blocks

#: Labelled rows to fit on, at most: those with the smallest hashes of their ids. Also bounds what is broadcast.
MAX_LABELLED = 4000
#: Dimensions of the two parts, and the part's share of a cosine: words and their pairs, shape.
DIMENSIONS, SHARES = (32, 48), (0.05, 0.95)
NEIGHBOURS = 24
#: A neighbour's weight is its cosine (0 at least) to this power.
SHARPNESS = 8.0
#: Predicted 1 from this score on.
CUT = 0.3
#: The query's folds: rows with crc32(doc_id) mod FOLDS = 0 are held out.
FOLDS = 5

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\x0b\x0c", ".", ",", "!?", "|", "*", "#", "$", "%", "&", "<>", "[]{}", "()", "\"'`", "-_", "/\\", "@", ":;"]
_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, _CLASSES - 1, np.int64)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _i
_CLASS[128:] = _CLASSES - 2
_TRIGRAMS = _CLASSES**3
#: Points between which a text's shares of distinct words, of distinct lines and of words unlike the one before are spread.
_KNOTS = np.array([0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0])
_SHAPE = _TRIGRAMS + 3 * len(_KNOTS)
#: Buckets of words and of pairs of words; they come after the terms of the shape.
BUCKETS = 1 << 12
TERMS = _SHAPE + BUCKETS
#: Weight of the variety terms against the length of the trigram part.
_VARIETY = 0.7


def _spread(value: float, at: int) -> tuple[list[int], list[float]]:
    k = int(np.clip(np.searchsorted(_KNOTS, value) - 1, 0, len(_KNOTS) - 2))
    share = (value - _KNOTS[k]) / (_KNOTS[k + 1] - _KNOTS[k])
    return [at + k, at + k + 1], [1 - share, share]


def terms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's terms and weights before idf: trigrams' log counts at unit length, variety, words' log counts at unit
    length. Empty: none."""
    data, offsets = buffers(texts)
    words, bounds = word_hashes(data, offsets)
    classes = _CLASS[data]
    codes = classes[:-2] * (_CLASSES * _CLASSES) + classes[1:-1] * _CLASSES + classes[2:] if len(data) > 2 else np.zeros(0, np.int64)
    raw = data.tobytes()
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words
    buckets = (words >> np.uint64(52)).astype(np.int64), (pairs >> np.uint64(52)).astype(np.int64)
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < 1:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        counts = np.bincount(codes[a : max(a, b - 2)], minlength=_TRIGRAMS)
        found = np.flatnonzero(counts)
        weight = np.log1p(counts[found])
        length = np.sqrt((weight * weight).sum()) or 1.0
        w = words[bounds[i] : bounds[i + 1]]
        lines = raw[a:b].split(b"\n")
        k1, v1 = _spread(len(np.unique(w)) / len(w) if len(w) else 1.0, _TRIGRAMS)
        k2, v2 = _spread(len(set(lines)) / len(lines), _TRIGRAMS + len(_KNOTS))
        k3, v3 = _spread(float((w[1:] != w[:-1]).mean()) if len(w) > 1 else 1.0, _TRIGRAMS + 2 * len(_KNOTS))
        lexical = np.bincount(np.r_[buckets[0][bounds[i] : bounds[i + 1]], buckets[1][bounds[i] : max(bounds[i], bounds[i + 1] - 1)]], minlength=BUCKETS)
        said = np.flatnonzero(lexical)
        often = np.log1p(lexical[said])
        out.append((np.r_[found, k1, k2, k3, _SHAPE + said], np.r_[weight / length, np.multiply(v1 + v2 + v3, _VARIETY), often / (np.sqrt((often * often).sum()) or 1.0)].astype(np.float32)))
    return out


def _directions(dense: np.ndarray, dimensions: int) -> np.ndarray:
    """The first right singular vectors, a column each: a randomised range finder with power steps.

    The sample is bounded, so this is a driver's work of seconds.
    """
    d = min(dimensions, *dense.shape)
    if not d:
        return np.zeros((dense.shape[1], 0), np.float32)
    probe = np.random.default_rng(7).standard_normal((dense.shape[1], min(d + 16, *dense.shape))).astype(np.float32)
    span = np.linalg.qr(dense @ probe)[0]
    for _ in range(3):
        span = np.linalg.qr(dense @ (dense.T @ span))[0]
    return np.linalg.svd(span.T @ dense, full_matrices=False)[2][:d].T


@dataclass
class NeighbourModel:
    """slot: each term's row of the projection or -1; split: the projection's first columns are of shapes, the rest of
    words; vectors and votes: the labelled sample."""

    slot: np.ndarray
    projection: np.ndarray
    split: int
    vectors: np.ndarray
    votes: np.ndarray
    prior: float
    neighbours: int

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, dimensions: tuple[int, int] = DIMENSIONS, neighbours: int = NEIGHBOURS) -> NeighbourModel:
        """rows: terms of the labelled texts; votes: their labels. No rows: every score is 0.5."""
        n = len(rows)
        df = np.zeros(TERMS)
        for at, _ in rows:
            df[at] += 1
        known = np.flatnonzero(df >= min(3, n)) if n else np.zeros(0, np.int64)
        slot = np.full(TERMS, -1, np.int32)
        slot[known] = np.arange(len(known))
        idf = np.log((1 + n) / (1 + df[known])) + 1
        dense = np.zeros((n, len(known)), np.float32)
        for i, (at, w) in enumerate(rows):
            ok = slot[at] >= 0
            dense[i, slot[at[ok]]] = w[ok]
        dense *= idf.astype(np.float32)
        shapes = int(np.searchsorted(known, _SHAPE))
        shape, lexical = _directions(dense[:, :shapes], dimensions[1]), _directions(dense[:, shapes:], dimensions[0])
        projection = np.zeros((len(known), max(1, shape.shape[1] + lexical.shape[1])), np.float32)
        projection[:shapes, : shape.shape[1]] = shape
        projection[shapes:, shape.shape[1] : shape.shape[1] + lexical.shape[1]] = lexical
        projection *= idf[:, None].astype(np.float32)
        model = cls(slot, projection, shape.shape[1], np.zeros((0, projection.shape[1]), np.float32), np.asarray(votes, np.float32), float(np.mean(votes)) if n else 0.5, neighbours)
        model.vectors = model.embed(rows)
        return model

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.projection.shape[1]), np.float32)
        for i, (at, w) in enumerate(rows):
            s = self.slot[at]
            ok = s >= 0
            out[i] = w[ok] @ self.projection[s[ok]]
        for part, share in ((out[:, self.split :], SHARES[0]), (out[:, : self.split], SHARES[1])):
            length = np.linalg.norm(part, axis=1, keepdims=True)
            np.divide(part * np.float32(share**0.5), length, out=part, where=length > 0)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 512) -> np.ndarray:
        """0 to 1. A text without known terms gets the share of label 1 among the labelled."""
        scores = np.full(len(rows), self.prior)
        if not len(self.vectors):
            return scores
        k = min(self.neighbours, len(self.vectors))
        for a in range(0, len(rows), block):
            cosines = self.embed(rows[a : a + block]) @ self.vectors.T
            nearest = np.argpartition(cosines, -k, axis=1)[:, -k:]
            weight = np.clip(np.take_along_axis(cosines, nearest, 1), 0, None).astype(float) ** SHARPNESS
            total = weight.sum(1)
            voted = (weight * self.votes[nearest]).sum(1)
            scores[a : a + block] = np.where(total > 1e-9, voted / np.maximum(total, 1e-9), self.prior)
        return np.clip(scores, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, folds: int | None = FOLDS) -> NeighbourModel:
    """Learns from labelled documents that are not in fold 0 (folds=None: from all), `max_labelled` at most.

    Labels other than 0 and 1 are skipped; of an id's labels the mean counts, of its texts the least. Terms are computed by
    the executors; the driver gets the sample's terms.
    """
    pool = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if folds is not None:
        pool = pool.where(fold("doc_id", folds) != 0)
    sample = pool.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    joined = labelled.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, chars=1_000_000):
            rows = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r[0].astype("<u4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "at", "w"])

    found = joined.mapInArrow(run, "doc_id long, quality double, at binary, w binary").orderBy("doc_id").collect()
    rows = [(np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.w, "<f4")) for r in found]
    return NeighbourModel.fit(rows, np.array([r.quality for r in found]))


def score(docs: DataFrame, model: NeighbourModel, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted. Only the text is an input.

    A null or empty text gets the share of label 1 among the labelled rows (0.5 if there are none). Equal texts get
    equal scores. An empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, chars=1_000_000):
            found = np.round(shared.value.score(terms(batch.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


def stage_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score `cut` or more, all columns; fitted on all labels' folds but 0, from docs' texts.

    Rows are scored where they lie, so ids may repeat or be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, chars=1_000_000):
            yield batch.filter(pa.array(np.round(shared.value.score(terms(batch.column("text"))), 6) >= cut))

    return map_rows(docs, run)
