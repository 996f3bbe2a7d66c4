"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are byte 3- and 4-grams of lower-cased text in which all that is no letter is one boundary mark. A text's vector
is the mean of its subwords' embeddings; embeddings and softmax are trained together by stochastic gradient descent in
numpy. A linear layer on a mean is the mean of what the layer makes of each embedding, so prediction sums one small
table row per subword. A temperature fitted on rows kept out of the descent calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import buffers
from tessera.llm.tables import fold, table, text_blocks

#: Training rows, at most: those with the smallest hashes of their ids; and bytes of their texts, at most. A row whose
#: text would go beyond is left out as a whole; texts are never cut short.
MAX_TRAINING, MAX_BYTES = 3000, 8_000_000
#: Training texts are learnt in pieces of this many bytes, so that short texts are learnt too; all pieces count.
PIECE = 400
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 4
RATE = 0.5
#: Below this calibrated score a prediction is marked as rejected.
REJECT = 0.5
FOLDS, HELD_OUT = 4, 2
_NONE, _MARKS = pa.scalar("", pa.large_string()), pa.scalar("\n\n\n", pa.large_string())
#: Bytes of text that are scored at a time.
STEP = 1 << 20

_MARK = np.zeros(256, np.uint32)
_MARK[97:123] = np.arange(97, 123)
_MARK[65:91] = np.arange(97, 123)
_MARK[128:] = np.arange(128, 256)


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the 3-gram and of the 4-gram that begin at each byte (of fewer bytes at the end: of marks)."""
    c = np.zeros(len(data) + 3, np.uint32)
    c[: len(data)] = _MARK[data]
    n = len(data)
    three = (c[:n] << np.uint32(16)) | (c[1 : n + 1] << np.uint32(8)) | c[2 : n + 2]
    four = (three << np.uint32(8)) | c[3 : n + 3]
    shift = np.uint32(32 - int(np.log2(BUCKETS)))
    return (three * np.uint32(2654435761)) >> shift, ((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> shift


@dataclass
class LanguageModel:
    languages: list[str]
    tables: np.ndarray
    bias: np.ndarray
    temperature: float

    @classmethod
    def fit(cls, texts: list[str], languages: list[str], seed: int = 3) -> LanguageModel:
        """Without rows the model knows no language and predicts und."""
        names = sorted(set(languages))
        y = np.array([names.index(x) for x in languages], np.int64)
        rng = np.random.default_rng(seed)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            for a in range(0, max(1, len(raw)), PIECE):
                pieces.append(raw[a : a + PIECE])
                owner.append(i)
        chosen = rng.permutation(len(pieces))
        kept_out = np.array([owner[i] % 5 == 0 for i in chosen], bool)
        embedding = rng.normal(0, 0.1, (2 * BUCKETS, WIDTH)).astype(np.float32)
        softmax = np.zeros((WIDTH, max(len(names), 1)), np.float32)
        bias = np.zeros(max(len(names), 1), np.float32)
        bags = {}
        for i in chosen:
            three, four = subwords(pieces[i])
            at, counts = np.unique(np.r_[three, four.astype(np.int64) + BUCKETS].astype(np.int64), return_counts=True)
            bags[i] = at, (counts / max(1, counts.sum())).astype(np.float32)
        steps = EPOCHS * int((~kept_out).sum())
        done = 0
        for _ in range(EPOCHS):
            for i in rng.permutation(chosen[~kept_out]):
                at, w = bags[i]
                if not len(at):
                    continue
                rate = RATE * (1 - done / max(steps, 1))
                done += 1
                mean = w @ embedding[at]
                z = mean @ softmax + bias
                z = np.exp(z - z.max())
                z /= z.sum()
                z[y[owner[i]]] -= 1
                back = softmax @ z
                softmax -= rate * np.outer(mean, z)
                bias -= rate * 0.1 * z
                embedding[at] -= (rate * 16) * w[:, None] * back
        model = cls(names, (embedding @ softmax).astype(np.float32), bias, 1.0)
        rows = [bags[i] for i in chosen[kept_out] if len(bags[i][0])]
        if names and rows:
            z = np.array([w @ model.tables[at] for at, w in rows]) + bias
            truth = y[[owner[i] for i in chosen[kept_out] if len(bags[i][0])]]
            grid = np.geomspace(0.25, 16, 25)
            model.temperature = float(grid[np.argmin([cls._loss(z / t, truth) for t in grid])])
        return model

    @staticmethod
    def _loss(z: np.ndarray, truth: np.ndarray) -> float:
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A row of calibrated probabilities for each text, over whole texts."""
        lengths = np.diff(buffers(texts)[1])
        # three marks after each text keep its subwords from reaching into the next one; their own sums are set to nought
        data, offsets = buffers(pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), _NONE, _MARKS))
        marks = (offsets[1:, None] - np.array([3, 2, 1])).ravel()
        sums = np.zeros((len(texts), len(self.bias)))
        for a in range(0, len(data), STEP):
            b = min(len(data), a + STEP)
            three, four = subwords(data[a : min(len(data), b + 3)])
            each = self.tables[three[: b - a]] + self.tables[four[: b - a].astype(np.int64) + BUCKETS]
            each[marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)] - a] = 0
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left") - 1
            starts = np.maximum(offsets[first : last + 1], a) - a
            sums[first : last + 1] += np.add.reduceat(each, starts, axis=0)
        z = (sums / np.maximum(2 * lengths, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = buffers(texts)
    ascii_letter = np.r_[0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))]
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def fit(docs: DataFrame, folds: int | None = FOLDS, held_out: int = HELD_OUT, max_training: int = MAX_TRAINING, max_bytes: int = MAX_BYTES) -> LanguageModel:
    """Learns from rows with text and lang that are not in the held-out fold (folds=None: from all), a bounded sample.

    Rows that repeat id and text are one, with the least lang. The sample goes by hashes of the ids, up to max_training
    rows, of which those are left out that would make their texts more than max_bytes.
    """
    pool = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    if folds is not None:
        pool = pool.where(fold("doc_id", folds) != held_out)
    named = pool.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "lang", "text")
    rows = named.groupBy("doc_id", "h").agg(F.min("lang").alias("lang"), F.max(F.octet_length("text")).alias("size"))
    chosen, size = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_training).collect():
        if size + r["size"] <= max_bytes:
            chosen.append((r.doc_id, r.h, r.lang))
            size += r["size"]
    if not chosen:
        return LanguageModel.fit([], [])
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, known string")
    found = named.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h", "known").agg(F.min("text").alias("text"))
    found = sorted(found.collect(), key=lambda r: (r.doc_id, r.h))
    return LanguageModel.fit([r.text for r in found], [r.known for r in found])


def identify(docs: DataFrame, model: LanguageModel, reject: float = REJECT) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, rejected. Only the text is an input.

    lang_pred is und, score 0 and rejected true if the text is null or has no letter, or if the model has no language.
    Otherwise the likeliest language (of equals the first by name), its calibrated probability, and whether that is below
    `reject`. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in text_blocks(batches, chars=STEP):
            texts = batch.column("text")
            p = m.probabilities(texts)
            known = has_letter(texts) & (len(m.languages) > 0)
            best = np.where(known, p.argmax(1), len(names) - 1)
            value = np.where(known, np.round(p.max(1), 6), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(value), pa.array(~known | (value < reject))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
