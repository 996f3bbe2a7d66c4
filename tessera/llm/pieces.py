"""Encoding by a SentencePiece vocabulary, with the ids that its own encoder gives.

An Aho-Corasick automaton of all pieces reads a word once and drives a single-pass Viterbi: at each position its output
links list every piece that ends there, each of which may relax the best path to that position.

A unigram vocabulary's path has the largest sum of piece scores. A BPE vocabulary's scores are ranks of merges, and the
largest sum of them is not its encoding. There a path counts as better only if it is what merging gives: a sequence of
pieces is the encoding of its text exactly if each two neighbours are the encoding of theirs, so of the pieces that end at
a position just one goes with the last piece of the path before it (tests hold the ids against SentencePiece's).

A character that no piece covers is taken as its UTF-8 bytes' pieces (byte fallback). Spaces become the vocabulary's mark,
and one is put before the text; no piece holds a mark after another character, so a text's best path is its words' best
paths. Decoding joins pieces and bytes: decode(encode(text)) is the text, but for the mark character, which is a space to
the vocabulary and comes back as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tessera.llm.tables import kept, table, text_blocks

MARK = "▁"
#: Words whose ids a worker remembers, in each of two generations.
MEMORY = 300_000
#: Added to a byte's score, so that bytes are taken only where no piece is.
BYTE_COST = -1e6
_RUNS = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """Pieces, scores and the automaton of a model file; control and unknown pieces take no part."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.byte_of)] = True
        self.automaton = ahocorasick.Automaton()
        plain = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), float(model.get_score(i)), i))
        self.automaton.make_automaton()
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds the mark after another character; words can't be encoded apart")
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        self.merges = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.scores = {self.pieces[i]: float(model.get_score(i)) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memory, self.young, self.old = memory, {}, {}

    def best_path(self, word: str) -> list[int]:
        """Ids of the path with the largest score; of equal ones the one with the longer last pieces."""
        n = len(word)
        score = [0.0] + [None] * n
        last: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0

        def fill(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if score[at] is None:
                    score[at] = score[at - 1] + BYTE_COST
                    last[at] = (1, -1)

        for end, (length, s, i) in self.automaton.iter(word):
            end += 1
            if end > at + 1:
                fill(end - 1)
            total = score[end - length] + s
            if score[end] is None or total > score[end]:
                if end > at and at == end - 1 and score[end - 1] is not None and total < score[end - 1] + BYTE_COST:
                    continue
                score[end], last[end] = total, (length, i)
        fill(n)
        out: list[int] = []
        while n:
            length, i = last[n]
            if i < 0:
                out += [self.bytes[b] for b in reversed(word[n - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            n -= length
        return out[::-1]

    def merged(self, word: str) -> list[str]:
        """A short word's pieces by merges: again and again the two neighbours whose union has the best score (of equal ones
        the first) become one."""
        parts = list(word)
        while len(parts) > 1:
            best = max(((self.scores.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)), default=None)
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _go_together(self, left: str, right: str) -> bool:
        """Whether merging leaves left and right, put together, as they are; left may be empty."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * self.memory:
                self.pairs = {}
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def merge_path(self, word: str) -> list[int]:
        """Ids of the path that merging gives."""
        last = [""] * (len(word) + 1)  # the last piece of the path to each position
        at = 0
        for end, (length, _, i) in self.automaton.iter(word):
            end += 1
            while at < end - 1:  # no piece that ends between goes with what stands before: single characters
                at += 1
                last[at] = last[at] or word[at - 1]
            if not last[end]:
                piece = self.pieces[i]
                if self._go_together("", piece) and self._go_together(last[end - length], piece):
                    last[end] = piece
        out: list[int] = []
        at = len(word)
        while at:
            piece = last[at] or word[at - 1]
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            at -= len(piece)
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; of an empty one none."""
        if not text:
            return np.zeros(0, "<u4")
        path = self.merge_path if self.merges else self.best_path
        words = _RUNS.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.young.get, words))
        if None in found:
            if len(self.young) > self.memory:
                self.old, self.young = self.young, {}
            for k, ids in enumerate(found):
                if ids is None:
                    w = words[k]
                    ids = self.young.get(w) or self.old.get(w) or np.array(path(w), "<u4").tobytes()
                    self.young[w] = found[k] = ids
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. A text's own mark characters come back as spaces."""
        if not self.is_byte[ids].any():
            return "".join(map(self.pieces.__getitem__, ids.tolist()))[1:].replace(MARK, " ")
        parts: list[str] = []
        held = bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(self.pieces[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)[1:].replace(MARK, " ")


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, n_bytes (byte pieces), ids_crc32, round_trip, and ids if with_ids.

    round_trip says that decoding gives the text back. It does for every text but those that hold the mark character
    itself, which comes back as a space. A null or empty text has no pieces and round_trip true. An empty table gives
    an empty result; other columns are not looked at.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(PieceModel, path)
        for batch in text_blocks(batches, chars=1_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [pieces.encode(t) for t in texts]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(pieces.is_byte[x].sum()) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)]), pa.array([x.tobytes() if with_ids else None for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean, ids binary")
    return out if with_ids else out.drop("ids")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
