"""Vector bin packing of tokenised documents into training sequences.

A piece of a document has a demand vector: tokens, segments (1) and loss-bearing tokens. Sequences have a capacity in
each. A task gathers documents up to a number of tokens, cuts full sequences off long ones, and places what remains by
the dot-product heuristic: the open sequence takes the piece whose demand has the largest dot product with what is left
of its capacities. When no whole piece fits, one is cut to fill the sequence (cutting is free), unless another
capacity is used up. The task's last sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.shingles import EXACT, buffers, hashed_words
from tessera.llm.tables import kept, release_memory, table, text_blocks

LENGTH = 4096
#: Segments of one sequence at most; attention masks are made of them.
SEGMENTS = 512
#: Loss-bearing tokens of one sequence at most.
LOSS_TOKENS = LENGTH
#: The id put after each document.
END = 2
#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 1 << 20
#: Characters of text whose words are looked up at once.
BLOCK_CHARS = 400_000
#: Words whose ids a task remembers (about 50 bytes each); it begins anew when they are more.
MEMORY = 1_000_000
#: Words that lower-casing and composing treat letter by letter, so that Python's str.lower will do.
_LATIN = re.compile("[!-~\xa1-\xac\xae-\xb4\xb6-\xff]+")
#: How the tokenizer splits a word (its pattern, for words of the letters above).
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}
#: Each character's UTF-8 bytes as byte-level tokenizers write them; the blank between pre-tokens stays.
_BYTE_LETTERS = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(256) if c != 32}


def _firsts(hashes: np.ndarray) -> np.ndarray:
    """Where each distinct pair of hashes comes first."""
    order = np.lexsort(hashes[::-1])
    some = hashes[:, order]
    return order[np.r_[True, (some[:, 1:] != some[:, :-1]).any(0)]] if len(order) else order


class WordEncoder:
    """Ids of texts by a tokenizer that splits at white space before all else, with words' ids remembered.

    For word_bpe_49k.json a text's ids are its words' ids, one after the other: normalising and splitting cross no
    white space. Words are looked up by a 128-bit hash, a block of texts at a time, in an open-addressing table in
    numpy; ids lie in one array. New words of Latin letters are split here and go to the BPE model in a few calls;
    others, and those that may hold a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self.bare.encode(_BYTE_LETTERS[10], add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        """Drops all words; the tokenizer stays."""
        self.size = 1024
        self.keys, self.places = np.zeros((2, self.size), np.uint64), np.zeros(self.size, np.int32)
        self.starts, self.lengths, self.words = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word with each pair of hashes, or -1."""
        out = np.full(hashes.shape[1], -1, np.int32)
        open_, at = np.arange(len(out)), (hashes[0] & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            key = self.keys[0, at]
            hit = (key == hashes[0, open_]) & (self.keys[1, at] == hashes[1, open_])
            out[open_[hit]] = self.places[at[hit]]
            on = ~hit & (key != 0)
            open_, at = open_[on], (at[on] + 1) & (self.size - 1)
        return out

    def _insert(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct new words."""
        n = hashes.shape[1]
        while self.words + n > len(self.starts):
            self.starts, self.lengths = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.lengths, np.zeros_like(self.lengths)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[self.words : self.words + n] = lengths
        self.starts[self.words : self.words + n] = self.used + np.cumsum(lengths) - lengths
        if 2 * (self.words + n) > self.size:  # at most half of the places are taken
            taken = np.flatnonzero(self.keys[0])
            keys, places = self.keys[:, taken], self.places[taken]
            self.size = 1 << (2 * (self.words + n) - 1).bit_length()
            self.keys, self.places = np.zeros((2, self.size), np.uint64), np.zeros(self.size, np.int32)
            self._place(keys, places)
        self._place(hashes, np.arange(self.words, self.words + n, dtype=np.int32))
        self.words += n
        self.used += len(ids)

    def _place(self, hashes: np.ndarray, words: np.ndarray) -> None:
        """Puts numbers of words that the table doesn't have into it."""
        open_, at = np.arange(len(words)), (hashes[0] & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(self.keys[0, at] == 0)
            free = free[np.unique(at[free], return_index=True)[1]]  # of words that want one place the first gets it
            won = np.zeros(len(open_), bool)
            won[free] = True
            self.keys[:, at[free]] = hashes[:, open_[free]]
            self.places[at[free]] = words[open_[free]]
            open_, at = open_[~won], (at[~won] + 1) & (self.size - 1)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of the words, one after the other, their numbers of ids, and in which order the words come."""
        plain = [k for k, w in enumerate(words) if ((w.isascii() and w.isprintable()) or _LATIN.fullmatch(w)) and "<|" not in w]
        ids, lengths = [], []
        for a in range(0, len(plain), 20_000):
            some = [words[k] for k in plain[a : a + 20_000]]
            # one pass over all words: their pre-tokens and the ends of words, blanks between, in the tokenizer's letters
            split = " ".join(_PRE_TOKENS.findall("\n".join(some).lower())).translate(_BYTE_LETTERS) + f" {_BYTE_LETTERS[10]}"
            lines, at = [], 0
            while at < len(split):
                cut = split.find(f"{_BYTE_LETTERS[10]} ", at + 2000)
                lines.append(split[at : cut + 1] if cut >= 0 else split[at:])
                at = cut + 2 if cut >= 0 else len(split)
            got = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
            ends = np.flatnonzero(got == self.mark[0])
            if len(self.mark) != 1 or len(ends) != len(some):
                raise ValueError("this tokenizer doesn't keep words apart")
            ids.append(got[got != self.mark[0]])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        known = set(plain)
        others = [k for k in range(len(words)) if k not in known]
        if others:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), "<u4"))
            lengths.append(np.array([len(x) for x in got], np.int64))
        return np.concatenate(ids), np.concatenate(lengths), plain + others

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and each text's bounds in them; nulls are empty."""
        data, offsets = buffers(texts)
        hashes, starts, ends = hashed_words(data, offsets, EXACT, hashes=2)
        hashes[0, hashes[0] == 0] = 1
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first = missing[_firsts(hashes[:, missing])]
            if self.words + len(first) > self.memory:
                missing, first = np.arange(hashes.shape[1]), _firsts(hashes)
                self.memory = max(self.memory, len(first))
                self.forget()
            raw = data.tobytes()
            ids, lengths, order = self._learn([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            self._insert(hashes[:, first[order]], ids, lengths)
            found[missing] = self._find(hashes[:, missing])
        lengths = self.lengths[found].astype(np.int64)
        upto = np.r_[0, np.cumsum(lengths)]
        at = np.repeat(self.starts[found] - upto[:-1], lengths) + np.arange(upto[-1])
        return self.ids[at], upto[np.searchsorted(starts, offsets)]


@dataclass(frozen=True)
class Limits:
    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LOSS_TOKENS


def pack(lengths: np.ndarray, losses: np.ndarray, limits: Limits = Limits()) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; lengths and loss-bearing tokens of the items are given.

    Loss-bearing tokens are an item's last ones (a prompt comes first), so a piece's demand follows from where it is cut.
    Every token lies in exactly one piece, offsets are gapless from 0, sequences count from 0. No items: nothing.
    Items without tokens give no piece. Ties go to the longer piece, then to the earlier item.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    prompt = np.asarray(lengths, np.int64) - np.asarray(losses, np.int64)
    # what remains of each item, by length: a bucket a length keeps the search for the best fit to the lengths in use
    rest: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def loss_of(item: int, start: int, n: int) -> int:
        return int(max(0, start + n - max(start, prompt[item])))

    def put_back(item: int, start: int) -> None:
        n = int(lengths[item]) - start
        if n > 0:
            rest.setdefault((n, loss_of(item, start, n)), []).append((item, start))

    for item, n in enumerate(lengths):
        start = 0
        while n - start >= limits.tokens and loss_of(item, start, limits.tokens) <= limits.loss:
            pieces.append((item, start, limits.tokens, sequence, 0))
            sequence, start = sequence + 1, start + limits.tokens
        put_back(item, start)
    for waiting in rest.values():
        waiting.reverse()
    kinds = np.array(sorted(rest, reverse=True), np.int64).reshape(-1, 2)
    counts = np.array([len(rest[tuple(k)]) for k in kinds.tolist()], np.int64)
    scale = np.array([limits.tokens, max(limits.loss, 1)], float)
    demand = np.c_[kinds / scale, np.full(len(kinds), 1 / limits.segments)]
    left, offset = np.array([limits.tokens, limits.loss, limits.segments], np.int64), 0
    started: tuple[int, int] | None = None  # an item that was cut: its rest opens the next sequence
    while counts.any() or started:
        if started:
            item, start = started
            n = min(int(lengths[item]) - start, int(left[0]))
            while loss_of(item, start, n) > left[1]:
                n -= loss_of(item, start, n) - int(left[1])
            started = None
        else:
            fits = (counts > 0) & (kinds[:, 0] <= left[0]) & (kinds[:, 1] <= left[1])
            if fits.any():
                value = np.where(fits, demand @ (left[[0, 1, 2]] / [scale[0], scale[1], limits.segments]), -1.0)
                k = int(value.argmax())
            else:
                k = int(np.flatnonzero(counts > 0)[-1])  # the shortest is cut: what remains of it is short as well
            counts[k] -= 1
            item, start = rest[tuple(kinds[k].tolist())].pop()
            n = min(int(lengths[item]) - start, int(left[0]))
            while n and loss_of(item, start, n) > left[1]:
                n -= loss_of(item, start, n) - int(left[1])
        if n:
            pieces.append((item, start, n, sequence, offset))
            offset += n
            left -= [n, loss_of(item, start, n), 1]
        if start + n < lengths[item]:
            started = (item, start + n)
        if left[0] == 0 or left[2] == 0 or started or (left[1] == 0 and counts.any()):
            sequence, offset, left = sequence + 1, 0, np.array([limits.tokens, limits.loss, limits.segments], np.int64)
    if offset:  # the last one, in powers of two
        tail = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(tail) :]
        room, at = 1 << (offset.bit_length() - 1), 0
        for item, start, n, _, _ in tail:
            while n:
                take = min(n, room - at)
                pieces.append((item, start, take, sequence, at))
                start, n, at, offset = start + take, n - take, at + take, offset - take
                if at == room and offset:
                    sequence, room, at = sequence + 1, 1 << (offset.bit_length() - 1), 0
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece_ids binary"


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), with_ids: bool = True, loss_from: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and piece_ids if with_ids.

    A document's ids are the tokenizer's, then END; a null or empty text is END alone. loss_from names a column with
    the number of a document's first tokens that bear no loss (a prompt; null: none); without it all tokens bear loss.
    sequence_id is unique: it holds the task's number above the sequence's within the task. Rows that repeat are packed
    each. An empty table gives an empty result; other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordEncoder, path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        held: list[tuple[int | None, bytes, int]] = []
        size = 0

        def send() -> pa.RecordBatch:
            nonlocal base
            lengths = np.array([len(ids) // 4 for _, ids, _ in held], np.int64)
            losses = lengths - np.minimum(lengths, [skip for _, _, skip in held])
            rows = pack(lengths, losses, limits)
            parts = [memoryview(held[i][1])[4 * a : 4 * (a + n)] for i, a, n, _, _ in rows]
            columns = [
                pa.array([held[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([int(lengths[r[0]]) for r in rows], pa.int64()),
                pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                pa.array([bytes(p) if with_ids else None for p in parts], pa.binary()),
            ]
            base += rows[-1][3] + 1
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_ids"])

        end = np.array([END], "<u4").tobytes()
        for batch in text_blocks(batches, chars=BLOCK_CHARS):
            skips = batch.column("skip").to_pylist()
            encoded, bounds = encoder.encode(batch.column("text"))
            bounds = bounds.tolist()
            for k, (i, skip) in enumerate(zip(batch.column("doc_id").to_pylist(), skips, strict=True)):
                ids = encoded[bounds[k] : bounds[k + 1]].tobytes() + end
                held.append((i, ids, max(0, skip or 0)))
                size += len(ids) // 4
                if size >= GROUP_TOKENS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()
        held, encoded = [], None
        encoder.forget()  # the worker goes on to other stages
        release_memory()

    skip = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", skip.alias("skip")).mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("piece_ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
