"""Token counts of documents that are edited: a segment tree of pre-token counts per document.

A leaf holds up to LEAF pre-tokens: their text, and their number of tokens. An inner node holds sums. An edit (replace
code points start to end by a text) touches the leaves that it meets; their text, and one leaf of context on either
side, is split and counted anew, until the new pre-tokens' bounds agree with the old ones again; then the sums on the
paths to the root are updated. All else is neither split nor counted again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.tables import kept, table, text_blocks

#: Pre-tokens of one leaf.
LEAF = 32
#: Pre-tokens whose counts a worker remembers.
MEMORY = 300_000
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: The letter that byte-level vocabularies have for each byte; between words the zero byte's, as a word of its own.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPELT = _LETTERS | {0: f" {_LETTERS[0]} "}


class Counter:
    """Tokens of pre-tokens, remembered. New ones go to the BPE model many at a time, in the tokenizer's byte letters."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.tokenizer, self.memory, self.known = Tokenizer.from_file(path), memory, {}
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = self.bare.encode(_LETTERS[0], add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("not a byte-level vocabulary")

    def learn(self, words: set[str]) -> None:
        """Counts the words that aren't known yet; the zero byte's letter stands between them."""
        new = [w for w in words if w not in self.known]
        if len(self.known) > self.memory:
            self.known, new = {}, list(words)
        odd = [w for w in new if "\0" in w]
        new = [w for w in new if "\0" not in w] if odd else new
        self.known.update({w: len(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in odd})
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            lines = ["\0".join([*some[k : k + 250], ""]).encode().decode("latin-1").translate(_SPELT) for k in range(0, len(some), 250)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)), np.int64)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(some):
                raise RuntimeError("the tokenizer's marks were lost")
            self.known.update(zip(some, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))

    def counts(self, words: list[str]) -> list[int]:
        found = list(map(self.known.get, words))
        if None in found:
            self.learn(set(words))
            found = [self.known[w] for w in words]
        return found


class CountTree:
    """Sums over leaves in an implicit binary tree; a leaf is a list of pre-tokens.

    chars and tokens are segment trees in arrays of twice the leaves' number, rounded up to a power of two.
    """

    def __init__(self, text: str, counter: Counter, words: list[str] | None = None) -> None:
        self.counter = counter
        words = _SPLIT.findall(text) if words is None else words
        counts = counter.counts(words)
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        self._build([sum(counts[i : i + LEAF]) for i in range(0, len(words), LEAF)] or [0])
        self.recounted = 0

    def _build(self, counts: list[int]) -> None:
        n = 1 << (len(self.leaves) - 1).bit_length()
        self.size = n
        rest = [0] * (n - len(self.leaves))
        self.tokens = [0] * n + counts + rest
        self.chars = [0] * n + [sum(map(len, leaf)) for leaf in self.leaves] + rest
        for i in range(n - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (at the text's end: the last), and the code points before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, words: list[str]) -> None:
        self.leaves[leaf] = words
        node = leaf + self.size
        self.tokens[node], self.chars[node] = sum(self.counter.counts(words)), sum(map(len, words))
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the code points from start to end (cut to the text's bounds) by new."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        first, before = self._find(start)
        last = self._find(end)[0]
        while first > 0 and start - before < 2:  # what stands before can change how the pre-token at start is split
            first -= 1
            before -= self.chars[self.size + first]
        if first > 0:
            first -= 1
            before -= self.chars[self.size + first]
        # the piece ends where splitting is sure to agree with the old bounds: after at least one whole leaf of context
        stop = last + 1
        while True:
            stop = min(stop + 1, len(self.leaves))
            body = "".join(w for leaf in self.leaves[first:stop] for w in leaf)
            body = body[: start - before] + new + body[end - before :]
            words = _SPLIT.findall(body)
            if stop == len(self.leaves):
                break
            follower = next((w for leaf in self.leaves[stop:] for w in leaf), "")
            tail = self.leaves[stop - 1][-2:]
            if len(tail) == 2 and words[-2:] == tail and _SPLIT.findall("".join(tail) + follower)[:2] == tail and not (tail[-1].isspace() or follower.isspace()):
                break
        self.recounted += len(body)
        room = stop - first
        share = -(-len(words) // room)
        if share > 2 * LEAF:  # too full: this part's leaves are dealt anew
            self.leaves[first:stop] = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
            counts = self.tokens[self.size : self.size + first], self.tokens[self.size + stop : self.size + stop + len(self.leaves)]
            fresh = [sum(self.counter.counts(leaf)) for leaf in self.leaves[first : first + -(-len(words) // LEAF)]]
            self._build([*counts[0], *fresh, *counts[1][: len(self.leaves) - first - len(fresh)]])
            return
        for i in range(room):
            part = words[i * share : (i + 1) * share] if share else []
            if part != self.leaves[first + i]:
                self._set(first + i, part)


def edits_of(doc_id: int, length: int, edits: int) -> list[tuple[int, int, str]]:
    """The query's edits of a document, from hashes of its id: positions all over the text, of three kinds in turn."""
    out = []
    for k in range(edits):
        h = zlib.crc32(f"{doc_id}:{k}".encode())
        at = h % (length + 1)
        out.append([(at, at, f" added {h % 1000} words,"), (at, at + 1 + h // 7 % 40, ""), (at, at + 9, f"It's {h % 97}%")][k % 3])
    return out


def count_edited(docs: DataFrame, edits: int = 3, tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, tokens_before, tokens_after, chars_after, chars_recounted.

    Each document gets `edits` edits in turn (edits_of). A null or empty text has no tokens before its edits; a null id
    acts as 0. An empty table gives an empty result; other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(Counter, path)
        for batch in text_blocks(batches, chars=1_000_000):
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [_SPLIT.findall(t) for t in texts]
            counter.learn({w for words in split for w in words})
            for i, text, words in zip(batch.column("doc_id").to_pylist(), texts, split, strict=True):
                tree = CountTree(text, counter, words)
                before = tree.total
                for k in range(edits):
                    tree.edit(*edits_of(i or 0, tree.length, edits)[k])
                out.append((before, tree.total, tree.length, tree.recounted))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), pa.int64()) for c in zip(*out, strict=True))], ["doc_id", "tokens_before", "tokens_after", "chars_after", "chars_recounted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens_before long, tokens_after long, chars_after long, chars_recounted long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents"))
