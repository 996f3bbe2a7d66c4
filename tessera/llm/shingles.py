"""Sets of hashed word shingles, a block of texts at a time, in numpy.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR after lower-casing A-Z. A text's set holds its
distinct 5-word shingles; with fewer words the whole word sequence is its one element; without words it is empty.

Words are hashed eight bytes at a time: each piece is mixed with its place, and the mixed pieces are added up. Two such
hashes with different keys make 128 bits. Shingles are 64-bit hashes: two different shingles of one pair of texts meet
with a chance of about n * m / 2**64. In sets so small that one such meeting could make a link, a second hash tells them
apart (see SMALL).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
#: In sets of fewer elements one wrong meeting of hashes could make a link (6 of 7 and 1 more: 6 / 8 is 75 %).
SMALL = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Every byte for itself.
EXACT = np.arange(256, dtype=np.uint8)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: Of each of the two hashes: what a piece is added to before it is mixed, and the step from one piece's place to the next.
_KEYS = np.random.default_rng(20).integers(1, 1 << 63, (2, 2), dtype=np.uint64) | np.uint64(1)
_MULTIPLIERS = np.random.default_rng(21).integers(1, 1 << 63, (2, WORDS), dtype=np.uint64) | np.uint64(1)
#: The bytes of a piece that belong to a word, by how many they are.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each text's bounds in them; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of each text begins and ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _LOWER, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of every word of every text (a row for each of one or two hashes), and where each word begins and ends.

    `letters` says which bytes count as equal; it keeps separators as they are.
    """
    starts, ends = word_bounds(data, offsets)
    return hashed_spans(data, starts, ends, letters, hashes), starts, ends


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = EXACT, hashes: int = 1) -> np.ndarray:
    """The hashes of the bytes from each start to its end, none of them empty; a row for each of one or two hashes."""
    if not len(starts):
        return np.zeros((hashes, 0), np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = letters[data]
    at_byte = np.ndarray(len(data), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    one = at_byte[starts] & _MASKS[np.minimum(lengths, 8)]
    long_ = np.flatnonzero(pieces > 1)
    if len(long_):  # words of more than one piece: all pieces but the first
        more = pieces[long_] - 1
        word = np.repeat(long_, more)
        place = np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more) + 1
        rest = at_byte[starts[word] + 8 * place] & _MASKS[np.minimum(lengths[word] - 8 * place, 8)]
        firsts = np.cumsum(more) - more
    out = np.empty((hashes, len(starts)), np.uint64)
    for k, (key, step) in enumerate(_KEYS[:hashes]):
        sums = mix(one + key)
        if len(long_):
            sums[long_] += np.add.reduceat(mix(mix(rest + key) + place.astype(np.uint64) * step), firsts)
        out[k] = mix(sums + lengths.astype(np.uint64) * step)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first hash of every word of every text, and each text's bounds among the words."""
    hashes, starts, _ = hashed_words(data, offsets)
    return hashes[0], np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """The sorted distinct shingle hashes of each text; and for sets under SMALL, a sum over their second hashes (else 0)."""
    data, offsets = buffers(texts)
    hashed, starts, _ = hashed_words(data, offsets, hashes=2)
    bounds = np.searchsorted(starts, offsets)
    n = hashed.shape[1] - WORDS + 1
    rolled = np.zeros((2, max(n, 0)), np.uint64)
    for k in range(WORDS):
        if n > 0:
            rolled += hashed[:, k : k + n] * _MULTIPLIERS[:, k, None]
    rolled = mix(rolled)
    sets, seconds = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        second = 0
        if b - a >= WORDS:
            one = np.sort(rolled[0, a : b - WORDS + 1])
            fresh = np.empty(len(one), bool)
            fresh[0] = True
            np.not_equal(one[1:], one[:-1], out=fresh[1:])
            one = one[fresh]
            if len(one) < SMALL:
                second = int(np.unique(rolled[1, a : b - WORDS + 1]).sum())
        elif b > a:
            one, other = mix((hashed[:, a:b] * _MULTIPLIERS[:, : b - a]).sum(1, keepdims=True) + np.uint64(b - a))
            second = int(other[0])
        else:
            one = np.zeros(0, np.uint64)
        sets.append(one)
        seconds.append(second)
    return sets, seconds
