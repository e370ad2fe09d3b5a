"""Word shingles of texts as 64-bit hashes, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of the blocks that words are hashed in; masks of the first bytes of a block.
_BLOCK = 8
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(_BLOCK + 1)], dtype=np.uint64)
_KEY = np.uint64(0x2545F4914F6CDD1D)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(1, n), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as longer slices come, for hashes that roll over bytes."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)


def _sums(low: np.ndarray, begins: np.ndarray, ends: np.ndarray, earlier: int = 0) -> np.ndarray:
    """For each run of bytes a sum over its blocks of eight: each block's value and place, spread by mix.

    A block enters by a function that is not linear in its bytes, so that no arrangement of equal parts cancels out.
    earlier: how many blocks of the first run were summed before.
    """
    blocks = (ends - begins + _BLOCK - 1) // _BLOCK
    heads = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    nth = np.arange(int(blocks.sum())) - np.repeat(heads, blocks)
    at = np.repeat(begins, blocks) + _BLOCK * nth
    left = np.minimum(_BLOCK, np.repeat(ends, blocks) - at)
    padded = np.concatenate([low, np.zeros(_BLOCK, dtype=np.uint8)])
    value = np.lib.stride_tricks.sliding_window_view(padded, _BLOCK)[at].view("<u8")[:, 0] & _FIRST[left]
    place = nth.astype(np.uint64)
    if earlier and len(blocks):
        place[: blocks[0]] += np.uint64(earlier)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ mix((place + np.uint64(1)) * _KEY)), dtype=np.uint64)])
    return total[heads + blocks] - total[heads]


def _words(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(lengths.astype(np.uint64) * np.uint64(_BASE)))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, byte offsets, bytes) of runs of rows with about so many bytes; null is empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, offsets[start : stop + 1] - offsets[start], data[offsets[start] : offsets[stop]]
        start = stop


def _long_words(data: np.ndarray, most: int):
    """The word hashes of one text of any length, a bounded part at a time; a word may go on over parts."""
    total, length, rest = np.zeros(1, dtype=np.uint64), 0, np.zeros(0, dtype=np.uint8)  # of a word that is open
    for start in range(0, len(data), most):
        low = np.concatenate([rest, _LOWER[data[start : start + most]]])
        last = start + most >= len(data)
        inside = ~_SPACE[low]
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
        if length and not len(rest) and not (len(begins) and begins[0] == 0):  # the open word ended with the part
            yield _words(total, np.array([length]))
            total, length = np.zeros(1, dtype=np.uint64), 0
        before, rest = length - len(rest), np.zeros(0, dtype=np.uint8)
        goes_on = bool(len(ends)) and ends[-1] == len(low) and not last
        stops = ends.copy()
        if goes_on:  # whole blocks of it now, what is left with the next part
            stops[-1] -= (ends[-1] - begins[-1]) % _BLOCK
            rest = low[stops[-1] :].copy()
        sums = _sums(low, begins, stops, before // _BLOCK if length else 0)
        lengths = ends - begins
        if length and len(begins):
            sums[:1] += total
            lengths[0] += before
        total, length = np.zeros(1, dtype=np.uint64), 0
        if goes_on:
            total, length = sums[-1:].copy(), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        if len(sums):
            yield _words(sums, lengths)


def _shingles(word: np.ndarray, words: int) -> np.ndarray:
    window = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for j in range(words):
        window = window * np.uint64(_BASE) + word[j : j + len(window)]
    return mix(window).view(np.int64)


def _few(word: np.ndarray) -> np.ndarray:
    """The one shingle of fewer words than a shingle has, none of no word."""
    if not len(word):
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(1, dtype=np.uint64)
    for w in word:
        h = h * np.uint64(_BASE) + w
    return mix(h + np.uint64(len(word))).view(np.int64)


def long_set(data: np.ndarray, words: int, most: int = SLICE_BYTES) -> np.ndarray:
    """The set of one text of any length: besides the set itself, memory is bounded by most."""
    kept, pending, tail = np.zeros(0, dtype=np.int64), [], np.zeros(0, dtype=np.uint64)
    seen = 0
    for part in _long_words(data, most):
        seen += len(part)
        word = np.concatenate([tail, part])
        pending.append(np.unique(_shingles(word, words)))
        tail = word[len(word) - min(len(word), words - 1) :]
        if sum(map(len, pending)) > len(kept) + most:
            kept, pending = np.unique(np.concatenate([kept, *pending])), []
    return np.unique(np.concatenate([kept, *pending])) if seen >= words else _few(tail)


def sets(texts: pa.Array, words: int):
    """For each row in order the sorted distinct signed hashes of its shingles of so many words.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; a text with fewer words has
    its whole sequence as its one shingle, a text without any has none.
    """
    for _, offsets, data in text_slices(texts):
        if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
            yield long_set(data, words)
            continue
        low = _LOWER[data]
        inside = ~_SPACE[low]
        n = len(low)
        rows = len(offsets) - 1
        if not n or not inside.any():
            for _ in range(rows):
                yield np.zeros(0, dtype=np.int64)
            continue
        first = np.zeros(n, dtype=bool)
        heads = offsets[:-1][offsets[:-1] < n]
        first[heads] = True
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | first[1:]]))
        after = np.concatenate([~inside[1:] | first[1:], [True]])
        ends = np.flatnonzero(inside & after) + 1
        word = _words(_sums(low, begins, ends), ends - begins)
        at = np.searchsorted(begins, offsets)
        window = _shingles(word, words)
        for r in range(rows):
            a, b = at[r], at[r + 1]
            yield np.unique(window[a : b - words + 1]) if b - a >= words else _few(word[a:b])
