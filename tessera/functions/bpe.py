"""Byte-level BPE from a tokenizer specification given by the caller, as a column function."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces that a worker remembers: with their ids, with their counts.
CACHED, COUNTED = 4096, 1 << 18
#: Pieces that are looked up and counted at once, and the characters from which a text is cut as it is read.
BLOCK, LONG_TEXT = 1 << 17, 1 << 20
#: Bytes up to which pieces are merged side by side, in tables of these widths; longer ones are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
_NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class Bpe:
    """A BPE model with added tokens, isolated regex splits and the byte step."""

    def __init__(self, spec: dict):
        import regex

        model = spec.get("model") or {}
        if model.get("type") != "BPE":
            raise ValueError("only BPE models are read")
        steps = spec.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps]) if steps.get("type") == "Sequence" else [steps]
        self.splits, bytes_step = [], False
        for step in steps:
            kind = step.get("type")
            if kind == "Split" and step.get("behavior") == "Isolated" and not step.get("invert"):
                pattern = step["pattern"]
                self.splits.append(regex.compile(pattern["Regex"] if "Regex" in pattern else regex.escape(pattern["String"])))
            elif kind == "ByteLevel":
                bytes_step = True
                if step.get("add_prefix_space"):
                    raise ValueError("a prefix space is not supported")
                if step.get("use_regex", False):
                    self.splits.append(regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"))
            else:
                raise ValueError(f"unsupported step {kind}")
        if not bytes_step:
            raise ValueError("a ByteLevel step is needed")
        self.vocab = model["vocab"]
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", []))
        self.ranks = {pair: n for n, pair in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.known: dict[str, list[int]] = {}
        self.counted: dict[str, int] = {}
        self._index()

    def _index(self) -> None:
        """Symbols as numbers, a byte's letter as the byte, and the pairs of them as sorted keys."""
        letters = byte_letters()
        self.names = [letters[b] for b in range(256)]
        number = {c: b for b, c in enumerate(self.names)}
        for a, b in self.ranks:
            for name in (a, b, a + b):
                if name not in number:
                    number[name] = len(number)
                    self.names.append(name)
        self.pairs = {(number[a], number[b]): rank for (a, b), rank in self.ranks.items()}
        self.results = np.zeros(max(self.ranks.values(), default=0) + 1, np.int32)
        for (a, b), rank in self.ranks.items():
            self.results[rank] = number[a + b]
        keys = np.fromiter((a * len(self.names) + b for a, b in self.pairs), np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.key_ranks = np.append(np.fromiter(self.pairs.values(), np.int32, len(self.pairs))[order], np.int32(_NONE))
        self.absent = np.array([name not in self.vocab for name in self.names])
        of_bytes = np.arange(256)
        self.byte_ranks = self._ranked(of_bytes[:, None], of_bytes[None, :])

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; _NONE if they don't merge, or one of them is none (-1)."""
        keys = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * len(self.names) + right)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], np.int32(_NONE))

    def _merge(self, data: bytes) -> list[int]:
        """The symbols of a piece: the pair of the lowest rank is merged, the first of them first, as long as there is one."""
        held, after, before = list(data), [*range(1, len(data)), -1], [*range(-1, len(data) - 1)]
        heap = [(rank, i) for i, pair in enumerate(zip(data, data[1:], strict=False)) if (rank := self.pairs.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if held[i] < 0 or j < 0 or self.pairs.get((held[i], held[j])) != rank:
                continue  # one of the two was merged meanwhile
            held[i], held[j] = int(self.results[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := self.pairs.get((held[a], held[b]))) is not None:
                    heapq.heappush(heap, (rank, a))
        held = [x for x in held if x >= 0]
        self._refuse(np.array(held, np.int64))
        return held

    def _refuse(self, symbols: np.ndarray) -> None:
        missing = symbols[self.absent[symbols]]
        if len(missing):
            raise ValueError(f"the vocabulary has no {self.names[missing[0]]!r}")

    def _piece(self, piece: str) -> list[int]:
        if piece in self.known:
            return self.known[piece]
        ids = [self.vocab[self.names[x]] for x in self._merge(piece.encode("utf-8"))]
        if len(self.known) < CACHED:
            self.known[piece] = ids
        return ids

    def _side_by_side(self, data: list[bytes], width: int) -> np.ndarray:
        """How many symbols pieces of at most so many bytes have. Each step merges one pair of every piece that has one."""
        counts = np.fromiter(map(len, data), np.int64, len(data))
        symbols = np.full((len(data), width), -1, np.int32)
        symbols[np.arange(width) < counts[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        ranks = np.full((len(data), width), _NONE, np.int32)
        both = symbols[:, 1:] >= 0
        ranks[:, :-1][both] = self.byte_ranks[symbols[:, :-1][both], symbols[:, 1:][both]]
        rows, places = np.arange(len(data)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            on = best < _NONE
            if not on.all():
                done = symbols[~on]
                self._refuse(done[done >= 0])
                rows, symbols, ranks, at, best = rows[on], symbols[on], ranks[on], at[on], best[on]
            if not len(rows):
                break
            counts[rows] -= 1
            # what stands behind the pair moves up
            source = np.minimum(places + (places > at[:, None]), width - 1)
            each, full = np.arange(len(rows)), symbols[:, -1] >= 0
            symbols, ranks = np.take_along_axis(symbols, source, 1), np.take_along_axis(ranks, source, 1)
            symbols[full, -1] = -1
            symbols[each, at] = self.results[best]
            behind = np.where(at + 1 < width, symbols[each, np.minimum(at + 1, width - 1)], -1)
            ahead = np.where(at > 0, symbols[each, np.maximum(at - 1, 0)], -1)
            ranks[each, at] = self._ranked(symbols[each, at], behind)
            ranks[each[at > 0], at[at > 0] - 1] = self._ranked(ahead, symbols[each, at])[at > 0]
        return counts

    def _counts(self, pieces: list[str]) -> list[int]:
        data = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        counts, low = np.zeros(len(data), np.int64), 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(some):
                counts[some] = self._side_by_side([data[i] for i in some], width)
            low = width
        for i in np.flatnonzero(sizes > low):
            counts[i] = len(self._merge(data[i]))
        return counts.tolist()

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """How many ids encode makes of each text (none of null). Equal pieces are counted once a block, and remembered."""
        texts = list(texts)
        totals, pieces, owners = np.zeros(len(texts), np.int64), [], []

        def settle() -> None:
            missing = list(set(pieces).difference(self.counted))
            self.counted.update(zip(missing, self._counts(missing), strict=True))
            found = np.fromiter(map(self.counted.__getitem__, pieces), np.int64, len(pieces))
            rows, sizes = np.array(owners, np.int64).reshape(-1, 2).T
            np.add.at(totals, rows, np.add.reduceat(found, np.cumsum(sizes) - sizes))
            if len(self.counted) > COUNTED:
                self.counted.clear()
            pieces.clear()
            owners.clear()

        def take(row: int, text: str) -> None:
            for block in self._blocks(text):
                pieces.extend(block)
                owners.append((row, len(block)))
                if len(pieces) >= BLOCK:
                    settle()

        for row, text in enumerate(texts):
            if not isinstance(text, str):
                continue
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                totals[row] += 1
                take(row, text[at : m.start()])
                at = m.end()
            take(row, text[at:])
        if pieces:
            settle()
        return totals.tolist()

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without added tokens, so many at a time."""
        if len(self.splits) == 1 and len(text) < LONG_TEXT and not self.splits[0].groups:
            block = self.splits[0].findall(text)
            if sum(map(len, block)) == len(text) and "" not in block:
                if block:
                    yield block
                return
        pieces = self._pieces(text)
        while block := list(islice(pieces, BLOCK)):
            yield block

    def _pieces(self, text: str) -> Iterator[str]:
        """The pieces of a text without added tokens, one after the other."""
        pieces = iter([text] if text else [])
        for pattern in self.splits:
            pieces = _isolated(pattern, pieces)
        return pieces

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self._plain(text[at : m.start()]) + [self.added[m[0]]]
            at = m.end()
        return ids + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for p in self._pieces(text) for i in self._piece(p)]


def _isolated(pattern, pieces: Iterator[str]) -> Iterator[str]:
    """What matches and what stands between, each as a piece."""
    for p in pieces:
        at = 0
        for m in pattern.finditer(p):
            if m.end() > m.start():
                if m.start() > at:
                    yield p[at : m.start()]
                yield m[0]
                at = m.end()
        if at < len(p):
            yield p[at:]


@lru_cache(maxsize=4)
def _built(text: str) -> Bpe:
    return Bpe(json.loads(text))


def count_tokens(c: Column, spec: dict) -> Column:
    """Exact token counts; the specification goes along with the function and is parsed once a worker."""
    text = json.dumps(spec)
    Bpe(spec)  # a bad specification fails here

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_built(text).count(texts), dtype="int64")

    return count(c)
