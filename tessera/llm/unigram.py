"""A unigram vocabulary, and the best segmentation by it.

The score of a segmentation is the sum of its pieces' log-probabilities. A unigram model file gives them, and they
are taken as they are: numbers of single precision, whose sums are exact here (in double precision). The library adds in
single precision, so that of segmentations whose sums differ by less than its rounding it may take another. A file of
another kind has none (its scores are merge ranks), so that its pieces, which stand in order of frequency, get those of
Zipf's law by their place, in steps of 1 / STEPS; as_unigram writes the same model for the tokenizer library, which adds
such steps exactly up to some 200,000 pieces a text and whose ids are equal text by text.

Of a file's normaliser only the space mark in front and for spaces is known; a unigram file with another one, or with
pieces that its user defined, is refused.

Ties go as in the library: of the pieces that end at one place the one that starts first wins. A character that
is no piece counts as unknown, 10 below the smallest score, and is written as its bytes where the vocabulary
has byte pieces.

No piece has the space mark behind another character, so that a cut before every space mark that follows
another character never changes the result: a text falls into units that are searched on their own. The
same holds for both sides of line breaks and tabs, if no piece has them.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
ALONE = "\n\t\r"
CACHED_UNITS = 150_000
CACHED_CHARS = 64
#: So many characters of texts are cut into units at a time, and so many unknown units searched in one go or, if fewer, each by itself.
GROUP_CHARS, SIDE_BY_SIDE, FEW = 1 << 19, 16_384, 32
NONE = float("-inf")
#: The scores of Zipf's law are multiples of 1 / STEPS.
STEPS = 8
#: What is added to a place in Zipf's law.
OFFSET = 2.7
UNIGRAM, NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 1, 2, 3, 4, 5, 6  # fixed values of the model format


def as_unigram(path: str):
    """The model file as a unigram model of the library's format: as it is, or with scores by Zipf's law."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type == UNIGRAM:
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("the model normalises texts in a way that is not known here")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("the model has pieces that its user defined")
        return model
    normal = [p for p in model.pieces if p.type == NORMAL]
    weights = [1 / (place + OFFSET) for place in range(1, len(normal) + 1)]
    total = sum(weights)
    for p, weight in zip(normal, weights, strict=True):
        p.score = round(math.log(weight / total) * STEPS) / STEPS
    model.trainer_spec.model_type = UNIGRAM
    return model


@dataclass(frozen=True)
class Vocabulary:
    """pieces: text -> (id, score) of what the search may use; texts: of every id; bytes_of: ids of byte pieces."""

    pieces: dict[str, tuple[int, float]]
    texts: list[str]
    byte_ids: dict[int, int]
    unknown_id: int
    unknown_score: float
    longest: int
    digest: str
    units: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        model = as_unigram(path)
        texts = [p.piece for p in model.pieces]
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type not in (UNKNOWN, CONTROL, UNUSED, BYTE)}
        if any(SPACE in t.lstrip(SPACE) for t in pieces):
            raise ValueError("a piece has the space mark behind another character")
        return Vocabulary(
            pieces=pieces,
            texts=texts,
            byte_ids={int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE},
            unknown_id=next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN),
            unknown_score=min(s for _, s in pieces.values()) - UNKNOWN_PENALTY,
            longest=max(map(len, pieces)),
            digest=hashlib.sha256(model.SerializeToString()).hexdigest(),
            units=unit_pattern(pieces),
        )

    def spell(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        if not self.byte_ids:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


def unit_pattern(pieces) -> str:
    """A pattern that cuts a text into units which no piece spans."""
    held = {c for p in pieces for c in p}
    alone = re.escape("".join(c for c in ALONE if c not in held))
    return f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")


def marked(text: str | None) -> str:
    """The text as it is searched: a space mark in front, and for every space; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def trace(text: str, back: list[int], end: int, v: Vocabulary) -> tuple[int, list[int]]:
    """Where the path to end entered (back is -1 there), and its ids."""
    ids: list[int] = []
    while end > 0 and back[end] >= 0:
        piece = text[back[end] : end]
        found = v.pieces.get(piece)
        ids.extend(reversed([found[0]] if found else v.spell(piece)))
        end = back[end]
    return end, ids[::-1]


class Trie:
    """The pieces as a tree: its edges are looked up for many characters at once, by exact (node, character) keys."""

    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        chars = {c: i for i, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        self.width = len(chars) + 1
        self.index = np.zeros(0x110000, dtype=np.int32)
        self.index[[ord(c) for c in chars]] = list(chars.values())
        edges: dict[int, int] = {}
        ids, scores = [-1], [0.0]
        for text, (i, score) in pieces.items():
            at = 0
            for c in text:
                key = at * self.width + chars[c]
                at = edges.get(key, 0)
                if not at:
                    at = edges[key] = len(ids)
                    ids.append(-1)
                    scores.append(0.0)
            ids[at], scores[at] = i, score
        self.ids, self.scores = np.array(ids, dtype=np.int32), np.array(scores)
        bits = (4 * len(edges)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        key, node = np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.nodes[slot[free]] = key[free], node[free]
            key, node, slot = (np.delete(x, free) for x in (key, node, slot))
            slot = (slot + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self._SPREAD) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to; 0 where there is none."""
        key = node.astype(np.int64) * self.width + char
        slot = self._slot(key)
        held, out = self.keys[slot], self.nodes[slot]
        off = np.flatnonzero((held != key) & (held >= 0))
        while len(off):
            slot[off] = next_ = (slot[off] + 1) & self.mask
            held, out[off] = self.keys[next_], self.nodes[next_]
            off = off[(held != key[off]) & (held >= 0)]
        return out


class Units:
    """Searches by the pieces, with a cache of units that is emptied when its bound is reached.

    Many unknown units are searched side by side by the tree, single ones and those with unknown characters by an
    automaton; both give the same.
    """

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        self.matches = ahocorasick.Automaton()
        for text, (i, score) in v.pieces.items():
            self.matches.add_word(text, (len(text), score, i))
        self.matches.make_automaton()
        self.cut = re.compile(v.units).findall
        self.trie = Trie(v.pieces)
        #: unit -> its ids as 4-byte little-endian numbers
        self.known: dict[str, bytes] = {}
        self.scores: dict[str, float] = {}

    def relax(self, text: str, best: list[float], back: list[int], stop: int) -> None:
        """The forward search from every reached place before stop; pieces may end anywhere in text.

        The automaton lists the matches that end at a place from the longest to the shortest, so that with a
        strict comparison the one that starts first wins a tie, and what best holds already wins over all.
        """
        n, unknown = len(text), self.v.unknown_score
        found = self.matches.iter(text)
        end, match = next(found, (n, None))
        for e in range(n):
            top, came, single = best[e + 1], -1, False
            while end == e:
                length, score, _ = match
                s = e + 1 - length
                if s < stop and best[s] + score > top:
                    top, came = best[s] + score, s
                single = single or length == 1
                end, match = next(found, (n, None))
            if not single and e < stop and best[e] + unknown > top:
                top, came = best[e] + unknown, e
            if came >= 0:
                best[e + 1], back[e + 1] = top, came

    def spelled(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of units, one after another, as 4-byte little-endian numbers."""
        wanted = set().union(*texts)
        missed = wanted.difference(self.known)
        if len(self.known) + len(missed) > CACHED_UNITS:
            self.known.clear()
            missed = wanted
        missed = list(missed)
        self.known.update(zip(missed, self._searched(missed)[0], strict=True))
        out = [b"".join(map(self.known.__getitem__, units)) for units in texts]
        for unit in missed:
            if len(unit) > CACHED_CHARS:
                del self.known[unit]
        return out

    def score(self, units: list[str]) -> float:
        """The sum of the scores of the units' best paths."""
        wanted = set(units)
        missed = wanted.difference(self.scores)
        if len(self.scores) + len(missed) > CACHED_UNITS // 4:
            self.scores.clear()
            missed = wanted
        missed = list(missed)
        self.scores.update(zip(missed, self._searched(missed)[1], strict=True))
        out = sum(map(self.scores.__getitem__, units))
        for unit in missed:
            if len(unit) > CACHED_CHARS:
                del self.scores[unit]
        return out

    def _searched(self, units: list[str]) -> tuple[list[bytes], list[float]]:
        """_search of each of the units: ids as bytes, and scores."""
        ids: list[bytes] = [b""] * len(units)
        scores = [0.0] * len(units)
        alone = [i for i, u in enumerate(units) if len(u) > CACHED_CHARS] if len(units) >= FEW else list(range(len(units)))
        if len(alone) < len(units):
            by = sorted((i for i, u in enumerate(units) if len(u) <= CACHED_CHARS), key=lambda i: -len(units[i]))
            for some in (by[i : i + SIDE_BY_SIDE] for i in range(0, len(by), SIDE_BY_SIDE)):
                for i, spelling, score in zip(some, *self._side_by_side([units[i] for i in some]), strict=True):
                    ids[i], scores[i] = spelling, score
                    if spelling is None:
                        alone.append(i)
        for i in alone:
            found, scores[i] = self._search(units[i])
            ids[i] = np.array(found, dtype="<i4").tobytes()
        return ids, scores

    def _side_by_side(self, units: list[str]) -> tuple[list[bytes | None], list[float]]:
        """_search of units in order of length, the longest first; None for the ids of units with unknown characters.

        All places that end e characters into their unit are settled in one go, by the pieces of each length in turn
        from the shortest: of equal scores the longer piece, which starts first, wins.
        """
        trie, n_units = self.trie, len(units)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=n_units)
        stops = np.cumsum(lengths)
        chars = trie.index[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        n = len(chars)
        unit = np.repeat(np.arange(n_units), lengths)
        left, within = stops[unit] - np.arange(n), np.arange(n) - (stops - lengths)[unit]
        node = trie.child(np.zeros(n, dtype=np.int32), chars)
        single = trie.ids[node]
        step = np.where(single >= 0, trie.scores[node], self.v.unknown_score)
        at = np.flatnonzero((node > 0) & (left > 1))
        node, size, found = node[at], 1, []
        while len(at):
            node = trie.child(node, chars[at + size])
            size += 1
            at, node = at[node > 0], node[node > 0]
            piece = trie.ids[node] >= 0
            found.append((at[piece], node[piece], np.full(int(piece.sum()), size)))
            more = left[at] > size
            at, node = at[more], node[more]
        none = np.zeros(0, dtype=np.int64)
        at, node, size = (np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        longest = self.v.longest + 1
        turn = (within[at] + size) * longest + size
        turn = turn.astype(np.min_scalar_type((CACHED_CHARS + 1) * longest))  # 16 bits are sorted by radix
        by = np.argsort(turn, kind="stable")
        rows = np.bincount(turn)
        turns = np.flatnonzero(rows)
        last = np.cumsum(rows[turns])
        first = last - rows[turns]
        # the place behind the e-th character of a unit is at begin + e
        begin = stops - lengths + np.arange(n_units)
        start, gain, which = (at + unit[at])[by], trie.scores[node[by]], trie.ids[node[by]]
        best, back, piece = np.zeros(n + n_units), np.ones(n + n_units, dtype=np.int64), np.full(n + n_units, -1, dtype=np.int32)
        piece[np.arange(n) + unit + 1] = single
        done = 0
        for turn, a, b in zip([*turns.tolist(), (CACHED_CHARS + 1) * longest], [*first.tolist(), 0], [*last.tolist(), 0], strict=True):
            e, size = divmod(turn, longest)
            while done < min(e, int(lengths[0])):  # the pieces of one character, and unknown ones
                here = int(np.searchsorted(-lengths, -done, side="left"))  # units of more than done characters
                place = begin[:here] + done
                best[place + 1] = best[place] + step[place - np.arange(here)]
                done += 1
            s = start[a:b]
            score = best[s] + gain[a:b]
            wins = np.flatnonzero(score >= best[s + size])
            place = s[wins] + size
            best[place], back[place], piece[place] = score[wins], size, which[a:b][wins]
        end = begin + lengths
        place, live, steps = end, np.arange(n_units), []
        while len(live):
            steps.append((live, piece[place]))
            place = place - back[place]
            more = place > begin[live]
            live, place = live[more], place[more]
        counts = np.bincount(np.concatenate([live for live, _ in steps]), minlength=n_units)
        stops = np.cumsum(counts)
        ids = np.zeros(int(stops[-1]), dtype="<i4")
        for k, (live, pieces) in enumerate(steps, 1):
            ids[stops[live] - k] = pieces
        unknown = set(np.repeat(np.arange(n_units), counts)[ids < 0].tolist())
        data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
        spelt = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in unknown:
            spelt[i] = None
        return spelt, best[end].tolist()

    def _search(self, unit: str) -> tuple[tuple[int, ...], float]:
        """relax and trace in one, for a unit on its own: places are filled in order, so that none is unreached."""
        best, back, piece = [0.0], [0], [-1]
        unknown, at, top, single = self.v.unknown_score, 0, NONE, False
        came = which = -1
        for end, (length, score, i) in self.matches.iter(unit):
            while at < end:  # the place before is complete
                if not single and best[at] + unknown > top:
                    top, came, which = best[at] + unknown, at, -1
                best.append(top)
                back.append(came)
                piece.append(which)
                at, top, single = at + 1, NONE, False
            here = best[end + 1 - length] + score
            if here > top:
                top, came, which = here, end + 1 - length, i
            if length == 1:
                single = True
        n = len(unit)
        while at < n:
            if not single and best[at] + unknown > top:
                top, came, which = best[at] + unknown, at, -1
            best.append(top)
            back.append(came)
            piece.append(which)
            at, top, single = at + 1, NONE, False
        ids: list[int] = []
        while n > 0:
            if piece[n] >= 0:
                ids.append(piece[n])
            else:
                ids.extend(reversed(self.v.spell(unit[n - 1])))
            n = back[n]
        return tuple(reversed(ids)), best[-1]

    def encode(self, searched: str) -> list[int]:
        return np.frombuffer(self.spelled([self.cut(searched)])[0], dtype="<i4").tolist()

    def encode_all(self, searched):
        """The ids of each text, as 4-byte little-endian numbers."""
        held, chars = [], 0
        for text in searched:
            held.append(self.cut(text))
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self.spelled(held)
                held, chars = [], 0
        if held:
            yield from self.spelled(held)


_shared: dict[str, Units] = {}


def shared_units(v: Vocabulary) -> Units:
    """One Units a process and vocabulary, so that its cache outlives a task."""
    found = _shared.get(v.digest)
    if found is None:
        _shared.clear()
        found = _shared[v.digest] = Units(v)
    return found


class Decoder:
    """Ids to texts. Byte pieces below 0x80 are characters of their own; others are read together as UTF-8."""

    def __init__(self, v: Vocabulary):
        self.byte_of = {i: b for b, i in v.byte_ids.items()}
        self.texts = list(v.texts)
        for b, i in v.byte_ids.items():
            if b < 0x80:
                self.texts[i] = chr(b)
        self.high = frozenset(i for b, i in v.byte_ids.items() if b >= 0x80)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: space marks as spaces, without the first space."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
        else:
            out: list[str] = []
            pending = bytearray()
            for i in ids:
                if i in self.high:
                    pending.append(self.byte_of[i])
                    continue
                if pending:
                    out.append(pending.decode("utf-8", "replace"))
                    pending.clear()
                out.append(self.texts[i])
            out.append(pending.decode("utf-8", "replace"))
            text = "".join(out)
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text
