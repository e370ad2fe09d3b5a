"""Token counts by a count-only Viterbi search: an Aho-Corasick automaton lists the vocabulary's matches, and
the search carries the best score and its number of pieces over a window of the longest piece's length."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_pandas
from tessera.llm.sentencepiece_codec import VOCABULARY, first_cut
from tessera.llm.unigram import CACHED_CHARS, CACHED_UNITS, NONE, Vocabulary, marked

#: Characters of the parts in which a long text is read.
PART = 1 << 18


class Counter:
    """Counts the ids of a text without making them; units are cached within a bound."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        self.matches = ahocorasick.Automaton()
        for text, (_, score) in v.pieces.items():
            self.matches.add_word(text, (len(text), score))
        self.matches.make_automaton()
        self.spelled = bool(v.byte_ids)
        self.cut = re.compile(v.units).findall
        self.known: dict[str, int] = {}

    def search(self, unit: str) -> int:
        """The number of ids of the best path.

        The automaton lists the matches that end at a place from the longest to the shortest, so that with a
        strict comparison the one that starts first wins a tie, as in the tokenizer.
        """
        n, unknown = len(unit), self.v.unknown_score
        best, count = [0.0] + [NONE] * n, [0] * (n + 1)
        found = self.matches.iter(unit)
        end, match = next(found, (n, None))
        for e in range(n):
            top, pieces, single = NONE, 0, False
            while end == e:
                length, score = match
                if best[e + 1 - length] + score > top:
                    top, pieces = best[e + 1 - length] + score, count[e + 1 - length] + 1
                single = single or length == 1
                end, match = next(found, (n, None))
            if not single and best[e] + unknown > top:
                top = best[e] + unknown
                pieces = count[e] + (len(unit[e].encode("utf-8", "surrogatepass")) if self.spelled else 1)
            best[e + 1], count[e + 1] = top, pieces
        return count[n]

    def search_long(self, unit: str) -> int:
        """search, with best scores and counts of the last places only, as many as the longest piece has."""
        width, unknown = self.v.longest + 1, self.v.unknown_score
        best, count = [0.0] + [NONE] * (width - 1), [0] * width
        found = self.matches.iter(unit)
        end, match = next(found, (len(unit), None))
        for e, char in enumerate(unit):
            top, pieces, single = NONE, 0, False
            while end == e:
                length, score = match
                at = (e + 1 - length) % width
                if best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
                single = single or length == 1
                end, match = next(found, (len(unit), None))
            at = e % width
            if not single and best[at] + unknown > top:
                top = best[at] + unknown
                pieces = count[at] + (len(char.encode("utf-8", "surrogatepass")) if self.spelled else 1)
            best[(e + 1) % width], count[(e + 1) % width] = top, pieces
        return count[len(unit) % width]

    def count(self, text: str | None) -> int:
        """The number of ids; a long text is read in parts that end where no piece spans."""
        searched, total, at = marked(text), 0, 0
        while at < len(searched):
            stop = len(searched)
            if stop - at > PART:
                cut = first_cut(searched, at + PART, stop)
                stop = cut if cut >= 0 else stop
            total += self._part(searched[at:stop])
            at = stop
        return total

    def _part(self, searched: str) -> int:
        total, known = 0, self.known
        for unit in self.cut(searched):
            n = known.get(unit)
            if n is None:
                n = self.search(unit) if len(unit) <= PART else self.search_long(unit)
                if len(unit) <= CACHED_CHARS:
                    if len(known) >= CACHED_UNITS:
                        known.clear()
                    known[unit] = n
            total += n
        return total


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, n_tokens (as many as sentencepiece_codec.encode gives ids).

    Null and empty texts have 0 of both; repeated rows are each counted; an empty table gives an empty
    result; other columns are not read. Besides the text itself, memory is bounded by PART.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # bounded by the vocabulary file
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(vocabulary.value)
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_chars": [len(t or "") for t in pdf["text"]],
                    "n_tokens": [counter.count(t) for t in pdf["text"]],
                }
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(map_pandas, run, f"doc_id {kind}, n_chars long, n_tokens long")
