"""Column functions over names, paths and bodies. All stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXACT, PREFIX, CONTAINS, PATH, TEXT, DESCRIPTION = 100, 70, 45, 30, 20, 12
_CJK = (
    "ᄀ-ᇿ⺀-⿟぀-ヿ㄰-㆏ㆠ-ㆿㇰ-ㇿ"
    "㐀-䶿一-鿿ꥠ-꥿가-퟿豈-﫿ｦ-ﾟ"
)


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as the LIKE of the model's store does."""
    return F.translate(c, UPPER, LOWER)


def _fold(q: str) -> str:
    return q.translate(str.maketrans(UPPER, LOWER))


def contains_ci(c: Column, q: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(_fold(q)))


def prefix_ci(c: Column, q: str) -> Column:
    return F.startswith(ascii_lower(c), F.lit(_fold(q)))


def equals_ci(c: Column, q: str) -> Column:
    return ascii_lower(c) == _fold(q)


def match_tier(name: Column, q: str) -> Column:
    """100 for the name itself, 70 for a prefix, 45 inside; null otherwise."""
    return F.when(equals_ci(name, q), EXACT).when(prefix_ci(name, q), PREFIX).when(contains_ci(name, q), CONTAINS)


def identifier_shaped(q: str) -> bool:
    """Whether a query is one identifier that prose would not hold: with _, $, a digit or a lower-upper step."""
    return bool(re.fullmatch(r"[A-Za-z_$][\w$]*", q)) and bool(re.search(r"[_$0-9]|[a-z][A-Z]", q))


def has_identifier(body: Column, name: str) -> Column:
    """The name, in any case, not inside a longer identifier."""
    return F.rlike(body, F.lit(r"(?i)(?<![A-Za-z0-9_$])\Q" + name + r"\E(?![A-Za-z0-9_$])"))


def query_words(q: str) -> list[str]:
    return q.split()


def every_word_at(body: Column, q: str) -> Column:
    """The place (from 1) of the first word if all words occur, else 0. Case-insensitive."""
    low = F.lower(body)
    words = [w.lower() for w in query_words(q)]
    if not words:
        return F.lit(0)
    found = F.instr(low, words[0])
    for w in words[1:]:
        found = F.when(F.contains(low, F.lit(w)), found).otherwise(0)
    return found


def body_weight(body: Column, q: str) -> Column:
    """Characters of the body that are occurrences of the whole query."""
    return (F.length(body) - F.length(F.replace(F.lower(body), F.lit(q.lower()), F.lit("")))).cast("long")


def line_at(body: Column, at: Column) -> Column:
    """The line (from 1) of a place (from 1)."""
    head = F.left(body, at - 1)
    return (1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("long")


def excerpt(body: Column, line: Column, margin: int = 2) -> Column:
    """The lines around a line as "N: text", right-trimmed, joined by newlines."""
    lines = F.split(body, "\n", -1)
    first = F.greatest(F.lit(1), line.cast("int") - margin)
    count = F.least(F.size(lines), line.cast("int") + margin) - first + 1
    numbered = F.transform(
        F.slice(lines, first, count), lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), F.regexp_replace(x, r"\s+$", ""))
    )
    return F.array_join(numbered, "\n")


def body_slice(body: Column, start: Column, end: Column, most: int = 80) -> tuple[Column, Column]:
    """Lines start to end of a body, at most so many, and how many were left out."""
    lines = F.split(body, "\n", -1)
    wanted = F.greatest(F.lit(0), F.least(end, F.size(lines)) - start + 1)
    shown = F.least(wanted, F.lit(most))
    return F.array_join(F.slice(lines, start, shown), "\n"), (wanted - shown).cast("int")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(c, "UTF-16BE")) / 8.0).cast("long")


def hit_cost(*parts: Column, extra: int = 6) -> Column:
    """What a line of an answer costs: its tokens and a surcharge."""
    return estimate_tokens(F.concat_ws(" ", *parts)) + extra


def pad_cjk(c: Column) -> Column:
    """Puts spaces around each CJK character, so that word search finds them."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"([{_CJK}])", " $1 "), r"\s+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_symptom(c: Column) -> Column:
    return F.lower(collapse(c))


def words(c: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least so many characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) >= least)


def _accents() -> tuple[str, str]:
    """Every lower-case letter of the BMP that decomposes into one ASCII letter and marks."""
    accented, plain = [], []
    for code in range(0x80, min(sys.maxunicode, 0x2000)):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(unicodedata.combining(x) for x in parts[1:]):
            accented.append(ch)
            plain.append(parts[0].lower())
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accents()


def search_form(c: Column) -> Column:
    """Lower case without accents, words apart by one space, with a space at both ends."""
    plain = F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def matches_phrases(c: Column, q: str) -> Column:
    """Whether every whitespace word of the query occurs as a phrase of whole words, case and accents aside.

    Each CJK character is a word of its own.
    """
    form = search_form(pad_cjk(c))
    found = F.lit(bool(query_words(q)))
    for w in query_words(q):
        asked = search_form(pad_cjk(F.lit(w)))
        held = F.when(F.trim(asked) == "", False).otherwise(F.contains(form, asked))
        found = found & (F.rlike(F.lower(c), F.lit(_apart(w))) | held if re.fullmatch("[A-Za-z0-9]+", w) else held)
    return found


def _apart(w: str) -> str:
    """A plain word between what is neither letter, digit nor mark: the search form surely has it as a word."""
    return rf"(?<![\p{{L}}\p{{N}}\p{{M}}]){w.lower()}(?![\p{{L}}\p{{N}}\p{{M}}])"


def holds_words(c: Column, q: str) -> Column:
    """Whether every word of the query occurs as it is written, case aside."""
    found = F.lit(bool(query_words(q)))
    for w in query_words(q):
        found = found & F.contains(F.lower(c), F.lit(w.lower()))
    return found


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clamp(c: Column, low: int, high: int, fallback: int) -> Column:
    """Truncated to a whole number within bounds; what is no number becomes the fallback."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double").try_cast("long"), F.lit(fallback)), F.lit(low)), F.lit(high))
