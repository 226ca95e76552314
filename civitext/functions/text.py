"""Text expressions: whitespace, normalizing, tokenizing, sanitizing.

All patterns spell out their character classes, since `\\s` and `\\w` differ
between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 whitespace code points.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_CHARS = r"\p{L}\p{N}_"

# Contractions a word tokenizer cuts in two.
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# Markup and link patterns that rule out a neutral sentence.
BAD_PATTERNS = [
    rf"^redirect(?:[^{WORD_CHARS}]|$)",
    r"\|",
    r"\{\{",
    r"\}\}",
    r"\[\[",
    r"\]\]",
    r"http[s]?://",
    r"www\.",
    r"^talk:",
    r"^category:",
    r"^template:",
    r"^file:",
    r"^user:",
    rf"^name[{WS}]*=",
]

CURLY_QUOTES, STRAIGHT_QUOTES = "’‘“”", "''\"\""
EDGE_QUOTES = " \"'`"


def is_nonblank(text: Column) -> Column:
    """True if anything but whitespace is left; null text is not."""
    return F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def strip(text: Column) -> Column:
    """Cut whitespace, Unicode included, from both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A[{WS}]+", ""), rf"(?<![{WS}])[{WS}]+\z", "")


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends cut."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def letters_only(text: Column) -> Column:
    """Lower-case ASCII letters with single spaces in place of all else."""
    return F.lower(F.trim(F.regexp_replace(text, "[^a-zA-Z]+", " ")))


def straighten(text: Column) -> Column:
    """Curly quotes to straight ones, whitespace squeezed."""
    return squeeze(F.translate(text, CURLY_QUOTES, STRAIGHT_QUOTES))


def letter_words(text: Column, split_contractions: bool = True) -> Column:
    """Words of the letters-only text, contractions cut in two."""
    line = letters_only(text)
    if split_contractions:
        groups = "|".join(f"({a})({b})" for a, b in CONTRACTIONS)
        heads = "".join(f"${2 * i + 1}" for i in range(len(CONTRACTIONS)))
        tails = "".join(f"${2 * i + 2}" for i in range(len(CONTRACTIONS)))
        line = F.regexp_replace(line, rf"\b(?:{groups})\b", f"{heads} {tails}")
    return F.array_remove(F.split(line, " "), "")


def wordpunct(text: Column) -> Column:
    """Lower-case runs of word characters and runs of punctuation."""
    pattern = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{WS}]+"
    return F.regexp_extract_all(F.lower(straighten(text)), F.lit(pattern), 0)


def sanitize_line(text: Column) -> Column:
    """Drop answer prefixes, leading bullets and surrounding quotes."""
    line = straighten(text)
    line = F.regexp_replace(line, r"(?i)^example *\p{Nd}+ *[:\-] *", "")
    line = F.regexp_replace(line, r"(?i)^output *[:\-] *", "")
    line = F.regexp_replace(line, r"^[-*> ]+", "")
    return squeeze(F.btrim(line, F.lit(EDGE_QUOTES)))


def alpha_share(text: Column) -> Column:
    """Share of letters among the characters, 0 for empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return letters / F.greatest(F.length(text), F.lit(1))


def is_good_neutral(text: Column, max_words: int = 20) -> Column:
    """Sentence-like text without markup or links; examples are excluded elsewhere."""
    fits = F.size(words(text)).between(3, max_words)
    bad = "|".join(BAD_PATTERNS)
    return F.coalesce(
        (F.length(text) >= 5)
        & fits
        & ~F.lower(text).rlike(bad)
        & (alpha_share(text) >= 0.55),
        F.lit(False),
    )


def lines_of(text: Column) -> Column:
    """Text cut at newlines, empty lines kept."""
    return F.split(text, "\n")


def sentences_of(text: Column) -> Column:
    """Text cut at whitespace that follows `.`, `!` or `?`."""
    return F.split(text, rf"(?<=[.!?])[{WS}]+")


def ngram_terms(text: Column) -> Column:
    """Words of two or more characters, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD_CHARS}]{{2,}}"), 0)


def with_bigrams(tokens: Column) -> Column:
    """The words followed by the pairs of neighbours joined by a space."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(tokens, pairs)
