"""Text cleaning and tokenising as native column expressions.

Every function maps Column to Column, so it stays inside the JVM, costs no
shuffle and works the same on a table and on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.constants import MISSING_TEXT, NA_WORDS

# Unicode white space plus the four ASCII separators that Java's \s leaves out.
BLANK = r"\s\x1c-\x1f"
_BLANKS = rf"(?U)[{BLANK}]+"
_NON_WORD = r"[^\p{L}\p{N}_]+"
# Possessive, since nothing follows a word that could give back characters.
_WORDS = r"\.{3}|(?:[a-z]\.){2,}|[0-9a-z]++(?:\.[0-9a-z]++|,[0-9][0-9a-z]*+)*+|[?.,]"
_RULES = {
    "blank": (rf"(?U)[^0-9a-zA-Z{BLANK}?.,]", " "),
    "delete": (rf"(?U)[^0-9a-zA-Z{BLANK}]", ""),
}
# Lower-cased, these two become ASCII letters, all other foreign characters stay foreign.
_FOREIGN_LETTERS = ("\u0130", "\u212a")
_JOINED = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
# Contractions that are read as two words.
_CONTRACTIONS = r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"


def na_to_null(text: Column) -> Column:
    """Missing-value words become NULL; every other text stays as it is."""
    return F.when(text.isin(NA_WORDS), F.lit(None).cast("string")).otherwise(text)


def as_text(text: Column) -> Column:
    """NULL reads as the word ``nan``, as a cast of a missing value does."""
    return F.coalesce(text.cast("string"), F.lit(MISSING_TEXT))


def is_decodable(text: Column) -> Column:
    """True for valid UTF-8; a missing text is decodable."""
    return text.isNull() | F.is_valid_utf8(text)


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^[{BLANK}]+", ""), rf"(?U)[{BLANK}]+$", "")


def folded(text: Column) -> Column:
    """Lower case, missing as the word ``nan``: what edit distances compare."""
    return F.lower(as_text(text))


def clean_tfidf(text: Column) -> Column:
    """Lower-case, missing to empty, each run of non-word characters to one blank."""
    return _clean_folded(folded(text), F.octet_length(as_text(text)))


def _clean_folded(low: Column, size: Column) -> Column:
    # Only ASCII letters become those of the missing word, so other sizes need no lower case for this.
    missing = (size == len(MISSING_TEXT)) & (low == MISSING_TEXT)
    return F.regexp_replace(F.when(missing, F.lit("")).otherwise(low), _NON_WORD, " ")


def _plain(text: Column, rule: str) -> Column:
    """Foreign characters removed by the named rule, then lower case."""
    foreign, instead = _RULES[rule]
    return F.lower(F.regexp_replace(as_text(text), foreign, instead))


def clean_train(text: Column) -> Column:
    """Each character outside letters, digits, blanks and ``? . ,`` to a blank."""
    return trim_blanks(_plain(text, "blank"))


def clean_test(text: Column) -> Column:
    """Each character outside letters, digits and blanks deleted."""
    return trim_blanks(_plain(text, "delete"))


def split_blanks(text: Column) -> Column:
    """Whitespace tokens, never empty ones."""
    return F.filter(F.split(text, _BLANKS), lambda t: t != "")


def whitespace_tokens(text: Column) -> Column:
    """Raw, case-sensitive whitespace tokens of a text."""
    return split_blanks(as_text(text))


def tfidf_tokens(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return _long_tokens(clean_tfidf(text))


def tfidf_tokens_of_folded(low: Column) -> Column:
    """The same tokens of a text that is ``folded`` already."""
    return _long_tokens(_clean_folded(low, F.octet_length(low)))


def _long_tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: F.length(t) >= 2)


def word_tokens(cleaned: Column) -> Column:
    """Word and punctuation tokens of a cleaned, lower-case text."""
    split = F.regexp_replace(cleaned, _CONTRACTIONS, "$1 ")
    return F.regexp_extract_all(split, F.lit(_WORDS), F.lit(0))


def sequence_tokens(text: Column, rule: str = "blank") -> Column:
    """Clean by the named rule, then word-tokenise; blanks at the ends yield no token.

    Where foreign characters would become blanks they part tokens as they are,
    so a text is rewritten only if it may hold a contraction, or a foreign
    character that is an ASCII letter in lower case.
    """
    rewritten = word_tokens(_plain(text, rule))
    if rule != "blank":
        return rewritten
    raw = as_text(text)
    low = F.lower(raw)
    needed = reduce(Column.__or__, [low.contains(w) for w in _JOINED] + [raw.contains(c) for c in _FOREIGN_LETTERS])
    return F.when(needed, rewritten).otherwise(F.regexp_extract_all(low, F.lit(_WORDS), F.lit(0)))
