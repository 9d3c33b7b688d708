"""Cleaning and tokenizing as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Whitespace class, tag and foreign-character patterns, and the stop
# substrings in the order they are deleted.
TAG = r"<[^>]+>"
BLANKS = "\t\n\x0B\f\r \x1C\x1D\x1E\x1F\x85\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000"
ANY_SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Whitespace and whatever is no Hangul syllable, ASCII letter or digit. Written as ranges: Java takes
# several times as long over the negated class.
FOREIGN = r"[\x00-/:-@\[-`{-\uABFF\uD7A4-\x{10FFFF}]"
STOP_SUBSTRINGS = ("기자", "사진", "연합뉴스", "뉴스", "보도", "오늘", "대한", "에서")
ALPHA_WORD = r"[\p{L}\p{Nl}\p{No}_]+"
# Two classes in a row run in a tight loop where a counted repetition does not.
TERM_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"


def strip_space(col: Column) -> Column:
    """Trim every kind of whitespace, the wide blanks of East Asian text too; only the ends are looked at."""
    return F.btrim(col, F.lit(BLANKS))


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def basic_clean(col: Column) -> Column:
    """Null becomes the empty string, the ends are stripped."""
    return strip_space(blank_if_null(col))


def clean_text(col: Column, whole_word: bool = False) -> Column:
    """Drop tags and foreign characters, squeeze whitespace, delete stop substrings.

    By default the stop substrings go wherever they occur, inside words too, and
    the gaps they leave stay. ``whole_word=True`` deletes only whole words and
    squeezes the gaps.
    """
    text = F.regexp_replace(blank_if_null(col), TAG, " ")
    text = F.trim(F.regexp_replace(text, rf"{FOREIGN}+", " "))
    if whole_word:
        kept = F.filter(F.split(text, " "), lambda w: ~w.isin(*STOP_SUBSTRINGS) & (w != ""))
        return F.array_join(kept, " ")
    return reduce(lambda c, stop: F.replace(c, F.lit(stop), F.lit("")), STOP_SUBSTRINGS, text)


def join_text(title: Column, content: Column) -> Column:
    """Title and content in one stripped string; nulls count as empty."""
    return strip_space(F.concat(blank_if_null(title), F.lit(" "), blank_if_null(content)))


def space_tokens(col: Column) -> Column:
    """Case-sensitive split on whitespace, no empty tokens."""
    return F.filter(F.split(blank_if_null(col), rf"{ANY_SPACE}+"), lambda w: w != "")


def lower_space_tokens(col: Column) -> Column:
    """Lower-cased split on whitespace, for the capped vocabulary."""
    return space_tokens(F.lower(col))


def word_tokens(col: Column, min_len: int = 2, max_len: int = 50) -> Column:
    """Lower-cased runs of letters, kept when the length fits and no ``_`` leads."""
    words = F.regexp_extract_all(F.lower(blank_if_null(col)), F.lit(ALPHA_WORD), F.lit(0))
    return F.filter(words, lambda w: F.length(w).between(min_len, max_len) & ~w.startswith("_"))


def term_words(col: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(blank_if_null(col)), F.lit(TERM_WORD), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """The words followed by every pair of neighbours joined by a blank.

    ``zip_with`` pads the shorter side with null, so the last word pairs with
    nothing; ``concat`` turns that pair into null and it is dropped.
    """
    shifted = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.array_compact(pairs))
