"""Text column functions: cleaning, labels, tokens, heuristics, log lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlab import constants as C

_BLANK_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends, in one linear pass."""
    return F.btrim(col, F.lit(C.BLANKS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(C.BLANKS))


def word_count(col: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(col, F.lit(f"[^{_BLANK_CLASS}]+"))


def order_key(id_col: Column, seed: int = C.SEED) -> Column:
    """Seeded shuffle key: a total order (with the id) that any partitioning agrees on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def hash_index(id_col: Column, size: int, seed: int = C.SEED) -> Column:
    """Seeded pseudo-random index in ``0 .. size-1`` that depends on the id alone."""
    digits = F.substring(order_key(id_col, seed), 1, 7)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def normalise_label(col: Column, data_type: str = "string") -> Column:
    """Map a label to {0, 1} by the type of its column."""
    if data_type == "boolean":
        return F.coalesce(col.cast("int"), F.lit(0))
    if data_type in ("double", "float", "tinyint", "smallint", "int", "bigint") or data_type.startswith("decimal"):
        value = col.cast("double")
        truncated_to_one = (value >= 1) & (value < 2)
        return F.when(truncated_to_one, 1).otherwise(0)
    word = F.lower(strip(col.cast("string")))
    return (
        F.when(word.isin(C.POSITIVE_LABELS), 1)
        .when(word.isin(C.NEGATIVE_LABELS), 0)
        .when(word.rlike("|".join(C.POSITIVE_STEMS)), 1)
        .otherwise(0)
    )


def tokens(col: Column) -> Column:
    """Lower-cased word and number tokens, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(C.TOKEN), F.lit(0))


def is_rare(token: Column, common: Sequence[str] = C.COMMON_WORDS) -> Column:
    """A word token outside the common vocabulary; numbers are never rare.

    Word tokens start with an apostrophe or a to z, told by plain comparisons.
    """
    word = ((token >= "a") & (token < "{")) | ((token >= "'") & (token < "("))
    return word & ~token.isin(list(common))


def looks_suspicious(text: Column) -> Column:
    """Non-ASCII characters, letter/digit words or unpronounceable consonant words.

    The non-ASCII test comes first: past it the text is ASCII, so the word boundary
    of the other two patterns means the same on every JDK.
    """
    t = F.lower(text)
    return t.rlike(C.NON_ASCII) | t.rlike(C.LETTER_DIGIT_WORD) | t.rlike(C.CONSONANT_WORD)


def insert_phrase(text: Column, phrase: Column | str) -> Column:
    """Phrase, one blank, text."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(phrase, F.lit(" "), text)


def pool_pick(pool: Sequence[str], index: Column) -> Column:
    """``pool[index]`` for a small literal pool."""
    return F.get(F.array(*[F.lit(p) for p in pool]), index)


def clean_generated(
    raw: Column,
    min_words: int = C.GENERATED_MIN_WORDS,
    max_words: int = C.GENERATED_MAX_WORDS,
) -> Column:
    """First usable sentence of a generated reply, null when none qualifies.

    Keeps what follows the last reasoning block, then strips quotes and leading
    numbering per line, and takes the first line of at least ``min_words`` words.
    A numbered prefix with neither dot nor bracket is left alone.
    """
    body = strip(F.element_at(F.split(raw, "</think>", -1), -1))
    numbered = r"^(?:(?=\p{Nd}(?:[\p{Nd}." + _BLANK_CLASS + r"]|\z))(?:[^.]*+\.)?+(?:[^)]*+\))?+[" + _BLANK_CLASS + "]*+)++"

    def tidy(line: Column) -> Column:
        unquoted = strip(F.btrim(F.btrim(strip(line), F.lit('"')), F.lit("'")))
        return F.regexp_replace(unquoted, numbered, "")

    lines = F.transform(F.split(body, "\n", -1), tidy)
    usable = F.filter(lines, lambda line: word_count(line) >= min_words)
    first = F.get(usable, F.lit(0))
    return F.when(word_count(first) <= max_words, first)


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, C.LOG_ANSI, "")


def _literal(pattern: str) -> str | None:
    """The text a pattern stands for when it has no operator but escapes."""
    if re.search(r"[\\.^$*+?{}\[\]|()]", re.sub(r"\\[^\w\s]", "", pattern)):
        return None
    return re.sub(r"\\([^\w\s])", r"\1", pattern)


def matches_any(col: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    """Whether any pattern occurs.

    Plain alternatives become substring tests, which are many times cheaper than one
    large alternation tried at every position; the rest stay regular expressions.
    """
    alternatives = [a for p in patterns for a in (p.split("|") if "(" not in p else [p])]
    plain = [t for t in map(_literal, alternatives) if t is not None]
    regexes = [a for a in alternatives if _literal(a) is None]
    if ignore_case:
        plain, regexes = [t.lower() for t in plain], ["(?i)" + r for r in regexes]
    words = _with(F.lower(col) if ignore_case else col, lambda t: _any([t.contains(w) for w in plain]))
    return words | _any([col.rlike(r) for r in regexes])


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _with(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test(value)`` with ``value`` evaluated once, however often the test refers to it."""
    return F.exists(F.array(value), test)


def is_noise(line: Column) -> Column:
    """Noise unless a keep pattern matches; colour codes do not count."""
    return _with(
        strip_ansi(line),
        lambda t: matches_any(t, C.LOG_NOISE) & ~matches_any(t, C.LOG_KEEP, ignore_case=True),
    )


def clean_log_line(line: Column) -> Column:
    """Drop colour codes, the worker prefix, the repeat suffix and trailing blanks."""
    body = rstrip(F.regexp_replace(strip_ansi(line), C.LOG_PREFIX, ""))
    return rstrip(F.regexp_replace(body, C.LOG_SUFFIX, ""))
