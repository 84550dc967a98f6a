"""Exact counts of one text, by whole-buffer operations."""

from __future__ import annotations

import numpy as np

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
MARKS = b"!\"'(),-./:;?@[\\]^_`{}~"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in some ``window``-word run found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    runs, kinds = codes[: n - window + 1], len(numbers)
    for step in range(1, window):
        if kinds > (1 << 62) // len(numbers):  # renumber where the code would not fit
            found, runs = np.unique(runs, return_inverse=True)
            kinds = len(found)
        runs = runs * len(numbers) + codes[step : n - window + 1 + step]
        kinds *= len(numbers)
    _, where, counts = np.unique(runs, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, bool)
    for step in range(window):
        inside[step : n - window + 1 + step] |= twice
    return int(inside.sum())


def facts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, upper, digits, marks."""
    if not text:
        return (0,) * 9
    data = text.encode()
    words = data.split()  # bytes split at exactly the six ASCII blanks
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, DIGITS)),
        len(data) - len(data.translate(None, MARKS)),
    )
