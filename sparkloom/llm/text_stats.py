"""Statistics of a text, each computed from its bytes in a few C calls."""

from __future__ import annotations

import numpy as np

SPACES = b"\t\n\v\f\r "
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_CODE_POINT_OF_WORD = SPACES + _CONTINUATION
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"


def count(text: bytes, these: bytes) -> int:
    return len(text) - len(text.translate(None, these))


def word_chars(text: bytes) -> int:
    """Code points in words."""
    return len(text.translate(None, _NOT_CODE_POINT_OF_WORD))


def lines_with_words(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line and not line.isspace()]


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of 8 words that are found twice or more in the text.

    Windows are compared exactly: pairs of words are numbered, then pairs of pairs, then pairs of those.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    distinct, step = len(number), 1
    while step < window:
        if distinct == len(ids):
            return 0
        keys = ids[: len(ids) - step] * distinct + ids[step:]
        found, ids = np.unique(keys, return_inverse=True)
        distinct, step = len(found), step * 2
    if distinct == len(ids):
        return 0
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge)[:n] > 0).sum())


#: Names of the statistics, in the order of `statistics`.
NAMES = (
    "n_words", "chars_per_word", "symbol_share", "upper_share", "digit_share", "exclaim_per_word", "pipe_per_word",
    "distinct_share", "adjacent_share", "repeat_share", "dup_line_share", "words_per_line", "punct_share", "longest_word",
)


def statistics(text: bytes | None) -> tuple[float, ...]:
    """Shares and means of a text; all 0 for an empty one."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    chars, lines = word_chars(text), lines_with_words(text)
    upper, lower = count(text, _UPPER), count(text, _LOWER)
    return (
        float(n),
        chars / n,
        count(text, SYMBOLS) / chars,
        upper / max(1, upper + lower),
        count(text, _DIGITS) / chars,
        text.count(b"!") / n,
        text.count(b"|") / n,
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        count(text, b".,;:?") / n,
        float(max(map(len, words))),
    )
