"""Statistics of one document, from its UTF-8 bytes: shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

_white = b"\x20\x09\x0a\x0b\x0c\x0d"
CLASSES = ("other", "white", "lower", "upper", "digit", "symbol", "mark", "pipe", "stop", "comma", "rest", "within")
_class = np.zeros(256, np.uint8)
_class[list(_white)] = 1
_class[97:123], _class[65:91], _class[48:58] = 2, 3, 4
for _c in b"#*$%&<>":
    _class[_c] = 5
_class[ord("!")], _class[ord("|")], _class[ord(".")], _class[ord(",")] = 6, 7, 8, 9
_class[128:] = 10  # the first byte of a character beyond ASCII
_class[128:192] = 11  # bytes within a character


def repeated_words(ids: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more, first included."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    mark = np.zeros(len(ids), bool)
    mark[:-2] |= again
    mark[1:-1] |= again
    mark[2:] |= again
    return int(mark.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip(_white)]
    return len(lines), len(lines) - len(set(lines))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "longest_word", "symbol_share", "mark_share", "pipe_share", "upper_share", "digit_share", "beyond_ascii_share", "full_stops", "commas", "dup_line_share", "repeat_word_share", "distinct_word_share", "words_a_line", "short_word_share", "log_lines")


def statistics(text: bytes) -> tuple[list[int], list[float], list[bytes]]:
    """(BASE counts, FEATURES, words). Words are split at ASCII white space; no division is by zero, so empty texts have zeros."""
    words = text.split()
    n = len(words)
    counts = np.bincount(_class[np.frombuffer(text, np.uint8)], minlength=len(CLASSES)).tolist()
    chars = len(text) - counts[11]
    in_words = chars - counts[1]
    lines, dup = duplicate_lines(text)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    again = repeated_words(ids)
    base = [n, in_words, counts[5] + counts[7], dup, again]
    share = lambda x: x / max(in_words, 1)
    features = [np.log1p(n), in_words / max(n, 1), np.log1p(max(map(len, words), default=0)), share(counts[5]), share(counts[6]), share(counts[7]), share(counts[3]), share(counts[4]), share(counts[10]), counts[8] / max(n, 1), counts[9] / max(n, 1), dup / max(lines, 1), again / max(n, 1), len(number) / max(n, 1), np.log1p(n / max(lines, 1)), sum(len(w) <= 3 for w in words) / max(n, 1), np.log1p(lines)]
    return base, features, words
