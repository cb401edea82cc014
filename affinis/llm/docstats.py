"""Statistics of one document, shared by the two quality operators."""

from __future__ import annotations

import numpy as np

#: Order of the columns of features().
FEATURES = (
    "log_words", "word_length", "symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "bang_ratio", "digit_ratio",
    "stop_ratio", "comma_ratio", "distinct_ratio", "line_words", "pipe_ratio", "short_ratio", "byte_entropy", "wide_ratio",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BREAKS = "\x20\t\n\x0b\x0c\r"


def repeated(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that occur at least twice, the first occurrence included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = len(ids)
    if base == len(words):
        return 0
    code = rank[:m].copy()
    top = base
    for k in range(1, n):
        if top * base >= 2**62:
            values, code = np.unique(code, return_inverse=True)
            top = len(values)
        code = code * base + rank[k : k + m]
        top *= base
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines that have a word and equal an earlier line, and lines that have a word."""
    lines = [x for x in text.split("\n") if x.strip(_BREAKS)]
    return len(lines) - len(set(lines)), len(lines)


def stats(text: str | None) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the values of FEATURES.

    A null text counts as empty; an empty text has zeros throughout.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, _count(raw, SYMBOLS), 0, 0], [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(count[:128].sum() + count[192:].sum() - count[9:14].sum() - count[32])
    symbols = int(count[SYMBOLS].sum())
    dup, lines = duplicate_lines(text)
    again = repeated(words)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    p = count[count > 0] / len(raw)
    shorts = sum(len(w) <= 3 for w in words)
    return [n, chars, symbols, dup, again], [
        np.log1p(n), chars / n, symbols / chars, again / n, dup / lines, upper / max(1, upper + lower), count[33] / n, count[48:58].sum() / chars,
        count[46] / n, count[44] / n, len(set(words)) / n, np.log1p(n / lines), count[124] / n, shorts / n, float(-(p * np.log2(p)).sum()), count[192:].sum() / chars,
    ]


def _count(raw: bytes, symbols: np.ndarray) -> int:
    return sum(raw.count(bytes([x])) for x in symbols)
